"""Alerting (a design, not a feature in use): states with debounce, cooldown and digests, two-threshold states,
fingerprints, rate caps per rolling window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import sha
from ..functions.let import let


def hysteresis(rows: DataFrame, keys: list[str], at: str, tie: str, enters: Column, leaves: Column) -> DataFrame:
    """``rows`` with ``on``: set where ``enters`` holds, cleared where ``leaves`` does, else as before; ``fires`` where it is newly set."""
    own = Window.partitionBy(*keys).orderBy(at, tie)
    moves = F.when(enters, F.lit(True)).when(leaves, F.lit(False))
    on = F.coalesce(F.last(moves, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False))
    rows = rows.withColumn("on", on)
    return rows.withColumn("fires", F.col("on") & ~F.coalesce(F.lag("on").over(own), F.lit(False)))


def fingerprint(*parts: Column) -> Column:
    return sha(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def capped(alerts: DataFrame, lane: list[str], at: str, tie: str, window_s: int, most: int) -> DataFrame:
    """``alerts`` with ``sent``: fewer than ``most`` came before it in the lane within ``window_s`` seconds; the rest waits for the digest."""
    clock = F.unix_micros(F.col(at).cast("timestamp"))
    recent = Window.partitionBy(*lane).orderBy("_clock").rangeBetween(-window_s * 1_000_000, -1)
    same = Window.partitionBy(*lane, "_clock").orderBy(tie)
    out = alerts.withColumn("_clock", clock)
    earlier = F.coalesce(F.count(F.lit(1)).over(recent), F.lit(0)) + F.row_number().over(same) - 1
    return out.withColumn("sent", earlier < most).drop("_clock")


@dataclass(frozen=True)
class Policy:
    """How alerts are held back: ``polls`` rows in a row that hold before the first; ``cooldown_s`` after one, unless the
    price is better by ``gain`` and by ``gain_share`` of it; ``ttl_s`` of silence after which a key is forgotten."""

    polls: int = 2
    cooldown_s: float = 43_200.0
    gain: float = 10.0
    gain_share: float = 0.05
    ttl_s: float = float(1 << 40)

    def __post_init__(self) -> None:
        if self.ttl_s < self.cooldown_s:
            raise ValueError("a key can't be forgotten before its cooldown has ended")

    @property
    def cooldown_us(self) -> int:
        return int(self.cooldown_s * 1_000_000)

    @property
    def ttl_us(self) -> int:
        return int(self.ttl_s * 1_000_000)


def alert_log(rows: DataFrame, policy: Policy, until: Column | None = None) -> DataFrame:
    """(key, n, at, event, price, waiting): the state after each row, and a digest for each cooldown that had any.

    ``rows``: key, n, at timestamp, price double, enters, leaves. What enters holds until it leaves. A key that holds is
    ``pending`` until it has ``polls`` rows in a row, then ``firing``. In the cooldown after an alert rows that hold are
    ``digested`` (a clearly better price fires at once), others ``cooling``; at its end comes a ``digest`` with the number
    and the best price of the digested. Digests that end after ``until`` (default: the newest row of all) aren't out yet.

    Whether a row alerts depends on the alert before it, so a key's rows are put in order and folded in one expression,
    in one task; a key is one watch and one listing. Repeated rows (key, at, n) count once.
    """
    micros, none = F.unix_micros(F.col("at")), F.lit(None)
    if until is None:
        until = F.lit(rows.agg(F.max(micros)).first()[0]).cast("long")
    else:
        until = F.unix_micros(until)
    one = F.struct(micros.alias("x"), F.col("n").cast("long").alias("n"), F.col("price").cast("double").alias("price"), F.coalesce("enters", F.lit(False)).alias("enters"), F.coalesce("leaves", F.lit(False)).alias("leaves"))
    some = rows.dropDuplicates(["key", "at", "n"]).groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    kind = "array<struct<n:bigint,x:bigint,event:string,price:double,waiting:bigint>>"
    start = F.struct(
        F.lit(0).cast("long").alias("run"), F.lit(False).alias("on"), none.cast("long").alias("alerted"), none.cast("double").alias("price"), F.lit(0).cast("long").alias("waiting"),
        none.cast("double").alias("best"), none.cast("long").alias("last"), F.array().cast(kind).alias("out"),
    )

    def told(n: Column, x: Column, event: Column, price: Column, waiting: Column) -> Column:
        return F.array(F.struct(n.cast("long").alias("n"), x.alias("x"), event.alias("event"), price.alias("price"), waiting.cast("long").alias("waiting")))

    def ended(s: Column, now: Column) -> Column:
        over = F.coalesce(now >= s["alerted"] + policy.cooldown_us, F.lit(False))
        silent = F.coalesce(now - s["last"] > policy.ttl_us, F.lit(False))
        out = F.when(over & (s["waiting"] > 0), F.concat(s["out"], told(none, s["alerted"] + policy.cooldown_us, F.lit("digest"), s["best"], s["waiting"]))).otherwise(s["out"])
        kept = lambda f, empty: F.when(over, empty).otherwise(s[f]).alias(f)
        return F.struct(
            F.when(silent, 0).otherwise(s["run"]).cast("long").alias("run"), F.when(silent, F.lit(False)).otherwise(s["on"]).alias("on"), kept("alerted", none.cast("long")), kept("price", none.cast("double")),
            kept("waiting", F.lit(0).cast("long")), kept("best", none.cast("double")), s["last"].alias("last"), out.alias("out"),
        )

    def step(s: Column, r: Column) -> Column:
        def decided(s: Column) -> Column:
            on = F.when(r["enters"], F.lit(True)).when(r["leaves"], F.lit(False)).otherwise(s["on"])
            run = F.when(on, s["run"] + 1).otherwise(0).cast("long")
            better = F.coalesce(r["price"] <= s["price"] - F.greatest(F.lit(policy.gain), s["price"] * policy.gain_share), F.lit(False))
            event = F.when(~on, F.when(s["alerted"].isNull(), "none").otherwise("cooling")).when(run < policy.polls, "pending").when(s["alerted"].isNull() | better, "firing").otherwise("digested")
            return F.struct(s.alias("s"), on.alias("on"), run.alias("run"), event.alias("event"))

        def moved(d: Column) -> Column:
            s, fires, waits = d["s"], d["event"] == "firing", d["event"] == "digested"
            return F.struct(
                d["run"].alias("run"), d["on"].alias("on"), F.when(fires, r["x"]).otherwise(s["alerted"]).alias("alerted"), F.when(fires, r["price"]).otherwise(s["price"]).alias("price"),
                F.when(waits, s["waiting"] + 1).otherwise(s["waiting"]).alias("waiting"), F.when(waits, F.least(s["best"], r["price"])).otherwise(s["best"]).alias("best"), r["x"].alias("last"),
                F.concat(s["out"], told(r["n"], r["x"], d["event"], r["price"], none)).alias("out"),
            )

        return let(let(ended(s, r["x"]), decided), moved)

    folded = F.aggregate("rows", start, step, lambda s: let(ended(s, until), lambda e: e["out"]))
    out = some.select("key", F.explode(folded).alias("o"))
    return out.select("key", "o.n", F.timestamp_micros("o.x").alias("at"), "o.event", "o.price", "o.waiting")
