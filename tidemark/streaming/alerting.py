"""Alerts and admissions as streams with state that expires: values with event-time timers, maps inside of a key.

These streams need Spark's RocksDB state store; ``stateful_session`` gives a session of its own that uses it, so that the
caller's settings stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import Policy

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Alert state of a key: rows in a row that held, whether it holds, micros and price of the last alert, rows and best
#: price that wait for the digest, micros and number of the last row.
_STATE = "run long, on boolean, alerted long, price double, waiting long, best double, last long, last_n long"
_NONE = (0, False, None, None, 0, None, None, None)
ALERTS = "key string, n long, at timestamp, event string, price double, waiting long"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application for streams of this module."""
    out = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        out.conf.set(name, spark.conf.get(name))
    out.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return out


class _Alerting(StatefulProcessor):
    def __init__(self, policy: Policy) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("alert", _STATE)

    def _due(self, s: tuple, now: int) -> tuple[tuple, list[tuple]]:
        """What has come to its end by ``now``: the cooldown with its digest, then the state of a silent key."""
        run, on, alerted, price, waiting, best, last, last_n = s
        out = []
        if alerted is not None and now >= alerted + self.policy.cooldown_us:
            if waiting:
                out.append((None, alerted + self.policy.cooldown_us, "digest", best, waiting))
            alerted, price, waiting, best = None, None, 0, None
        if last is not None and now - last > self.policy.ttl_us:
            return (0, False, None, None, 0, None, last, last_n), out
        return (run, on, alerted, price, waiting, best, last, last_n), out

    def _step(self, s: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        x, n, cost, enters, leaves = row
        (run, on, alerted, price, waiting, best, _, _), out = self._due(s, x)
        on = True if enters else False if leaves else on
        run = run + 1 if on else 0
        better = alerted is not None and cost is not None and price is not None and cost <= price - max(self.policy.gain, self.policy.gain_share * price)
        if not on:
            event = "none" if alerted is None else "cooling"
        elif run < self.policy.polls:
            event = "pending"
        elif alerted is None or better:
            event, alerted, price = "firing", x, cost
        else:
            event, waiting = "digested", waiting + 1
            best = min((p for p in (best, cost) if p is not None), default=None)
        out.append((n, x, event, cost, None))
        return (run, on, alerted, price, waiting, best, x, n), out

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        at = pd.to_datetime([x for _, x, *_ in out], unit="us", utc=True)
        return pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype=object), "n": pd.array([n for n, *_ in out], "Int64"), "at": at, "event": pd.Series([e for _, _, e, *_ in out], dtype=object), "price": pd.array([p for *_, p, _ in out], "Float64"), "waiting": pd.array([w for *_, w in out], "Int64")})

    def _timers(self, s: tuple) -> None:
        """One timer a key, at the next moment that something ends."""
        ends = [s[2] + self.policy.cooldown_us] if s[2] is not None else []
        ends += [s[6] + self.policy.ttl_us] if s[6] is not None and self.policy.ttl_us < 1 << 60 else []
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if ends:
            self.handle.registerTimer(min(ends) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        s = tuple(self.held.get()) if self.held.exists() else _NONE
        batch = pd.concat(list(rows)).sort_values(["x", "n"], kind="stable")
        out = []
        for x, n, cost, enters, leaves in zip(batch["x"].tolist(), batch["n"].tolist(), batch["price"].tolist(), batch["enters"].tolist(), batch["leaves"].tolist(), strict=True):
            if s[6] is not None and (x, n) <= (s[6], s[7]):
                continue  # played again, or older than what has been decided
            s, more = self._step(s, (x, n, None if cost is None or cost != cost else cost, bool(enters), bool(leaves)))
            out += more
        self.held.update(s)
        self._timers(s)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        s = tuple(self.held.get())
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        s, out = self._due(s, now)
        if now - s[6] > self.policy.ttl_us:
            self.held.clear()
        else:
            self.held.update(s)
            self._timers(s)
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def alert_stream(rows: DataFrame, policy: Policy, late: str = "0 seconds") -> DataFrame:
    """ALERTS by the rules of ``alerts.alert_log``. ``rows`` (streaming, of a ``stateful_session``): key string, n long,
    at timestamp, price double, enters boolean, leaves boolean.

    A digest comes when the watermark has passed the end of its cooldown, or with the key's next row after that. A key
    that is silent for ``ttl_s`` is forgotten. Rows that come again, or are older than the key's newest, change nothing.
    A key's rows of one trigger are in memory at once.
    """
    slim = rows.select("key", "n", "at", F.unix_micros("at").alias("x"), F.col("price").cast("double").alias("price"), F.coalesce("enters", F.lit(False)).alias("enters"), F.coalesce("leaves", F.lit(False)).alias("leaves"))
    return slim.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Alerting(policy), ALERTS, "append", "EventTime")


ADMITTED = "domain string, source string, n long, at timestamp, granted boolean"


class _Admission(StatefulProcessor):
    def __init__(self, capacity: float, per_second: float) -> None:
        self.capacity, self.per_second = capacity, per_second

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.domain = handle.getValueState("domain", "tokens double, at double")
        self.sources = handle.getMapState("sources", "source string", "tokens double, at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["x", "n"], kind="stable")
        own = tuple(self.domain.get()) if self.domain.exists() else None
        held: dict[str, tuple[float, float]] = {}
        granted = []

        def full(bucket: tuple[float, float] | None, now: float, capacity: float, rate: float) -> tuple[float, float]:
            if bucket is None:
                return capacity, now
            tokens, at = bucket
            return min(capacity, tokens + rate * max(0.0, now - at)), max(now, at)

        for x, source, burst, rate in zip(batch["x"].tolist(), batch["source"].tolist(), batch["burst"].tolist(), batch["per_second"].tolist(), strict=True):
            now = x / 1e6
            if source is None or burst is None or burst != burst or rate is None or rate != rate:
                granted.append(False)  # nobody has configured it
                continue
            if source not in held and self.sources.containsKey((source,)):
                held[source] = tuple(self.sources.getValue((source,)))
            mine, own = full(held.get(source), now, burst, rate), full(own, now, self.capacity, self.per_second)
            # both or neither: what is denied costs nothing on either side
            yes = mine[0] >= 1 and own[0] >= 1
            held[source], own = (mine[0] - yes, mine[1]), (own[0] - yes, own[1])
            granted.append(yes)
        if own is not None:
            self.domain.update(own)
        for source, bucket in held.items():
            self.sources.updateValue((source,), bucket)
        yield pd.DataFrame({"domain": pd.Series([key[0]] * len(batch), dtype=object), "source": batch["source"].astype(object).to_numpy(), "n": batch["n"].to_numpy(), "at": batch["at"].to_numpy(), "granted": granted})

    def close(self) -> None:
        pass


def admission_stream(requests: DataFrame, capacity: float = 10.0, per_second: float = 0.5) -> DataFrame:
    """ADMITTED: each request takes one token from its source's bucket and one from its domain's, or none from either.

    ``requests`` (streaming, of a ``stateful_session``): domain, source string, n long, at timestamp, and the source's
    burst and per_second (null: not configured, denied). A domain's buckets are folded together, in the order of time
    within a trigger; its requests of one trigger are in memory at once.
    """
    rows = requests.select("domain", "source", "n", "at", F.unix_micros("at").alias("x"), F.col("burst").cast("double").alias("burst"), F.col("per_second").cast("double").alias("per_second"))
    return rows.groupBy("domain").transformWithStateInPandas(_Admission(capacity, per_second), ADMITTED, "append", "None")
