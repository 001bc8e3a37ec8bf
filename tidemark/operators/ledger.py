"""What touches what in time, at any mixture of lengths, and the ledger that is placed on cycles by it.

Intervals are laid out on units of their own length: the power of two (of microseconds) that is just longer, so that
each lies on two units at most, whether it lasts a second or for ever. A pair meets on the units of the longer of the
two, onto which the shorter is laid as well, for as many lengths as the other side has (63 at most). A unit that holds
far more rows than others is split: its left rows are dealt out, its right rows sent to each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units shorter than this many bits of microseconds (about a second) aren't told apart; an open end.
LEAST_BITS, NEVER = 20, 1 << 61
#: Left rows of a unit from which on it is split, unless that is under a thousandth of all.
HOT = 100_000


def _laid(rows: DataFrame, side: str, start: Column, end: Column, guard_s: float) -> DataFrame:
    guard = int(guard_s * 1_000_000)
    a = F.unix_micros(start.cast("timestamp")) - guard
    b = F.when(end.isNull(), F.lit(NEVER)).otherwise(F.unix_micros(end.cast("timestamp")) + guard)
    out = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(f"{side}_row"), a.alias(f"{side}_a"), b.alias(f"{side}_b")).where(F.col(f"{side}_a") <= F.col(f"{side}_b"))
    bits = F.length(F.bin(F.col(f"{side}_b") - F.col(f"{side}_a")))
    return out.withColumn(f"{side}_bits", F.greatest(bits, F.lit(LEAST_BITS)))


def _on_units(rows: DataFrame, side: str, others: list[int]) -> DataFrame:
    """A row for each unit that an interval lies on: of its own length, and of the other side's longer ones."""
    own = F.col(f"{side}_bits")
    longer = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > own)
    rows = rows.withColumn("bits", F.explode(F.concat(F.array(own), longer)))
    return rows.withColumn("unit", F.explode(F.expr(f"sequence(shiftright({side}_a, bits), shiftright({side}_b, bits))")))


def touching(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, guard_s: float = 0.0) -> DataFrame:
    """All pairs of rows whose closed intervals touch, the left ones being widened by ``guard_s`` on both sides; each once.

    A null end is open; a null start, or an end before its start, touches nothing. Columns of both sides, whose names
    must differ.
    """
    both = set(left.columns) & set(right.columns)
    if both:
        raise ValueError(f"columns of both sides: {sorted(both)}")
    ls, rs = _laid(left, "l", F.col(l_start), F.col(l_end), guard_s), _laid(right, "r", F.col(r_start), F.col(r_end), 0.0)
    # lengths are few: 43 at most
    lengths = [sorted(r[0] for r in side.select(f"{name}_bits").distinct().collect()) for name, side in (("l", ls), ("r", rs))]
    lu, ru = _on_units(ls, "l", lengths[1]), _on_units(rs, "r", lengths[0])
    counts = lu.groupBy("bits", "unit").agg(F.count(F.lit(1)).alias("n"))
    most = max(HOT, (counts.agg(F.sum("n")).first()[0] or 0) // 1000)
    # a thousand units at most hold over a thousandth of all rows
    hot = F.broadcast(counts.where(F.col("n") > most).select("bits", "unit", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    lu = lu.join(hot, ["bits", "unit"], "left").withColumn("part", F.pmod(F.xxhash64("l_row"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    ru = ru.join(hot, ["bits", "unit"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    met = lu.join(ru, ["bits", "unit", "part"]).where((F.col("bits") == F.greatest("l_bits", "r_bits")) & (F.col("l_a") <= F.col("r_b")) & (F.col("l_b") >= F.col("r_a")))
    # in the first unit that they share
    met = met.where(F.col("unit") == F.expr("shiftright(greatest(l_a, r_a), bits)"))
    return met.select("l_row.*", "r_row.*")


def charge_lines(ledger: DataFrame, guard_s: float) -> DataFrame:
    """What each row of a ledger may charge, and when: ``line`` (outstanding, settled, monitoring), ``line_from``,
    ``line_to`` (null: open) and ``amount``, beside the row's columns.

    ``ledger``: status (open, reconciled, or neither), reserved_at, last_charge_at, reconciled_at, monitoring_last_at,
    monitoring_open boolean, estimate, actual, monitoring. An open row counts from its admission on, at its estimate
    and its allowance; a reconciled one from admission to its last charge at what it came to, and for monitoring from
    its reconciliation to the last such charge, if that is over. All are widened by a guard.
    """
    shifted = lambda c, s: F.timestamp_micros(F.unix_micros(c.cast("timestamp")) + int(s * 1_000_000))
    start, zero = shifted(F.col("reserved_at"), -guard_s), F.lit(0)
    line = lambda name, a, b, amount: F.struct(F.lit(name).alias("line"), a.alias("line_from"), b.cast("timestamp").alias("line_to"), F.coalesce(amount, zero).cast("decimal(18,4)").alias("amount"))
    open_ = F.array(line("outstanding", start, F.lit(None), F.coalesce("estimate", zero) + F.coalesce("monitoring", zero)))
    over = F.when(~F.coalesce("monitoring_open", F.lit(False)), shifted(F.coalesce("monitoring_last_at", "reconciled_at"), guard_s))
    done = F.array(line("settled", start, shifted(F.col("last_charge_at"), guard_s), F.col("actual")), line("monitoring", shifted(F.col("reconciled_at"), -guard_s), over, F.col("monitoring")))
    rows = ledger.withColumn("_l", F.explode(F.when(F.col("status") == "open", open_).when(F.col("status") == "reconciled", done)))
    return rows.select(*ledger.columns, "_l.*")


def placed(ledger: DataFrame, cycles: DataFrame, by: list[str], guard_s: float) -> DataFrame:
    """Sums by cycle (cycle_start, cycle_end), ``by`` and line of what the ledger's rows may charge to it, and the number of rows."""
    met = touching(charge_lines(ledger, guard_s), cycles.select("cycle_start", "cycle_end"), "line_from", "line_to", "cycle_start", "cycle_end")
    return met.groupBy("cycle_start", "cycle_end", *by, "line").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
