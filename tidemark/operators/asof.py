"""Joins in time: as-of with tolerance, points in intervals, overlapping intervals. None compares all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, tolerance_s: int, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the newest right row of the same key that is not later and at most
    ``tolerance_s`` older; null where there is none. Equal times count; of right rows with equal times
    the one with the largest values.

    Both sides are cut into time buckets of one tolerance; a right row goes to its own and the next
    bucket. So a hot key is split by time, one exchange serves both sides, and no pairs are made.
    """
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (tolerance_s * 1_000_000))
    found = F.struct(F.col(right_at).alias("at"), *values)
    r = right.where(F.col(right_at).isNotNull()).select(F.col(by).alias("_k"), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), found.alias("_r"), F.lit(None).cast(left.schema.simpleString()).alias("_l"), F.explode(F.array(bucket(F.col(right_at)), bucket(F.col(right_at)) + 1)).alias("_b"))
    l = left.select(F.col(by).alias("_k"), F.col(left_at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"), bucket(F.col(left_at)).alias("_b"))  # noqa: E741
    own = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = r.unionByName(l).withColumn("_found", F.last("_r", ignorenulls=True).over(own)).where("_side = 1")
    near = (F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_found.at").cast("timestamp"))) <= tolerance_s * 1_000_000
    return both.select("_l.*", *[F.when(near, F.col(f"_found.{v}")).alias(v) for v in values])


def stamp_rates(rows: DataFrame, rates: DataFrame, currency: str, on_date: str, max_age_days: int = 7, home: str = "USD") -> DataFrame:
    """``rows`` with fx_rate, fx_date, fx_source: the newest rate of the currency that is not after the
    date and at most ``max_age_days`` old. The home currency has rate 1; other rows without a rate keep nulls
    (rejects). ``rates``: base, rate_date, rate, source.

    Every rate is laid out on the days it holds for, so this is an equality join: rates are few (days by
    currencies) and Spark broadcasts them under its threshold.
    """
    following = F.lead("rate_date").over(Window.partitionBy("base").orderBy("rate_date"))
    newest = rates.groupBy("base", "rate_date").agg(F.max(F.struct("source", "rate")).alias("r")).withColumn("next", following)
    until = F.least(F.date_add("rate_date", max_age_days), F.coalesce(F.date_sub("next", 1), F.date_add("rate_date", max_age_days)))
    days = newest.select(F.col("base").alias("_base"), F.explode(F.sequence("rate_date", until)).alias("_day"), F.col("r.rate").cast("decimal(12,6)").alias("_rate"), F.col("rate_date").alias("_date"), F.col("r.source").alias("_source"))
    out = rows.join(days, (F.col(currency) == F.col("_base")) & (F.col(on_date).cast("date") == F.col("_day")) & (F.col(currency) != home), "left")
    is_home = F.col(currency) == home
    return out.select(
        *rows.columns,
        F.when(is_home, F.lit(1).cast("decimal(12,6)")).otherwise(F.col("_rate")).alias("fx_rate"),
        F.when(is_home, F.col(on_date).cast("date")).otherwise(F.col("_date")).alias("fx_date"),
        F.when(is_home, F.lit("identity")).otherwise(F.col("_source")).alias("fx_source"),
    )


def _units(start: Column, end: Column, days: int) -> Column:
    unit = lambda c: F.floor(F.unix_date(c.cast("date")) / days)
    return F.explode(F.sequence(unit(start), unit(end)))


def overlapping(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, unit_days: int = 31) -> DataFrame:
    """All pairs of rows whose closed date intervals touch; an open end should be filled before.

    Intervals are laid out on units of ``unit_days``; a pair that shares several units is made in the
    first of them only.
    """
    lv = left.select("*", _units(F.col(l_start), F.col(l_end), unit_days).alias("_lu"))
    rv = right.select("*", _units(F.col(r_start), F.col(r_end), unit_days).alias("_ru"))
    first = F.floor(F.unix_date(F.greatest(F.col(l_start).cast("date"), F.col(r_start).cast("date"))) / unit_days)
    both = lv.join(rv, F.col("_lu") == F.col("_ru")).where((F.col("_lu") == first) & (F.col(l_start) <= F.col(r_end)) & (F.col(l_end) >= F.col(r_start)))
    return both.drop("_lu", "_ru")
