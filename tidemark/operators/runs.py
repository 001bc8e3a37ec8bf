"""Sequences of runs: gaps, failure streaks and recovery, sessions of continuous polling, medians of the last runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(a: Column, b: Column) -> Column:
    """From ``a`` to ``b``."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1_000_000


def gaps(runs: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    own = Window.partitionBy(key).orderBy(at, tie)
    return runs.withColumn("gap_s", seconds(F.lag(at).over(own), F.col(at)))


def gap_summary(runs: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Per key: n_gaps, p50 and max of the seconds between neighbouring runs."""
    return gaps(runs, key, at, tie).groupBy(key).agg(F.count("gap_s").alias("n_gaps"), F.median("gap_s").alias("p50_gap_s"), F.max("gap_s").alias("max_gap_s"))


def failure_streaks(runs: DataFrame, key: str, at: str, tie: str, failed: Column, succeeded: Column) -> DataFrame:
    """One row per streak of failures: its number of failures, first and last, and the success that ends it with the
    seconds it took (null while it lasts). Rows that are neither start nor end a streak."""
    own = Window.partitionBy(key).orderBy(at, tie)
    marked = runs.withColumn("_ok", F.coalesce(succeeded, F.lit(False)).cast("int")).withColumn("_bad", F.coalesce(failed, F.lit(False)).cast("int")).where("_ok + _bad > 0")
    # backwards: a frame that begins behind its row and has no end is gone through anew for each row
    back = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_island", F.sum("_ok").over(own)).withColumn("_next", F.min(F.when(F.col("_ok") == 1, F.col(at))).over(back))
    streaks = marked.where("_bad = 1").groupBy(key, "_island").agg(F.count(F.lit(1)).alias("failures"), F.min(at).alias("first_failed"), F.max(at).alias("last_failed"), F.min("_next").alias("recovered"))
    return streaks.select(key, "failures", "first_failed", "last_failed", "recovered", seconds(F.col("first_failed"), F.col("recovered")).alias("recovery_s"))


def sessions(runs: DataFrame, keys: list[str], at: str, tie: str, tolerance_s: Column, breaks: Column | None = None) -> DataFrame:
    """One row per stretch of runs that follow each other within ``tolerance_s`` (a gap of just that continues);
    a row that ``breaks`` ends its stretch and is in none. start, end, n_runs."""
    own = Window.partitionBy(*keys).orderBy(at, tie)
    broken = F.coalesce(breaks, F.lit(False)) if breaks is not None else F.lit(False)
    marked = runs.withColumn("_broken", broken)
    prev, was = F.lag(at).over(own), F.lag("_broken").over(own)
    new = prev.isNull() | was | (seconds(prev, F.col(at)) > tolerance_s)
    marked = marked.withColumn("_new", new.cast("int")).withColumn("_session", F.sum("_new").over(own)).where(~F.col("_broken"))
    return marked.groupBy(*keys, "_session").agg(F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.count(F.lit(1)).alias("n_runs")).drop("_session")


def median_of_last(runs: DataFrame, key: str, at: str, tie: str, value: str, n: int = 10) -> DataFrame:
    """Median of ``value`` over each key's last ``n`` rows."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))
    return runs.withColumn("_n", last).where(F.col("_n") <= n).groupBy(key).agg(F.count(F.lit(1)).alias("n_runs"), F.median(value).alias("median_value"))


def change_decisions(readings: DataFrame, keys: list[str], at: str, tie: str, price: str, stock: str, fingerprint: Column, least_drop: float = 0.0) -> DataFrame:
    """``readings`` with ``decision``: failed without a stock state, ambiguous where it is unknown, transition_detected
    at the first sighting, a new state or a price that fell by ``least_drop`` or more, else unchanged. A failed
    reading is none to compare with: the next one looks at the last that worked."""
    own = Window.partitionBy(*keys).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    this = F.struct(F.col(price).cast("double").alias("price"), F.col(stock).alias("stock"), fingerprint.alias("fp"))
    seen = readings.withColumn("_this", this).withColumn("_was", F.last(F.when(F.col(stock).isNotNull(), F.col("_this")), ignorenulls=True).over(own))
    was, now = F.col("_was.price"), F.col("_this.price")
    fell = F.coalesce((now < was) & ((was - now) / was >= least_drop), F.lit(False))
    decision = (
        F.when(F.col(stock).isNull(), "failed")
        .when(F.col(stock) == "unknown", "ambiguous")
        .when(F.col("_was").isNull(), "transition_detected")
        .when(F.col("_this.fp") == F.col("_was.fp"), "unchanged")
        .when((F.col(stock) != F.col("_was.stock")) | fell, "transition_detected")
        .otherwise("unchanged")
    )
    return seen.withColumn("decision", decision).drop("_this", "_was")


def daily_counts(rows: DataFrame, at: str, by: list[str]) -> DataFrame:
    return rows.groupBy(F.to_date(at).alias("day"), *by).agg(F.count(F.lit(1)).alias("n"))


# Statuses that pass by themselves and statuses that shut a collector out; a body this small is a block.
TRANSIENT_STATUSES = (408, 500, 502, 504)
ANTI_BOT_STATUSES = (401, 403, 429, 503)
SOFT_BLOCK = 0.2


def response_class(status: Column, is_json: Column, expects_json: Column, challenge: Column, size: Column, median_size: Column) -> Column:
    """How a fetch went, by its first failing sign; null is healthy so far. A wrong type, a challenge in the body
    (``challenge``) and a body far below the source's usual size are blocks, whatever the status says."""
    no = F.lit(False)
    return (
        F.when(status.isin(*TRANSIENT_STATUSES), "transient")
        .when(status.isin(*ANTI_BOT_STATUSES), "anti_bot")
        .when(expects_json & ~F.coalesce(is_json, no), "anti_bot")
        .when(F.coalesce(challenge, no), "anti_bot")
        .when(F.coalesce((median_size > 0) & (size < SOFT_BLOCK * median_size), no), "anti_bot")
        .when(status >= 400, "unknown")
    )
