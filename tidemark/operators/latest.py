"""Newest and first rows of a key, upserts, and the order-independent current state of late-arriving history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. ``order`` should be total, else any of the tied rows is taken."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).where("_at = 1").drop("_at")


def newest_value(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Like first_per_key for few columns, but as an aggregate: one row a key and task is exchanged, so hot keys don't matter."""
    best = F.max(F.struct(*order, *[c for c in values if c not in order])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in values])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, keep: list[str]) -> DataFrame:
    """Newest row per key of both; columns in ``keep`` fall back to the old value where the new one is null."""
    cols = old.columns
    both = old.withColumn("_side", F.lit(0)).unionByName(new.select(*cols).withColumn("_side", F.lit(1)))
    rest = [c for c in cols if c not in keys]
    newest = F.max(F.struct(order, "_side", *[c for c in rest if c != order])).alias("_new")
    known = [F.max(F.when(F.col(c).isNotNull(), F.struct(order, "_side", c))).alias(f"_k_{c}") for c in keep]
    merged = both.groupBy(*keys).agg(newest, *known)
    return merged.select(*[F.col(c) if c in keys else (F.col(f"_k_{c}.{c}") if c in keep else F.col(f"_new.{c}")).alias(c) for c in cols])


def absent_rows(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't there yet: replays append nothing."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def in_arrival_order(df: DataFrame, key: str, arrival: str, event: str) -> DataFrame:
    """Marks each row with ``moves_state``: its event time is not before any that arrived earlier (ties move it),
    and ``state_at``, the event time of the state after it. Late rows stay in the history."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(event).over(before)
    moves = seen.isNull() | (F.col(event) >= seen)
    return df.withColumn("state_at", F.greatest(seen, F.col(event))).withColumn("moves_state", moves)
