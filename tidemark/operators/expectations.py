"""Constraints as checks: Parquet enforces none, so each is a column, and rows that break one go to the rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both_or_none(a: Column, b: Column) -> Column:
    return a.isNull() == b.isNull()


def snapshot_checks() -> dict[str, Column]:
    """A stated price is positive, and a foreign currency has its rate, date and source."""
    c = F.col
    return {
        "price_positive": c("price") > 0,
        "fx_stamped": (c("currency") == "USD") | (c("fx_rate").isNotNull() & c("fx_date").isNotNull() & c("fx_source").isNotNull()),
        "stock_known": c("stock_status").isin("in_stock", "out_of_stock", "preorder", "unknown"),
    }


def listing_checks() -> dict[str, Column]:
    """A delisting has its reason and no reason stands alone; bounded rows expire, others don't."""
    c = F.col
    return {
        "delist_together": both_or_none(c("delisted_at"), c("delist_reason")),
        "bounded_expires": c("bounded") == c("expires_at").isNotNull(),
    }


def edge_checks() -> dict[str, Column]:
    """An accept has a target, a grain, a method and a confidence; other outcomes have no target."""
    c = F.col
    accept = c("outcome") == "accept"
    return {
        "accept_is_whole": ~accept | (c("target").isNotNull() & (c("grain") != "none") & c("method").isNotNull() & c("confidence").isNotNull()),
        "others_are_bare": accept | c("target").isNull(),
    }


def split(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that hold all checks, and the others with ``broken``, the names of what they break; a null is a break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, nulls taken as equal, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: how many rows break each check."""
    return rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
