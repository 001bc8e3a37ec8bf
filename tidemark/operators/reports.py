"""Report roll-ups: backfill queue, coverage, run health, spend by several groupings, matcher precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import share


def backfill_queue(rows: DataFrame, by: list[str], family: Column, at: str, least: int = 1) -> DataFrame:
    """Unknown products by how often they were seen, and from when to when."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(family).alias("family_only"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return out.where(F.col("occurrences") >= least)


def run_stats(runs: DataFrame, by: list[str], ok: Column, full: Column, complete: Column, fetched: str, valid: str) -> DataFrame:
    """Runs by outcome, rows fetched and valid, and dropped ones where both are known and consistent; a sum of nothing recorded is null."""
    dropped = F.when(F.col(valid) <= F.col(fetched), F.col(fetched) - F.col(valid))
    out = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(ok).alias("successful"),
        F.count_if(full).alias("full_runs"),
        F.count_if(ok & full & complete).alias("complete"),
        F.sum(fetched).alias("fetched"),
        F.sum(valid).alias("valid"),
        F.sum(dropped).alias("dropped"),
    )
    return out.withColumn("completeness", share(F.col("complete"), F.col("full_runs")))


def spend_by(rows: DataFrame, groupings: list[list[str]], amount: str) -> DataFrame:
    """Sums over several groupings at once; ``grouping`` says which columns a row sums over."""
    cols = sorted({c for g in groupings for c in g})
    out = rows.groupingSets([[F.col(c) for c in g] for g in groupings], *cols).agg(F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"))
    return out


def conditional_sums(rows: DataFrame, by: list[str], amount: str, lines: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(c, F.col(amount))), F.lit(0)).alias(k) for k, c in lines.items()])


def precision(predictions: DataFrame, accepted: Column, correct: Column, by: list[str], least: int = 100, per_mille: int = 995) -> DataFrame:
    """Accepts, correct ones, precision, and whether the gate holds, compared in whole numbers."""
    out = predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(accepted).alias("accepts"), F.count_if(accepted & correct).alias("correct"))
    gate = (F.col("accepts") >= least) & (F.col("correct") * 1000 >= F.col("accepts") * per_mille)
    return out.withColumn("precision", share(F.col("correct"), F.col("accepts"))).withColumn("passes", gate)


def grain_counts(runs: DataFrame, ids: str, current: DataFrame, key: str, grain: str) -> DataFrame:
    """Resolution grains over listing ids with repeats; ids without an edge count as none."""
    each = runs.select(F.explode(ids).alias("_id"))
    out = each.join(current.select(F.col(key).alias("_key"), grain), F.col("_id") == F.col("_key"), "left")
    return out.groupBy(F.coalesce(grain, F.lit("none")).alias(grain)).agg(F.count(F.lit(1)).alias("n"))
