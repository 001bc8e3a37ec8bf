"""Connected components of a link table, by alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node it sees."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # the sum keeps the two sides' partitionings apart, so a hub's rows are exchanged and can be split
    out = both.where("v > u").join(least.select(F.col("u").alias("w"), "m"), F.col("u") + 0 == F.col("w") + 0)
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least.select(F.col("u").alias("w"), "m"), F.col("u") + 0 == F.col("w") + 0)
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long, not null), root being the smallest node reachable.

    An empty table gives an empty result; loops and repeated links change nothing. Every round is
    written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    edges = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    while True:
        old, edges = edges, written(_small_star(_large_star(edges)), "edges")
        dropped(old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
