"""Sharding by longest-processing-time scheduling.

Rows of one group stay together. Groups, sorted by size, go one by one to the least-loaded shard. What
the schedule needs to know of the groups is how many there are of each size: the driver reads these
counts in descending order of size and deals every run of equal groups through the heap of loads at
once, as single groups would be (ties of load go to the smaller shard). It keeps the loads, and of
each size how many of its groups each shard gets, which is written as a table in parts of SIZES rows.
Groups of one size are numbered, and the number tells the shard. So all groups are scheduled singly,
whatever their number, and the driver's memory doesn't grow with the groups.

Numbers without gaps, of groups in a size and of rows in a shard (their slots), are given in cells, a
hashed fraction of each, so that neither a common size nor a shard meets in one task.

Cases: a null group is a group like any other; a null or negative size counts as 0. Repeated rows are
rows like others and stay together. An empty table gives an empty result. Groups whose 64-bit hashes
collide are kept together, which no law forbids. Columns of the input stay as they are, whatever they
are called; ``shard`` and ``slot`` win a name clash.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, new_path, packed, written

#: Rows that are numbered together, on average.
CELL = 20_000
#: Sizes whose shares are written at once.
SIZES = 50_000


def dealt(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` groups of ``size`` each shard gets, one by one to the least load; ``loads`` is brought up to date."""
    shards = len(loads)
    got = [0] * shards
    if size == 0:
        got[min(range(shards), key=lambda j: (loads[j], j))] = n
    elif n <= shards:
        heap = [(load, j) for j, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(n):
            load, j = heap[0]
            got[j] += 1
            heapq.heapreplace(heap, (load + size, j))
    else:
        # a shard takes a group at every load it passes through; the n smallest of these loads count
        below = lambda level: sum(max(0, -(-(level - load) // size)) for load in loads)
        low, high = min(loads), max(loads) + (n // shards + 1) * size + 1
        while high - low > 1:
            level = (low + high) // 2
            low, high = (level, high) if below(level) <= n else (low, level)
        got = [max(0, -(-(low - load) // size)) for load in loads]
        left = n - sum(got)
        for j in range(shards):
            if left and loads[j] + got[j] * size == low:
                got[j] += 1
                left -= 1
    for j in range(shards):
        loads[j] += got[j] * size
    return got


def _shares(sizes: DataFrame, shards: int) -> DataFrame:
    """(size, ends) of ``sizes`` (size, n): of the n groups, those numbered below ends[0] go to shard 0, and so on."""
    spark, path = sizes.sparkSession, new_path(sizes.sparkSession, "shares")
    kind = "size long, ends array<long>"
    loads, held = [0] * shards, []

    def flush() -> None:
        rows = pd.DataFrame(held, columns=["size", "ends"])
        (spark.createDataFrame(rows, kind) if held else spark.createDataFrame([], kind)).write.mode("append").parquet(path)
        held.clear()

    for r in sizes.orderBy(F.desc("size")).toLocalIterator():
        end, ends = 0, []
        for c in dealt(loads, r["size"], r["n"]):
            end += c
            ends.append(end)
        held.append((r["size"], ends))
        if len(held) == SIZES:
            flush()
    flush()
    return spark.read.schema(kind).parquet(path)


def _numbered(df: DataFrame, keys: list[str], cell: Column, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, numbers from 0 without gaps in each group of ``keys``, cell by cell."""
    df = df.withColumn("cell", cell)
    counts = df.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(k).alias(f"s_{k}") for k in (*keys, "cell")], F.coalesce(before, F.lit(0)).alias("start"))
    at = df.withColumn("at", F.row_number().over(Window.partitionBy(*keys, "cell").orderBy(*order)))
    met = [F.col(k) == F.col(f"s_{k}") for k in (*keys, "cell")]
    at = at.join(starts, met).withColumn(name, F.col("start") + F.col("at") - 1)
    return at.select(*[c for c in df.columns if c not in ("cell", name)], name)


def lpt_shards(df: DataFrame, group: Column, size: Column, shards: int, order: list[Column] | None = None) -> DataFrame:
    """The columns of ``df`` with ``shard`` (int) and ``slot`` (long; by ``order`` within a cell)."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    tie = F.struct(*order) if order else F.lit(0)
    rows = df.select(packed(df.select(*kept)) if kept else F.lit(None).alias("rec"), F.xxhash64(F.lit("group"), group).alias("g"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"), tie.alias("tie"))
    rows = written(rows, "rows")
    groups = written(rows.groupBy("g").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("members")), "groups")
    total, n = groups.agg(F.sum("members"), F.count(F.lit(1))).first()
    shares = _shares(groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")), shards).select(F.col("size").alias("of"), "ends")
    cells = lambda k: F.lit(max(16, -(-(k or 0) // CELL)))
    numbers = _numbered(groups.select("g", "size"), ["size"], F.pmod(F.xxhash64(F.lit("number"), F.col("g")), cells(n)), [F.col("g")], "number")
    placed = numbers.join(shares, F.col("size") == F.col("of"))
    placed = written(placed.select(F.col("g").alias("pg"), F.size(F.filter("ends", lambda e: e <= F.col("number"))).alias("shard")), "placed")
    at = rows.join(placed, F.col("g") == F.col("pg")).select("rec", "tie", "g", "shard")
    cell = F.pmod(F.xxhash64(F.lit("cell"), F.col("g"), F.col("tie")), cells(-(-(total or 0) // shards)))
    out = _numbered(at, ["shard"], cell, [F.col("tie"), F.col("g")], "slot")
    dropped(groups)
    return out.select(*([f"rec.`{c}`" for c in df.columns if c not in ("shard", "slot")]), "shard", F.col("slot").cast("long").alias("slot"))
