"""SimHash near-dedup with pivot distance tables.

Every text gets a 64-bit fingerprint of its word shingles. For each distinct fingerprint the table of
its Hamming distances to PIVOTS reference fingerprints is computed once. Pairs are met, discarded and verified:

1. Met. Two fingerprints within RADIUS bits agree on all bits of at least BLOCKS - RADIUS slices, so a
   join on the bits of every choice of so many slices meets every such pair. The distances themselves
   can't take this part: those of two random fingerprints to a reference are within RADIUS of each
   other in 57 of 100 cases, so bands of a few of them would leave most pairs to be looked at.
2. Discarded. By the triangle inequality no coordinate of a pair within RADIUS differs by more than
   that; a pair whose largest difference of coordinates is larger is no pair.
3. Verified. What survives is compared bit by bit.

Links are used for components alone, so no group of near copies is expanded into pairs. First every
fingerprint is tried against the two leaders of its buckets (the smallest and the largest, found by
aggregation); this already joins dense groups. Then only buckets that still hold more than one
component are searched in full, for pairs of different components. Nothing is capped: every link
between different components is found, so the components are exact.

Cases: a null or wordless text has fingerprint zero and links like any other. Fewer words than a
shingle make one shingle of all of them. Repeated rows and equal texts share a fingerprint and so a
component. A null doc_id never is a component id unless all members' ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, packed, small_batches, written
from .components import components

RADIUS = 4
BLOCKS = 7
PIVOTS = 16


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray:
    """The unsigned XXH64 (seed 42) of the text's shingles in order, repeats included."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    if n < shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), "<u8", n - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint: a bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The majority of the text's shingle hashes."""
    return majority(shingle_hashes(text, shingle))


def fingerprint_column(text_col: str, shingle: int = 4) -> F.Column:
    """The fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], "<u8").view("<i8"))

    return of(F.col(f"`{text_col}`"))


def _references() -> list[int]:
    """Reference fingerprints: the hashes of 0, 1, 2, ... as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(j), 42)).astype(np.int64)) for j in range(PIVOTS)]


def _slices() -> list[int]:
    edges = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def coordinates(fp: Column) -> list[Column]:
    """The distances to all references, eight a long."""
    half = PIVOTS // 2
    refs = _references()

    def whole(js: range) -> Column:
        parts = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(refs[j]))).cast("long"), 8 * k) for k, j in enumerate(js)]
        return sum(parts[1:], parts[0])

    return [whole(range(half)), whole(range(half, PIVOTS))]


def pivot_table(distinct: DataFrame) -> DataFrame:
    """Adds c0, c1 to the column fp: its coordinates."""
    return distinct.select("*", *[c.alias(f"c{k}") for k, c in enumerate(coordinates(F.col("fp")))])


def _keys() -> Column:
    """One bucket key for each choice of slices that a pair within the radius can agree on."""
    chosen = combinations(_slices(), BLOCKS - RADIUS)
    return F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(sum(ms)))) for t, ms in enumerate(chosen)])


def _largest_difference(a: list[Column], b: list[Column]) -> Column:
    at = lambda c, k: F.shiftright(c, 8 * k).bitwiseAND(F.lit(127))
    return F.greatest(*[F.abs(at(x, k) - at(y, k)) for x, y in zip(a, b, strict=True) for k in range(PIVOTS // 2)])


def _within(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def _linked(pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a_fp, b_fp and their coordinates) that survive the pivots and the comparison."""
    far = _largest_difference([F.col("a_c0"), F.col("a_c1")], [F.col("b_c0"), F.col("b_c1")])
    return pairs.where(far <= RADIUS).where(_within(F.col("a_fp"), F.col("b_fp")))


def meetings(table: DataFrame) -> DataFrame:
    """(key, fp, lo, hi): the buckets of a pivot table that hold more than one fingerprint, with their leaders."""
    rows = table.select("fp", F.explode(_keys()).alias("key"))
    led_by = rows.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    # merged: Spark takes exploded rows to be as few as the fingerprints, and would broadcast them
    return written(rows.hint("merge").join(led_by.select((F.col("key") + 0).alias("lk"), "lo", "hi"), F.col("key") + 0 == F.col("lk")).select("key", "fp", "lo", "hi"), "met")


def led_pairs(table: DataFrame, met: DataFrame) -> DataFrame:
    """(u, v): fingerprints of ``table`` and leaders of their buckets that survive both steps."""
    # merged, as all tables that grow with the input and are small once compressed
    side = lambda s: table.select(*[F.col(c).alias(f"{s}{c}") for c in ("fp", "c0", "c1")]).hint("merge")
    led = met.select("fp", F.explode(F.array("lo", "hi")).alias("lead")).where("fp <> lead").distinct()
    led = led.join(side("a_"), F.col("fp") == F.col("a_fp")).join(side("b_"), F.col("lead") == F.col("b_fp"))
    return _linked(led).select(F.col("a_fp").alias("u"), F.col("b_fp").alias("v"))


def near_classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``prints`` (id, fp)."""
    table = written(pivot_table(prints.groupBy("fp").agg(F.min("id").alias("lead"))), "pivots")
    met = meetings(table)
    first = written(components(led_pairs(table, met)), "classes")

    # what is left between different components
    comps = table.join(first, F.col("fp") == F.col("node"), "left").select("fp", "c0", "c1", "lead", F.coalesce("root", "fp").alias("comp"))
    comps = written(comps, "comps")
    joined = met.select("key", "fp").join(comps.select(F.col("fp").alias("cfp"), "c0", "c1", "comp").hint("merge"), F.col("fp") == F.col("cfp")).select("key", "fp", "c0", "c1", "comp")
    joined = written(joined, "joined")
    mixed = joined.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select((F.col("key") + 0).alias("mk"))
    mixed = written(joined.join(mixed, F.col("key") + 0 == F.col("mk")).select("key", "fp", "c0", "c1", "comp"), "mixed")
    left = mixed.select("key", *[F.col(c).alias(f"a_{c}") for c in ("fp", "c0", "c1", "comp")])
    right = mixed.select(F.col("key").alias("key2"), *[F.col(c).alias(f"b_{c}") for c in ("fp", "c0", "c1", "comp")])
    # both conditions go into the join, so that nothing else leaves it
    pairs = _linked(left.join(right, (F.col("key") == F.col("key2")) & (F.col("a_comp") < F.col("b_comp"))))
    second = components(pairs.select(F.col("a_comp").alias("u"), F.col("b_comp").alias("v")))

    roots = comps.select("fp", "comp", "lead").join(second, F.col("comp") == F.col("node"), "left").select("fp", F.coalesce("root", "comp").alias("root"), "lead")
    roots = written(roots, "roots")
    dropped(met, joined, mixed, table, comps)
    least = roots.groupBy("root").agg(F.min("lead").alias("component_id"))
    return roots.join(least.select((F.col("root") + 0).alias("r"), "component_id").hint("merge"), F.col("root") + 0 == F.col("r")).select("fp", "root", "component_id")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row for each row of ``docs``: id_col, fingerprint (16 hex digits), component_id."""
    small_batches(docs.sparkSession)
    prints = written(docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint_column(text_col, shingle).alias("fp")), "prints")
    classes = written(near_classes(prints), "classes").select(F.col("fp").alias("cfp"), "component_id")
    out = prints.join(classes.hint("merge"), F.col("fp") == F.col("cfp"))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id (rows without an id come
    last; of rows that share it, the one with the smallest text hash, then row hash). Columns are as
    they were."""
    small_batches(docs.sparkSession)
    text_hash = F.xxhash64(F.col(f"`{text_col}`"))
    prints = written(docs.select(F.col(f"`{id_col}`").alias("id"), text_hash.alias("th"), fingerprint_column(text_col, shingle).alias("fp")), "prints")
    classes = written(near_classes(prints), "classes").select(F.col("fp").alias("cfp"), "root", "component_id")
    leads = prints.join(classes.hint("merge"), (F.col("fp") == F.col("cfp")) & F.col("id").eqNullSafe(F.col("component_id")))
    keep = leads.groupBy("root").agg(F.min("th").alias("kt"), F.min("id").alias("ki")).select("ki", "kt")
    rows = docs.select(packed(docs), F.col(f"`{id_col}`").alias("id"), text_hash.alias("th"))
    rows = rows.join(keep.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("ki")) & (F.col("th") == F.col("kt")), "left_semi")
    return rows.groupBy("id", "th").agg(F.min_by("rec", F.xxhash64("rec")).alias("rec")).select("rec.*")
