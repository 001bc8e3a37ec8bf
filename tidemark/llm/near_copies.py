"""Near-dedup by exact Jaccard similarity of word shingles.

Two texts are near copies if the sets of their five-word shingles have a similarity (members in both
over members in either) of 0.8 or more. Groups are the connected components of these links. Close
pairs are met by SimHash and discarded by pivot tables (``simhash``) and then checked exactly. A SimHash
pair at 0.8 is expected 10 bits apart and may be 19, too far for pivot tables, so that the remaining
pairs are met by prefixes, which miss none:

1. Prefixes. Every set is ordered by one order of all shingles. Two sets at the threshold share one of
   the first n - ceil(0.8 n) + 1 members of both. Frequent shingles (found in a sample) come last in
   the order, so that prefixes hold rare ones; any order gives the same result.
2. Bitmaps. Every shingle flips one of 512 bits, so two sets differ in at least as many members as
   their bitmaps in bits. Pairs at the threshold differ in a ninth of both sizes' sum at most; the
   rest is discarded. What is left is compared likewise on bitmaps of two to four bits a member, which
   tell large sets apart, too; of bitmaps of two sizes the larger is folded.
3. What is left is checked exactly, on the sets themselves (of 64-bit hashes).

Links are used for components alone: first every set is tried against the leaders of its prefixes'
buckets, then only pairs of different components are searched in full. Nothing is capped. Texts are
exchanged only where a candidate needs its set, or where a row's group has other rows.

Cases: words are cut and lowered as for the fingerprint. Fewer words than a shingle make one shingle
of all of them. Null and wordless texts are copies of each other. Texts with equal sets are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, packed, small_batches, written
from .components import components
from .hash_bits import bit_table, bits_for, has_bit, may_be_among
from .simhash import led_pairs, majority, meetings, pivot_table, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
LANES = 8
#: One text in so many is looked at for frequent shingles, in how many of these they are at least, and in how many steps of four times.
SAMPLE_PART, FREQUENT, LEVELS = 8, 3, 8
_BITS = [f"b{k}" for k in range(LANES)]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles, as signed longs."""
    return np.unique(shingle_hashes(text, shingle).view("<i8"))


def _set_column(text: Column, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, shingle) for t in texts], dtype=object)

    return of(text)


def _least(n: int, similarity: float) -> int:
    return int(np.ceil(n * similarity - 1e-9))


def _folded(wide: bytes, size: int) -> np.ndarray:
    """A bitmap as if it had been made with ``size`` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(wide, np.uint8).reshape(-1, size), axis=0)


def _late(sh: np.ndarray, frequent: list[np.ndarray]) -> np.ndarray:
    """In how many of the tables each hash is: the later, the more frequent."""
    rank = np.zeros(len(sh), np.int8)
    for t in frequent:
        rank += has_bit(t, sh & (8 * len(t) - 1))
    return rank


def _print_column(text: Column, shingle: int, similarity: float, frequent: Broadcast) -> Column:
    """sid (hash of the set), fp (SimHash of the text), n, the lanes of the bitmap and the prefix."""
    kind = "sid long, fp long, n int, " + ", ".join(f"{b} long" for b in _BITS) + ", wide binary, prefix array<long>"

    @F.pandas_udf(kind)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                hashes = shingle_hashes(t, shingle)
                fp = int(np.array([majority(hashes)], "<u8").view("<i8")[0])
                sh = np.unique(hashes.view("<i8"))
                n = len(sh)
                size = max(64 * LANES, 1 << (2 * n).bit_length())
                flips = np.bincount((sh & (size - 1)).astype(np.int64), minlength=size) & 1
                wide = np.packbits(flips.astype(bool), bitorder="little").tobytes()
                lanes = _folded(wide, 8 * LANES).view("<i8").tolist()
                order = np.argsort(_late(sh, frequent.value), kind="stable")
                prefix = sh[order[: n - _least(n, similarity) + 1]]
                sid = int(np.array([xxhash.xxh64_intdigest(sh.tobytes(), 42)], "<u8").view("<i8")[0])
                out.append((sid, fp, n, *lanes, wide, prefix))
            yield pd.DataFrame(out, columns=["sid", "fp", "n", *_BITS, "wide", "prefix"]).astype({"sid": "int64", "fp": "int64", "n": "int32"} | dict.fromkeys(_BITS, "int64"))

    return of(text)


def frequent_shingles(docs: DataFrame, text_col: str, shingle: int) -> list[np.ndarray]:
    """Bit tables of the shingles in at least FREQUENT, 4 * FREQUENT, ... of the sampled texts.

    They decide the order in prefixes, not the result. The sample is a fixed part of the texts, so that what
    counts as frequent does not grow with the input.
    """
    text = F.col(f"`{text_col}`")
    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_PART)) == 0).distinct()
    counts = some.select(F.explode(_set_column(F.col("text"), shingle)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    counts = written(counts, "counts")
    out = []
    for level in range(LEVELS):
        some = counts.where(F.col("n") >= FREQUENT * 4**level)
        if not (n := some.count()):
            break
        bits = bits_for(n)
        out.append(bit_table(some.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("p")), bits))
    dropped(counts)
    return out


def _differ(a: str, b: str) -> Column:
    parts = [F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in _BITS]
    return sum(parts[1:], parts[0])


def _possible(a: str, b: str, similarity: float) -> Column:
    """Neither the sizes nor the bitmaps rule out the threshold."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    sizes = F.least(na, nb) >= F.greatest(na, nb) * similarity - 1e-6
    return sizes & (_differ(a, b) <= (na + nb) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _left(pairs: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v of sids) that the wide bitmaps don't rule out."""

    @F.pandas_udf("int")
    def differ(a: pd.Series, b: pd.Series) -> pd.Series:
        least = [min(len(x), len(y)) for x, y in zip(a, b, strict=True)]
        return pd.Series([int(np.bitwise_count(_folded(x, k) ^ _folded(y, k)).sum()) for x, y, k in zip(a, b, least, strict=True)], dtype="int32")

    side = lambda s: table.select(*[F.col(c).alias(f"{s}{c}") for c in ("sid", "n", "wide")]).hint("merge")
    both = pairs.join(side("a_"), F.col("u") == F.col("a_sid")).join(side("b_"), F.col("v") == F.col("b_sid"))
    return both.where(differ("a_wide", "b_wide") <= (F.col("a_n") + F.col("b_n")) * ((1 - similarity) / (1 + similarity)) + 1e-6).select("u", "v")


def _checked(pairs: DataFrame, docs: DataFrame, table: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): the ``pairs`` (u, v of sids) at the threshold; ``docs`` (th, text), ``table`` has th of every sid."""
    pairs = written(_left(pairs, table, similarity), "left")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("w")).distinct()
    wanted = written(table.select("sid", "th").join(ends, F.col("sid") == F.col("w"), "left_semi"), "wanted")
    # one text each: copies meet inside the tasks first
    texts = docs.where(may_be_among(F.col("th"), wanted.select("th"))).groupBy("th").agg(F.first("text").alias("text"))
    of = wanted.select("sid", F.col("th").alias("wth")).join(texts, F.col("wth").eqNullSafe(F.col("th")))
    sets = written(of.select("sid", _set_column(F.col("text"), shingle).alias("sh")), "sets")
    mine, theirs = sets.select(F.col("sid").alias("us"), F.col("sh").alias("ush")), sets.select(F.col("sid").alias("vs"), F.col("sh").alias("vsh"))
    both = pairs.join(mine, F.col("u") == F.col("us")).join(theirs, F.col("v") == F.col("vs"))
    shared = F.size(F.array_intersect("ush", "vsh"))
    links = written(both.where(shared >= (F.size("ush") + F.size("vsh") - shared) * similarity - 1e-9).select("u", "v"), "links")
    dropped(sets, wanted, pairs)
    return links


def _close(table: DataFrame) -> DataFrame:
    """(u, v) of sids: by SimHash, sets of one fingerprint and of fingerprints that meet and survive the pivot table."""
    leads = written(pivot_table(table.groupBy("fp").agg(F.min("sid").alias("lead"))), "pivots")
    met = meetings(leads)
    of = lambda s: leads.select(F.col("fp").alias(f"{s}f"), F.col("lead").alias(f"{s}s")).hint("merge")
    near = led_pairs(leads, met).join(of("a"), F.col("u") == F.col("af")).join(of("b"), F.col("v") == F.col("bf")).select("as", "bs")
    one = table.select("sid", "fp").join(of("a"), F.col("fp") == F.col("af")).where("sid <> as").select("as", F.col("sid").alias("bs"))
    pairs = written(near.union(one).select(F.least("as", "bs").alias("u"), F.greatest("as", "bs").alias("v")).distinct(), "close")
    dropped(leads, met)
    return pairs


def copy_classes(docs: DataFrame, shingle: int, similarity: float, frequent: list[np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (id, th, text; th the text's hash): (id, th, sid) of every row, (sid, root) of every distinct set."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    prints = written(docs.select("id", "th", _print_column(F.col("text"), shingle, similarity, sent).alias("p")).select("id", "th", "p.*"), "prints")
    # rows of equal text hash are the same text, and any text of a set stands for it
    table = prints.groupBy("sid").agg(F.min("th").alias("th"), F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in ("n", *_BITS, "wide")])
    table = written(table, "table")
    texts = docs.select("th", "text")

    # a shingle's buckets are led by its smallest and its largest set
    members = prints.select("sid", F.explode("prefix").alias("h"))
    led_by = members.groupBy("h").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi")
    # merged, here and below: Spark takes exploded rows to be as few as the sets and would broadcast them, and what is small once compressed
    met = members.hint("merge").join(led_by.select((F.col("h") + 0).alias("sh"), "lo", "hi"), F.col("h") == F.col("sh")).select("h", "sid", "lo", "hi").distinct()
    met = written(met, "met")

    side = lambda s: table.select(*[F.col(c).alias(f"{s}{c}") for c in ("sid", "n", *_BITS)]).hint("merge")
    led = met.select("sid", F.explode(F.array("lo", "hi")).alias("lead")).where("sid <> lead").select(F.least("sid", "lead").alias("u"), F.greatest("sid", "lead").alias("v")).distinct()
    led = led.join(side("a_"), F.col("u") == F.col("a_sid")).join(side("b_"), F.col("v") == F.col("b_sid")).where(_possible("a_", "b_", similarity)).select("u", "v")
    close = _close(table)
    led = written(close.union(led).distinct(), "led")
    first = written(components(_checked(led, texts, table, shingle, similarity)), "classes")

    # what is left between different components
    comps = met.select("h", "sid").join(first.hint("merge"), F.col("sid") == F.col("node"), "left").select("h", "sid", F.coalesce("root", "sid").alias("comp"))
    comps = written(comps, "comps")
    mixed = comps.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select((F.col("h") + 0).alias("mh"))
    rest = comps.hint("merge").join(mixed, F.col("h") == F.col("mh")).select("h", "sid", "comp")
    rest = written(rest.join(side("t_"), F.col("sid") == F.col("t_sid")).select("h", "sid", "comp", *[F.col(f"t_{c}").alias(c) for c in ("n", *_BITS)]), "mixed")
    # sizes at the threshold are in the same step of sizes or in neighbouring ones
    step = F.floor(F.log(F.col("n")) / (1.001 * float(np.log(1 / similarity)))) if similarity < 1 else F.col("n").cast("long")
    left = rest.select("h", step.alias("step"), *[F.col(c).alias(f"a_{c}") for c in ("sid", "comp", "n", *_BITS)])
    right = rest.select(F.col("h").alias("h2"), F.explode(F.array(step - 1, step, step + 1)).alias("step2"), *[F.col(c).alias(f"b_{c}") for c in ("sid", "comp", "n", *_BITS)])
    pairs = left.join(right.hint("merge"), (F.col("h") == F.col("h2")) & (F.col("step") == F.col("step2")) & (F.col("a_comp") < F.col("b_comp")) & _possible("a_", "b_", similarity))
    pairs = written(pairs.select(F.col("a_sid").alias("u"), F.col("b_sid").alias("v")).distinct(), "pairs")
    dropped(met, comps, rest, led, close)
    links = _checked(pairs, texts, table, shingle, similarity)
    all_first = table.select("sid").join(first, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("comp"))
    all_first = written(all_first, "comps")
    name = lambda s: all_first.select(F.col("sid").alias(f"{s}s"), F.col("comp").alias(f"{s}c"))
    links = links.join(name("u"), F.col("u") == F.col("us")).join(name("v"), F.col("v") == F.col("vs")).select(F.col("uc").alias("u"), F.col("vc").alias("v"))
    second = components(links)
    roots = all_first.join(second, F.col("comp") == F.col("node"), "left").select("sid", F.coalesce("root", "comp").alias("root"))
    return prints.select("id", "th", "sid"), roots


def copy_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one of the smallest id (rows without an id
    come last; of rows that share it, the one with the smallest text hash, then row hash). Columns are
    as they were."""
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    prints, roots = copy_classes(rows, shingle, similarity, frequent_shingles(docs, text_col, shingle))
    classes = prints.groupBy("id", "th").agg(F.min("sid").alias("sid"), F.count(F.lit(1)).alias("times"))
    classes = written(classes.join(roots.select(F.col("sid").alias("rs"), "root"), F.col("sid") == F.col("rs")).select("id", "th", "times", "root"), "roots")
    keep = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("k"), F.sum("times").alias("all"))
    keep = written(keep.select("root", F.col("k.id").alias("ki"), F.col("k.th").alias("kt"), "all"), "keep")
    dropped(prints)
    # rows alone in their group stay without an exchange of their texts
    crowd = keep.where("all > 1")
    crowd_hashes = classes.join(crowd.select((F.col("root") + 0).alias("cr")), F.col("root") == F.col("cr"), "left_semi").select("th")
    out = docs.select(packed(docs), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"))
    out = out.withColumn("some", may_be_among(F.col("th"), crowd_hashes))
    some = out.where("some").join(keep.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("ki")) & (F.col("th") == F.col("kt")), "left_semi")
    some = some.groupBy("id", "th").agg(F.min_by("rec", F.xxhash64("rec")).alias("rec"))
    return out.where("not some").select("rec.*").union(some.select("rec.*"))
