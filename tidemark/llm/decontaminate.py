"""Benchmark decontamination: item-sized windows around anchor shingles, bound by shared places, exact check.

A document is contaminated if a window of it, as many words long as a benchmark item, has a weighted
shingle similarity of THRESHOLD or more with the item: shingles are SHINGLE words, their weights the
times they occur, the similarity is the sum of smaller over the sum of larger weights.

1. Regions. A window that reaches the threshold lacks at most a known share of the item's shingles,
   so it holds one of any few more of them. These anchors (a few an item) are met with all shingles
   of all documents; around each place found lie all windows that hold it. Nothing else of a
   document can qualify, and nothing else is moved.
2. Counts. A window at the threshold holds a known number of places whose shingle is one of the item's:
   the shared weight is at most that number. The places of a region that hold a shingle of an item are
   met by equality; every window with enough of them is a candidate, whatever else it holds. A SimHash
   of the window's words would lose some: a word that fills it up adds up in all bits.
3. Candidates are checked exactly.

Words are runs of letters and digits in lower case. Cases: null or wordless texts and items match
nothing. Items of fewer than SHINGLE words have one shingle, all of them. A document that is shorter
than an item is one window as a whole. Items with equal texts are all reported. Rows with equal
(id, text) count as one document in the report; all of them go. A null id is an id like any other.
Empty tables give no findings. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHINGLE = 5
THRESHOLD = 0.8
#: Anchors up to this number (of some 30 bytes) are broadcast; more are joined by exchange.
BROADCAST_ROWS = 500_000
_KEY = ("id", "th", "m", "lo")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _indexes(n: Column) -> Column:
    """0 to n - 1; empty for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column, k: int) -> Column:
    return F.transform(_indexes(F.size(words) - (k - 1)), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def _shingles(words: Column, k: Column) -> Column:
    return F.transform(_indexes(F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i + 1, k), " "))


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, no, words, m, k) of the items with words: m words, shingles of k; no stands for item and words."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("item"), words_of(F.col(f"`{text_col}`")).alias("words")).where(F.size("words") > 0)
    items = items.distinct().withColumn("m", F.size("words"))
    return items.select("item", F.xxhash64("item", "words").alias("no"), "words", "m", F.least("m", F.lit(SHINGLE)).alias("k"))


def _hashes_of(words: Column, k: Column) -> Column:
    return F.coalesce(*[F.when(k == n, _hashes(words, n)) for n in range(1, SHINGLE + 1)])


def _anchors(items: DataFrame, ks: list[int], threshold: float) -> DataFrame:
    """(hash, m, k): of each item so many shingles that no window at the threshold lacks them all."""
    hashed = F.coalesce(*[F.when(F.col("k") == k, _hashes(F.col("words"), k)) for k in ks])
    sh = items.select("m", "k", F.array_sort(hashed).alias("sh"))
    # a document shorter than the item lacks most
    few = F.size("sh") - F.ceil(F.size("sh") * F.lit(threshold) - 1e-9).cast("int") + 1
    return sh.select("m", "k", F.explode(F.slice("sh", F.lit(1), few)).alias("hash")).distinct()


def regions(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(id, th, m, k, size, lo, last, words): stretches of ``docs`` (id, th, text) that may hold a window.
    The windows are ``size`` words long and start from ``lo`` to ``last``; ``words`` begins at ``lo``."""
    ks = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most SHINGLE values
    anchors = _anchors(items, ks or [SHINGLE], threshold)
    anchors = written(anchors, "anchors").select("m", F.col("k").alias("ak"), F.col("hash").alias("ah"))
    anchors = F.broadcast(anchors) if anchors.count() <= BROADCAST_ROWS else anchors
    words = docs.select("id", "th", words_of(F.col("text")).alias("words"))
    found = []
    for k in ks:
        at = words.select("id", "th", F.size("words").alias("n"), F.posexplode(_hashes(F.col("words"), k)).alias("pos", "hash"))
        found.append(at.join(anchors.where(F.col("ak") == k), F.col("hash") == F.col("ah")).select("id", "th", "n", "m", F.col("ak").alias("k"), "pos"))
    if not found:
        found.append(words.select("id", "th", F.lit(0).alias("n"), F.lit(0).alias("m"), F.lit(1).alias("k"), F.lit(0).alias("pos")).where(F.lit(False)))
    hits = found[0]
    for f in found[1:]:
        hits = hits.union(f)
    hits = written(hits.distinct(), "hits")
    own = Window.partitionBy("id", "th", "m").orderBy("pos")
    apart = (F.col("pos") - F.lag("pos").over(own)) > 2 * F.col("m")
    parts = hits.withColumn("new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("part", F.sum("new").over(own))
    reach = F.col("m") - F.col("k")  # a window starts so many words before its last shingle at most
    parts = parts.groupBy("id", "th", "m", "k", "n", "part").agg(F.min(F.col("pos") - reach).alias("from"), F.max("pos").alias("to"))
    size = F.least("m", "n")
    parts = parts.select("id", "th", "m", "k", size.alias("size"), F.greatest("from", F.lit(0)).alias("lo"), F.least("to", F.col("n") - size).alias("last"))
    # starts before 0 are the window at 0
    parts = parts.withColumn("lo", F.least("lo", "last"))
    each = parts.groupBy(F.col("id").alias("rid"), F.col("th").alias("rth")).agg(F.collect_list(F.struct("m", "k", "size", "lo", "last")).alias("parts"))
    with_text = docs.join(each.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")))
    with_text = with_text.groupBy("id", "th", "parts").agg(F.first("text").alias("text"))
    out = with_text.select("id", "th", words_of(F.col("text")).alias("words"), "parts").select("id", "th", "words", F.explode("parts").alias("p"))
    return out.select("id", "th", "p.*", F.slice("words", F.col("p.lo") + 1, F.col("p.last") - F.col("p.lo") + F.col("p.size")).alias("words"))


def candidates(areas: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(id, th, m, lo, no, start) of every window that holds enough places of an item of its size."""
    here = areas.select(*_KEY, "k", "size", "last", F.posexplode(_hashes_of(F.col("words"), F.col("k"))).alias("i", "hash"))
    theirs = items.select("no", F.col("m").alias("im"), F.explode(F.array_distinct(_hashes_of(F.col("words"), F.col("k")))).alias("ih"))
    met = here.join(theirs, (F.col("m") == F.col("im")) & (F.col("hash") == F.col("ih")))
    places = met.groupBy(*_KEY, "no", "k", "size", "last").agg(F.array_sort(F.collect_list(F.col("lo") + F.col("i"))).alias("at"))
    # shared / (mine + theirs - shared) reaches the threshold
    need = F.ceil((F.col("size") + F.col("m") - 2 * (F.col("k") - 1)) * F.lit(threshold / (1 + threshold)) - 1e-9).cast("int")
    places = places.withColumn("need", F.greatest(need, F.lit(1))).where(F.size("at") >= F.col("need"))

    def starts(i: Column) -> Column:
        """Of the windows whose first place is the i-th: those that reach the last place needed."""
        low = F.greatest(F.coalesce(F.get("at", i - 1) + 1, F.col("lo")), F.get("at", i + F.col("need") - 1) - (F.col("size") - F.col("k")), F.col("lo"))
        high = F.least(F.get("at", i), F.col("last"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    found = F.flatten(F.transform(_indexes(F.size("at") - F.col("need") + 1), starts))
    return places.select(*_KEY, "no", F.explode(found).alias("start"))


def _again(a: Column) -> Column:
    """A multiset without one of each of its members."""
    more = F.transform(F.array(F.array_sort(a)), lambda xs: F.filter(xs, lambda x, i: (i > 0) & (x == F.get(xs, i - 1))))
    return F.when(F.size(F.array_distinct(a)) == F.size(a), F.array().cast("array<string>")).otherwise(more[0])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger weights of two shingle lists, a shingle's weight being the times it occurs."""
    more_a, more_b = _again(a), _again(b)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    rest = F.aggregate(F.array_intersect(more_a, more_b), F.lit(0), lambda s, x: s + F.least(count(more_a, x), count(more_b, x)))
    both = F.size(F.array_intersect(a, b)) + rest
    return both / (F.size(a) + F.size(b) - both)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document and item found in it the best window (of equals the first): id_col, text_hash, item_id,
    start (in words, from 0), n_words, similarity."""
    items = written(benchmark_items(benchmark, item_id, item_text), "items")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("text"))
    areas = written(regions(rows, items, threshold), "regions")
    met = written(candidates(areas, items, threshold), "candidates")
    parts = areas.select(F.col("id").alias("aid"), F.col("th").alias("ath"), F.col("m").alias("am"), F.col("lo").alias("alo"), "k", "size", F.col("words").alias("area"))
    met = met.join(parts, F.col("id").eqNullSafe(F.col("aid")) & (F.col("th") == F.col("ath")) & (F.col("m") == F.col("am")) & (F.col("lo") == F.col("alo")))
    met = met.select("id", "th", "m", "k", "size", "start", "no", _shingles(F.slice("area", F.col("start") - F.col("lo") + 1, F.col("size")), F.col("k")).alias("mine"))
    theirs = items.select("item", F.col("no").alias("tno"), _shingles(F.col("words"), F.col("k")).alias("theirs"))
    pairs = met.join(theirs, F.col("no") == F.col("tno"))
    pairs = pairs.select("id", "th", "item", "start", "size", weighted_similarity(F.col("mine"), F.col("theirs")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = pairs.groupBy("id", "th", "item").agg(F.max_by(F.struct("start", "size", "similarity"), F.struct("similarity", -F.col("start"))).alias("w"))
    return best.select(F.col("id").alias(id_col), F.col("th").alias("text_hash"), F.col("item").alias("item_id"), F.col("w.start").alias("start"), F.col("w.size").alias("n_words"), F.col("w.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found; columns as they were."""
    found = written(contaminated(docs, benchmark, id_col, text_col, **options), "found")
    gone = found.select(F.col(id_col).alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    same = docs[f"`{id_col}`"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == gone["_gone_hash"])
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")
