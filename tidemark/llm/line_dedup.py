"""Line dedup: overlapping three-line windows, repeated ones removed but for their first occurrence.

Every run of three consecutive lines is hashed to 128 bits. A window that occurs more than once
anywhere keeps its first occurrence, in the order of (doc_id, text hash, position); the lines covered by any
later occurrence go. Covered positions of overlapping windows are merged, so a repeated passage of
any length from three lines up goes as a whole.

Cases: a null text stays null and has no lines. A text of fewer than three lines, the empty text
included, has no window and stays. A null doc_id comes after all others. Rows that share both doc_id
and text count as one document: they don't remove lines from each other, though a window that repeats
inside one row keeps only its first place there. Different texts are different documents, whatever
their ids. A text whose lines all go becomes "".
Columns of the input stay as they are, whatever they are called; the results win a name clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``docs`` with repeated windows cut out of ``text_col``, plus ``n_lines`` and ``n_removed``."""
    base = docs.select(
        packed(docs),
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("th"),
        F.split(F.col(f"`{text_col}`"), "\n", -1).alias("lines"),
    )
    spans = F.filter(F.sequence(F.lit(0), F.greatest(F.size("lines") - window, F.lit(0))), lambda i: i <= F.size("lines") - window)

    def hashed(i: F.Column) -> F.Column:
        parts = [F.get(F.col("lines"), i + k) for k in range(window)]
        return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(window), *parts).alias("b"), i.alias("pos"))

    def repeats(x: F.Column, i: F.Column) -> F.Column:
        before = F.get(F.col("wins"), i - 1)
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), x["pos"].alias("pos"), F.coalesce((before["a"] == x["a"]) & (before["b"] == x["b"]), F.lit(False)).alias("again"))

    # sorted by hash, so that a window's later places inside its own text are next to the first
    wins = base.where(F.size("lines") >= window).select("id", "th", F.array_sort(F.transform(spans, hashed)).alias("wins"))
    seen = wins.select("id", "th", F.explode(F.transform("wins", repeats)).alias("w")).select("id", "th", "w.a", "w.b", "w.pos", "w.again")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    first = seen.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # joined on one of the two hashes, so that both sides are exchanged for the join and a hot window's rows can be split
    first = first.select(F.col("a").alias("fa"), F.col("b").alias("fb"), "first")
    later = (
        seen.join(first, (F.col("a") == F.col("fa")) & (F.col("b").bitwiseXOR(F.col("fb")) == 0))
        .where(F.col("again") | (place > F.col("first")))
        .groupBy("id", "th")
        .agg(F.collect_set("pos").alias("starts"))
        .select(F.col("id").alias("did"), F.col("th").alias("dth"), "starts")
    )
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (window - 1)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    out = base.join(later.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("dth")), "left")
    out = out.select(
        "rec",
        F.when(F.col("starts").isNull(), F.col(f"rec.`{text_col}`")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size(covered)).alias("n_removed"),
    )
    new = {text_col: "text", "n_lines": "n_lines", "n_removed": "n_removed"}
    cols = [F.col(new[c]).alias(c) if c in new else F.col(f"rec.`{c}`") for c in docs.columns]
    return out.select(*cols, *[c for c in ("n_lines", "n_removed") if c not in docs.columns])
