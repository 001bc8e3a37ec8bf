"""The prefix trie of many conversations: every shared beginning once, with what sharing it saves.

A node is a distinct sequence of first turns. Nobody walks the trie: a node is a group of rows, one for
each conversation that passes through it (a member), told apart by a digest of the path so far. The
node is owned by its smallest member. Whoever owns a node owns all nodes further down its own path that
it passes through, so that what a conversation owns is a suffix of its path and one number (the depth
where it begins) says all about it. From there everything is a sum over members:

- a child is owned by one member, so children are the members whose next node is owned by themselves;
- a leaf is owned by one conversation, so leaves below a node are its members that own a leaf;
- tokens saved below a node are those of all its members' turns from there on, less those of the nodes
  that they own.

Digests of paths are running sums: each turn at its depth is hashed (MD5) into four numbers of 32 bits,
and a path's digest is that of the sums. Sums can be put together from blocks of BLOCK turns, so that a
conversation of any length is spread over tasks, and so is the order of its turns (by ranges of the
sorted table). Groups by path are pre-aggregated where the rows are. A parent's owner is looked up only
where a conversation's own suffix begins; nodes with over a thousandth of all nodes as children (a
thousand at most) are sent to all tasks for that, others are joined.

Cases: null role and text are empty. Rows without a conversation are in none and left out. Null turns
come first; rows of one turn are ordered by the MD5 of role and text, and equal rows follow each other.
Texts of any length are hashed where they lie and don't move. An empty table gives an empty trie.
Working columns are the operator's own; other columns of the caller's are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Turns of one conversation that are summed in one go.
BLOCK = 1024
#: A node with more children than this, and than a thousandth of all nodes, is looked up by broadcast.
CHILDREN = 1000
_LANES = ["s0", "s1", "s2", "s3"]


def ordered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, d, digest, n): each conversation's turns numbered from 1, the MD5 of role and text, and the text's code points."""
    who, said = (F.coalesce(F.col(f"`{x}`"), F.lit("")) for x in (role, text))
    slim = rows.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("c"),
        F.col(f"`{turn}`").alias("t"),
        F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary"))).alias("digest"),
        F.length(said).cast("long").alias("n"),
        F.monotonically_increasing_id().alias("at"),
    )
    by = ["c", "t", "digest", "at"]
    placed = written(slim.repartitionByRange(*by).sortWithinPartitions(*by).select("c", "digest", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "turns")
    starts = placed.groupBy("c", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first"))
    before = F.sum("rows").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("c", "part", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return placed.join(starts, ["c", "part"]).select("c", (F.col("seq") + F.col("shift")).alias("d"), "digest", "n")


def _running(rows: DataFrame, sums: list[str]) -> DataFrame:
    """Running sums of ``sums`` along each conversation, put together from blocks of its turns."""
    blocks = rows.withColumn("block", F.floor(F.col("d") / BLOCK))
    inner = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("c", "block").agg(*[F.sum(s).alias(s) for s in sums])
    offsets = totals.select("c", "block", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums])
    within = blocks.withColumns({f"{s}_to": F.sum(s).over(inner) for s in sums})
    return within.join(offsets, ["c", "block"]).select("*", *[(F.col(f"{s}_to") + F.col(f"{s}_before")).alias(f"{s}_path") for s in sums])


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *lanes).cast("binary")))


def _paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth, the root's included: key and parent of its node, code points of the turn and before it, and where the path ends."""
    mixed = F.md5(F.concat(F.col("d").cast("string"), F.lit(":"), F.hex("digest")).cast("binary"))
    lanes = [F.conv(F.substring(mixed, 1 + 8 * k, 8), 16, 10).cast("long").alias(s) for k, s in enumerate(_LANES)]
    roots = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("n"), *[F.lit(0).cast("long").alias(s) for s in _LANES])
    rows = turns.select("c", "d", "n", *lanes).unionByName(roots)
    ends = rows.groupBy("c").agg(F.max("d").alias("end"), F.sum("n").alias("all"))
    run = _running(rows, ["n", *_LANES]).join(ends, "c")
    return run.select(
        "c",
        F.col("d").alias("depth"),
        "end",
        "all",
        (F.col("n_path") - F.col("n")).alias("before"),
        _key(F.col("d"), [F.col(f"{s}_path") for s in _LANES]).alias("key"),
        F.when(F.col("d") > 0, _key(F.col("d") - 1, [F.col(f"{s}_path") - F.col(s) for s in _LANES])).alias("parent"),
    )


def _ends(paths: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ids that end at a node, ascending and joined by commas.

    Ids are sorted and joined by ranges, however many end at one node; what meets for a node's digest is
    text of up to a batch of ids a row, in order, which is hashed as it comes and never held.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            run = (batch["key"] != batch["key"].shift()).cumsum()
            some = batch.groupby(run.to_numpy(), sort=False).agg(key=("key", "first"), least=("c", "first"), ids=("c", lambda x: ",".join(map(str, x))))
            yield pd.DataFrame({"key": some["key"].to_numpy(object), "least": some["least"].to_numpy("int64"), "ids": pd.Series(some["ids"].tolist(), dtype=object)})

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hashed = None, hashlib.sha256()
        for batch in batches:
            done = []
            for k, ids in zip(batch["key"], batch["ids"], strict=True):
                if k == key:
                    hashed.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((key, hashed.hexdigest()))
                key, hashed = k, hashlib.sha256(ids.encode())
            yield pd.DataFrame({"key": pd.Series([k for k, _ in done], dtype=object), "ends": pd.Series([x for _, x in done], dtype=object)})
        if key is not None:
            yield pd.DataFrame({"key": pd.Series([key], dtype=object), "ends": pd.Series([hashed.hexdigest()], dtype=object)})

    last = paths.where("depth = end").select("key", "c")
    pieces = last.repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInPandas(join, "key binary, least long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "least").mapInPandas(digest, "key binary, ends string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` (c): all conversations, each once; ``turns`` (c, d, digest, n) as from ``ordered_turns``,
    each conversation's depths running from 1 without gaps. A conversation without turns ends at the root.
    """
    paths = written(_paths(convs, turns), "paths")
    groups = paths.groupBy("key").agg(F.min("c").alias("c"), F.any_value("depth").alias("depth"), F.any_value("before").alias("before"), F.count(F.lit(1)).alias("members"), F.count_if(F.col("depth") == F.col("end")).alias("ending"))
    owners = groups.groupBy("c").agg(F.min("depth").alias("owns"), F.min_by("before", "depth").alias("kept"), F.max((F.col("members") == F.col("ending")).cast("int")).alias("leaf"))

    marked = paths.join(owners, "c", "left")
    # what follows the turns before this one, up to the first node of its own
    saved = F.greatest(F.coalesce("kept", "all") - F.col("before"), F.lit(0))
    nodes = marked.groupBy("key").agg(
        F.min("c").alias("conv_id"),
        F.any_value("depth").alias("depth"),
        F.any_value("parent").alias("parent"),
        F.coalesce(F.max(F.col("depth") == F.col("owns")), F.lit(False)).alias("begins"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if((F.col("depth") < F.col("end")) & (F.col("depth") + 1 >= F.col("owns"))).alias("n_children"),
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"),
    )
    nodes = written(nodes, "nodes")

    begun = nodes.where("begins and depth > 0").select("key", "parent")
    over = max(CHILDREN, nodes.count() // 1000)
    named = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    wide = F.broadcast(named.where(F.col("n_children") > over).drop("n_children"))
    above = begun.join(wide, "parent").select("key", "parent_conv_id").union(
        begun.join(wide, "parent", "left_anti").join(named.where(F.col("n_children") <= over), "parent").select("key", "parent_conv_id")
    )
    own = F.when((F.col("depth") > 0) & ~F.col("begins"), F.col("conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.join(above, "key", "left").join(_ends(paths), "key", "left")
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", own).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"))


def grafted(turns: DataFrame, heads: int, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """(convs, turns) with each conversation c begun by the first ``taken`` turns of conversation ``base`` in place of its own.

    Both are columns over c; ``taken`` is ``heads`` at most. A base with fewer turns gives all it has, an
    absent one none. Bases are taken to serve a bounded number of conversations each.
    """
    turns = written(turns, "ordered")
    lengths = turns.groupBy("c").agg(F.max("d").alias("length"))
    plan = lengths.select("c", base.alias("base"), taken.cast("long").alias("h"))
    plan = plan.join(lengths.select(F.col("c").alias("base"), F.col("length")), "base", "left")
    plan = written(plan.select("c", "base", "h", F.least(F.col("h"), F.coalesce("length", F.lit(0))).alias("k")), "grafts")
    first = turns.where(F.col("d") <= heads).select(F.col("c").alias("base"), "d", "digest", "n")
    begun = plan.join(first, "base").where("d <= h").select("c", "d", "digest", "n")
    rest = turns.join(plan.select("c", "h", "k"), "c").where("d > h").select("c", (F.col("d") - F.col("h") + F.col("k")).alias("d"), "digest", "n")
    return plan.select("c"), begun.union(rest)
