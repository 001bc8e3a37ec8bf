"""Chat formatting of reply trees.

Messages point at the message they reply to. Iterative self-joins double the reach of each message's
pointer (parent, grandparent, ...), so a thread of depth d takes log2(d) joins; the same pointers then
unfold every leaf into its path to the root. Paths of a tree are ranked by score and each chosen path
becomes one conversation.

Template: a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. A control string inside a role or text is
broken by a backslash after its first character; one that already holds backslashes there gets one
more, so reading removes exactly one and every text comes back as it was. In roles backslashes and
line ends are written ``\\b`` and ``\\n`` first.

Cases: a null role or text is read as empty. A message whose parent is null or missing is a root.
Messages in a cycle have no root and no path. Of rows with the same tree and node the one that is
smallest by (parent, role, text, score) counts. A null tree id is a tree like any other. A null score
counts as 0. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import same, written

#: Strings that tokenizers commonly treat as control marks.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>\n"
_TAILS = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROL)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_TAILS})", "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) from ``nodes`` (tree, node, parent): each leaf's path, up counting from the leaf."""
    known = nodes.select(F.col("tree").alias("kt"), F.col("node").alias("kn"))
    hop = nodes.join(known, same(F.col("tree"), F.col("kt")) & (F.col("parent") == F.col("kn"))).select("tree", "node", F.col("kn").alias("to"))
    hops = [written(hop, "hops")]
    size = hops[0].count()
    # hops that land nowhere are left out; one of 2^k beyond the number of nodes that lands somewhere runs in a cycle
    while hops[-1].limit(1).count() and 1 << (len(hops) - 1) <= size:
        last = hops[-1]
        onward = last.select(F.col("tree").alias("ot"), F.col("node").alias("on"), F.col("to").alias("far"))
        hop = last.join(onward, same(F.col("tree"), F.col("ot")) & (F.col("to") == F.col("on")))
        hops.append(written(hop.select("tree", "node", F.col("far").alias("to")), "hops"))
    cyclic = hops[-1].select(F.col("tree").alias("ct"), F.col("node").alias("cn"))
    parents = nodes.where("parent is not null").select(F.col("tree").alias("pt"), F.col("parent").alias("pn"))
    leaves = nodes.join(parents, same(F.col("tree"), F.col("pt")) & (F.col("node") == F.col("pn")), "left_anti")
    leaves = leaves.join(cyclic, same(F.col("tree"), F.col("ct")) & (F.col("node") == F.col("cn")), "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(hops) - 1)):
        step = hops[k].select(F.col("tree").alias("st"), F.col("node").alias("sn"), "to")
        further = paths.join(step, same(F.col("tree"), F.col("st")) & (F.col("node") == F.col("sn")))
        paths = paths.union(further.select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up")))
        paths = written(paths, "paths") if k % 3 == 0 else paths
    return paths


def format_trees(messages: DataFrame, best: int | None = None, learn: str = "assistant") -> DataFrame:
    """One row per chosen root-to-leaf path of ``messages`` (tree, node, parent, role, text, score):

    tree, leaf, branch (1 for the highest mean score; ties go to the smaller leaf), n_turns,
    formatted, and loss_spans: for each turn of role ``learn``, start (from 1) and length in
    characters of its escaped text in ``formatted``. ``best`` keeps that many branches of a tree.
    """
    messages = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    first = F.row_number().over(Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score"))
    messages = written(messages.where("node is not null").withColumn("_first", first).where("_first = 1").drop("_first"), "messages")
    paths = leaf_paths(messages.select("tree", "node", "parent"))
    said = messages.select(F.col("tree").alias("mt"), F.col("node").alias("mn"), "role", "text", "score")
    turns = paths.join(said, same(F.col("tree"), F.col("mt")) & (F.col("node") == F.col("mn")))
    turns = turns.select("tree", "leaf", "up", "role", "score", F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    long = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(long).over(before), F.lit(0)) + F.length("head") + 1)
    turn = F.struct("start", F.concat("head", "body", F.lit(END)).alias("piece"), F.length("body").cast("long").alias("length"), (F.col("role") == learn).alias("learnt"))
    out = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.avg("score").alias("score"))
    branch = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    out = out.withColumn("branch", branch)
    out = out.where(F.col("branch") <= best) if best is not None else out
    spans = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return out.select("tree", "leaf", "branch", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.piece"), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    whole = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turn(part: Column) -> Column:
        bare = F.substring(part, F.lit(len(START) + 1), F.length(part))
        role = F.substring_index(bare, "\n", 1)
        return F.struct(_role_in(role).alias("role"), unescape(F.substring(bare, F.length(role) + 2, F.length(bare))).alias("text"))

    return F.transform(F.slice(whole, F.lit(1), F.size(whole) - 1), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")


def thread_messages(rows: DataFrame, tree: str, order: str, role: str, text: str) -> DataFrame:
    """Conversations kept as numbered turns, as trees without branches; ties of ``order`` go by role and text."""
    at = F.row_number().over(Window.partitionBy(f"`{tree}`").orderBy(F.col(f"`{order}`"), F.col(f"`{role}`"), F.col(f"`{text}`")))
    out = rows.select(F.col(f"`{tree}`").alias("tree"), at.cast("long").alias("node"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    return out.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
