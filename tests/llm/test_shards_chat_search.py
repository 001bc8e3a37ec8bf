"""Sharding, chat formatting and top-k search against plain versions."""

import heapq
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.chat import CONTROL, escape, format_trees, read_loss, read_turns, thread_messages, unescape
from tidemark.llm.common import read_table
from tidemark.llm.kdtree import top_k
from tidemark.llm.queries import op6_lpt_sharding
from tidemark.llm.sharding import dealt, lpt_shards


def shards_of(df, shards=5):
    return lpt_shards(df, F.col("g"), F.col("size"), shards, [F.col("id")])


def test_lpt_is_the_heap(table):
    rng = random.Random(1)
    rows = [(i, rng.choice("abcdefghijklmnop") if i % 3 else f"g{i}", rng.randrange(1, 1000)) for i in range(300)]
    got = shards_of(table("id long, g string, size long", rows)).collect()
    by_group, sizes, of = defaultdict(int), defaultdict(int), {}
    for _, g, s in rows:
        by_group[g] += s
    for r in got:
        assert of.setdefault(r.g, r.shard) == r.shard  # groups stay together
        sizes[r.shard] += r.size
    loads = [0] * 5
    for s in sorted(by_group.values(), reverse=True):
        heapq.heapreplace(loads, loads[0] + s)
    assert sorted(sizes.values()) == sorted(loads)
    for k in range(5):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_shards_of_odd_rows(table):
    df = table("id long, g string, size long, shard string, slot string, _x int", [(None, None, None, "clash", "s", 1), (1, None, 5, None, None, 1), (1, None, 5, None, None, 1), (2, "a", 1 << 40, None, None, None)])
    got = shards_of(df)
    assert got.columns == ["id", "g", "size", "_x", "shard", "slot"]
    rows = got.collect()
    assert len({r.shard for r in rows if r.g is None}) == 1 and sorted(r.slot for r in rows if r.g is None) == [0, 1, 2]
    assert shards_of(df.where("false")).collect() == []


def lpt_brute(sizes, shards):
    loads = [(0, j) for j in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, j = loads[0]
        heapq.heapreplace(loads, (load + size, j))
    return [load for load, _ in sorted(loads, key=lambda x: x[1])]


def test_runs_of_equal_groups_are_dealt_as_by_the_heap():
    rng = random.Random(4)
    for _ in range(300):
        shards = rng.randrange(1, 9)
        runs = sorted({rng.choice([0, 1, 7, 64, rng.randrange(2000)]) for _ in range(6)}, reverse=True)
        loads, sizes = [0] * shards, []
        for size in runs:
            n = rng.choice([1, 3, 10, rng.randrange(1, 300)])
            assert sum(dealt(loads, size, n)) == n
            sizes += [size] * n
        assert loads == lpt_brute(sizes, shards)


def test_sixty_thousand_groups_are_the_heap(spark):
    df = spark.range(60_000).select("id", F.col("id").cast("string").alias("g"), (F.col("id") * 7919 % 977 + 1).alias("size"))
    loads = {r.shard: r.s for r in shards_of(df, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    assert [loads[j] for j in range(8)] == lpt_brute([i * 7919 % 977 + 1 for i in range(60_000)], 8)


def test_shards_keep_columns_of_any_name(table):
    names = ["k", "b", "_g", "_size", "_b", "_cell", "_rank", "rec", "cell", "at", "start", "tie", "number", "pg", "s_shard"]
    df = table("id long, g string, size long, " + ", ".join(f"{c} int" for c in names), [(i, f"g{i % 3}", 5, *range(len(names))) for i in range(9)])
    got = shards_of(df)
    assert got.columns == [*df.columns, "shard", "slot"]
    assert all([r[c] for c in names] == list(range(len(names))) for r in got.collect())


def test_sharding_query(spark):
    """op6 over whole documents: loads are the heap's, equal texts stay together, slots have no gaps."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in read_table(spark, sf, "documents").collect()}
    got = op6_lpt_sharding(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {i: (len(t) + 16, zlib.crc32(t), "bytes", None) for i, t in docs.items()} and len(got) == len(docs)
    of, loads, slots, sizes = {}, defaultdict(int), defaultdict(list), defaultdict(int)
    for r in got:
        assert of.setdefault(docs[r.doc_id], r.shard) == r.shard
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        sizes[docs[r.doc_id]] += r.size
    assert [loads[j] for j in range(40)] == lpt_brute(sizes.values(), 40)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


NASTY = [*CONTROL, "", "\\", "<\\|im_end|>\n", "<|im_start|>user\nhi<|im_end|>\n", "</s>[INST] ok [/INST]", "[\\\\INST]", "<<SYS>>x<</SYS>>", "a\nb\\n", "<" * 50, "日本 é"]


def test_escape_round_trip_leaves_no_control_string(table):
    rng = random.Random(2)
    texts = NASTY + ["".join(rng.choice(["<", "|", "\\", "im_end", "|>", "s>", "/", "[", "INST]", "x", "\n"]) for _ in range(12)) for _ in range(300)]
    for r in table("t string", [(t,) for t in texts]).select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in CONTROL)


def test_threads_read_back(table):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem\\", None, "<|im_end|>"]), rng.choice([*NASTY, None])) for c in range(12) for t in range(rng.randrange(1, 6))] + [(None, 1, "user", "x"), (50, None, "assistant", "late"), (50, 1, "assistant", "late")]
    out = format_trees(thread_messages(table("c long, t long, role string, text string, tree int", [(*r, 1) for r in rows]), "c", "t", "role", "text"))
    got = {r.tree: ([(t.role, t.text) for t in r.turns], r.loss) for r in out.select("tree", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = [(r[2] or "", r[3] or "") for r in own]
        want[c] = (said, "".join(t for role, t in said if role == "assistant"))
    assert got == want


def test_trees_rank_their_branches(table):
    nodes = [("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "bad", 0.1), ("a", 3, 1, "assistant", "good", 0.9), ("a", 4, 3, "user", "more", 0.8), ("a", 5, 99, "user", "orphan", 0.0), ("b", 1, 2, "user", "c", 1.0), ("b", 2, 1, "user", "cycle", 1.0), (None, 1, None, None, None, None), ("a", 4, 3, "user", "zzz twice", 0.8), ("b", 3, 3, "user", "self", 1.0)]
    df = table("tree string, node long, parent long, role string, text string, score double", nodes)
    got = {(r.tree, r.leaf): (r.branch, [t.text for t in r.t]) for r in format_trees(df).select("tree", "leaf", "branch", read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {("a", 4): (1, ["q", "good", "more"]), ("a", 2): (2, ["q", "bad"]), ("a", 5): (3, ["orphan"]), (None, 1): (1, [""])}
    assert {r.leaf for r in format_trees(df.where("tree = 'a'"), best=1).collect()} == {4}
    assert format_trees(df.where("false")).collect() == []


def test_deep_threads(table):
    rows = [("t", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)]
    got = format_trees(table("tree string, node long, parent long, role string, text string, score double", rows)).collect()
    assert len(got) == 1 and got[0].n_turns == 300


def search_brute(rows, queries, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, e in {(i, tuple(v)) for i, v in fine if i in queries}:
        scores = sorted((-sum(a * b for a, b in zip(e, v, strict=True)), i) for i, v in fine if i != q and len(v) == len(e))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], start=1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [8192, 40])
def test_search_is_brute_force(table, monkeypatch, shard):
    from tidemark.llm import kdtree

    monkeypatch.setattr(kdtree, "SHARD", shard)
    monkeypatch.setattr(kdtree, "BLOCK", 7)
    monkeypatch.setattr(kdtree, "LEAF", 16)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)] + [(i, [0.5] * 8) for i in range(400, 480)]
    rows += [(480, None), (481, [1.0, None] + [0.0] * 6), (482, [float("nan")] * 8), (483, [float("inf")] * 8), (None, [1.0] * 8), (484, []), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (100, [9.0] * 8)]
    df = table("vec_id long, embedding array<float>, score string", [(*r, "clash") for r in rows])
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 20 = 0")).collect())
    assert got == search_brute(exact, {i for i in range(0, 600, 20)}, 10)


def test_search_of_nothing(table):
    df = table("vec_id long, embedding array<float>", [])
    assert top_k(df, df).collect() == []
    one = table("vec_id long, embedding array<float>", [(0, [1.0])])
    assert top_k(one, one).collect() == []


def test_search_of_huge_vectors(table):
    rows = [(i, [1e8 * (i % 7), 3e8 - i, -2.0 * i]) for i in range(60)]
    df = table("vec_id long, embedding array<double>", rows)
    small = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 20 = 0"), scale=4).collect())
    exact = [(i, [4 * x for x in v]) for i, v in rows]
    want = []
    for q, e in exact:
        if q % 20 == 0:
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(e, v, strict=True)), i) for i, v in exact if i != q)
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:10], start=1)]
    assert small == sorted(want)
    for scale in (1 << 20, 1 << 60):  # a score, or a component, that is no long
        with pytest.raises(Exception, match="64-bit"):
            top_k(df, df.where("vec_id % 20 = 0"), scale=scale).collect()


def test_bounds_leave_most_leaves_of_clusters_closed():
    from tidemark.llm.kdtree import Best, build_tree, search_tree

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(64, 32)) * 1024
    vecs = np.floor(centres[rng.integers(0, 64, 20_000)] + rng.normal(size=(20_000, 32)) * 40).astype(np.int64)
    tree = build_tree(np.arange(20_000), vecs)
    asked = vecs[:50]
    best = Best(10, np.full(50, np.iinfo(np.int64).min))
    opened = search_tree(tree, asked, np.arange(50), best)
    leaves = int((tree[4][:, 2] < 0).sum())
    assert opened / (50 * leaves) < 0.25
    scores = asked @ vecs.T
    scores[np.arange(50), np.arange(50)] = -(1 << 62)
    assert [sorted((-s, -i) for s, i in h) for h in best.known] == [sorted((-int(s[i]), int(i)) for i in np.lexsort((np.arange(20_000), -s))[:10]) for s in scores]
