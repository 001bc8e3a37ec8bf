"""The prefix trie against one that is walked node by node."""

import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie as trie
from tidemark.llm import queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(rows):
    """Each conversation's (role, text), in order; rows: (conv, turn, role, text)."""
    said = {}
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=order):
        said.setdefault(c, []).append((role or "", text or ""))
    return said


def walked(paths):
    """The same by building each node's set of members."""
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    below = {k: [x for x in nodes if x[: len(k)] == k] for k in nodes}
    leaf = {k for k in nodes if len(below[k]) == 1}
    out = []
    for k, members in nodes.items():
        ends = sorted(c for c in members if len(paths[c]) == len(k))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below[k] if x)
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), parent, len(members), sum(len(x) == len(k) + 1 for x in below[k]), sum(x in leaf for x in below[k]), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def some_rows(rng, convs, longest):
    rows = []
    for c in convs:
        for d in range(rng.randrange(longest + 1)):
            rows.append((c, rng.choice([d, d, d, None, 0]), rng.choice(["user", "user", "assistant", None, ""]), rng.choice(["a", "a", "a", "bb", "Ünï🙂", "", None])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, d string, key string"


def own_trie(table, rows):
    turns = trie.ordered_turns(table(SCHEMA, [(*r, "clash", "clash") for r in rows]), "conv_id", "turn", "role", "text")
    return trie.prefix_trie(turns.select("c").distinct(), turns)


def test_trie_is_the_walked_one(table):
    rng = random.Random(5)
    rows = some_rows(rng, [*range(-30, 60), 10**12], 5) + [(None, 0, "user", "lost"), (7, 3, "user", "twice"), (7, 3, "user", "twice"), (8, 1, "user", "long " * 50_000)]
    assert made(own_trie(table, rows)) == walked(turns_of(rows))
    assert own_trie(table, []).collect() == []
    assert made(own_trie(table, [(4, None, None, None)])) == walked({4: [("", "")]})


def test_long_conversations_and_wide_nodes_are_put_together_from_parts(table, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "CHILDREN", 2)
    rng = random.Random(9)
    rows = some_rows(rng, range(40), 4) + [(c, d, "user", f"x{d}") for c in (3, 90, 91, 92) for d in range(10, 40 - c % 7)] + [(200 + c, 0, "user", f"first {c}") for c in range(12)]
    assert made(own_trie(table, rows)) == walked(turns_of(rows))


def test_grafted_conversations(table, spark):
    rng = random.Random(2)
    rows = some_rows(rng, [*range(0, 330, 7), 100, 205, 206, -7, -150], 8)
    said = turns_of(rows)
    want = {}
    for c in said:
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100 if c > 0 else -(abs(c) % 100))
        want[c] = said.get(base, [])[:h] + said[c][h:]
    assert any(not p for p in want.values())
    turns = trie.ordered_turns(table(SCHEMA, [(*r, "", "") for r in rows]), "conv_id", "turn", "role", "text")
    c = F.col("c")
    got = trie.prefix_trie(*trie.grafted(turns, 5, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6))
    assert made(got) == walked(want)


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert made(queries.op12_prefix_trie(spark, sf)) == sorted((tuple(r) for r in con.execute(f"select {', '.join(COLUMNS)} from ({queries.OP12_SQL})").fetchall()), key=repr)
