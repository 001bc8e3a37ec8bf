"""Line dedup and SimHash near-dedup against brute force, and their odd inputs."""

import random

import xxhash
from pyspark.sql import functions as F

from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.simhash import RADIUS, fingerprint, simhash_classes, simhash_dedup

DOCS = "doc_id long, text string, lang string, n_lines int, rec string"


def dedup_brute(docs, window=3):
    """docs: (id, text) with distinct ids, in any order; texts without the later occurrences of windows."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        if text is None:
            out[i] = None
            continue
        lines, gone = text.split("\n"), set()
        for p in range(len(lines) - window + 1):
            w = tuple(lines[p : p + window])
            if w in seen:
                gone |= set(range(p, p + window))
            seen.add(w)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_line_dedup_is_brute_force(table):
    rng = random.Random(1)
    docs = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "x\n" * 400), (104, "unique line one")]
    got = {r.doc_id: r.text for r in line_dedup(table(DOCS, [(i, t, "en", 7, "r") for i, t in docs])).collect()}
    assert got == dedup_brute(docs)


def test_line_dedup_keeps_columns_and_rows(table):
    rows = [(None, "a\nb\nc", "en", 1, "x"), (5, "a\nb\nc", None, 1, None), (5, "a\nb\nc", None, 1, None), (6, None, "en", 1, "x")]
    df = table(DOCS, rows)
    out = line_dedup(df)
    assert out.columns == ["doc_id", "text", "lang", "n_lines", "rec", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=repr)
    # repeated rows of one id don't cut each other; a missing id comes last
    assert got == sorted([(5, "a\nb\nc", 3, 0), (5, "a\nb\nc", 3, 0), (6, None, 0, 0), (None, "", 3, 3)], key=repr)
    assert line_dedup(df.where("false")).collect() == []


def test_line_dedup_tells_texts_of_one_id_apart(table):
    """A passage that only rows without an id (or of one id) share stays in one of them."""
    for i in (None, 5):
        out = line_dedup(table(DOCS, [(i, f"{x}\na\nb\nc", "en", 1, "x") for x in "pqr"])).collect()
        assert sorted(r.n_removed for r in out) == [0, 3, 3]


def fingerprint_brute(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \n", "One", "a b c", "A É ß x y z", "the quick brown fox " * 50, "\x1c\x85 a", "x" * 100_000):
        assert fingerprint(text) == fingerprint_brute(text)


def near_texts(rng):
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 400))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return [*texts, None, "", "  ", "alone"]


def components_brute(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= RADIUS:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in prints}


def test_components_are_brute_force(table):
    docs = list(enumerate(near_texts(random.Random(2)), start=10))
    want = components_brute({i: fingerprint_brute(t) for i, t in docs})
    got = simhash_classes(table("doc_id long, text string", docs)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{fingerprint_brute(t):016x}" for i, t in docs}


def test_components_chain_beyond_the_radius(spark, table):
    """A chain whose ends are far apart is one component."""
    from tidemark.llm.simhash import near_classes

    chain = [(1 << 4 * k) - 1 for k in range(16)]
    prints = table("id long, fp long", [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(chain)])
    assert {r.component_id for r in near_classes(prints).collect()} == {0}


def test_dedup_keeps_one_of_each_group(table):
    docs = list(enumerate(near_texts(random.Random(4)), start=10))
    want = set(components_brute({i: fingerprint_brute(t) for i, t in docs}).values())
    df = table("doc_id long, text string, root string", [(i, t, "r") for i, t in docs])
    out = simhash_dedup(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)
    rows = [(None, "a b", "x"), (None, "a b", "x"), (3, "a b", None), (3, "a b", None)]
    assert [r.doc_id for r in simhash_dedup(table("doc_id long, text string, root string", rows)).collect()] == [3]
    assert simhash_dedup(df.where("false")).collect() == []
    assert simhash_classes(df.where("false")).collect() == []


def test_no_growing_table_is_broadcast(spark, table, monkeypatch, capsys):
    """Exploded rows and the fingerprints are merged, however small Spark takes them to be."""
    from tidemark.llm import simhash

    for f in (simhash.meetings, lambda t: simhash.led_pairs(t, t.selectExpr("0L as key", "fp", "fp as lo", "-fp as hi"))):
        with monkeypatch.context() as m:
            m.setattr(simhash, "written", lambda df, name: df)
            f(simhash.pivot_table(spark.range(100).selectExpr("id as fp", "id as lead"))).explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # a table as the last join meets it
    docs = table("doc_id long, text string", [(k, f"a{k} b c d e") for k in range(50)])
    simhash_classes(docs).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
