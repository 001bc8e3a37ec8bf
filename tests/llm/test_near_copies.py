"""Near-dedup at five words and 0.8 against brute force over all pairs."""

import random

import corpus_pipeline
from tidemark.llm import near_copies
from tidemark.llm.near_copies import copy_dedup


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def kept_brute(docs):
    """docs: (id, text) with distinct ids; the smallest id of each component."""
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted({find(i) for i in root})


def texts(rng):
    words = [f"w{i}" for i in range(40)]
    shared = [rng.choice(words) for _ in range(12)]  # a passage of every text
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 300))] + shared
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    for n in (5, 9, 13, 14, 60, 104):  # a text and its beginning, about the threshold
        base = [f"{n}x{i}" for i in range(n)]
        out += [" ".join(base), " ".join(base[: n - (n - 4) // 5]), " ".join(base[: n - (n - 4) // 5 - 1])]
    return [*out, None, "", "  ", "alone", "ALONE"]


def test_pairs_at_the_threshold_are_brute_force(table, monkeypatch):
    docs = list(enumerate(texts(random.Random(2)), start=10))
    want = kept_brute(docs)
    df = table("doc_id long, text string, root string", [(i, t, "r") for i, t in docs])
    for least in (8, 10**9):  # with frequent shingles last, and without
        monkeypatch.setattr(near_copies, "FREQUENT", least)
        out = copy_dedup(df)
        assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == want


def test_odd_rows(table):
    rows = [(None, "a b", "x"), (None, "a b", "x"), (3, "a b", None), (3, "a b", None), (None, "only here", "y")]
    df = table("doc_id long, text string, root string", rows)
    assert sorted(((r.doc_id, r.text) for r in copy_dedup(df).collect()), key=repr) == sorted([(3, "a b"), (None, "only here")], key=repr)
    assert copy_dedup(df.where("false")).collect() == []


def test_stage_takes_copies_beyond_four_bits(spark, table):
    """Similarity 0.8 and more, while SimHash is further than 4 bits off."""
    from tidemark.llm.simhash import fingerprint

    rng, docs = random.Random(5), []
    for k in range(20):
        base = [f"v{rng.randrange(5000)}" for _ in range(200)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:180]))]
    assert any(bin(fingerprint(docs[k][1]) ^ fingerprint(docs[k + 1][1])).count("1") > 4 for k in range(0, 40, 2))
    out = corpus_pipeline.near_dedup(spark, table("doc_id long, text string", docs), "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 40, 2))


def test_filter_hides_no_partner(table):
    from pyspark.sql import functions as F

    from tidemark.llm.hash_bits import may_be_among

    few = table("v long", [(k * k,) for k in range(300)] + [(None,)])
    all_rows = table("x long", [(k,) for k in range(20_000)] + [(None,)])
    hit = {r.x for r in all_rows.where(may_be_among(F.col("x"), few)).collect()}
    assert {k * k for k in range(142)} <= hit and len(hit) < 2000
    assert all_rows.where(may_be_among(F.col("x"), few.where("false"))).count() == 0


def test_simhash_finds_close_copies_by_itself(spark, table, monkeypatch):
    """Pairs within four bits are met by fingerprints, also where prefixes find nothing."""
    from pyspark.sql import functions as F

    from tidemark.llm.simhash import fingerprint

    rng, docs, close = random.Random(6), [], 0
    for k in range(12):
        base = [f"v{rng.randrange(5000)}" for _ in range(400)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:-1], "end"]))]
        close += bin(fingerprint(docs[-2][1], 5) ^ fingerprint(docs[-1][1], 5)).count("1") <= 4
    assert close > 6
    monkeypatch.setattr(near_copies, "_possible", lambda a, b, similarity: F.lit(False))
    out = corpus_pipeline.near_dedup(spark, table("doc_id long, text string", docs), "")
    assert out.count() == 24 - close


def test_what_is_frequent_does_not_grow_with_the_input(spark):
    from pyspark.sql import functions as F

    for n in (4_000, 80_000):
        docs = spark.range(n).select(F.format_string("w%d p q r s u%d", F.floor(F.col("id") / 40), "id").alias("text"))
        tables = near_copies.frequent_shingles(docs, "text", 5)
        shared = near_copies.np.concatenate([near_copies.shingle_set(f"w{k} p q r s") for k in range(n // 40)])
        assert (near_copies._late(shared, tables) > 0).mean() > 0.75
        alone = near_copies.np.concatenate([near_copies.shingle_set(f"p q r s u{k}") for k in range(1000)])
        assert (near_copies._late(alone, tables) > 0).mean() < 0.2


def test_no_exploded_rows_are_broadcast(table, monkeypatch, capsys):
    """Rows of prefixes and the tables that they meet are merged, however small Spark takes them to be."""
    plans, written = {}, near_copies.written

    def noted(df, name):
        df.explain()
        plans[name] = capsys.readouterr().out
        return written(df, name)

    monkeypatch.setattr(near_copies, "written", noted)
    docs = [(k, " ".join(f"w{k // 2}x{i}" for i in range(40 + k % 2))) for k in range(20)]
    assert sorted(r.doc_id for r in copy_dedup(table("doc_id long, text string", docs)).collect()) == list(range(0, 20, 2))
    for name in ("met", "close", "led", "left", "mixed", "pairs"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name], name
