"""Vector codes against plain Lloyd rounds over whole numbers."""

import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import queries, vector_codes
from tidemark.llm.vector_codes import again, codebooks_sha256, compress, drifts, nearest, squares


def plain(vecs, ids, parts, entries, rounds):
    """(codes, errors, books) without bounds."""
    order = sorted(range(len(vecs)), key=lambda i: (ids[i] is None, ids[i] or 0, vecs[i].tolist()))
    cut = vecs.reshape(len(vecs), parts, -1)
    books = [cut[order[:entries], p].copy() for p in range(parts)]
    for turn in range(rounds + 1):
        dist = [squares(cut[:, p], books[p]) for p in range(parts)]
        code = np.array([d.argmin(1) for d in dist]).T
        if turn < rounds:
            for p in range(parts):
                for e in set(code[:, p].tolist()):
                    mine = cut[code[:, p] == e, p]
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(0)]
    return code, sum(d.min(1) for d in dist), books


numbers = st.integers(-40, 40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=60), st.lists(st.tuples(numbers, numbers), min_size=1, max_size=8), st.lists(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=8, max_size=8), max_size=4))
def test_bounds_never_change_a_code(rows, book, steps):
    rows, book = np.array(rows, np.int64), np.array(book, np.int64)
    code, upper, lower = nearest(rows, book)
    for step in steps:
        new = book + np.array(step[: len(book)], np.int64)
        code, upper, lower, _ = again(rows, new, code, upper, lower, *drifts(book, new))
        book = new
        dist = squares(rows, book)
        assert code.tolist() == dist.argmin(1).tolist()
        true = np.sqrt(dist[np.arange(len(rows)), code])
        assert (upper >= true).all()
        if len(book) > 1:
            dist[np.arange(len(rows)), code] = np.iinfo(np.int64).max
            assert (lower <= np.sqrt(dist.min(1).astype(float))).all()


def test_bounds_spare_most_scans():
    rng = np.random.default_rng(1)
    centres = rng.integers(-100_000, 100_000, (32, 4))
    rows = centres[rng.integers(0, 32, 20_000)] + rng.integers(-500, 500, (20_000, 4))
    code, upper, lower = nearest(rows, centres)
    new = centres + rng.integers(-200, 200, centres.shape)
    found, *_, scanned = again(rows, new, code, upper, lower, *drifts(centres, new))
    assert found.tolist() == squares(rows, new).argmin(1).tolist()
    assert scanned < len(rows) / 20


def test_rows_of_every_kind(table, monkeypatch):
    monkeypatch.setattr(vector_codes, "SCAN", 7)
    rng = np.random.default_rng(3)
    good = [(int(i) if i % 9 else None, (rng.integers(-3, 3, 6) / 4).tolist()) for i in rng.integers(-50, 50, 80)]
    good += [(1, [0.5] * 6)] * 5 + [(None, [1000.0, -1000.0, 0.0, 0.0, 1e-9, -1e-9])]
    bad = [(2, None), (3, [0.0, None, 0.0, 0.0, 0.0, 0.0]), (4, [math.nan] * 6), (-99, [math.inf] * 6), (-98, [-math.inf] + [0.0] * 5)]
    df = table("id long, emb array<double>, code string, rec int, v string", [(i, e, f"c{n}", n, None) for n, (i, e) in enumerate(good + bad)])
    vecs = np.array([[math.floor(16 * x) for x in e] for _, e in good], np.int64)
    for entries, rounds in ((10, 2), (1, 1), (200, 2), (5, 0)):
        got, books = compress(df, "emb", "id", parts=3, entries=entries, rounds=rounds, scale=16)
        code, error, want = plain(vecs, [i for i, _ in good], 3, entries, rounds)
        assert codebooks_sha256(books) == codebooks_sha256(want)
        rows = got.collect()
        assert len(rows) == len(good) and got.columns == ["rec", "code", "error"]
        assert {r.rec.rec: (r.rec.id, r.rec.code, list(bytes(r.code)), r.error) for r in rows} == {n: (i, f"c{n}", code[n].tolist(), int(error[n])) for n, (i, _) in enumerate(good)}


def test_no_rows_and_no_common_length(table):
    schema = "id long, emb array<float>"
    for rows in ([], [(1, None)]):
        got, books = compress(table(schema, rows), "emb", "id", parts=2)
        assert books == [] and got.collect() == [] and got.columns == ["rec", "code", "error"]
    with pytest.raises(ValueError):
        compress(table(schema, [(1, [0.0] * 3)]), "emb", "id", parts=2)
    for odd in ([0.0] * 4, [1e30] * 2):
        with pytest.raises(Exception, match="components|too large"):
            compress(table(schema, [(1, [0.0] * 2), (2, odd)]), "emb", "id", parts=2)[0].collect()


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    columns = "vec_id, code, error, label_error, codebooks_sha256"
    assert sorted(tuple(r) for r in queries.op13_vector_codes(spark, sf).selectExpr(*columns.split(", ")).collect()) == sorted(con.execute(f"select {columns} from ({queries.OP13_SQL})").fetchall())
