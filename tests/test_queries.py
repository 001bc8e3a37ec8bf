"""Every registered query of the library's own operators against the SQL that DuckDB runs on the same files."""

import math
import os

import duckdb
import pytest

from tidemark.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Folds and windows see cases on more rows that they don't see on few.
LARGER = "/root/testdata/sf0.01"
FOLDS = "q_lifecycle_fold q_lifecycle_log q_lifecycle_stream q_streaks q_change_detect q_continuity q_edge_chain q_settled q_sweep_verdicts".split()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    cons = {sf: duckdb.connect() for sf in (SF, LARGER)}
    for sf, con in cons.items():
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return cons


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "item"):
        return plain(x.item())
    return x


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize(("name", "sf"), [*((n, SF) for n in sorted(queries.queries())), *((n, LARGER) for n in FOLDS)])
def test_matches_sql(spark, duck, name, sf):
    got = queries.queries()[name](spark, sf)
    said = duck[sf].execute(queries.oracle_sql()[name])
    cols = [d[0] for d in said.description]
    assert sorted(cols) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(cols, said.fetchall())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())
