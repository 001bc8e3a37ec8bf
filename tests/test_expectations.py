"""Constraint checks and their rejects."""

from pyspark.sql import functions as F

from tidemark.operators import expectations


def test_split_and_counts(table):
    df = table("price double, currency string, fx_rate double, fx_date string, fx_source string, stock_status string", [(1.0, "USD", None, None, None, "in_stock"), (None, "EUR", 1.0, "d", None, "odd"), (2.0, "EUR", 1.0, "d", "s", "unknown")])
    good, bad = expectations.split(df, expectations.snapshot_checks())
    assert good.count() == 2 and [r.broken for r in bad.collect()] == [["price_positive", "fx_stamped", "stock_known"]]
    assert expectations.violations(df, expectations.snapshot_checks()).first().asDict() == {"price_positive": 1, "fx_stamped": 1, "stock_known": 1}


def test_duplicates_take_nulls_as_equal(table):
    df = table("a int, b int", [(1, None), (1, None), (2, 1)])
    assert [tuple(r) for r in expectations.duplicates(df, ["a", "b"]).collect()] == [(1, None, 2)]


def test_edges_and_listings(table):
    df = table("outcome string, target string, grain string, method string, confidence double", [("accept", "1", "model", "alias", 0.9), ("accept", None, "none", None, None), ("review", "1", "none", None, None)])
    assert [r.broken for r in expectations.split(df, expectations.edge_checks())[1].collect()] == [["accept_is_whole"], ["others_are_bare"]]
    df = table("delisted_at int, delist_reason string, bounded boolean, expires_at int", [(None, None, True, 5), (1, None, False, None), (None, None, False, 3)])
    assert sorted(r.broken[0] for r in expectations.split(df, expectations.listing_checks())[1].select(F.col("broken")).collect()) == ["bounded_expires", "delist_together"]
