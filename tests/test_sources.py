"""Readers over small landed payloads."""

import json

from pyspark.sql import functions as F

from tidemark.sources import listings


def test_search_pages(table):
    item = {"itemId": "1", "title": "disk", "price": {"value": "10.50", "currency": "EUR"}, "shippingOptions": [{"shippingCost": {"value": "0"}}], "itemLocation": {"country": "DE"}}
    body = json.dumps({"total": 3, "offset": 0, "itemSummaries": [item, {"itemId": "2", "title": "x", "price": {"value": "free"}}, {"title": "no key", "price": {"value": "1"}}]})
    got = listings.search_pages(table("page int, body string", [(1, body), (2, "{}"), (3, None), (4, "not json")])).orderBy("page", "item_no").collect()
    first = [r for r in got if r.page == 1]
    assert [(r.source_listing_key, r.currency, r.ships_from_country, r.reject) for r in first] == [("1", "EUR", "DE", None), ("2", "USD", "US", "no_price"), (None, "USD", "US", "no_key")]
    assert [r.reject for r in got if r.page > 1] == ["no_key"] * 3


def test_variants(table):
    body = json.dumps({"products": [{"id": 1, "title": "t", "variants": [{"id": 5, "sku": "a", "price": "3.00", "available": True}, {"id": 6, "price": "x", "available": False}]}]})
    got = listings.product_variants(table("body string", [(body,)])).orderBy("variant_no").collect()
    assert [(r.source_listing_key, r.mpn, r.price and float(r.price), r.stock_status) for r in got] == [("5", "a", 3.0, "in_stock"), ("6", None, None, "out_of_stock")]


def test_json_ld(table):
    html = '<html><script type="application/ld+json">{"sku": "s1", "name": "n", "offers": {"price": "9.99", "availability": "https://schema.org/OutOfStock"}}</script><p><script>x</script>'
    got = listings.json_ld_offers(table("id int, html string", [(1, html), (2, "<p>"), (3, None)])).collect()
    assert [(r.id, r.source_listing_key, float(r.price), r.currency, r.stock_status) for r in got] == [(1, "s1", 9.99, "USD", "out_of_stock")]


def test_admission(table):
    schema = "source_listing_key string, site_key string, collection_scope string, price decimal(10,2)"
    row = lambda **k: json.dumps({"source_listing_key": "k", "site_key": "s", "collection_scope": "s:c:q", "price": 1} | k)
    df = table("n int, body string", [(1, row()), (2, row(site_key="z")), (3, row(collection_scope="no")), (4, row(price=0)), (5, "{"), (6, row(x="y" * 500))])
    got = {r.n: r.reject for r in listings.admitted_rows(df, "body", schema, "s", F.lit("s:c:q"), 400).collect()}
    assert got == {1: None, 2: "site_mismatch", 3: "scope_mismatch", 4: "invariant", 5: "contract", 6: "too_large"}


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url": "u", "http_status": 200, "body": "b"}\n{oops\n')
    rows = listings.raw_items(spark, str(tmp_path / "a.jsonl")).collect()
    assert sorted(r._corrupt is None for r in rows) == [False, True]
    (tmp_path / "seed").mkdir()
    (tmp_path / "seed/x.json").write_text(json.dumps({"category": "drive", "manufacturer_key": "m", "family_name": "f", "models": [{"model_number": "1", "aliases": []}, {"model_number": "2"}]}, indent=1))
    assert [r.model_number for r in listings.seed_models(spark, str(tmp_path / "seed")).orderBy("model_number").collect()] == ["1", "2"]
