"""Cards of pages, well formed or not, and shops that list codes first."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.sources import cards

PAGE = """<!DOCTYPE html><body><!-- <div class="v-product">no</div> --><script>var a = '<div class="v-product">';</script>
<div class="grid"><div class="x v-product"><a class="v-product__title" href="/seagate-p/st1.htm?a=1&amp;b=2"><span itemprop="name"> Exos &amp; Co </span></a>
<div class="product_productprice">Our Price: <b class="pricecolor">$1,2<i>34</i>.50</b></div><br><img src=x></div>
<div class="v-product"><a href='/wd-p/w2.htm'>  WD  Red </a></div>
<div class="v-product"><a href="/about.htm">no product</a></div>
<div class="v-product"><a href=/odd-p/x>Odd</a><div class="product_productprice">1.2.3</div></div>
<div class="v-product"><a href="/open-p/o5.htm">Open</a><div class="product_productprice">$7</div>"""


def test_cards_of_a_shop(table):
    df = table("page_id int, html string", [(1, PAGE), (2, None), (3, ""), (4, "no markup < at all"), (5, PAGE)])
    got = cards.shop_cards(df).orderBy("page_id", "place").collect()
    want = [(0, True, "st1", "Exos & Co", Decimal("1234.50"), None), (1, True, "w2", "WD  Red", None, "no_price"), (3, True, "/odd-p/x", "Odd", None, "no_price"), (4, False, "o5", "Open", Decimal("7.00"), None)]
    assert [(r.place, r.closed, r.source_listing_key, r.title, r.price, r.reject) for r in got if r.page_id == 1] == want
    assert {r.page_id for r in got} == {1, 5} and got[0].href == "/seagate-p/st1.htm?a=1&b=2"


@pytest.mark.parametrize(
    ("page", "tag", "want"),
    [
        ("<p>a<p>b</p>c", "p", [("a", False), ("b", True)]),
        ("<ul><li>a<ul><li>b</li></ul></li><li>c", "li", [("ab", True), ("b", True), ("c", False)]),
        ("<b>x<p>y</b>z</p>", "p", [("y", False)]),
        ("<div>1<div>2</div>3</div></div>4", "div", [("123", True), ("2", True)]),
        ("<td>1<table><tr><td>2</table>3", "td", [("123", False), ("2", False)]),
        ("<p title='a>b' data-x=\"</p>\">t</p>", "p", [("t", True)]),
        ("<script>'<p>'</script><style><p></style><p/>n<P>t</P>", "p", [("t", True)]),
        ("<p>a &lt;p&gt; é &#128578;", "p", [("a <p> é 🙂", False)]),
    ],
)
def test_what_a_stack_makes_of_bad_markup(page, tag, want):
    got = cards.scan(page, tag, None)
    assert [("".join(t for _, t in texts), closed) for _, closed, _, texts in got] == want


def test_very_long_and_deep_pages():
    assert len(cards.scan("<li><a href='/x'>t</a></li>" * 50_000, "li", None)) == 50_000
    assert cards.scan("<div>" * 3_000 + "t", "b", None) == []


def test_two_steps(table):
    searches = table("body string", [('{"products": [{"code": "a-recertified"}, {"code": "b"}, {"code": 7}, 3]}',), ('{"products": [{"code": "a-recertified"}, {"code": "c-recertified"}]}',), ("not json",), (None,), ('{"products": 5}',)])
    good = '{"name": "WD Gold", "variantOptions": [{"code": "RWD240KFGX", "saleable": true, "priceData": {"value": 10.5}, "stock": {"stockLevelStatus": "lowStock"}}, {"code": "RWDBBGB0040HBK", "saleable": true, "priceData": {"value": "7"}, "stock": {"stockLevelStatus": "outOfStock"}}, {"priceData": {"value": 1}}, {"code": "x", "priceData": 3}, 5, {"code": "R0F62802", "saleable": false, "priceData": {"value": "n/a"}}]}'
    products = table("code string, body string, title string", [("a-recertified", good, "kept"), ("b", good, ""), ("c-recertified", '{"name": "WD Elements", "variantOptions": {"a": 1}}', ""), ("c-recertified", '{"name": "no options"}', ""), ("c-recertified", None, "")])
    got = cards.product_options(products.drop("title"), cards.searched_codes(searches, "-recertified")).orderBy("code", "variant_no").collect()
    assert [(r.source_listing_key, r.price, r.stock_status, r.mpn, r.reject) for r in got] == [
        ("RWD240KFGX", Decimal("10.50"), "in_stock", "WD240KFGX", None), ("RWDBBGB0040HBK", Decimal("7.00"), "out_of_stock", None, None), (None, Decimal("1.00"), None, None, "no_key"),
        ("x", None, None, None, "no_price"), (None, None, None, None, "record"), ("R0F62802", None, None, None, "no_price"), (None, None, None, None, "variants"),
    ]
    named = products.select("code", F.lit('{"name": "My  Book", "variantOptions": [{"code": "RWD240KFGX", "priceData": {"value": 1}}]}').alias("body")).limit(1)
    assert [r.mpn for r in cards.product_options(named, named.select("code")).collect()] == [None]


def test_page_cards_read_the_entities_that_their_sql_reads(spark, tmp_path):
    import duckdb

    from tidemark.plans import queries

    page = '<ul><li><a href="/a?b=1&amp;c=2">x &quot;y&quot; &lt;&amp;gt;</a></li></ul><article><h1>k = &quot;5&quot; &amp;&amp;amp; a&amp</h1><p>t &gt; u</p></article>'
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    said = duckdb.sql(f"SELECT * FROM ({queries.oracle_sql()['q_page_cards'].replace('FROM pages', f'''FROM '{tmp_path}/pages.parquet/*.parquet' ''')})").fetchall()
    assert [tuple(r) for r in queries.queries()["q_page_cards"](spark, str(tmp_path)).collect()] == said
