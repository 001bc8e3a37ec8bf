"""Readers of landed payloads. Input: rows of raw text; output: parsed listings, with what failed beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import content_hash, sha

#: A parsed listing.
LISTING = "source_listing_key string, url string, title string, price decimal(10,2), currency string, shipping_price decimal(10,2), stock_status string, quantity_available int, seller_name string, condition_label string, ships_from_country string, mpn string, category_hint string, collection_scope string"
_SUMMARY = "struct<itemId: string, title: string, itemWebUrl: string, price: struct<value: string, currency: string>, shippingOptions: array<struct<shippingCost: struct<value: string>>>, seller: struct<username: string>, condition: string, itemLocation: struct<country: string>>"


def raw_items(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses (JSON lines: url, http_status, content_type, body, fetched_at) with their content hash."""
    rows = spark.read.schema("url string, http_status int, content_type string, body string, fetched_at timestamp, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("content_hash", content_hash(F.col("body"), F.lit(None).cast("string"))).withColumn("url_hash", sha(F.col("url")))


def search_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """Listings of marketplace search pages, one per summary, with page and item places; items without id, title or a
    positive price have ``reject``."""
    parsed = F.from_json(F.col(body), f"struct<total: long, offset: long, itemSummaries: array<{_SUMMARY}>>")
    rows = pages.withColumn("_p", parsed).select(*pages.columns, F.col("_p.total").alias("total"), F.col("_p.offset").alias("offset"), F.posexplode_outer("_p.itemSummaries").alias("item_no", "_i"))
    price = F.expr("try_cast(_i.price.value as decimal(10,2))")
    shipping = F.expr("try_cast(_i.shippingOptions[0].shippingCost.value as decimal(10,2))")
    rows = rows.select(
        *pages.columns,
        "total",
        "offset",
        "item_no",
        F.col("_i.itemId").alias("source_listing_key"),
        F.col("_i.itemWebUrl").alias("url_listed"),
        F.col("_i.title").alias("title"),
        price.alias("price"),
        F.coalesce("_i.price.currency", F.lit("USD")).alias("currency"),
        shipping.alias("shipping_price"),
        F.coalesce("_i.seller.username", F.lit("")).alias("seller_name"),
        F.coalesce("_i.condition", F.lit("")).alias("condition_label"),
        F.coalesce("_i.itemLocation.country", F.lit("US")).alias("ships_from_country"),
    )
    return rows.withColumn("reject", reject_reason({"no_key": F.col("source_listing_key").isNull(), "no_title": F.col("title").isNull() | (F.col("title") == ""), "no_price": F.coalesce(F.col("price") <= 0, F.lit(True))}))


def reject_reason(checks: dict[str, Column]) -> Column:
    """Name of the first check that holds; null for a good row."""
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in checks.items()])


def product_variants(pages: DataFrame, body: str = "body") -> DataFrame:
    """Listings of a shop's product feed: products, then their variants."""
    variant = "struct<id: long, sku: string, title: string, price: string, available: boolean>"
    parsed = F.from_json(F.col(body), f"struct<products: array<struct<id: long, title: string, handle: string, vendor: string, variants: array<{variant}>>>>")
    products = pages.withColumn("_p", parsed).select(*pages.columns, F.posexplode_outer("_p.products").alias("product_no", "_q"))
    rows = products.select(*pages.columns, "product_no", "_q", F.posexplode_outer("_q.variants").alias("variant_no", "_v"))
    return rows.select(
        *pages.columns,
        "product_no",
        "variant_no",
        F.col("_v.id").cast("string").alias("source_listing_key"),
        F.col("_q.title").alias("title"),
        F.col("_v.sku").alias("mpn"),
        F.expr("try_cast(_v.price as decimal(10,2))").alias("price"),
        F.when(F.col("_v.available"), "in_stock").when(~F.col("_v.available"), "out_of_stock").otherwise("unknown").alias("stock_status"),
    )


def script_json(html: Column, pattern: str, schema: str) -> Column:
    """The JSON that a page embeds in a script, by the first group of ``pattern``."""
    return F.from_json(F.regexp_extract(html, pattern, 1), schema)


def json_ld_offers(pages: DataFrame, html: str = "html") -> DataFrame:
    """Offers of a page's JSON-LD product blocks."""
    block = F.expr(rf"regexp_extract_all(`{html}`, '(?s)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>', 1)")
    rows = pages.select(*pages.columns, F.explode(block).alias("_block"))
    offer = F.from_json("_block", "struct<sku: string, name: string, offers: struct<price: string, priceCurrency: string, availability: string>>")
    rows = rows.withColumn("_o", offer)
    there = F.lower(F.substring_index(F.col("_o.offers.availability"), "/", -1))
    stock = F.when(there == "instock", "in_stock").when(there.isin("outofstock", "soldout"), "out_of_stock").when(there == "preorder", "preorder").otherwise("unknown")
    return rows.select(*pages.columns, F.col("_o.sku").alias("source_listing_key"), F.col("_o.name").alias("title"), F.expr("try_cast(_o.offers.price as decimal(10,2))").alias("price"), F.coalesce("_o.offers.priceCurrency", F.lit("USD")).alias("currency"), stock.alias("stock_status"))


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(place, href, text) of the links of a page."""
    found = F.expr(rf"regexp_extract_all(`{html}`, '<a href=\"([^\"]*)\">[^<]*</a>', 1)")
    texts = F.expr(rf"regexp_extract_all(`{html}`, '<a href=\"[^\"]*\">([^<]*)</a>', 1)")
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.arrays_zip(found.alias("href"), texts.alias("text"))).alias("place", "link")).select(*[c for c in pages.columns if c != html], "place", "link.href", "link.text")


def admitted_rows(rows: DataFrame, body: str, schema: str, site: str, scope: Column, most_bytes: int) -> DataFrame:
    """Remote rows with ``row`` (parsed) and ``reject``, the first that fails of: size, contract, site, scope, invariants."""
    parsed = rows.withColumn("row", F.from_json(F.col(body), schema, {"mode": "PERMISSIVE"}))
    bad = F.col("row").isNull() | F.col("row.source_listing_key").isNull()
    checks = {
        "too_large": F.octet_length(F.col(body)) > most_bytes,
        "contract": bad,
        "site_mismatch": ~F.col("row.site_key").eqNullSafe(F.lit(site)),
        "scope_mismatch": ~F.col("row.collection_scope").eqNullSafe(scope),
        "invariant": F.coalesce(F.col("row.price") <= 0, F.lit(True)),
    }
    return parsed.withColumn("reject", reject_reason(checks))


def seed_models(spark: SparkSession, path: str) -> DataFrame:
    """Catalog models from seed documents (one JSON document a file), with their aliases."""
    schema = "schema string, category string, manufacturer_name string, manufacturer_key string, family_name string, models array<struct<model_number: string, aliases: array<struct<alias_type: string, text: string, is_primary: boolean>>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select("category", "manufacturer_key", "family_name", F.explode("models").alias("m")).select("category", "manufacturer_key", "family_name", "m.model_number", "m.aliases")


def labelled_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled listings (JSON lines); a line that can't be read has ``_corrupt``."""
    schema = "id string, source string, title string, listing struct<source_listing_key: string, price: string, currency: string, condition_label: string, attrs: map<string,string>, category_hint: string>, label struct<expected_grain: string, expected_target: struct<manufacturer_key: string, family: string, model_number: string>, oem_dual_label: boolean, audit_status: string>, _corrupt string"
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
