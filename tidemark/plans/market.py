"""One collection run, end to end: parsed listings to verdicts. Each step is a DataFrame to a DataFrame; nothing runs until it is read.
Write what ``read_titles`` and ``resolved`` return before the next step reads it: their expressions are long, and planning them again
for each step takes longer than the rows do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import candidates, keys, money, mpn, title
from ..operators import asof, eligibility, latest, resolve


def normalize(parsed: DataFrame, rates: DataFrame, observed: str = "observed_at") -> DataFrame:
    """Parsed listings with the day's rate, prices in USD and ``reject`` (no rate within its age, no positive price)."""
    rows = asof.stamp_rates(parsed, rates, "currency", observed)
    usd = money.stated_usd(F.col("price"), F.col("shipping_price"), F.lit(None).cast("decimal(10,2)"), F.col("fx_rate"))
    reject = F.when(F.coalesce(F.col("price") <= 0, F.lit(True)), "price").when(F.col("fx_rate").isNull(), "no_rate")
    return rows.withColumns({
        "usd": usd,
        "landed": money.landed_total(F.col("price"), F.col("shipping_price"), F.lit(None).cast("decimal(10,2)")),
        "shipping_known": F.col("shipping_price").isNotNull(),
        "stock": keys.stock_status(F.col("stock_status")),
        "international": F.col("ships_from_country") != "US",
        "reject": reject,
    })


def current_offers(history: DataFrame) -> DataFrame:
    """The newest snapshot of each listing (site, source_listing_key), whatever the order in which they came."""
    values = ["observed_at", "title", "usd", "shipping_known", "stock", "international", "condition_label", "mpn", "category_hint"]
    return latest.newest_value(history.where("reject is null"), ["site", "source_listing_key"], ["observed_at", "usd", "stock", "title"], values)


def read_titles(offers: DataFrame) -> DataFrame:
    """Offers with listing_id, canonical title, attributes and candidates: read once, used by resolution and verdicts alike."""
    label = F.coalesce(F.nullif(F.trim("condition_label"), F.lit("")), F.lit(""))
    text = F.when(label != "", F.concat_ws(" | ", "title", label)).otherwise(F.col("title"))
    rows = offers.withColumn("canonical", title.canonical_title(text)).withColumn("listing_id", F.xxhash64("site", "source_listing_key"))
    a = title.attributes(F.col("canonical"))
    wanted = ("capacity", "interface", "form_factor", "sector_format", "security", "brand", "families", "condition", "quantity", "recording")
    return rows.withColumns({**{f"said_{k}": a[k] for k in wanted}, "candidates": candidates.candidates(F.col("canonical"), F.col("mpn")), "priced_quantity": title.offer_quantity(F.col("canonical"))})


def resolved(offers: DataFrame, aliases: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """The ladder's decision for each offer that ``read_titles`` made."""
    sure = lambda c, least: F.when(F.col(f"{c}.confidence") >= least, F.col(c))
    spec = F.struct(F.col("said_capacity.bytes").alias("capacity"), F.col("said_interface").alias("interface"), F.col("said_form_factor").alias("form_factor"), F.col("said_sector_format").alias("sector_format"), F.col("said_security").alias("security"), F.lit(None).cast("struct<brand: string, name: string>").alias("family"))
    mentions = F.transform("said_families", lambda f: F.struct(F.split_part(f, F.lit("/"), F.lit(1)).alias("brand"), F.split_part(f, F.lit("/"), F.lit(2)).alias("name")))
    rows = offers.select("listing_id", "site", "candidates", F.col("said_brand").alias("brand"), sure("said_quantity", 0.9)["n"].alias("quantity"), candidates.mpns(F.col("candidates")).alias("mpns"), spec.alias("spec"), mentions.alias("mentions"))
    token = F.get(F.filter("candidates", lambda c: c["kind"] == "manufacturer_mpn"), F.lit(0))["norm"]
    decoded = rows.select("listing_id", mpn.decode(token).alias("d")).where("d is not null").select("listing_id", "d.vendor", "d.family", F.col("d.capacity_bytes").alias("capacity"), "d.provenance")
    hits = resolve.alias_hits(rows, aliases)
    return resolve.decide(rows, hits, decoded, priors)


def _catalog_or_unknown(required: Column, value: Column, ok: Column, contradicts: Column) -> Column:
    return F.when(required.isNull(), eligibility.MATCH).otherwise(eligibility.product_outcome(F.when(value.isNotNull(), ok), contradicts))


def verdicts(offers: DataFrame, decisions: DataFrame, specs: DataFrame, watches: DataFrame) -> DataFrame:
    """One row per watch and offer of its category: outcome of each clause and the verdict.

    ``specs``: model_id, capacity_bytes, interface. ``watches``: watch_id, category, min_capacity_bytes, interfaces array,
    conditions array, max_unit_usd, require_in_stock, allow_international. Watches are few; Spark broadcasts them under its threshold.
    """
    accepted = decisions.where("outcome = 'accept' and grain = 'model'").select(F.col("listing_id").alias("_id"), "target")
    known = specs.select(F.col("model_id").cast("string").alias("_model"), F.col("capacity_bytes").alias("cat_capacity"), F.col("interface").alias("cat_interface"))
    rows = offers.join(accepted, F.col("listing_id") == F.col("_id"), "left").join(known, F.col("target") == F.col("_model"), "left")
    rows = rows.withColumn("_category", F.coalesce("category_hint", F.lit("drive"))).join(watches, F.col("_category") == F.col("category"))
    sure = F.coalesce(F.col("said_capacity.confidence") >= 0.85, F.lit(False))
    clauses = F.array(
        eligibility.clause("capacity", _catalog_or_unknown(F.col("min_capacity_bytes"), F.col("cat_capacity"), F.col("cat_capacity") >= F.col("min_capacity_bytes"), sure & (F.col("said_capacity.bytes") < F.col("min_capacity_bytes")))),
        eligibility.clause("interface", _catalog_or_unknown(F.col("interfaces"), F.col("cat_interface"), F.array_contains("interfaces", F.col("cat_interface")), ~F.array_contains("interfaces", F.col("said_interface")))),
        eligibility.clause("price", eligibility.price_outcome(F.col("max_unit_usd"), F.col("usd"), F.col("shipping_known"), F.col("priced_quantity.n"), F.col("priced_quantity.confidence"))),
        eligibility.clause("condition", eligibility.condition_outcome(F.col("conditions"), F.col("said_condition.value"))),
        eligibility.clause("stock", eligibility.stock_outcome(F.col("require_in_stock"), F.col("stock"))),
        eligibility.clause("international", eligibility.international_outcome(F.col("allow_international"), F.col("international"))),
    )
    return rows.select("watch_id", "listing_id", "usd", "observed_at", clauses.alias("clauses")).withColumn("verdict", eligibility.verdict(F.col("clauses")))
