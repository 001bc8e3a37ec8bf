"""Cohorts of comparable offers: who is scored, price per terabyte, cohort keys and their relaxation, alert cooldowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of quantities and capacities, the least weight of a cohort, tiers and what they widen to.
QUANTITY_MIN_CONFIDENCE, MAX_LOT_QUANTITY = 0.85, 100
TOLERANCE, LEAST = 0.05, 30.0
STEPS = ("none", "condition", "capacity", "tier")


def population(listings: DataFrame, snapshots: DataFrame, sources: list[str], now: Column) -> DataFrame:
    """Listings that are scored: of a scored source, live, and observed at least once."""
    live = F.col("delisted_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return listings.where(F.col("source").isin(*sources) & live).join(snapshots.select("listing_id").distinct(), "listing_id", "left_semi")


def baseline_observations(snapshots: DataFrame, now: Column, without: list[str], days: int = 90) -> DataFrame:
    """Observations that prices are compared with: of the last ``days``, whatever became of their listing, but for some sources."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))
    return snapshots.where(~F.col("source").isin(*without) & age.between(0, days * 86_400_000_000))


def unit_quantity(structured: Column, extracted: Column, confidence: Column) -> Column:
    """struct<n, basis, flag>: how many units a price is for. What the merchant says goes before what a title says."""
    sure = extracted.isNotNull() & (confidence >= QUANTITY_MIN_CONFIDENCE)
    valid = extracted.between(1, MAX_LOT_QUANTITY)

    def said(n: Column, basis: str, flag: str | None) -> Column:
        return F.struct(n.cast("int").alias("n"), F.lit(basis).alias("basis"), F.lit(flag).cast("string").alias("flag"))

    one = F.lit(1)
    return (
        F.when(structured.isNotNull() & extracted.isNotNull() & (structured != extracted), said(structured, "structured_over_extracted", "quantity_conflict"))
        .when(structured.isNotNull(), said(structured, "structured", None))
        .when(extracted.isNull(), said(one, "default_single", "quantity_assumed"))
        .when(~valid, said(one, "default_single", "quantity_invalid"))
        .when(~F.coalesce(sure, F.lit(False)), said(one, "default_single", "quantity_low_confidence"))
        .otherwise(said(extracted, "extracted", None))
    )


def dollars_per_tb(usd: Column, capacity_tb: Column, quantity: Column) -> Column:
    return F.try_divide(usd.cast("double"), capacity_tb.cast("double") * quantity)


def capacity_bucket(capacity_tb: Column, buckets: list[str]) -> Column:
    """The nearest bucket (decimal texts, ascending) within the tolerance, relative to the bucket, the lower of two that
    are as near; else the value itself with a tilde. Three decimals."""
    c = capacity_tb.cast("decimal(7,3)")
    known = F.array(*[F.lit(b).cast("decimal(7,3)") for b in buckets])
    near = F.transform(known, lambda b: F.struct((F.abs(c - b) / b).alias("d"), b.alias("b")))
    best = F.array_min(F.filter(near, lambda x: x["d"] <= TOLERANCE))
    return F.when(best.isNotNull(), best["b"].cast("string")).when(c.isNotNull(), F.concat(F.lit("~"), c.cast("string")))


def cohort_key(bucket: Column, tier: Column, interface: Column, form_factor: Column, condition: Column) -> Column:
    """Null without a capacity; what isn't known is a value of its own."""
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    return F.when(bucket.isNotNull(), F.concat(F.lit("cap="), bucket, F.lit("|tier="), known(tier), F.lit("|ifff="), known(interface), F.lit("-"), known(form_factor), F.lit("|cond="), known(condition)))


def with_neighbours(bucket: Column, buckets: list[str]) -> Column:
    """The bucket with those next to it on both sides; one of its own stays beside the buckets around its value."""
    known = F.array(*[F.lit(b).cast("decimal(7,3)") for b in buckets])
    value = F.ltrim(F.translate(bucket, "~", "")).cast("decimal(7,3)")
    below, above = F.array_max(F.filter(known, lambda b: b < value)), F.array_min(F.filter(known, lambda b: b > value))
    return F.array_compact(F.array(below.cast("string"), bucket, above.cast("string")))


def relaxed(offers: DataFrame, baseline: DataFrame, buckets: list[str], parents: dict[str, str], weight: str) -> DataFrame:
    """``offers`` with ``step`` and ``n_eff`` of the first cohort of the ladder that has LEAST effective observations;
    ``exhausted`` where none has, then at the last step. Both tables: bucket, tier, ifff, condition; ``baseline`` has ``weight``.

    Each step counts what the baseline sums up to (w and w squared) by its own components, and is met by equality:
    the baseline is rolled up, once and then per step, before it is joined, so no observation meets an offer. Offers of one cohort are
    told the same, so the steps are taken once a cohort.
    """
    parent = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv])
    known = baseline.withColumn("parent", F.coalesce(F.try_element_at(parent, F.col("tier")), F.col("tier")))
    known = known.groupBy("bucket", "tier", "parent", "ifff", "condition").agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(weight)).alias("w2"))
    sums = lambda keys: known.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("w2").alias("w2"))
    own = F.struct("bucket", "tier", "ifff", "condition")
    rows = offers.select(own.alias("_id")).distinct().select("_id", "_id.*")
    rows = rows.withColumn("parent", F.coalesce(F.try_element_at(parent, F.col("tier")), F.col("tier")))
    wide = rows.withColumn("bucket", F.explode(with_neighbours(F.col("bucket"), buckets)))
    levels = [(rows, ["bucket", "tier", "ifff", "condition"]), (rows, ["bucket", "tier", "ifff"]), (wide, ["bucket", "tier", "ifff"]), (wide, ["bucket", "parent", "ifff"])]
    out = rows
    for k, (side, keys) in enumerate(levels):
        counted = sums(keys).select(*[F.col(c).alias(f"b_{c}") for c in keys], "w", "w2")
        met = side.select("_id", *keys).join(counted, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in keys])
        weights = met.groupBy("_id").agg(F.try_divide(F.sum("w") * F.sum("w"), F.sum("w2")).alias(f"n{k}"))
        out = out.join(weights.withColumnRenamed("_id", f"_i{k}"), F.col("_id") == F.col(f"_i{k}"), "left").drop(f"_i{k}")
    n = [F.coalesce(f"n{k}", F.lit(0.0)) for k in range(4)]
    enough = [F.when(n[k] >= LEAST, F.struct(F.lit(s).alias("step"), n[k].alias("n_eff"), F.lit(False).alias("exhausted"))) for k, s in enumerate(STEPS)]
    chosen = F.coalesce(*enough, F.struct(F.lit("tier").alias("step"), n[3].alias("n_eff"), F.lit(True).alias("exhausted")))
    # a small file of offers is broadcast for its size on disk, which is a fiftieth of that in memory
    told = out.select(F.col("_id").alias("_cohort"), chosen.alias("_c")).hint("merge")
    return offers.join(told, own == F.col("_cohort")).select(*offers.columns, "_c.step", "_c.n_eff", "_c.exhausted")


def steady_alerts(sightings: DataFrame, key: str, at: str, tie: str, polls: int, cooldown_s: float) -> DataFrame:
    """(key, at, tie) of the sightings that alert: the condition (column ``holds``) has been seen ``polls`` times in a row,
    and the last alert is ``cooldown_s`` or more ago, unless the row may pass that by (column ``bypass``: a better price).

    Whether a row alerts depends on the last that did, so the steady rows of a key are folded in their order in one
    expression, in one task; all others have gone before that.
    """
    own = Window.partitionBy(key).orderBy(at, tie)
    holds = F.coalesce("holds", F.lit(False))
    rows = sightings.withColumn("_run", F.sum((~holds).cast("int")).over(own))
    rows = rows.withColumn("_n", F.sum(holds.cast("int")).over(Window.partitionBy(key, "_run").orderBy(at, tie))).where(holds & (F.col("_n") >= polls))
    one = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.unix_micros(F.col(at).cast("timestamp")).alias("x"), F.coalesce("bypass", F.lit(False)).alias("anyway"))
    steady = rows.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_rows"))
    kind = steady.schema["_rows"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(kind).alias("sent"))

    def step(s: Column, r: Column) -> Column:
        alerts = s["last"].isNull() | r["anyway"] | (r["x"] - s["last"] >= int(cooldown_s * 1_000_000))
        return F.when(alerts, F.struct(r["x"].alias("last"), F.concat(s["sent"], F.array(r)).alias("sent"))).otherwise(s)

    sent = steady.select(key, F.explode(F.aggregate("_rows", start, step, lambda s: s["sent"])).alias("_r"))
    return sent.select(key, F.col("_r.at").alias(at), F.col("_r.tie").alias(tie))
