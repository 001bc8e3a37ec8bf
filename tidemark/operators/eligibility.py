"""Three-valued eligibility: clauses with evidence, verdicts, agreement of family members, currency of stored verdicts.

An outcome is the text match, no_match or unknown, never a null or a boolean: a missing bound is a match, a missing
value unknown, and a title can contradict the catalog but not stand in for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, NO_MATCH, UNKNOWN = "match", "no_match", "unknown"


def at_least(bound: Column, value: Column) -> Column:
    """True, false, or null for an unknown value; true without a bound."""
    return F.when(bound.isNull(), F.lit(True)).otherwise(value >= bound)


def at_most(bound: Column, value: Column) -> Column:
    return F.when(bound.isNull(), F.lit(True)).otherwise(value <= bound)


def one_of(allowed: Column, value: Column) -> Column:
    return F.when(allowed.isNull() | (F.size(allowed) == 0), F.lit(True)).otherwise(F.array_contains(allowed, value))


def equal_to(bound: Column, value: Column) -> Column:
    return F.when(bound.isNull(), F.lit(True)).otherwise(value == bound)


def product_outcome(catalog_ok: Column, contradicted: Column, on_conflict: str = UNKNOWN) -> Column:
    """Catalog first; a title that contradicts turns a match into ``on_conflict`` and silence into no_match."""
    against = F.coalesce(contradicted, F.lit(False))
    return (
        F.when(catalog_ok == F.lit(False), NO_MATCH)
        .when(against & catalog_ok.isNotNull(), on_conflict)
        .when(against, NO_MATCH)
        .when(catalog_ok.isNotNull(), MATCH)
        .otherwise(UNKNOWN)
    )


def price_outcome(most: Column, price: Column, shipping_known: Column, quantity: Column, confidence: Column, trusted_from: float = 0.85) -> Column:
    """A unit price against a maximum. Above it is no_match even without shipping; within it is a match only with
    shipping stated. A quantity that isn't trusted doesn't divide, and then above the maximum proves nothing."""
    trusted = quantity.isNotNull() & F.coalesce(confidence >= trusted_from, F.lit(False))
    unit = price / F.when(trusted & (quantity > 0), quantity).otherwise(1)
    doubtful = quantity.isNotNull() & ~trusted
    return (
        F.when(most.isNull(), MATCH)
        .when(price.isNull(), UNKNOWN)
        .when(unit <= most, F.when(F.coalesce(shipping_known, F.lit(False)), MATCH).otherwise(UNKNOWN))
        .when(doubtful, UNKNOWN)
        .otherwise(NO_MATCH)
    )


def condition_outcome(allowed: Column, stated: Column) -> Column:
    return (
        F.when(allowed.isNull() | (F.size(allowed) == 0), MATCH)
        .when(stated.isNull() | (stated == "unknown"), UNKNOWN)
        .when(F.array_contains(allowed, stated), MATCH)
        .otherwise(NO_MATCH)
    )


def stock_outcome(required: Column, status: Column) -> Column:
    return F.when(~required, MATCH).when(status == "in_stock", MATCH).when(status.isin("out_of_stock", "preorder"), NO_MATCH).otherwise(UNKNOWN)


def international_outcome(allowed: Column, international: Column) -> Column:
    return F.when(allowed, MATCH).when(international.isNull(), UNKNOWN).when(international, NO_MATCH).otherwise(MATCH)


def clause(name: str, outcome: Column) -> Column:
    return F.struct(F.lit(name).alias("clause"), outcome.alias("outcome"))


def verdict(clauses: Column) -> Column:
    """no_match beats unknown beats match; no clauses at all is an error, never a match."""
    has = lambda o: F.exists(clauses, lambda c: c["outcome"] == o)
    return F.when(F.size(clauses) == 0, F.raise_error(F.lit("a verdict needs a clause"))).when(has(NO_MATCH), NO_MATCH).when(has(UNKNOWN), UNKNOWN).otherwise(MATCH)


def vetoes(pairs: dict[str, tuple[Column, Column]], tolerance: dict[str, float] | None = None) -> Column:
    """Names of the attributes that both sides state and that differ, beyond the tolerance where one is given."""
    near = tolerance or {}

    def differs(k: str) -> Column:
        a, b = pairs[k]
        return F.abs(a - b) > near[k] * F.greatest(a, b) if k in near else a != b

    return F.array_compact(F.array(*[F.when(F.coalesce(differs(k), F.lit(False)), F.lit(k)) for k in pairs]))


def agreement(members: DataFrame, key: str, fields: list[str], has_spec: Column) -> DataFrame:
    """Per key the fields on which all members agree, else null. A member without a spec leaves nothing agreed;
    a null is a value that must be shared too."""
    rows = members.withColumn("_spec", F.coalesce(has_spec, F.lit(False)))
    same = [(F.min(F.struct(f)) == F.max(F.struct(f))).alias(f"_same_{f}") for f in fields]
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_members"), F.every("_spec").alias("_all"), *same, *[F.max(f).alias(f) for f in fields])
    # struct comparison takes a null as smallest, so a null beside a value is no agreement
    return out.select(key, "n_members", *[F.when(F.col("_all") & F.col(f"_same_{f}"), F.col(f)).alias(f) for f in fields])


def sole(values: Column) -> Column:
    """The value if all agree on one."""
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def stale_fields(stored: dict[str, Column], live: dict[str, Column]) -> Column:
    """Names of the bound inputs that changed, nulls compared as values."""
    return F.array_compact(F.array(*[F.when(~stored[k].eqNullSafe(live[k]), F.lit(k)) for k in stored]))


def shortlist(evaluated: DataFrame, price: str, key: str) -> DataFrame:
    """Matches, cheapest first, unpriced last."""
    return evaluated.where(F.col("verdict") == MATCH).orderBy(F.asc_nulls_last(price), key)


def meets_target(target: Column, price: Column, shipping_known: Column, quantity: Column, confidence: Column) -> Column:
    """Whether an offer's price surely is, or isn't, within the price one hopes for; null without one, or if it is open."""
    said = price_outcome(target, price, shipping_known, quantity, confidence)
    return F.when(target.isNotNull(), F.when(said == MATCH, F.lit(True)).when(said == NO_MATCH, F.lit(False)))


def review_queue(evaluated: DataFrame, key: str) -> DataFrame:
    return evaluated.where((F.col("verdict") == UNKNOWN) | (F.size("stale") > 0)).orderBy(key)


def verdict_counts(evaluated: DataFrame, by: list[str], pending: Column) -> DataFrame:
    """Counts by verdict; pending rows count beside their stored verdict."""
    return evaluated.groupBy(*by).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in (MATCH, NO_MATCH, UNKNOWN)], F.count_if(pending).alias("pending"))


def all_of(outcomes: list[Column]) -> Column:
    """The verdict of single outcomes."""
    worst = reduce(F.greatest, [F.when(o == NO_MATCH, 2).when(o == UNKNOWN, 1).otherwise(0) for o in outcomes])
    return F.when(worst == 2, NO_MATCH).when(worst == 1, UNKNOWN).otherwise(MATCH)


def vendor_lock_outcome(require_unlocked: Column, lock: Column, confidence: Column, least: float = 0.85) -> Column:
    """Only a stated unlock satisfies the requirement: a part that may be locked may not start in the buyer's board."""
    stated = F.when(confidence >= least, lock)
    return F.when(~F.coalesce(require_unlocked, F.lit(False)), MATCH).when(stated == "unlocked", MATCH).when(stated == "locked", NO_MATCH).otherwise(UNKNOWN)


def target_outcome(target_family: Column, target_model: Column, grain: Column, family: Column, model: Column) -> Column:
    """Null without a target. A family can't tell a model: that is unknown, not another one."""
    known = grain.isNotNull() & (grain != "none")
    same = lambda a, b: F.when(a.eqNullSafe(b), MATCH).otherwise(NO_MATCH)
    of_model = F.when(grain == "family", UNKNOWN).otherwise(same(model, target_model))
    of_family = F.when(family.isNull(), UNKNOWN).otherwise(same(family, target_family))
    return F.when(target_model.isNotNull(), F.when(known, of_model).otherwise(UNKNOWN)).when(target_family.isNotNull(), F.when(known, of_family).otherwise(UNKNOWN))


def recording_contradicted(allowed: Column, said: Column) -> Column:
    """A title says only the kind; a kind of subtypes goes with any of them."""
    subtype = F.exists(allowed, lambda a: F.startswith(a, F.lit("smr")))
    return F.coalesce(~F.when(said == "smr", subtype).otherwise(F.array_contains(allowed, said)), F.lit(False))
