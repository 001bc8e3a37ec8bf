"""Reports made of other tables: facts per listing, categories, evidence over scopes, sources on pause, chains of edges."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import share, shipping_bucket

#: Grains and outcomes that a report names even where they are zero.
GRAINS = ("none", "family", "model", "variant", "no_edge")
OUTCOMES = ("accept", "review", "none", "error", "no_edge")


def listing_facts(snapshots: DataFrame, keys: list[str], at: str, newest: list[str], shipping: str) -> DataFrame:
    """Per ``keys``: snapshots, how many had free, paid or unknown shipping, and the ``newest`` columns of the last one."""
    kind = shipping_bucket(F.col(shipping))
    buckets = [F.count_if(kind == k).alias(f"shipping_{k}") for k in ("free", "paid", "unknown")]
    last = F.max(F.struct(at, *[c for c in newest if c != at])).alias("_last")
    return snapshots.groupBy(*keys).agg(F.count(F.lit(1)).alias("snapshots"), *buckets, last).select(*keys, "snapshots", *[f"shipping_{k}" for k in ("free", "paid", "unknown")], *[F.col(f"_last.{c}").alias(c) for c in newest])


def category_report(facts: DataFrame, by: list[str], has_mpn: Column, has_condition: Column, grain: Column, outcome: Column) -> DataFrame:
    """Roll-up of ``listing_facts``: sums, shares, and one count for every grain and outcome. A null grain or outcome is no edge."""
    no, g, o = F.lit(False), F.coalesce(grain, F.lit("no_edge")), F.coalesce(outcome, F.lit("no_edge"))
    mpn, model = F.coalesce(has_mpn, no), g.isin("model", "variant")
    out = facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("listings"),
        F.sum("snapshots").alias("snapshots"),
        F.count_if(mpn).alias("with_mpn"),
        F.count_if(model).alias("with_model"),
        F.count_if(mpn | model).alias("with_identifier"),
        F.count_if(F.coalesce(has_condition, no)).alias("with_condition"),
        *[F.sum(f"shipping_{k}").alias(f"shipping_{k}") for k in ("free", "paid", "unknown")],
        *[F.count_if(g == k).alias(f"grain_{k}") for k in GRAINS],
        *[F.count_if(o == k).alias(f"outcome_{k}") for k in OUTCOMES],
    )
    return out.withColumns({
        "identifier_coverage": share(F.col("with_identifier"), F.col("listings")),
        "condition_coverage": share(F.col("with_condition"), F.col("listings")),
        "shipping_coverage": share(F.col("shipping_free") + F.col("shipping_paid"), F.col("snapshots")),
    })


def merged_evidence(scopes: DataFrame, run: str) -> DataFrame:
    """One record a run from the evidence of its scopes (completeness, reason, stale_allowed): complete only if all are;
    a reason that all share is kept. For the record: what a scope proved is decided scope by scope."""
    same = F.count_distinct(F.coalesce("reason", F.lit(""))) == 1
    whole = F.every(F.col("completeness") == "complete")
    first = F.when(F.count(F.lit(1)) == 1, F.first("completeness")).otherwise(F.when(whole, "complete").otherwise("truncated"))
    return scopes.groupBy(run).agg(F.count(F.lit(1)).alias("scopes"), first.alias("completeness"), F.when(same, F.max("reason")).otherwise("adapter_sweep_incomplete").alias("reason"), F.every("stale_allowed").alias("stale_allowed"))


def paused_sources(reservations: DataFrame, imports: DataFrame, latched: DataFrame | None = None) -> DataFrame:
    """(source, reason) of sources whose newest reservation (source, at, id, status, reason) was denied with no successful
    import (source, finished_at) since. While a latch holds, its sources (``latched``: source) are paused by it before all else."""
    newest = reservations.groupBy("source").agg(F.max(F.struct("at", "id", "status", "reason")).alias("n"))
    denied = newest.where("n.status = 'denied'").select("source", F.col("n.at").alias("_at"), F.col("n.reason").alias("reason"))
    last = imports.groupBy(F.col("source").alias("_source")).agg(F.max("finished_at").alias("_last"))
    out = denied.join(last, F.col("source") == F.col("_source"), "left").where("_last is null or _last <= _at").select("source", "reason")
    if latched is None:
        return out
    held = latched.select("source", F.lit("overrun_latch").alias("reason")).distinct()
    return held.union(out.join(held.select("source"), "source", "left_anti"))


def unreconciled_families(families: DataFrame, models: DataFrame, aliases: DataFrame) -> DataFrame:
    """Families (family_id, name) that neither a model nor an alias refers to."""
    used = models.select("family_id").union(aliases.select("family_id")).distinct()
    return families.join(used, "family_id", "left_anti")


def uncounted(runs: DataFrame, provider_runs: DataFrame, key: str) -> DataFrame:
    """Runs that no provider's own record counts already."""
    return runs.join(provider_runs.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def payload_of(records: DataFrame, payloads: DataFrame, url: str, order: list[str]) -> DataFrame:
    """``records`` with the first payload (by ``order``) of their url, if there is one."""
    rest = [c for c in payloads.columns if c != url]
    first = payloads.groupBy(F.col(url).alias("_url")).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_p"))
    out = records.join(first, F.col(url) == F.col("_url"), "left")
    return out.select(*records.columns, *[F.col(f"_p.{c}").alias(f"payload_{c}") for c in rest])


def edge_chain(edges: DataFrame, key: str, order: list[str], edge: str) -> DataFrame:
    """Edges with the one that superseded them and whether they are current."""
    after = F.lead(edge).over(Window.partitionBy(key).orderBy(*order))
    return edges.withColumn("superseded_by", after).withColumn("is_current", F.col("superseded_by").isNull())


def settled(reads: DataFrame, key: str, at: str, amount: str, wanted: int, interval_s: float) -> DataFrame:
    """Per key the last read, if the last ``wanted`` reads lie ``interval_s`` or more apart and all say the same amount."""
    own = Window.partitionBy(key).orderBy(at)
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(own).cast("timestamp"))) / 1_000_000
    rows = reads.withColumn("_gap", gap).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at))))
    tail = rows.where(F.col("_n") <= wanted).groupBy(key).agg(
        F.count(F.lit(1)).alias("_reads"),
        F.every(F.col(amount).isNotNull()).alias("_known"),
        F.min(F.when(F.col("_n") < wanted, F.col("_gap"))).alias("_least"),
        F.count_distinct(amount).alias("_amounts"),
        F.max(at).alias(at),
        F.max_by(amount, at).alias(amount),
    )
    steady = (F.col("_reads") == wanted) & F.col("_known") & (F.col("_amounts") == 1) & F.coalesce(F.col("_least") >= interval_s, F.lit(wanted == 1))
    return tail.where(steady).select(key, at, amount)


def one_per_key(records: DataFrame, keys: list[str], scope: str, order: list[str]) -> DataFrame:
    """The first record of each key in the order of the batch, records of a scope before those of none."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(scope).isNull(), *order))
    return records.withColumn("_at", at).where("_at = 1").drop("_at")


def scope_reports(observed: DataFrame, run: str, scope: str, key: str) -> DataFrame:
    """Per run and scope what it saw, the null scope first, and what the run saw in all scopes together: only keys
    that no scope saw may be absent."""
    per = observed.groupBy(run, scope).agg(F.count_distinct(key).alias("seen"))
    whole = observed.groupBy(F.col(run).alias("_run")).agg(F.count_distinct(key).alias("seen_in_run"))
    out = per.join(whole, F.col(run) == F.col("_run")).drop("_run")
    return out.withColumn("position", F.row_number().over(Window.partitionBy(run).orderBy(F.asc_nulls_first(scope))))


def pending(current: DataFrame, key: str, stale: Column) -> DataFrame:
    """Listings with a watch row that is missing or out of date, once each."""
    return current.where(F.coalesce(stale, F.lit(True))).select(key).distinct()


def requirement_versions(saves: DataFrame, key: str, order: str, hard: list[str], soft: list[str]) -> DataFrame:
    """``saves`` of requirements with ``changed`` and ``version``: only a change of a hard field counts it up, nulls being
    values. The first save of a watch changes it and starts at 1."""
    own = Window.partitionBy(key).orderBy(order)
    moved = lambda cols: ~F.struct(*cols).eqNullSafe(F.lag(F.struct(*cols)).over(own))
    rows = saves.withColumn("_hard", moved(hard)).withColumn("changed", F.col("_hard") | moved(soft) if soft else F.col("_hard"))
    return rows.withColumn("version", F.sum(F.col("_hard").cast("int")).over(own)).drop("_hard")


def change_counts(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: how many keys an import would create, update, leave or no longer names."""
    old = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_old"))
    new = after.select(*keys, F.struct(*values).alias("_new"))
    both = new.join(old, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "full")
    there, was = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    same = F.col("_new").eqNullSafe(F.col("_old"))
    return both.agg(F.count_if(there & ~was).alias("created"), F.count_if(there & was & ~same).alias("updated"), F.count_if(there & was & same).alias("unchanged"), F.count_if(~there).alias("missing"))


def audit_sample(entry_ids: Iterable[str], version: str, part: float = 0.2) -> tuple[str, ...]:
    """Ids of a labelled corpus to be audited (a few hundred): drawn by the version, whatever their order."""
    ids = sorted(set(entry_ids))
    random.Random(version).shuffle(ids)
    return tuple(ids[: math.ceil(part * len(ids))])
