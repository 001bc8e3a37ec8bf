"""Presence and absence of listings: who was seen, who is gone after a complete sweep, what may be purged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seen(listings: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return listings.join(observed.select(*keys).distinct(), keys, "left_semi")


def unseen(listings: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return listings.join(observed.select(*keys).distinct(), keys, "left_anti")


def live(listings: DataFrame, now: Column) -> DataFrame:
    """Neither delisted nor expired."""
    return listings.where(F.col("delisted_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def delist(listings: DataFrame, swept: DataFrame, observed: DataFrame) -> DataFrame:
    """``listings`` (site, key, scope, last_seen, delisted_at, delist_reason) after sweeps.

    ``swept``: site, scope, swept_at, complete, and for stale absence stale_allowed, continuous_since, grace_s. A
    listing of a swept scope that was not seen (``observed``: site, key) and not observed later goes at once after a
    complete sweep. After an incomplete one it goes as stale, if the scope allows that, has been swept without a
    break for the grace, and the listing was last seen before it began. One that was never seen goes only after a
    complete sweep. A null scope is a scope of its own.
    """
    marks = swept.withColumns({c: F.lit(None).cast(t) for c, t in (("stale_allowed", "boolean"), ("continuous_since", "timestamp"), ("grace_s", "long")) if c not in swept.columns})
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    before = F.timestamp_micros(micros(F.col("swept_at")) - F.col("grace_s").cast("long") * 1_000_000)
    gated = ~F.col("complete") & F.col("stale_allowed") & (micros(F.col("swept_at")) - micros(F.col("continuous_since")) >= F.col("grace_s").cast("long") * 1_000_000)
    marks = marks.groupBy(F.col("site").alias("_site"), F.col("scope").alias("_scope")).agg(
        F.max(F.when(F.col("complete"), F.col("swept_at"))).alias("_complete_at"),
        F.max(F.when(gated, F.struct(F.col("swept_at").alias("at"), before.alias("before")))).alias("_stale"),
    )
    out = listings.join(marks, (F.col("site") == F.col("_site")) & F.col("scope").eqNullSafe(F.col("_scope")), "left")
    there = observed.select(F.col("site").alias("_osite"), F.col("key").alias("_okey"), F.lit(True).alias("_there")).distinct()
    out = out.join(there, (F.col("site") == F.col("_osite")) & (F.col("key") == F.col("_okey")), "left")
    open_ = F.col("delisted_at").isNull() & F.col("_there").isNull()
    not_later = lambda at: F.col("last_seen").isNull() | (F.col("last_seen") <= at)
    gone = open_ & F.col("_complete_at").isNotNull() & not_later(F.col("_complete_at"))
    stale = open_ & F.coalesce(F.col("last_seen").cast("timestamp") < F.col("_stale.before"), F.lit(False))
    at = F.when(gone, F.col("_complete_at")).when(stale, F.col("_stale.at")).otherwise(F.col("delisted_at"))
    why = F.when(gone, "absent_from_complete_sweep").when(stale, "stale").otherwise(F.col("delist_reason"))
    return out.select(*[c for c in listings.columns if c not in ("delisted_at", "delist_reason")], at.alias("delisted_at"), why.alias("delist_reason"))


def continuity(events: DataFrame, keys: list[str], at: str, tie: str, eligible: Column, tolerance_s: Column) -> DataFrame:
    """Sweeps in the order of their arrival with ``continuous_since``: since when their scope has been swept without a
    break. An eligible sweep continues the last one within ``tolerance_s``; an ineligible one breaks, whenever it
    is from. A sweep from before the newest break (or of its time), or older than the newest sweep, proves nothing and
    changes nothing. ``events``: keys, ``at`` (time of the sweep), ``tie`` (order of arrival)."""
    own = Window.partitionBy(*keys).orderBy(tie)
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.coalesce(eligible, F.lit(False))
    rows = events.withColumn("_ok", ok).withColumn("_broken", F.max(F.when(~ok, F.col(at))).over(past))
    rows = rows.withColumn("_open", F.col("_ok") & F.coalesce(F.col(at) > F.col("_broken"), F.lit(True)))
    # a sweep that the rule above turns away is no newer than the newest break, so it can't hide a later one
    rows = rows.withColumn("_newest", F.max(F.when(F.col("_open"), F.col(at))).over(past))
    rows = rows.withColumn("_counts", F.col("_open") & F.coalesce(F.col(at) >= F.col("_newest"), F.lit(True)))
    before = F.last(F.when(F.col("_counts"), F.col(at)), ignorenulls=True).over(past)
    n = F.row_number().over(own)
    last_break, last_count = F.max(F.when(~F.col("_ok"), F.col("_n"))).over(past), F.max(F.when(F.col("_counts"), F.col("_n"))).over(past)
    rows = rows.withColumn("_n", n)
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1_000_000
    starts = before.isNull() | F.coalesce(last_break > last_count, F.lit(False)) | (gap > tolerance_s)
    rows = rows.withColumn("_start", F.when(F.col("_counts") & starts, F.col(at)))
    since = F.last("_start", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("continuous_since", F.when(F.col("_counts"), since)).drop("_ok", "_broken", "_open", "_newest", "_counts", "_n", "_start")


def retention_split(rows: DataFrame, expired: Column, redacted_only: Column, exempt: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``fate``: keep, redact (expired, but of a class that keeps identity or referred to by ``exempt``) or delete."""
    refs = exempt.select(F.col(key).alias("_ref")).distinct()
    out = rows.join(refs, F.col(key) == F.col("_ref"), "left")
    fate = F.when(~F.coalesce(expired, F.lit(False)), "keep").when(redacted_only | F.col("_ref").isNotNull(), "redact").otherwise("delete")
    return out.withColumn("fate", fate).drop("_ref")


def redact(rows: DataFrame, when: Column, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.when(when, F.lit("")).otherwise(F.col(c)) for c in columns})
