"""Absence by scope over any number of runs: what each sweep could tell about each listing, and the times it was there.

Runs are taken in the order of their time (of one time, by number), however they arrived. A run sweeps some scopes and
sees some listings. A listing belongs to the scope under which it was last seen (a sighting without a scope leaves it
where it is). After a sighting the listing is there until a sweep of its scope says otherwise, or it is seen again:

- a complete sweep that didn't see it says so at once;
- an incomplete one, where its scope allows that, if the scope had been swept without a break for the grace and the
  listing was last seen before the grace began.

So each sighting meets the first sweep after it that could tell: a forward as-of join by scope. Scopes may be few and
hold most of all listings, so both sides are cut into units of time: a unit holds its own sweeps and the first of the
next unit that has any. What a run saw anywhere, none of its sweeps can miss.

A listing's own sightings, and a scope's sweeps (one a run), are put in order in one task each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .presence import continuity

ABSENT, STALE = "absent_from_complete_sweep", "stale"


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def gate(scope_complete: Column, stale_allowed: Column, completeness: Column, stale_eligible: Column) -> Column:
    """struct<gated, complete>: whether a run's evidence lets its scope speak, and whether as a complete one.

    Only a complete run keeps a complete scope complete. An incomplete claim, or a truncated run, may speak of stale
    listings where both the run (``stale_eligible``: local ones only) and the scope allow that; a null scope, partial and
    failed runs are silent.
    """
    whole, may = F.coalesce(scope_complete, F.lit(False)), F.coalesce(stale_eligible & stale_allowed, F.lit(False))
    gated = scope_complete.isNotNull() & F.when(completeness == "complete", whole | may).when(completeness == "truncated", may).otherwise(F.lit(False))
    return F.struct(gated.alias("gated"), (gated & (completeness == "complete") & whole).alias("complete"))


def eligible(local: Column, completeness: Column, stale_eligible: Column, scope_complete: Column) -> Column:
    """Whether a run counts as having swept its scope: complete, or truncated where a stale absence may follow; of a
    remote run only if its own scope claims to be complete, too."""
    own = (completeness == "complete") | ((completeness == "truncated") & F.coalesce(stale_eligible, F.lit(False)))
    return F.coalesce(F.when(local, own).otherwise((completeness == "complete") & F.coalesce(scope_complete, F.lit(False))), F.lit(False))


def continuous(reports: DataFrame, tolerance_s: Column) -> DataFrame:
    """``reports`` (site, run, at, scope, eligible and whatever else; one row a run and scope) with ``continuous_since``.

    An ineligible report breaks its scope. A run that doesn't sweep the null scope breaks that one at its own time.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in reports.columns]).alias("r")
    rows = reports.select("site", "scope", "at", F.struct("at", "run").alias("order"), F.coalesce("eligible", F.lit(False)).alias("ok"), own)
    runs = reports.groupBy("site", "run", "at").agg(F.max(F.col("scope").isNull()).alias("swept")).where(~F.col("swept"))
    breaks = runs.select("site", F.lit(None).cast(reports.schema["scope"].dataType).alias("scope"), "at", F.struct("at", "run").alias("order"), F.lit(False).alias("ok"), F.lit(None).cast(rows.schema["r"].dataType).alias("r"))
    out = continuity(rows.unionByName(breaks), ["site", "scope"], "at", "order", F.col("ok"), tolerance_s)
    return out.where(F.col("r").isNotNull()).select("r.*", "continuous_since")


def next_sweep(rows: DataFrame, sweeps: DataFrame, by: list[str], unit: int) -> DataFrame:
    """``rows`` (by, pos struct whose first field ``x`` is a long, and others) with ``next``: the first of ``sweeps``
    (by, pos, said) whose position is greater, null where there is none. Nulls in ``by`` are values."""
    key = [F.struct(F.col(b)).alias(f"_{b}") for b in by]
    keys = [f"_{b}" for b in by]
    cut = F.floor(F.col("pos.x") / unit).alias("_unit")
    marks = sweeps.select(*key, cut, F.col("pos").alias("_at"), F.struct("pos", "said").alias("_sweep"))
    firsts = marks.groupBy(*keys, "_unit").agg(F.min("_sweep").alias("_first"))
    own = rows.select(*key, cut, F.col("pos").alias("_at"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    # the first sweep of any later unit, for the units that hold rows or sweeps
    units = own.select(*keys, "_unit").distinct().join(firsts, [*keys, "_unit"], "full")
    # windows run backwards: a frame that begins behind its row and has no end is gone through anew for each row
    later = Window.partitionBy(*keys).orderBy(F.desc("_unit")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = units.select(*keys, "_unit", F.last("_first", ignorenulls=True).over(later).alias("_beyond"))
    both = own.withColumn("_sweep", F.lit(None).cast(marks.schema["_sweep"].dataType)).unionByName(marks.withColumn("_row", F.lit(None).cast(own.schema["_row"].dataType)))
    # rows of a position stand behind its sweeps, which are no later ones
    within = Window.partitionBy(*keys, "_unit").orderBy(F.desc("_at"), F.col("_row").isNotNull().desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_own", F.last("_sweep", ignorenulls=True).over(within)).where(F.col("_row").isNotNull())
    out = found.join(beyond, [*keys, "_unit"], "left")
    return out.select("_row.*", F.coalesce("_own", "_beyond").alias("next"))


def absences(sightings: DataFrame, reports: DataFrame, unit_s: int = 86_400) -> DataFrame:
    """Each sighting (site, key, run, at, scope: the listing's from then on) with absent_at, absent_run and reason, null
    where nothing spoke against the listing before it was seen again; ``next_at`` is when that was.

    ``sightings``: site, key, run, at, scope (null: seen without one), any number of rows a run. ``reports``: as from
    ``continuous``, with complete, gated (whether the run's evidence lets the scope speak at all), stale_allowed, grace_s.
    """
    seen = sightings.groupBy("site", "key", "run", "at").agg(F.max("scope").alias("said"))
    order = Window.partitionBy("site", "key").orderBy("at", "run")
    seen = seen.select(
        "site",
        "key",
        "run",
        "at",
        F.last("said", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("scope"),
        F.lead(F.struct("at", "run")).over(order).alias("again"),
        F.struct(_micros(F.col("at")).alias("x"), F.col("run").cast("long").alias("n")).alias("pos"),
    )
    speaking = reports.where(F.coalesce("gated", F.lit(False)))
    said = F.struct("at", F.col("run").alias("run")).alias("said")
    complete = speaking.where("complete").select("site", "scope", F.struct(_micros(F.col("at")).alias("x"), F.col("run").cast("long").alias("n")).alias("pos"), said)
    # of incomplete sweeps each that reaches further back than all before it; the others come too late to tell anything first
    grace = F.col("grace_s").cast("long") * 1_000_000
    stale = speaking.where(~F.col("complete") & F.coalesce("stale_allowed", F.lit(False)) & (_micros(F.col("at")) - _micros(F.col("continuous_since")) >= grace))
    stale = stale.withColumn("_x", _micros(F.col("at")) - grace)
    before = F.max("_x").over(Window.partitionBy("site", "scope").orderBy("at", "run").rowsBetween(Window.unboundedPreceding, -1))
    stale = stale.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_x") > F.col("_before")))
    # strictly before the grace: a sighting of the very time stands behind
    stale = stale.select("site", "scope", F.struct(F.col("_x").alias("x"), F.lit(-(1 << 63)).alias("n")).alias("pos"), said)

    unit = unit_s * 1_000_000
    out = next_sweep(seen, complete, ["site", "scope"], unit).withColumnRenamed("next", "gone")
    out = next_sweep(out, stale, ["site", "scope"], unit).withColumnRenamed("next", "old")
    # the least skips nulls
    one = lambda c, why: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.said.at").alias("at"), F.col(f"{c}.said.run").alias("run"), F.lit(why).alias("why")))
    first = F.least(one("gone", ABSENT), one("old", STALE))
    out = out.withColumn("first", first)
    told = F.col("first").isNotNull() & (F.col("again").isNull() | (F.struct("first.at", "first.run") < F.struct("again.at", "again.run")))
    return out.select("site", "key", "run", "at", "scope", F.col("again.at").alias("next_at"), *[F.when(told, F.col(f"first.{a}")).alias(b) for a, b in (("at", "absent_at"), ("run", "absent_run"), ("why", "reason"))])


def episodes(told: DataFrame) -> DataFrame:
    """Times a listing was there, from ``absences``: site, key, episode (from 1), first_seen, last_seen, sightings, and
    delisted_at and reason, null while it is there. An episode after the first is a relisting."""
    order = Window.partitionBy("site", "key").orderBy("at", "run")
    rows = told.withColumn("_new", F.coalesce(F.lag("absent_at").over(order).isNotNull(), F.lit(False)).cast("int"))
    rows = rows.withColumn("episode", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return rows.groupBy("site", "key", "episode").agg(
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("sightings"), F.max("absent_at").alias("delisted_at"), F.max("reason").alias("reason")
    )


def pulled_forward(evidence: DataFrame, told: DataFrame, bounded: Column, unit_s: int = 86_400) -> DataFrame:
    """``evidence`` (site, key, observed_at, expires_at and whatever else) with ``expires_at`` pulled forward to the
    first time that its listing was found gone (``told``: from ``absences``), where its class is ``bounded``; never
    pushed back, and a relisting doesn't restore it."""
    own = F.struct(*[F.col(f"`{c}`") for c in evidence.columns]).alias("row")
    rows = evidence.select("site", "key", F.struct(_micros(F.col("observed_at")).alias("x"), F.lit(-1).cast("long").alias("n")).alias("pos"), bounded.alias("bounded"), own)
    gone = told.where(F.col("absent_at").isNotNull()).select("site", "key", F.struct(_micros(F.col("absent_at")).alias("x"), F.lit(0).cast("long").alias("n")).alias("pos"), F.struct("absent_at").alias("said"))
    out = next_sweep(rows, gone, ["site", "key"], unit_s * 1_000_000)
    at = F.when(F.coalesce("bounded", F.lit(False)), F.least(F.col("row.expires_at"), F.col("next.said.absent_at").cast(evidence.schema["expires_at"].dataType))).otherwise(F.col("row.expires_at"))
    return out.select(*[at.alias(c) if c == "expires_at" else F.col(f"row.`{c}`").alias(c) for c in evidence.columns])
