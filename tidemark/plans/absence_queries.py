"""Registered queries of scoped absence: events are sightings of users, each hour a run, and what it holds says what it swept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import absence
from .common import table
from .registry import query

_RUNS_SQL = """e AS (SELECT user_id % 2 AS site, user_id AS key, date_trunc('hour', ts) AS t, epoch_us(date_trunc('hour', ts)) // 3600000000 AS run, CASE event_type WHEN 'view' THEN 'a' WHEN 'click' THEN 'b' END AS scope, value FROM events),
p AS (SELECT site, run, t, scope, max(value) > 40 AS complete, min(value) < 60 AS gated, max(value) > 3 AS eligible, coalesce(scope, 'a') = 'a' AS stale_allowed FROM e GROUP BY 1, 2, 3, 4),
n AS (SELECT site, run, t, scope, eligible FROM p UNION ALL SELECT site, run, any_value(t), NULL, false FROM p GROUP BY 1, 2 HAVING count(*) = count(scope)),
g AS (SELECT *, lag(t) OVER w AS before, lag(eligible) OVER w AS fine FROM n WINDOW w AS (PARTITION BY site, scope ORDER BY t)),
h AS (SELECT *, last_value(CASE WHEN eligible AND NOT coalesce(fine AND t - before <= INTERVAL 9 HOUR, false) THEN t END IGNORE NULLS) OVER (PARTITION BY site, scope ORDER BY t) AS began FROM g),
r AS (SELECT p.*, CASE WHEN h.eligible THEN began END AS since FROM p JOIN h ON h.site = p.site AND h.run = p.run AND h.scope IS NOT DISTINCT FROM p.scope)"""
_TOLD_SQL = f"""{_RUNS_SQL},
s AS (SELECT site, key, run, t, max(scope) AS said FROM e GROUP BY 1, 2, 3, 4),
o AS (SELECT site, key, run, t, last_value(said IGNORE NULLS) OVER w AS scope, lead(t) OVER w AS again FROM s WINDOW w AS (PARTITION BY site, key ORDER BY t)),
c AS (SELECT o.site, o.key, o.t, min(r.t) AS c FROM o JOIN r ON r.site = o.site AND r.scope IS NOT DISTINCT FROM o.scope AND r.gated AND r.complete AND r.t > o.t GROUP BY 1, 2, 3),
z AS (SELECT o.site, o.key, o.t, min(r.t) AS z FROM o JOIN r ON r.site = o.site AND r.scope IS NOT DISTINCT FROM o.scope AND r.gated AND NOT r.complete AND r.stale_allowed AND r.t - r.since >= INTERVAL 4 HOUR AND o.t < r.t - INTERVAL 4 HOUR GROUP BY 1, 2, 3),
a AS (SELECT o.*, c, z, CASE WHEN least(c, z) < coalesce(again, TIMESTAMP '9999-01-01') THEN least(c, z) END AS gone FROM o LEFT JOIN c USING (site, key, t) LEFT JOIN z USING (site, key, t))"""


def _told(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("site"), F.col("user_id").alias("key"), F.date_trunc("hour", "ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "view", "a").when(F.col("event_type") == "click", "b").alias("scope"), "value")
    e = e.withColumn("run", F.floor(F.unix_seconds("at") / 3600))
    reports = e.groupBy("site", "run", "at", "scope").agg((F.max("value") > 40).alias("complete"), (F.min("value") < 60).alias("gated"), (F.max("value") > 3).alias("eligible"))
    reports = reports.withColumn("stale_allowed", F.coalesce("scope", F.lit("a")) == "a").withColumn("grace_s", F.lit(14_400))
    reports = absence.continuous(reports, F.lit(32_400))
    return absence.absences(e.select("site", "key", "run", "at", "scope"), reports), reports


@query(f"WITH {_RUNS_SQL} SELECT site, run, scope, since AS continuous_since FROM r")
def q_scope_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Since when each scope has been swept without a break; a run without the null scope breaks that one."""
    return _told(spark, sf_dir)[1].select("site", "run", "scope", F.col("continuous_since").cast("timestamp_ntz").alias("continuous_since"))


@query(f"WITH {_TOLD_SQL} SELECT site, key, t AS seen_at, scope, gone AS absent_at, CASE WHEN gone IS NULL THEN NULL WHEN gone = c THEN 'absent_from_complete_sweep' ELSE 'stale' END AS reason FROM a")
def q_scoped_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each sighting, the first sweep of the listing's scope that could tell it was gone."""
    plain = lambda c: F.col(c).cast("timestamp_ntz")
    return _told(spark, sf_dir)[0].select("site", "key", plain("at").alias("seen_at"), "scope", plain("absent_at").alias("absent_at"), "reason")


@query(f"""WITH {_TOLD_SQL}, f AS (SELECT *, lag(gone) OVER (PARTITION BY site, key ORDER BY t) IS NOT NULL AS fresh FROM a), i AS (SELECT *, 1 + sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY site, key ORDER BY t) AS episode FROM f)
SELECT site, key, CAST(episode AS BIGINT) AS episode, min(t) AS first_seen, max(t) AS last_seen, count(*) AS sightings, max(gone) AS delisted_at, max(CASE WHEN gone = c THEN 'absent_from_complete_sweep' WHEN gone IS NOT NULL THEN 'stale' END) AS reason FROM i GROUP BY 1, 2, 3""")
def q_presence_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times each listing was there: first and last seen, gone when and why, come back as an episode of its own."""
    out = absence.episodes(_told(spark, sf_dir)[0])
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("site", "key", "episode", plain("first_seen"), plain("last_seen"), "sightings", plain("delisted_at"), "reason")


@query(f"""WITH {_TOLD_SQL}, x AS (SELECT event_id, user_id % 2 AS site, user_id AS key, ts, ts + INTERVAL 5 DAY AS expires, event_type <> 'signup' AS bounded FROM events),
d AS (SELECT event_id, min(gone) AS gone FROM x JOIN a ON a.site = x.site AND a.key = x.key AND gone >= x.ts GROUP BY 1)
SELECT x.event_id, CASE WHEN bounded THEN least(expires, gone) ELSE expires END AS expires_at FROM x LEFT JOIN d ON d.event_id = x.event_id""")
def q_evidence_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of bounded classes expires when its listing is found gone, if not before."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 2).alias("site"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("observed_at"), (F.col("ts") + F.expr("interval 5 days")).cast("timestamp").alias("expires_at"), "event_type")
    out = absence.pulled_forward(e, _told(spark, sf_dir)[0], F.col("event_type") != "signup")
    return out.select("event_id", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))
