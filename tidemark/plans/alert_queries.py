"""Registered queries of alert states and admissions, as a fold and as streams over the same events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import alerts
from ..streaming import alerting
from .common import table, work_path
from .registry import query

POLICY = alerts.Policy(polls=2, cooldown_s=129_600, gain=10.0, gain_share=0.05)
_ALERT_SQL = """WITH RECURSIVE l AS (SELECT user_id AS k, event_id AS n, ts, value AS v, value < 60 AS enters, value > 85 AS leaves, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS DOUBLE) AS v, false AS held, CAST(0 AS BIGINT) AS run, CAST(NULL AS TIMESTAMP) AS alerted, CAST(NULL AS DOUBLE) AS price, CAST(0 AS BIGINT) AS waiting, CAST(NULL AS DOUBLE) AS best, '' AS event, CAST(NULL AS TIMESTAMP) AS out_at, CAST(NULL AS DOUBLE) AS out_best, CAST(NULL AS BIGINT) AS out_n FROM l
UNION ALL SELECT k, i, n, ts, v, held, run, CASE WHEN event = 'firing' THEN ts ELSE alerted END, CASE WHEN event = 'firing' THEN v ELSE price END, CASE WHEN event = 'digested' THEN waiting + 1 ELSE waiting END, CASE WHEN event = 'digested' THEN least(best, v) ELSE best END, event, out_at, out_best, out_n FROM (
SELECT *, CASE WHEN NOT held THEN CASE WHEN alerted IS NULL THEN 'none' ELSE 'cooling' END WHEN run < 2 THEN 'pending' WHEN alerted IS NULL OR coalesce(v <= price - greatest(10, price * 0.05), false) THEN 'firing' ELSE 'digested' END AS event FROM (
SELECT *, CASE WHEN held THEN run_before + 1 ELSE 0 END AS run FROM (
SELECT f.k, l.i, l.n, l.ts, l.v, CASE WHEN enters THEN true WHEN leaves THEN false ELSE f.held END AS held, f.run AS run_before, CASE WHEN o THEN NULL ELSE alerted END AS alerted, CASE WHEN o THEN NULL ELSE price END AS price, CASE WHEN o THEN 0 ELSE waiting END AS waiting, CASE WHEN o THEN NULL ELSE best END AS best,
 CASE WHEN o AND waiting > 0 THEN alerted + INTERVAL 36 HOUR END AS out_at, CASE WHEN o AND waiting > 0 THEN best END AS out_best, CASE WHEN o AND waiting > 0 THEN waiting END AS out_n
FROM (SELECT f.*, l.ts >= f.alerted + INTERVAL 36 HOUR AS o FROM f JOIN l ON l.k = f.k AND l.i = f.i + 1) f JOIN l ON l.k = f.k AND l.i = f.i + 1)))),
z AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1)
SELECT CAST(k AS VARCHAR) AS key, n, ts AS at, event, v AS price, CAST(NULL AS BIGINT) AS waiting FROM f WHERE i > 0
UNION ALL SELECT CAST(k AS VARCHAR), NULL, out_at, 'digest', out_best, out_n FROM f WHERE out_at IS NOT NULL
UNION ALL SELECT CAST(k AS VARCHAR), NULL, alerted + INTERVAL 36 HOUR, 'digest', best, waiting FROM z WHERE waiting > 0 AND alerted + INTERVAL 36 HOUR <= (SELECT max(ts) FROM events)"""


def _sightings(events: DataFrame) -> DataFrame:
    value: Column = F.col("value")
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("at"), value.alias("price"), (value < 60).alias("enters"), (value > 85).alias("leaves"))


def _plain(out: DataFrame) -> DataFrame:
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType.fromJson(table(spark, sf_dir, "events").schema.jsonValue())
    return alerting.stateful_session(spark).readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    path = work_path(spark, name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(_ALERT_SQL)
def q_alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each watch after each sighting: debounce, cooldown, better prices, digests."""
    return _plain(alerts.alert_log(_sightings(table(spark, sf_dir, "events")), POLICY))


@query(_ALERT_SQL)
def q_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's alerts are the fold's; digests come by timer."""
    return _plain(_drained(alerting.alert_stream(_sightings(_streamed(spark, sf_dir)), POLICY), spark, "alerts"))


@query("""WITH RECURSIVE l AS (SELECT user_id % 25 AS d, user_id AS s, event_id AS n, epoch_us(ts) / 1e6 AS t, event_type <> 'signup' AS known, row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT d, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS s, CAST(4 AS DOUBLE) AS own, CAST(NULL AS DOUBLE) AS t, CAST(map([], []) AS MAP(BIGINT, STRUCT(k DOUBLE, t DOUBLE))) AS m, false AS granted FROM l
UNION ALL SELECT d, i, n, s, CASE WHEN known THEN own - CAST(granted AS INTEGER) ELSE was END, CASE WHEN known THEN t ELSE was_t END,
 CASE WHEN known THEN map_from_entries(list_concat(list_filter(map_entries(m), lambda e: e.key <> s), [{'key': s, 'value': {'k': mine - CAST(granted AS INTEGER), 't': t}}])) ELSE m END, granted FROM (
SELECT *, known AND own >= 1 AND mine >= 1 AS granted FROM (
SELECT f.d, l.i, l.n, l.s, l.t, known, f.m, f.own AS was, f.t AS was_t, CASE WHEN f.t IS NULL THEN f.own ELSE least(4, f.own + (l.t - f.t) / 9000.0) END AS own, CASE WHEN m[l.s] IS NULL THEN 2 ELSE least(2, m[l.s].k + (l.t - m[l.s].t) / 40000.0) END AS mine FROM f JOIN l ON l.d = f.d AND l.i = f.i + 1)))
SELECT CAST(d AS VARCHAR) AS domain, CAST(s AS VARCHAR) AS source, count(*) AS n, count(*) FILTER (granted) AS granted FROM f WHERE i > 0 GROUP BY 1, 2""")
def q_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokens a source and four a domain, refilled at their own rates; a request takes one of each or none."""
    known = F.col("event_type") != "signup"
    e = _streamed(spark, sf_dir).select((F.col("user_id") % 25).cast("string").alias("domain"), F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("at"), F.when(known, 2.0).alias("burst"), F.lit(1 / 40_000).alias("per_second"))
    out = _drained(alerting.admission_stream(e, 4.0, 1 / 9_000), spark, "admissions")
    return out.groupBy("domain", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("granted").alias("granted"))
