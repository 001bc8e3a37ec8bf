"""Registered queries of read models: what is live, what is shown of it, what waits, and what the gates of absence let through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import categories, states
from ..operators import absence, cohorts, completeness, eligibility, presence, rollups
from .common import table
from .registry import query

_NOW = "2002-06-01"


@query(f"""SELECT o_orderkey, CASE WHEN late THEN '' ELSE o_orderpriority END AS title, CASE WHEN late THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS seller, o_totalprice FROM (SELECT *, o_orderstatus = 'P' AS late FROM orders)
WHERE NOT (o_orderpriority = '5-LOW') AND (o_totalprice > 300000 OR o_orderdate + INTERVAL 2 YEAR > TIMESTAMP '{_NOW}')""")
def q_live_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither delisted nor expired; of those whose content may no longer be shown, blank."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_custkey").cast("string").alias("seller"), "o_totalprice", "o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")).alias("delisted_at"), F.when(F.col("o_totalprice") <= 300_000, F.col("o_orderdate") + F.expr("interval 2 years")).alias("expires_at"))
    live = presence.live(rows, F.expr(f"timestamp_ntz'{_NOW}'"))
    return presence.redact(live, F.col("o_orderstatus") == "P", ["title", "seller"]).select("o_orderkey", "title", "seller", "o_totalprice")


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS price, l_returnflag, l_shipdate, l_tax, CAST(l_quantity AS INTEGER) AS q, CASE WHEN l_discount <= 0.05 THEN 0.9 ELSE 0.5 END AS conf FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 10),
p AS (SELECT *, price / CASE WHEN conf >= 0.85 THEN q ELSE 1 END AS unit FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price, CASE WHEN l_tax > 0.06 THEN NULL WHEN unit <= 3000 THEN CASE WHEN l_returnflag <> 'R' THEN true END WHEN conf < 0.85 THEN NULL ELSE false END AS meets_target,
 CASE WHEN l_returnflag = 'A' THEN 'budget_paused' WHEN l_suppkey % 10 = 0 OR epoch_us(TIMESTAMP '{_NOW}') - epoch_us(l_shipdate) > CAST(2 * 86400 AS BIGINT) * 365000000 THEN 'stale' ELSE 'fresh' END AS freshness FROM p""")
def q_watch_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches on live listings with what makes them worth a look: target met or not, and how fresh they are."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.withColumn("verdict", F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 10), "match").otherwise("no_match")).withColumnRenamed("l_extendedprice", "price")
    sure = F.when(F.col("l_discount") <= 0.05, 0.9).otherwise(0.5)
    target = F.when(F.col("l_tax") <= 0.06, 3000)
    out = eligibility.shortlist(rows, "price", "l_orderkey")
    fresh = completeness.freshness(F.col("l_shipdate"), F.when(F.col("l_suppkey") % 10 != 0, 86_400 * 365), F.expr(f"timestamp_ntz'{_NOW}'"), F.col("l_returnflag") == "A")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", eligibility.meets_target(target, F.col("price"), F.col("l_returnflag") != "R", F.col("l_quantity").cast("int"), sure).alias("meets_target"), fresh.alias("freshness"))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-06-01' OR l_tax IS NULL OR l_discount > 0.09")
def q_pending_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a watch row that is missing or out of date, once each."""
    rows = table(spark, sf_dir, "lineitem")
    stale = F.when(F.col("l_tax").isNotNull(), (F.col("l_shipdate") > F.expr("timestamp_ntz'2001-06-01'")) | (F.col("l_discount") > 0.09))
    return rollups.pending(rows, "l_partkey", stale)


@query("""WITH r AS (SELECT event_id, ['complete', 'truncated', 'partial', 'failed'][user_id % 4 + 1] AS c, event_type = 'view' AS loc, value > 30 AS stale, CASE WHEN event_type <> 'signup' THEN value % 2 < 1 END AS scope, value < 70 AS allowed FROM events),
g AS (SELECT *, scope IS NOT NULL AND CASE c WHEN 'complete' THEN scope OR (stale AND allowed) WHEN 'truncated' THEN stale AND allowed ELSE false END AS gated FROM r)
SELECT event_id, gated, gated AND c = 'complete' AND scope AS complete, coalesce(CASE WHEN loc THEN c = 'complete' OR (c = 'truncated' AND stale) ELSE c = 'complete' AND coalesce(scope, false) END, false) AS eligible FROM g""")
def q_absence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run's evidence makes of the claim of its scope, and whether it counts as a sweep."""
    e = table(spark, sf_dir, "events")
    kind = F.get(F.array(*map(F.lit, ("complete", "truncated", "partial", "failed"))), (F.col("user_id") % 4).cast("int"))
    scope = F.when(F.col("event_type") != "signup", F.col("value") % 2 < 1)
    gate = absence.gate(scope, F.col("value") < 70, kind, F.col("value") > 30)
    return e.select("event_id", gate.alias("g"), absence.eligible(F.col("event_type") == "view", kind, F.col("value") > 30, scope).alias("eligible")).select("event_id", "g.gated", "g.complete", "eligible")


@query("SELECT event_type AS source, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type NOT IN ('signup') AND ts <= TIMESTAMP '2024-01-25' AND ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def q_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that prices are compared with: recent, of any listing, but for some sources."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("observed_at"), "value")
    kept = cohorts.baseline_observations(rows, F.expr("timestamp_ntz'2024-01-25'"), ["signup"], 10)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag, CASE WHEN count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_suppkey END) = 1 THEN min(CASE WHEN l_linestatus = 'O' THEN l_suppkey END) END AS supplier FROM lineitem GROUP BY 1")
def q_sole_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value if all that say one agree, nulls saying nothing."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("suppliers"))
    return rows.select("l_orderkey", eligibility.sole(F.col("flags")).alias("flag"), categories.sole(F.col("suppliers")).alias("supplier"))


@query("""SELECT event_id, CASE WHEN value < 20 THEN 'not_recorded' WHEN value < 50 THEN 'remote' ELSE 'local' END AS provider, CASE WHEN event_type = 'view' THEN 'gpu' WHEN user_id % 2 = 0 THEN 'cpu' END AS category,
CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'click' THEN 'review' WHEN value > 50 THEN 'accept' ELSE 'none' END AS outcome,
CASE WHEN event_type = 'view' THEN 'running' WHEN event_type = 'error' OR value > 90 THEN 'failed' WHEN user_id % 3 = 0 THEN 'empty' WHEN user_id % 3 = 1 THEN 'truncated' ELSE 'complete' END AS run, CASE WHEN value < 30 THEN 'drive' WHEN value < 80 THEN 'ram-2' END AS dispatched, CASE WHEN value >= 80 OR value IS NULL THEN 'bad_category' END AS reject FROM events""")
def q_run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who collected, for which category, and what came of it."""
    e, v, kind = table(spark, sf_dir, "events"), F.col("value"), F.col("event_type")
    endpoint = F.when(v >= 20, F.when(v < 50, "remote://run/1").otherwise("https://shop"))
    evidence = F.when(kind == "error", '{"error": "x", "category": "cpu"}').when(kind == "click", '{"outcome": "review", "category": "cpu"}').otherwise('{"outcome": "odd", "category": "cpu"}')
    named = F.when(F.col("user_id") % 2 == 0, evidence).otherwise(F.replace(evidence, F.lit(', "category": "cpu"'), F.lit("")))
    hint = F.when(v < 30, F.lit(None)).when(v < 80, "ram-2").otherwise("Bad Slug")
    run = states.run_outcome(F.when(kind == "view", "running").when(kind == "error", "failed").otherwise("ended"), F.get(F.array(*map(F.lit, ("complete_empty", "truncated", "complete"))), (F.col("user_id") % 3).cast("int")), F.when(v > 90, "timeout"))
    slug = states.dispatch_category(hint)
    return e.select("event_id", states.provider(endpoint, "remote://").alias("provider"), states.category(F.when(kind == "view", "gpu").otherwise(""), named).alias("category"), states.edge_outcome(named, F.when(v > 50, "model").otherwise("none")).alias("outcome"), run.alias("run"), slug["category"].alias("dispatched"), slug["reject"].alias("reject"))
