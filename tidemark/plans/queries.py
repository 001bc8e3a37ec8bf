"""Registered queries: every operator over whole tables, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys, money, mpn, title
from ..operators import alerts, asof, completeness, eligibility, latest, lifecycle, presence, reports, resolve, runs, score
from ..sources import listings
from ..streaming import heartbeat, sources
from .common import spread, table, work_path
from .registry import QUERIES, SQL, Query, query


# shortlist: parts are the catalog, their newest line items the offers, a literal watch the requirement

OFFERS_SQL = """
  SELECT p_partkey, p_brand, p_type, p_size, l_extendedprice AS price, CAST(l_quantity AS INTEGER) AS quantity,
         CASE WHEN l_quantity <= 25 THEN 0.9 ELSE 0.5 END AS confidence, l_returnflag <> 'R' AS shipping_known,
         CASE WHEN l_linestatus = 'O' THEN 'in_stock' WHEN l_returnflag = 'N' THEN 'unknown' ELSE 'out_of_stock' END AS stock
  FROM part LEFT JOIN (
    SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) = 1
  ) ON p_partkey = l_partkey
"""
_OUTCOMES_SQL = f"""
  SELECT p_partkey, p_brand, price,
    CASE WHEN p_size >= 10 THEN 'match' WHEN p_size IS NULL THEN 'unknown' ELSE 'no_match' END AS size_o,
    CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'match' WHEN p_type IS NULL THEN 'unknown' ELSE 'no_match' END AS type_o,
    CASE WHEN price IS NULL THEN 'unknown'
         WHEN price / (CASE WHEN quantity IS NOT NULL AND confidence >= 0.85 AND quantity > 0 THEN quantity ELSE 1 END) <= 3000
           THEN CASE WHEN shipping_known THEN 'match' ELSE 'unknown' END
         WHEN quantity IS NOT NULL AND confidence < 0.85 THEN 'unknown' ELSE 'no_match' END AS price_o,
    CASE WHEN stock = 'in_stock' THEN 'match' WHEN stock = 'out_of_stock' THEN 'no_match' ELSE 'unknown' END AS stock_o
  FROM ({OFFERS_SQL})
"""
_VERDICTS_SQL = f"""
  SELECT *, CASE WHEN 'no_match' IN (size_o, type_o, price_o, stock_o) THEN 'no_match'
                 WHEN 'unknown' IN (size_o, type_o, price_o, stock_o) THEN 'unknown' ELSE 'match' END AS verdict
  FROM ({_OUTCOMES_SQL})
"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    newest = latest.newest_value(items, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], ["l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"])
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", "p_brand", "p_type", "p_size")
        .join(newest, F.col("p_partkey") == F.col("l_partkey"), "left")
        .select(
            "p_partkey",
            "p_brand",
            "p_type",
            "p_size",
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.when(F.col("l_quantity") <= 25, 0.9).otherwise(0.5).alias("confidence"),
            (F.col("l_returnflag") != "R").alias("shipping_known"),
            F.when(F.col("l_linestatus") == "O", "in_stock").when(F.col("l_returnflag") == "N", "unknown").otherwise("out_of_stock").alias("stock"),
        )
    )


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(False)
    clauses = F.array(
        eligibility.clause("size", eligibility.product_outcome(eligibility.at_least(F.lit(10), F.col("p_size")), none)),
        eligibility.clause("type", eligibility.product_outcome(eligibility.one_of(F.array(*map(F.lit, ("ECONOMY", "STANDARD", "PROMO"))), F.col("p_type")), none)),
        eligibility.clause("price", eligibility.price_outcome(F.lit(3000.0), F.col("price"), F.col("shipping_known"), F.col("quantity"), F.col("confidence"))),
        eligibility.clause("stock", eligibility.stock_outcome(F.lit(True), F.col("stock"))),
    )
    return offers(spark, sf_dir).withColumn("clauses", clauses).withColumn("verdict", eligibility.verdict(F.col("clauses")))


@query(f"SELECT p_partkey, p_brand, price FROM ({_VERDICTS_SQL}) WHERE verdict = 'match' ORDER BY price NULLS LAST, p_partkey")
def q_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.shortlist(evaluated(spark, sf_dir), "price", "p_partkey").select("p_partkey", "p_brand", "price")


@query(f"SELECT p_partkey, size_o, type_o, price_o, stock_o, verdict FROM ({_VERDICTS_SQL})")
def q_tri_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = lambda i: F.get(F.col("clauses"), F.lit(i))["outcome"]
    return evaluated(spark, sf_dir).select("p_partkey", o(0).alias("size_o"), o(1).alias("type_o"), o(2).alias("price_o"), o(3).alias("stock_o"), "verdict")


@query(f"""SELECT p_brand, count(*) FILTER (verdict = 'match') AS match, count(*) FILTER (verdict = 'no_match') AS no_match,
count(*) FILTER (verdict = 'unknown') AS unknown, count(*) FILTER (price IS NULL) AS pending FROM ({_VERDICTS_SQL}) GROUP BY p_brand""")
def q_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.verdict_counts(evaluated(spark, sf_dir), ["p_brand"], F.col("price").isNull())


@query(f"SELECT p_partkey, verdict FROM ({_VERDICTS_SQL}) WHERE verdict = 'unknown' OR p_partkey % 7 = 0 ORDER BY p_partkey")
def q_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bindings of every seventh part name another brand than the live one, so they are stale."""
    stored = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_brand", F.lit("-old"))).otherwise(F.col("p_brand"))
    rows = evaluated(spark, sf_dir).withColumn("stale", eligibility.stale_fields({"brand": stored}, {"brand": F.col("p_brand")}))
    return eligibility.review_queue(rows, "p_partkey").select("p_partkey", "verdict")


# newest rows, state, upserts


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def q_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.newest_value(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["ts", "event_id", "event_type", "value"])


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value IS NULL, value DESC, event_id) = 1")
def q_one_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("value").isNull(), F.desc("value"), F.asc("event_id")]
    return latest.first_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], order).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, greatest(coalesce(seen, ts), ts) AS state_at, seen IS NULL OR ts >= seen AS moves_state FROM (
SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (
SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END AS ts FROM events))""")
def q_current_state_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh event arrives a day late."""
    late = F.when(F.col("event_id") % 11 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", late.alias("ts"))
    return latest.in_arrival_order(rows, "user_id", "event_id", "ts").select("event_id", "state_at", "moves_state")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(note, (ts, event_id)) FILTER (note IS NOT NULL) AS note
FROM (SELECT *, CASE WHEN event_type = 'view' THEN props END AS note FROM events) GROUP BY user_id""")
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer half is upserted into the older; a note that is null never overwrites one."""
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type", F.when(F.col("event_type") == "view", F.col("props")).alias("note"))
    # as both halves interleave in time, older rows of the second half must not win
    return latest.upsert(rows.where("at.event_id % 2 = 0"), rows.where("at.event_id % 2 = 1"), ["user_id"], "at", ["note"]).select("user_id", "event_type", "note")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return latest.absent_rows(table(spark, sf_dir, "orders").select("o_orderkey"), there, ["o_orderkey"])


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def q_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    return e.where("event_type = 'view'").unionByName(e.where("event_type in ('click', 'view')")).dropDuplicates(["user_id", "event_type"])


# joins in time


@query("""SELECT p.event_id, v.ts AS view_ts, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN LATERAL (SELECT ts, event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 7 DAY ORDER BY ts DESC, event_id DESC LIMIT 1) v ON true""")
def q_asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof.asof_backward(bought, views, "user_id", "ts", "view_ts", 7 * 86_400, ["view_ts", "view_id"]).select("event_id", "view_ts", "view_id")


@query("""WITH r AS (SELECT event_type AS base, CAST(ts AS DATE) AS d, count(*) AS rate FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2 HAVING count(*) > 90),
p AS (SELECT event_id, CAST(ts AS DATE) AS d, CASE user_id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'error' WHEN 2 THEN 'signup' ELSE 'none' END AS currency FROM events WHERE event_type = 'purchase')
SELECT event_id, currency, CAST(CASE WHEN currency = 'USD' THEN 1 ELSE r.rate END AS BIGINT) AS fx_rate, CAST(CASE WHEN currency = 'USD' THEN p.d ELSE r.d END AS VARCHAR) AS fx_date
FROM p LEFT JOIN LATERAL (SELECT d, rate FROM r WHERE r.base = p.currency AND r.d <= p.d AND r.d >= p.d - 7 ORDER BY d DESC LIMIT 1) r ON true""")
def q_fx_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    rates = e.where("event_type in ('error', 'signup')").groupBy(F.col("event_type").alias("base"), F.col("d").alias("rate_date")).agg(F.count(F.lit(1)).alias("rate")).where("rate > 90").withColumn("source", F.lit("events"))
    currency = F.when(F.col("user_id") % 4 == 0, "USD").when(F.col("user_id") % 4 == 1, "error").when(F.col("user_id") % 4 == 2, "signup").otherwise("none")
    bought = e.where("event_type = 'purchase'").select("event_id", "d", currency.alias("currency"))
    return asof.stamp_rates(bought, rates, "currency", "d").select("event_id", "currency", F.col("fx_rate").cast("long").alias("fx_rate"), F.col("fx_date").cast("string").alias("fx_date"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, greatest(CAST(o_orderdate AS DATE), CAST(max(l_shipdate) AS DATE)) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate),
c AS (SELECT CAST(x AS DATE) AS c_start, CAST(x + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS c_end FROM range(TIMESTAMP '1992-01-01', TIMESTAMP '2003-01-01', INTERVAL 1 MONTH) t(x))
SELECT CAST(c_start AS VARCHAR) AS c_start, count(*) AS n_orders, CAST(sum(date_diff('day', greatest(a, c_start), least(b, c_end)) + 1) AS BIGINT) AS order_days FROM o JOIN c ON a <= c_end AND b >= c_start GROUP BY c.c_start""")
def q_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("shipped"))
    o = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.greatest(F.to_date("o_orderdate"), "shipped").alias("b"))
    months = spark.range(132).select(F.add_months(F.lit("1992-01-01").cast("date"), F.col("id").cast("int")).alias("c_start")).withColumn("c_end", F.last_day("c_start"))
    both = asof.overlapping(o, months, "a", "b", "c_start", "c_end")
    days = F.date_diff(F.least("b", "c_end"), F.greatest("a", "c_start")) + 1
    return both.groupBy(F.col("c_start").cast("string").alias("c_start")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum(days).alias("order_days"))


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), k AS (SELECT d, (year(d) - 1992) * 12 + month(d) - 1 - CASE WHEN day(d) < 15 THEN 1 ELSE 0 END AS k FROM o)
SELECT CAST(CAST(DATE '1992-01-15' + to_months(CAST(k AS INTEGER)) AS DATE) AS VARCHAR) AS cycle_start, CAST(CAST(DATE '1992-01-15' + to_months(CAST(k + 1 AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS cycle_end, count(*) AS n FROM k GROUP BY ALL""")
def q_billing_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.lit("1992-01-15").cast("date")
    o = table(spark, sf_dir, "orders").select(money.cycle_start(anchor, F.col("o_orderdate")).alias("cycle_start"), money.cycle_end(anchor, F.col("o_orderdate")).alias("cycle_end"))
    return o.groupBy(F.col("cycle_start").cast("string").alias("cycle_start"), F.col("cycle_end").cast("string").alias("cycle_end")).agg(F.count(F.lit(1)).alias("n"))


# presence and retention


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q_seen_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return presence.seen(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def q_absent_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return presence.unseen(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("""WITH l AS (SELECT user_id, user_id % 5 AS scope, max(CASE WHEN event_type = 'signup' THEN ts END) AS last_seen FROM events GROUP BY user_id),
w AS (SELECT user_id % 5 AS scope, ts, user_id % 5 = 0 AND event_type <> 'error' AS complete, CASE WHEN user_id % 5 < 3 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-30' END AS since FROM events WHERE user_id % 5 < 4),
s AS (SELECT scope, max(CASE WHEN complete THEN ts END) AS complete_at, max(CASE WHEN NOT complete AND scope <> 1 AND ts - since >= INTERVAL 2 DAY THEN ts END) AS stale_at FROM w GROUP BY 1),
seen AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-28'),
j AS (SELECT l.user_id, last_seen, complete_at, stale_at, seen.user_id IS NOT NULL AS there FROM l LEFT JOIN s USING (scope) LEFT JOIN seen ON l.user_id = seen.user_id),
k AS (SELECT *, NOT there AND complete_at IS NOT NULL AND coalesce(last_seen <= complete_at, true) AS gone, NOT there AND coalesce(last_seen < stale_at - INTERVAL 2 DAY, false) AS stale FROM j)
SELECT user_id, CASE WHEN gone THEN complete_at WHEN stale THEN stale_at END AS delisted_at, CASE WHEN gone THEN 'absent_from_complete_sweep' WHEN stale THEN 'stale' END AS delist_reason FROM k""")
def q_delist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are listings last seen when they signed up, a fifth of them a scope, events its sweeps, late purchases the observations."""
    e = table(spark, sf_dir, "events").withColumn("scope", F.col("user_id") % 5).withColumn("site", F.lit(1))
    rows = e.groupBy("site", "scope", F.col("user_id").alias("key")).agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("last_seen"))
    rows = rows.withColumn("delisted_at", F.lit(None).cast("timestamp_ntz")).withColumn("delist_reason", F.lit(None).cast("string"))
    since = F.when(F.col("scope") < 3, F.expr("timestamp_ntz'2024-01-02'")).otherwise(F.expr("timestamp_ntz'2024-01-30'"))
    swept = e.where("scope < 4").select("site", "scope", F.col("ts").alias("swept_at"), ((F.col("scope") == 0) & (F.col("event_type") != "error")).alias("complete"), (F.col("scope") != 1).alias("stale_allowed"), since.alias("continuous_since"), F.lit(172_800).alias("grace_s"))
    there = e.where("event_type = 'purchase' and ts >= timestamp_ntz'2024-01-28'").select("site", F.col("user_id").alias("key"))
    return presence.delist(rows, swept, there).select(F.col("key").alias("user_id"), F.col("delisted_at").cast("timestamp_ntz").alias("delisted_at"), "delist_reason")


@query("""WITH RECURSIVE e AS (SELECT user_id % 10 AS scope, event_id AS n, ts + CASE WHEN event_id % 7 = 0 THEN INTERVAL '-3 days' ELSE INTERVAL 0 SECOND END AS moment, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS i FROM events),
f AS (SELECT DISTINCT scope, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS since, CAST(NULL AS TIMESTAMP) AS newest, CAST(NULL AS TIMESTAMP) AS broken, CAST(NULL AS TIMESTAMP) AS said FROM e
UNION ALL SELECT f.scope, e.n, e.i, CASE WHEN NOT ok THEN NULL WHEN moment <= broken OR moment < newest THEN since WHEN since IS NULL OR newest IS NULL OR moment - newest > INTERVAL '9000 seconds' THEN moment ELSE since END,
CASE WHEN ok AND NOT coalesce(moment <= broken OR moment < newest, false) THEN moment ELSE newest END, CASE WHEN NOT ok AND coalesce(broken < moment, true) THEN moment ELSE broken END,
CASE WHEN ok AND NOT coalesce(moment <= broken, false) AND NOT coalesce(moment < newest, false) THEN CASE WHEN since IS NULL OR newest IS NULL OR moment - newest > INTERVAL '9000 seconds' THEN moment ELSE since END END FROM f JOIN e ON e.scope = f.scope AND e.i = f.i + 1)
SELECT n AS event_id, said AS continuous_since FROM f WHERE i > 0""")
def q_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenths of the users are scopes, events their sweeps in order of arrival, a seventh of them reports of three days ago, errors breaks."""
    late = F.when(F.col("event_id") % 7 == 0, F.expr("ts - interval 3 days")).otherwise(F.col("ts"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("scope"), "event_id", late.alias("at"), (F.col("event_type") != "error").alias("ok"))
    return presence.continuity(rows, ["scope"], "at", "event_id", F.col("ok"), F.lit(9000)).select("event_id", "continuous_since")


@query("""SELECT fate, event_type, count(*) AS n FROM (SELECT event_type, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 'keep'
WHEN event_type = 'signup' OR user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95) THEN 'redact' ELSE 'delete' END AS fate FROM events) GROUP BY ALL""")
def q_retention_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    exempt = e.where("event_type = 'purchase' and value > 95").select("user_id")
    out = presence.retention_split(e, F.col("ts") < F.expr("timestamp_ntz'2024-01-15'"), F.col("event_type") == "signup", exempt, "user_id")
    return out.groupBy("fate", "event_type").agg(F.count(F.lit(1)).alias("n"))


# runs


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.daily_counts(table(spark, sf_dir, "events"), "ts", ["event_type"]).withColumn("day", F.col("day").cast("string"))


_READINGS_SQL = """SELECT event_id, user_id, ts, value, CASE event_type WHEN 'purchase' THEN 'out_of_stock' WHEN 'error' THEN 'unknown' WHEN 'signup' THEN NULL ELSE 'in_stock' END AS stock FROM events"""


def _stock() -> F.Column:
    kind = F.col("event_type")
    return F.when(kind == "purchase", "out_of_stock").when(kind == "error", "unknown").when(kind != "signup", "in_stock")


_DECISIONS_SQL = f"""SELECT event_id, user_id, ts, CASE WHEN stock IS NULL THEN 'failed' WHEN stock = 'unknown' THEN 'ambiguous' WHEN was IS NULL THEN 'transition_detected'
WHEN stock <> was_stock OR (value < was AND (was - value) / was >= 0.1) THEN 'transition_detected' ELSE 'unchanged' END AS decision
FROM (SELECT *, last_value(CASE WHEN stock IS NOT NULL THEN stock END IGNORE NULLS) OVER w AS was_stock, last_value(CASE WHEN stock IS NOT NULL THEN value END IGNORE NULLS) OVER w AS was FROM ({_READINGS_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"SELECT event_id, decision FROM ({_DECISIONS_SQL})")
def q_change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", "user_id", "ts", "value", _stock().alias("stock"))
    out = runs.change_decisions(rows, ["user_id"], "ts", "event_id", "value", "stock", keys.reading_fingerprint(F.col("value"), F.col("stock")), 0.1)
    return out.select("event_id", "decision")


@query("""SELECT user_id, count(g) AS n_gaps, round(median(g), 6) AS p50_gap_s, round(max(g), 6) AS max_gap_s FROM (
SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000 AS g FROM events) GROUP BY user_id""")
def q_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.gap_summary(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return out.select("user_id", "n_gaps", F.round("p50_gap_s", 6).alias("p50_gap_s"), F.round("max_gap_s", 6).alias("max_gap_s"))


@query("""WITH m AS (SELECT *, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('purchase', 'error')),
i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER w AS island, min(CASE WHEN ok THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS failures, min(ts) AS first_failed, max(ts) AS last_failed, min(nxt) AS recovered, round((epoch_us(min(nxt)) - epoch_us(min(ts))) / 1000000, 6) AS recovery_s FROM i WHERE NOT ok GROUP BY user_id, island""")
def q_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.failure_streaks(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")
    return out.withColumn("recovery_s", F.round("recovery_s", 6))


@query("""WITH p AS (SELECT *, event_type = 'error' AS b, lag(ts) OVER w AS prev, lag(event_type = 'error') OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR was OR epoch_us(ts) - epoch_us(prev) > 36000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM p)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_runs FROM s WHERE NOT b GROUP BY user_id, s""")
def q_continuity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", F.lit(36_000), F.col("event_type") == "error")


@query("SELECT user_id, count(*) AS n_runs, round(median(value), 6) AS median_value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10) GROUP BY user_id")
def q_median_last10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.median_of_last(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value").withColumn("median_value", F.round("median_value", 6))


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE event_id % 23 WHEN 0 THEN 'anti_bot' WHEN 1 THEN 'parser_rot' WHEN 2 THEN 'transient_failure' WHEN 3 THEN 'probe_success' WHEN 4 THEN 'manual_skip' WHEN 5 THEN 'manual_reactivate'
WHEN 6 THEN 'unknown_failure' WHEN 7 THEN 'degradation' WHEN 8 THEN 'probe_failure' WHEN 9 THEN 'parser_rot' ELSE 'success' END AS ev FROM events),
n AS (SELECT *, row_number() OVER w AS n, last_value(CASE WHEN ev NOT IN ('degradation', 'probe_failure', 'manual_skip', 'manual_reactivate') THEN ev END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, coalesce(ev IN ('anti_bot', 'unknown_failure') OR (ev = 'parser_rot' AND was = 'parser_rot'), false) AS hold FROM n),
l AS (SELECT *, coalesce(max(CASE WHEN ev = 'manual_reactivate' THEN n END) OVER w, 0) AS by_hand, coalesce(max(CASE WHEN ev IN ('manual_reactivate', 'probe_success') THEN n END) OVER w, 0) AS rel,
coalesce(max(CASE WHEN ev IN ('success', 'probe_success', 'manual_reactivate') THEN n END) OVER w, 0) AS good, coalesce(max(CASE WHEN ev IN ('transient_failure', 'parser_rot') THEN n END) OVER w, 0) AS bad,
coalesce(max(CASE WHEN ev = 'manual_skip' THEN n END) OVER w, 0) AS skip, coalesce(max(CASE WHEN hold THEN n END) OVER w, 0) AS held FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN skip > by_hand THEN 'skip' WHEN held > rel THEN 'paused_pending_fix' WHEN bad > good THEN 'backing_off' ELSE 'active' END AS state FROM l""")
def q_lifecycle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {0: "anti_bot", 1: "parser_rot", 2: "transient_failure", 3: "probe_success", 4: "manual_skip", 5: "manual_reactivate", 6: "unknown_failure", 7: "degradation", 8: "probe_failure", 9: "parser_rot"}
    told = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.coalesce(F.try_element_at(told, (F.col("event_id") % 23).cast("int")), F.lit("success")).alias("event"))
    return lifecycle.lifecycle(rows, "user_id", "event", ["ts", "event_id"]).select("event_id", "state")


# reports


@query("""SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS occurrences, count(*) FILTER (value > 50) AS family_only, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL HAVING count(*) >= 2""")
def q_backfill_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return reports.backfill_queue(e, ["event_type", "k"], F.col("value") > 50, "ts", 2)


@query("""SELECT l_linestatus, l_returnflag, CAST(GROUPING(l_linestatus, l_returnflag) AS BIGINT) AS grouping, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amount
FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, l_returnflag), (l_returnflag), (l_linestatus), ())""")
def q_spend_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return reports.spend_by(cents, [["l_linestatus", "l_returnflag"], ["l_returnflag"], ["l_linestatus"], []], "cents")


@query("""SELECT o_orderpriority, count(*) AS runs, count(*) FILTER (ok) AS successful, count(*) FILTER (fl) AS full_runs, count(*) FILTER (ok AND fl AND o_custkey % 2 = 0) AS complete,
CAST(sum(f) AS BIGINT) AS fetched, CAST(sum(v) AS BIGINT) AS valid, CAST(sum(CASE WHEN v <= f THEN f - v END) AS BIGINT) AS dropped,
round_even(count(*) FILTER (ok AND fl AND o_custkey % 2 = 0) / CAST(nullif(count(*) FILTER (fl), 0) AS DOUBLE), 4) AS completeness
FROM (SELECT *, o_orderstatus = 'F' AS ok, o_custkey % 3 <> 0 AS fl, o_orderkey % 100 AS f, o_custkey % 90 AS v FROM orders) GROUP BY o_orderpriority""")
def q_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_custkey", (F.col("o_orderkey") % 100).alias("f"), (F.col("o_custkey") % 90).alias("v"))
    return reports.run_stats(o, ["o_orderpriority"], F.col("o_orderstatus") == "F", F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 2 == 0, "f", "v")


@query("""SELECT user_id % 10 AS cohort, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN c END), 0) AS BIGINT) AS settled, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN c END), 0) AS BIGINT) AS open,
CAST(coalesce(sum(CASE WHEN event_type = 'error' AND value > 99.9 THEN c END), 0) AS BIGINT) AS monitoring FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY ALL""")
def q_cycle_debits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("cohort", F.col("user_id") % 10).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    kind = F.col("event_type")
    return reports.conditional_sums(e, ["cohort"], "c", {"settled": kind == "purchase", "open": kind == "view", "monitoring": (kind == "error") & (F.col("value") > 99.9)})


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS accepts, count(*) FILTER (value > 50 AND user_id % 200 <> 0) AS correct,
count(*) FILTER (value > 50) >= 100 AND count(*) FILTER (value > 50 AND user_id % 200 <> 0) * 1000 >= count(*) FILTER (value > 50) * 995 AS passes,
round_even(count(*) FILTER (value > 50 AND user_id % 200 <> 0) / CAST(nullif(count(*) FILTER (value > 50), 0) AS DOUBLE), 4) AS precision FROM events GROUP BY event_type""")
def q_matcher_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.precision(table(spark, sf_dir, "events"), F.col("value") > 50, F.col("user_id") % 200 != 0, ["event_type"])


@query("SELECT coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'none') AS c_mktsegment, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def q_grain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids repeat and count as often as they do; a thousand orders are a batch. Customers in debt have no segment."""
    batches = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000)).agg(F.collect_list("o_custkey").alias("ids"))
    named = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return reports.grain_counts(batches, "ids", named, "c_custkey", "c_mktsegment")


@query("""SELECT o_custkey, n AS n_members, CASE WHEN a AND s THEN v END AS o_orderstatus, CASE WHEN a AND p THEN w END AS o_orderpriority FROM (
SELECT o_custkey, count(*) AS n, bool_and(o_totalprice > 20000) AS a, count(DISTINCT coalesce(st, '#')) = 1 AS s, count(DISTINCT o_orderpriority) = 1 AS p, max(st) AS v, max(o_orderpriority) AS w
FROM (SELECT *, nullif(o_orderstatus, 'P') AS st FROM orders) GROUP BY o_custkey)""")
def q_agreement_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"), "o_orderpriority", "o_totalprice")
    return eligibility.agreement(o, "o_custkey", ["o_orderstatus", "o_orderpriority"], F.col("o_totalprice") > 20000)


@query("""WITH n AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY user_id),
o AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, arg_max(value, (ts, event_id)) AS v FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY user_id)
SELECT n.user_id, concat_ws(',', CASE WHEN n.t IS DISTINCT FROM o.t THEN 'event_type' END, CASE WHEN n.v IS DISTINCT FROM o.v THEN 'value' END) AS stale FROM n LEFT JOIN o ON n.user_id = o.user_id""")
def q_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda df: latest.newest_value(df, ["user_id"], ["ts", "event_id"], ["event_type", "value"])
    now, then = pick(e), pick(e.where("ts < timestamp_ntz'2024-01-30'")).select(F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.col("value").alias("v"))
    both = now.join(then, F.col("user_id") == F.col("u"), "left")
    stale = eligibility.stale_fields({"event_type": F.col("t"), "value": F.col("v")}, {"event_type": F.col("event_type"), "value": F.col("value")})
    return both.select("user_id", F.array_join(stale, ",").alias("stale"))


# money, text, catalog


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(10,2)) + CAST(coalesce(CASE WHEN l_returnflag <> 'R' THEN l_discount END, 0) AS DECIMAL(10,2)) + CAST(coalesce(CASE WHEN l_tax > 0.02 THEN 9.5 END, 0) AS DECIMAL(10,2)) AS VARCHAR) AS landed,
CASE WHEN l_returnflag = 'R' THEN 'unknown' WHEN l_discount = 0 THEN 'free' ELSE 'paid' END AS shipping FROM lineitem""")
def q_landed_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    ship = F.when(F.col("l_returnflag") != "R", F.col("l_discount"))
    tax = F.when(F.col("l_tax") > 0.02, F.lit("9.50").cast("decimal(10,2)"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", money.landed_total(F.col("l_extendedprice"), ship, tax).cast("string").alias("landed"), money.shipping_bucket(ship).alias("shipping"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') AS alias_key, sha256(p_name) AS name_hash FROM part")
def q_alias_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", keys.alias_key(F.concat_ws(" ", "p_name", "p_brand")).alias("alias_key"), keys.sha(F.col("p_name")).alias("name_hash"))


@query("""WITH t AS (SELECT p_partkey, 'st' || CAST(p_size * 500 AS VARCHAR) || CASE p_partkey % 5 WHEN 0 THEN 'ne' WHEN 1 THEN 'vn' WHEN 2 THEN 'vx' WHEN 3 THEN 'dm' ELSE 'nm' END || CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') END AS token FROM part),
m AS (SELECT *, regexp_full_match(token, 'st(\\d{3,6})([a-z]{2})(\\d{3})([a-z0-9]?)') AS ok, regexp_extract(token, '^st(\\d{3,6})([a-z]{2})', 2) AS seg FROM t)
SELECT p_partkey, token, CASE WHEN ok THEN 'seagate' END AS vendor, CASE WHEN ok THEN CASE seg WHEN 'ne' THEN 'ironwolf pro' WHEN 'vn' THEN 'ironwolf' WHEN 'vx' THEN 'skyhawk' WHEN 'dm' THEN 'barracuda' END END AS family,
CASE WHEN ok THEN CAST(regexp_extract(token, '^st(\\d{3,6})', 1) AS BIGINT) * 1000000000 END AS capacity_bytes FROM m""")
def q_mpn_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    segment = F.get(F.array(*map(F.lit, ("ne", "vn", "vx", "dm", "nm"))), (k % 5).cast("int"))
    tail = F.when(k % 7 == 0, "x").otherwise(F.lpad((k % 1000).cast("string"), 3, "0"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("st"), (F.col("p_size") * 500).cast("string"), segment, tail).alias("token"))
    return rows.withColumn("d", mpn.decode_seagate(F.col("token"))).select("p_partkey", "token", "d.vendor", "d.family", "d.capacity_bytes")


@query("""SELECT p_partkey, CAST(p_size AS BIGINT) * 1000000000000 AS capacity_bytes, CASE p_partkey % 3 WHEN 0 THEN 'sata' WHEN 1 THEN 'sas' ELSE 'nvme' END AS interface, '3.5' AS form_factor, CAST(5400 + 100 * p_size AS INTEGER) AS rpm,
CASE p_partkey % 4 WHEN 0 THEN 'seagate' WHEN 1 THEN 'western_digital' WHEN 2 THEN 'toshiba' ELSE 'hgst' END AS brand,
CASE p_partkey % 5 WHEN 0 THEN 'recertified' WHEN 1 THEN 'used' WHEN 2 THEN 'new' WHEN 3 THEN 'for_parts' END AS condition, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS INTEGER) END AS quantity FROM part""")
def q_title_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles made from the catalog's columns are read back."""
    k = F.col("p_partkey")
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    quoted = F.when(k % 2 == 0, F.concat(F.lit("LOT OF "), "p_size", F.lit(" "))).otherwise("")
    text = F.concat(quoted, pick("Seagate", "WD", "TOSHIBA", "Hitachi"), F.lit(" "), "p_size", F.lit("TB "), pick("SATA", "SAS", "NVMe"), F.lit(" 6Gb/s 3.5\" "), (5400 + 100 * F.col("p_size")).cast("string"), F.lit("RPM "), pick("factory recertified", "used", "NEW", "as-is", "not used"), F.lit(" — FREE SHIPPING, replacement for Kioxia open box"))
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", title.canonical_title(text).alias("t"))
    a = title.attributes(F.col("t"))
    return rows.select("p_partkey", a["capacity"]["bytes"].alias("capacity_bytes"), a["interface"].alias("interface"), a["form_factor"].alias("form_factor"), a["rpm"].alias("rpm"), a["brand"].alias("brand"), a["condition"]["value"].alias("condition"), a["quantity"]["n"].alias("quantity"))


@query("""WITH a AS (SELECT regexp_replace(lower(p_type || p_size), '[^a-z0-9]', '', 'g') AS norm, CASE p_partkey % 3 WHEN 0 THEN 'mpn' WHEN 1 THEN 'oem_pn' ELSE 'house_sku' END AS alias_type, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 25 END AS site, p_partkey AS model_id FROM part),
l AS (SELECT event_id AS listing_id, user_id % 25 AS site, regexp_replace(lower(p_type || p_size), '[^a-z0-9]', '', 'g') AS norm, CASE event_type WHEN 'click' THEN 'manufacturer_mpn' WHEN 'view' THEN 'oem' WHEN 'error' THEN 'house_sku' ELSE 'structured' END AS kind FROM events JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part))
SELECT listing_id, count(*) AS hits, count(DISTINCT model_id) AS models, sum(model_id) AS sum_model, count(*) FILTER (WHERE alias_type = 'oem_pn') AS oem FROM l JOIN a ON l.norm = a.norm WHERE (a.site IS NULL OR a.site = l.site) AND CASE kind WHEN 'manufacturer_mpn' THEN alias_type = 'mpn' WHEN 'oem' THEN alias_type = 'oem_pn' WHEN 'house_sku' THEN alias_type = 'house_sku' ELSE true END GROUP BY listing_id""")
def q_alias_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a listing whose candidate is the key of some part."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    key = keys.alias_key_ascii(F.concat("p_type", "p_size"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % part.count()).alias("n"))
    kind = F.when(F.col("event_type") == "click", "manufacturer_mpn").when(F.col("event_type") == "view", "oem").when(F.col("event_type") == "error", "house_sku").otherwise("structured")
    rows = e.join(part, F.col("n") == k).select(F.col("event_id").alias("listing_id"), (F.col("user_id") % 25).alias("site"), F.array(F.struct(key.alias("norm"), kind.alias("kind"))).alias("candidates"))
    alias_type = F.when(k % 3 == 0, "mpn").when(k % 3 == 1, "oem_pn").otherwise("house_sku")
    aliases = part.select(key.alias("norm"), alias_type.alias("alias_type"), F.when(k % 4 == 0, k % 25).alias("site"), k.alias("model_id"), F.col("p_size").alias("family_id"), F.col("p_brand").alias("brand"))
    return resolve.alias_counts(rows, aliases, "oem_pn").withColumnRenamed("of_type", "oem")


_LADDER_SQL = """
WITH makers AS (SELECT unnest(range(6)) AS i, unnest(['western_digital', 'hgst', 'seagate', 'toshiba', 'sandisk', 'samsung']) AS maker, unnest(['ultrastar', 'ultrastar', 'ironwolf', 'n300', 'optimus', 'evo']) AS line),
listing AS (
  SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'western_digital' WHEN '2-HIGH' THEN 'seagate' WHEN '3-MEDIUM' THEN 'toshiba' END AS brand, o_custkey % 11 = 0 AS lot, o_custkey % 7 = 0 AS two,
         CASE WHEN o_orderstatus = 'P' THEN o_custkey % 4 + 1 END AS tb, CASE WHEN o_custkey % 6 = 0 THEN 'sas' END AS bus, o_custkey % 5 = 0 AS says_pro, o_custkey % 2 = 0 AS decodes, o_custkey % 13 = 0 AS has_prior,
         CASE o_orderpriority WHEN '1-URGENT' THEN 0.92 WHEN '2-HIGH' THEN 0.85 ELSE 0.75 END AS source
  FROM orders
),
hit AS (
  SELECT l_orderkey AS id, 'n' || (l_linenumber % 3) AS norm, CASE WHEN l_orderkey % 3 = 0 OR l_returnflag = 'R' THEN 'oem_pn' ELSE 'mpn' END AS kind,
         CASE WHEN l_linestatus = 'O' THEN 0.98 WHEN l_suppkey % 3 = 0 THEN 0.95 WHEN l_suppkey % 3 = 1 THEN 0.85 ELSE 0.5 END AS trust,
         'f' || (p_size % 12 // 2) AS family, 'm' || (p_size % 12) AS model, maker, line, CASE WHEN l_discount < 0.03 THEN maker WHEN l_discount < 0.05 THEN 'toshiba' ELSE '' END AS vendor,
         l_tax >= 0.06 AS structured, l_quantity > 40 AS doubt_only, p_size % 4 + 1 AS tb, CASE WHEN p_size % 3 = 0 THEN 'sas' ELSE 'sata' END AS bus
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN makers ON i = p_size % 12 // 2
),
kin AS (SELECT * FROM (VALUES ('western_digital'), ('hgst'), ('sandisk')) k(brand)),
judged AS (
  SELECT h.*, l.brand IS NULL OR l.brand = maker OR (l.brand IN (FROM kin) AND maker IN (FROM kin)) AS agrees,
         coalesce(l.tb <> h.tb, false) OR coalesce(l.bus <> h.bus, false) OR (says_pro AND maker = 'seagate') AS vetoed
  FROM hit h JOIN listing l USING (id)
),
ground AS (SELECT id, count(*) AS n FROM judged WHERE NOT doubt_only GROUP BY id),
viable AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY trust DESC, norm, kind, family, model, vendor, structured) AS rn FROM judged WHERE agrees AND NOT doubt_only),
fit AS (SELECT id, count(*) AS n, count(DISTINCT model) AS targets, count(DISTINCT family) AS families, bool_and(kind = 'oem_pn') AS oem, bool_or(NOT vetoed) AS clean, min(family) AS family, min(line) FILTER (WHERE NOT vetoed) AS line, min(maker) AS maker FROM viable GROUP BY id),
best AS (SELECT * FROM viable WHERE rn = 1),
named AS (SELECT id, count(DISTINCT norm) AS norms, bool_or(model = 'm5') AS m5 FROM hit GROUP BY id),
shared AS (SELECT id, max(n) AS most FROM (SELECT id, model, count(DISTINCT norm) AS n FROM hit GROUP BY id, model) GROUP BY id),
mpns AS (SELECT id, count(DISTINCT norm) AS norms, count(DISTINCT model) AS models FROM hit WHERE norm IN ('n0', 'n1') GROUP BY id),
rung AS (
  SELECT l.*, g.n AS grounded, CASE
    WHEN has_prior THEN CASE WHEN l.tb <> 2 OR l.bus <> 'sata' THEN '0review:veto' ELSE '0accept:prior' END
    WHEN g.n > 0 AND f.n IS NULL THEN '1review:brand_contradicts_exact_alias'
    WHEN g.n > 0 AND targets = 1 AND b.vetoed THEN '1review:veto'
    WHEN g.n > 0 AND targets = 1 AND NOT (l.brand IS NOT NULL OR b.structured OR b.vendor = b.maker OR (b.vendor IN (FROM kin) AND b.maker IN (FROM kin))) THEN '1review:no_brand_evidence'
    WHEN g.n > 0 AND targets = 1 THEN '1accept:exact_alias'
    WHEN g.n > 0 AND families = 1 AND oem AND clean THEN '1accept:oem_fan_out'
    WHEN g.n > 0 THEN '1review:conflicting_targets'
    WHEN NOT decodes THEN '-none:no_evidence'
    WHEN coalesce(l.brand <> 'seagate', false) THEN '2review:brand_contradicts_decode'
    WHEN says_pro THEN '2review:family_contradicts_decode'
    WHEN coalesce(l.tb <> 2, false) THEN '2review:veto'
    ELSE '2accept:mpn_decode' END AS r, b.model AS best_model, b.trust AS best_trust, f.family AS fan_family,
    CASE WHEN has_prior THEN 'toshiba' WHEN g.n > 0 AND targets = 1 THEN b.maker WHEN g.n > 0 THEN f.maker ELSE 'seagate' END AS g_maker,
    CASE WHEN has_prior THEN 'n300' WHEN g.n > 0 AND targets = 1 THEN b.line WHEN g.n > 0 THEN f.line ELSE 'ironwolf' END AS g_line,
    CASE WHEN has_prior THEN 2 WHEN g.n > 0 AND targets = 1 THEN b.tb WHEN g.n > 0 THEN NULL ELSE 2 END AS g_tb,
    CASE WHEN has_prior THEN 'm5' WHEN g.n > 0 AND targets = 1 THEN b.model END AS g_model
  FROM listing l LEFT JOIN ground g USING (id) LEFT JOIN fit f USING (id) LEFT JOIN best b USING (id)
),
beside AS (
  SELECT r.id, bool_or(coalesce(h.tb <> g_tb, false) OR NOT ((h.maker = g_maker OR (h.maker IN (FROM kin) AND g_maker IN (FROM kin))) AND h.line = g_line)) AS disowned
  FROM rung r JOIN hit h ON r.id = h.id WHERE doubt_only AND h.model IS DISTINCT FROM g_model GROUP BY r.id
),
whys AS (
  SELECT r.*, concat_ws(',', CASE WHEN n.norms > 1 AND s.most < n.norms THEN 'conflicting_alias_models' END, CASE WHEN r[1] = '0' AND n.id IS NOT NULL AND NOT n.m5 THEN 'prior_model_not_named' END,
    CASE WHEN disowned THEN 'review_only_alias_conflict' END, CASE WHEN lot THEN 'lot' END, CASE WHEN two AND NOT coalesce(p.norms = 2 AND p.models = 1, false) THEN 'multiple_mpns' END) AS why
  FROM rung r LEFT JOIN named n USING (id) LEFT JOIN shared s USING (id) LEFT JOIN mpns p USING (id) LEFT JOIN beside USING (id)
),
said AS (SELECT *, regexp_extract(r, '.([a-z]+):', 1) AS o, split_part(r, ':', 2) AS reason, r LIKE '%accept%' AND why <> '' AS down FROM whys)
SELECT id AS listing_id, CASE WHEN down THEN 'review' ELSE o END AS outcome, CASE WHEN r[1] <> '-' THEN CAST(r[1] AS INTEGER) END AS rung,
  CASE WHEN down OR o <> 'accept' THEN 'none' WHEN reason IN ('prior', 'exact_alias') THEN 'model' ELSE 'family' END AS grain,
  CASE WHEN down OR o <> 'accept' THEN NULL WHEN reason = 'prior' THEN 'm5' WHEN reason = 'exact_alias' THEN best_model WHEN reason = 'oem_fan_out' THEN fan_family ELSE 'seagate/ironwolf' END AS target,
  CAST(CASE WHEN down OR o <> 'accept' THEN 0 WHEN reason = 'prior' THEN 0.9 WHEN reason = 'exact_alias' THEN best_trust WHEN reason = 'oem_fan_out' THEN 0.8 ELSE source END AS DOUBLE) AS confidence,
  CASE WHEN down THEN why ELSE reason END AS reason
FROM said
"""


@query(_LADDER_SQL)
def q_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are listings and their lines are hits on models made from parts: every rung, veto and ambiguity occurs."""
    o, c, size = table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("p_size")
    pick = lambda n, *xs: F.get(F.array(*map(F.lit, xs)), n.cast("int"))
    null = lambda kind: F.lit(None).cast(kind)
    tera = lambda n: n.cast("long") * 10**12

    def spec(capacity: F.Column, interface: F.Column, maker: F.Column, line: F.Column) -> F.Column:
        words = [interface.alias("interface"), *[null("string").alias(w) for w in ("form_factor", "sector_format", "security")]]
        return F.struct(capacity.alias("capacity"), *words, F.struct(maker.alias("brand"), line.alias("name")).alias("family"))

    pro = F.array(F.struct(F.lit("seagate").alias("brand"), F.lit("ironwolf pro").alias("name")))
    said = spec(F.when(F.col("o_orderstatus") == "P", tera(c % 4 + 1)), F.when(c % 6 == 0, "sas"), null("string"), null("string"))
    urgent = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    lst = o.select(
        F.col("o_orderkey").alias("listing_id"), pick(urgent, "western_digital", "seagate", "toshiba", None, None).alias("brand"), F.when(c % 11 == 0, 2).otherwise(1).alias("quantity"),
        F.when(c % 7 == 0, F.array(F.lit("n0"), F.lit("n1"))).otherwise(F.array(F.lit("n0"))).alias("mpns"), said.alias("spec"), F.when(c % 5 == 0, pro).alias("mentions"),
    )
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    nth = F.floor(size % 12 / 2)
    maker, line = pick(nth, "western_digital", "hgst", "seagate", "toshiba", "sandisk", "samsung"), pick(nth, "ultrastar", "ultrastar", "ironwolf", "n300", "optimus", "evo")
    hits = li.select(
        F.col("l_orderkey").alias("listing_id"), F.concat(F.lit("n"), F.col("l_linenumber") % 3).alias("norm"), F.when((F.col("l_orderkey") % 3 == 0) | (F.col("l_returnflag") == "R"), "oem_pn").otherwise("mpn").alias("alias_type"),
        F.when(F.col("l_linestatus") == "O", "catalog_authoritative").otherwise(pick(F.col("l_suppkey") % 3, "manual", "listing_derived", None)).alias("source_kind"), F.concat(F.lit("f"), nth).alias("family_id"), F.concat(F.lit("m"), size % 12).alias("model_id"),
        maker.alias("brand"), F.when(F.col("l_discount") < 0.03, maker).when(F.col("l_discount") < 0.05, "toshiba").otherwise("").alias("vendor"), (F.col("l_tax") >= 0.06).alias("structured"), (F.col("l_quantity") > 40).alias("review_only"),
        spec(tera(size % 4 + 1), F.when(size % 3 == 0, "sas").otherwise("sata"), maker, line).alias("spec"),
    )
    decoded = o.where(c % 2 == 0).select(F.col("o_orderkey").alias("listing_id"), F.lit("seagate").alias("vendor"), F.lit("ironwolf").alias("family"), F.lit(2 * 10**12).alias("capacity"), pick(urgent, "vendor_official", "corroborated_community", "inferred", "inferred", "inferred").alias("provenance"))
    prior = spec(F.lit(2 * 10**12), F.lit("sata"), F.lit("toshiba"), F.lit("n300"))
    priors = o.where(c % 13 == 0).select(F.col("o_orderkey").alias("listing_id"), F.lit("model").alias("grain"), F.lit("m5").alias("target"), F.lit("m5").alias("model_id"), F.lit(0.9).alias("confidence"), prior.alias("spec"))
    return resolve.decide(lst, hits, decoded, priors)


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS n_links, sha256(url) AS url_hash FROM pages""")
def q_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    links = listings.page_links(p.select("page_id", "html")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))
    out = p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), keys.sha(F.col("url")).alias("url_hash"))
    return out.join(links, "page_id", "left").select("page_id", "title", F.coalesce("n_links", F.lit(0)).alias("n_links"), "url_hash")


@query("""SELECT event_id, CASE WHEN length(props) > 9 THEN 'too_large' WHEN json_extract_string(props, '$.k') IS NULL THEN 'contract' WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 10 THEN 'invariant' END AS reject FROM events""")
def q_row_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "struct<k: int>")["k"]
    checks = {"too_large": F.octet_length("props") > 9, "contract": k.isNull(), "invariant": k < 10}
    return table(spark, sf_dir, "events").select("event_id", listings.reject_reason(checks).alias("reject"))


# scores


@query("""WITH w AS (SELECT *, pow(2.0, -p_size / 30.0) AS w FROM part),
v AS (SELECT p_brand, p_retailprice, sum(w) AS wv, sum(w * w) AS w2 FROM w GROUP BY ALL),
q AS (SELECT *, sum(wv) OVER (PARTITION BY p_brand) AS total, sum(w2) OVER (PARTITION BY p_brand) AS t2, coalesce(sum(wv) OVER (PARTITION BY p_brand ORDER BY p_retailprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v),
r AS (SELECT p_brand, p_retailprice, (below + 0.5 * wv) / total AS q, total * total / t2 AS n_eff FROM q),
s AS (SELECT p_partkey, q, n_eff, least(1.0, n_eff / 30.0) AS lam, p_size FROM part JOIN r USING (p_brand, p_retailprice))
SELECT p_partkey, round(q, 6) AS q, round(n_eff, 4) AS n_eff, round(lam * (1 - q) + (1 - lam) * 0.5, 6) AS s_price, n_eff < 30 AS provisional FROM s""")
def q_price_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score.cohort_rank(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", score.decay(F.col("p_size")))
    return out.select("p_partkey", F.round("q", 6).alias("q"), F.round("n_eff", 4).alias("n_eff"), F.round("s_price", 6).alias("s_price"), "provisional")


@query("""WITH b AS (SELECT s_suppkey, (s_suppkey % 101) / 100.0 AS p, s_suppkey % 37 AS n, s_nationkey FROM supplier),
t AS (SELECT *, CASE WHEN n = 0 THEN 0.6 ELSE 0.6 * ((19.0 + p * n) / (20.0 + n)) + 0.4 * ((p + 1.2816 * 1.2816 / (2 * n) - 1.2816 * sqrt((p * (1 - p) + 1.2816 * 1.2816 / (4 * n)) / n)) / (1 + 1.2816 * 1.2816 / n)) END AS seller FROM b)
SELECT s_suppkey, round(seller, 6) AS seller, CAST(round(100 * least(pow(greatest(p, 0.02), 0.5) * pow(greatest((0.5 * p + 0.3 * 0.85 + 0.2 * 1.0), 0.02), 0.25) * pow(greatest(seller, 0.02), 0.15) * pow(greatest(CASE WHEN s_nationkey % 2 = 0 THEN 1.0 ELSE 0.3 END, 0.02), 0.1),
 least(CASE WHEN s_nationkey % 5 = 0 THEN 0.35 ELSE 1.0 END, CASE WHEN s_nationkey % 3 = 0 THEN 0.60 ELSE 1.0 END, CASE WHEN seller < 0.5 THEN 0.60 ELSE 1.0 END))) AS INTEGER) AS score FROM t""")
def q_deal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("s_suppkey") % 101) / 100.0
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", p.alias("p"), (F.col("s_suppkey") % 37).alias("n"))
    rows = rows.withColumn("seller", score.seller_trust(F.col("p"), F.col("n")))
    stock = F.when(F.col("s_nationkey") % 2 == 0, 1.0).otherwise(0.3)
    total = score.total_score(F.col("p"), score.fitness(F.col("p"), F.lit(0.85), F.lit(1.0)), F.col("seller"), stock, F.col("s_nationkey") % 5 == 0, F.col("s_nationkey") % 3 == 0)
    return rows.select("s_suppkey", F.round("seller", 6).alias("seller"), total.alias("score"))


@query("""SELECT event_id, user_id, level FROM (SELECT *, lag(level) OVER w AS was, row_number() OVER w AS n FROM (SELECT event_id, user_id, ts, CAST(floor(value / 40) AS BIGINT) AS level FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR level IS DISTINCT FROM was""")
def q_price_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor(F.col("value") / 40).alias("level"))
    return score.price_events(rows, "user_id", "ts", "event_id", "level").select("event_id", "user_id", "level")


# completeness and alerts


@query("""WITH p AS (SELECT o_custkey AS sweep, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS page_no, o_orderpriority, o_orderkey, o_orderkey % 31 = 0 AS dropped, o_orderkey % 3 AS items, o_orderkey % 7 AS m FROM orders),
b AS (SELECT *, CASE WHEN m = 6 THEN 'unparseable_page' WHEN m = 1 AND page_no > 0 THEN 'offset_gap' WHEN items = 0 AND page_no > 0 THEN 'silent_window_end' WHEN m = 2 THEN 'total_missing' END AS bad FROM p),
g AS (SELECT sweep, o_orderpriority, count(*) AS n, bool_or(dropped) AS dropped, arg_min(bad, page_no) FILTER (WHERE bad IS NOT NULL) AS bad, arg_max(m = 3, page_no) AS nxt, count(DISTINCT CASE WHEN m <> 2 THEN items END) AS totals, max(CASE WHEN m <> 2 THEN items END) AS total, count(DISTINCT o_orderkey % 2) AS ids FROM b GROUP BY ALL),
a AS (SELECT c_custkey AS sweep, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS o_orderpriority FROM customer UNION SELECT sweep, o_orderpriority FROM g)
SELECT sweep, o_orderpriority AS scope, coalesce(n, 0) AS n_pages, CAST(coalesce(ids, 0) AS INTEGER) AS n_ids, CASE WHEN n IS NULL THEN 'empty' WHEN dropped THEN 'parse_drop' WHEN bad IS NOT NULL THEN bad WHEN nxt AND n >= 3 THEN 'page_cap' WHEN nxt THEN 'next_present'
WHEN totals <> 1 THEN 'total_unstable' WHEN total > ids THEN 'total_exceeds_seen' WHEN n > 1 THEN 'multi_page_unprovable' END AS verdict FROM a LEFT JOIN g USING (sweep, o_orderpriority)""")
def q_sweep_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders of one priority are the pages of a sweep; every customer has a sweep of every priority."""
    k, n = F.col("o_orderkey"), F.col("page_no")
    m = k % 7
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sweep"), F.col("o_orderpriority").alias("scope"), k)
    pages = o.withColumn("page_no", F.row_number().over(Window.partitionBy("sweep", "scope").orderBy(k)) - 1)
    pages = pages.select("sweep", "scope", n, (m != 6).alias("parsed"), F.when((m == 1) & (n > 0), -1).otherwise(n * 200).alias("offset"), F.when(m != 2, k % 3).alias("total"), (k % 3).alias("items"), F.array(k % 2).alias("distinct_ids"), (m == 3).alias("has_next"), (k % 31 == 0).cast("int").alias("dropped"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sweep"), F.explode(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))).alias("scope"))
    asked = asked.union(o.select("sweep", "scope"))
    return completeness.sweep_verdicts(pages, ["sweep", "scope"], 200, 3, asked)


@query("""WITH r AS (SELECT event_id AS e, event_type AS t, event_id % 10 AS counted, least(event_id % 13, event_id % 10) AS usable, event_id % 7 = 1 AS hit, event_id % 5 <> 0 AS whole, event_id % 41 = 0 AS cut, event_id % 37 = 0 AS miscounted, event_id % 3 AS pages, CASE WHEN event_id % 4 = 0 THEN event_id % 10 END AS said, event_id % 17 = 0 AS errors FROM events),
s AS (SELECT *, CASE t WHEN 'error' THEN 'TIMED-OUT' WHEN 'signup' THEN 'ABORTED' ELSE 'SUCCEEDED' END AS status FROM r),
c AS (SELECT *, concat_ws(', ', CASE WHEN whole AND hit THEN 'complete_with_limit_hit' END, CASE WHEN whole AND cut THEN 'complete_and_truncated' END, CASE WHEN cut AND NOT hit AND status <> 'TIMED-OUT' THEN 'truncated_without_limit_hit' END,
 CASE WHEN miscounted THEN 'count_mismatch' END, CASE WHEN whole AND pages < 1 THEN 'complete_with_pages_unfetched' END) AS against FROM s),
k AS (SELECT *, CASE WHEN e % 29 = 0 THEN 'failed/missing_output' WHEN e % 23 = 0 THEN 'failed/unknown_schema_version' WHEN e % 19 = 0 THEN 'failed/scope_mismatch' WHEN against <> '' THEN 'failed/contradictory_report: ' || against
 WHEN counted > 0 AND usable = 0 THEN 'failed/no_usable_items' WHEN status = 'ABORTED' AND counted > 0 THEN 'partial_failure/remote_failed_with_items' WHEN status = 'ABORTED' THEN 'failed/remote_failed_empty' WHEN errors THEN 'partial_failure/errors_reported: a, b'
 WHEN hit AND status = 'TIMED-OUT' THEN 'truncated/truncated: time, pages' WHEN hit THEN 'truncated/truncated: pages' WHEN status = 'TIMED-OUT' THEN 'truncated/truncated: time' WHEN counted = 0 AND whole AND pages >= 1 AND said = 0 THEN 'complete/complete_empty' WHEN counted = 0 THEN 'failed/ambiguous_empty'
 WHEN NOT whole THEN 'failed/unexplained_incomplete' WHEN usable < counted THEN 'partial_failure/unusable_items' ELSE 'complete/complete' END AS c FROM c)
SELECT split_part(c, '/', 1) AS completeness, split_part(c, '/', 2) AS reason, CASE WHEN c LIKE 'truncated/%' THEN CASE WHEN status = 'TIMED-OUT' THEN 'time' ELSE 'pages' END END AS "limit", count(*) AS n FROM k GROUP BY ALL""")
def q_run_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    status = F.when(F.col("event_type") == "error", "TIMED-OUT").when(F.col("event_type") == "signup", "ABORTED").otherwise("SUCCEEDED")
    report = F.struct(
        (e % 23 != 0).alias("schema_ok"), F.lit(True).alias("valid"), (e % 19 != 0).alias("scope_ok"), (e % 5 != 0).alias("complete"), (e % 41 == 0).alias("truncated"), F.lit(True).alias("succeeded"),
        F.when(e % 7 == 1, F.array(F.lit("pages"))).otherwise(F.array().cast("array<string>")).alias("limits"), F.when(e % 37 == 0, -1).otherwise(e % 10).alias("items_emitted"), F.when(e % 4 == 0, e % 10).alias("items_declared"),
        (e % 3).alias("pages_fetched"), F.greatest(e % 3, F.lit(1)).alias("pages_declared"), F.when(e % 17 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )
    kind = completeness.run_class(status, F.when(e % 29 != 0, report), e % 10, F.least(e % 13, e % 10))
    return table(spark, sf_dir, "events").select(kind.alias("c")).groupBy("c.completeness", "c.reason", "c.limit").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(CASE WHEN s IN (408, 500, 502, 504) THEN 'transient' WHEN s IN (401, 403, 429, 503) THEN 'anti_bot' WHEN e % 3 = 0 AND e % 11 = 0 THEN 'anti_bot' WHEN p LIKE '%7%' THEN 'anti_bot' WHEN value < 0.2 * m THEN 'anti_bot' WHEN s >= 400 THEN 'unknown' END, 'healthy') AS kind, s AS status, count(*) AS n
FROM (SELECT event_id AS e, value, props AS p, list_extract([200, 200, 200, 401, 403, 404, 408, 410, 429, 500, 502, 503, 504, 505], CAST(event_id % 14 AS INTEGER) + 1) AS s, median(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY ALL""")
def q_response_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    usual = rows.groupBy(F.col("event_type").alias("_t")).agg(F.median("value").alias("usual"))
    rows = rows.join(usual, F.col("event_type") == F.col("_t"))
    status = F.get(F.array(*map(F.lit, (200, 200, 200, 401, 403, 404, 408, 410, 429, 500, 502, 503, 504, 505))), (F.col("event_id") % 14).cast("int"))
    kind = runs.response_class(status, F.col("event_id") % 11 != 0, F.col("event_id") % 3 == 0, F.col("props").contains("7"), F.col("value"), F.col("usual"))
    return rows.select(F.coalesce(kind, F.lit("healthy")).alias("kind"), status.alias("status")).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT s_nationkey % 3 AS s, CASE WHEN s_suppkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS c, s_suppkey % 7 <> 0 AS ok FROM supplier) m WHERE ok AND m.s = o_custkey % 30 AND m.c = o_orderpriority)""")
def q_admission_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 3).alias("source"), F.when(F.col("s_suppkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("category"), F.when(F.col("s_suppkey") % 7 != 0, "admitted").otherwise("denied").alias("status"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 30).alias("source"), F.col("o_orderpriority").alias("category"))
    return completeness.admitted(o, m).select("o_orderkey", "o_orderpriority")


@query("""SELECT user_id, CASE WHEN user_id % 9 = 0 THEN 'budget_paused' WHEN max(ts) IS NULL THEN 'stale' WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) > 2 * 21600 * 1000000::BIGINT THEN 'stale' ELSE 'fresh' END AS freshness FROM events GROUP BY user_id""")
def q_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return last.select("user_id", completeness.freshness(F.col("ts"), F.lit(21_600), F.expr("timestamp_ntz'2024-01-31'"), F.col("user_id") % 9 == 0).alias("freshness"))


@query("""SELECT coalesce(d, l) AS doc_id, coalesce(nd, 0) AS n_predictions, coalesce(nl, 0) AS n_labels FROM (SELECT doc_id AS d, count(*) AS nd FROM documents GROUP BY 1) FULL JOIN (SELECT doc_id AS l, count(*) AS nl FROM labels GROUP BY 1) ON d = l WHERE coalesce(nd, 0) <> 1 OR coalesce(nl, 0) <> 1""")
def q_unmatched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.matched_one_to_one(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("""WITH m AS (SELECT event_id, user_id, ts, CASE WHEN value >= 80 THEN true WHEN value <= 60 THEN false END AS mv FROM events),
o AS (SELECT *, coalesce(last_value(mv IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS st FROM m)
SELECT event_id, st AS on, st AND NOT coalesce(lag(st) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS fires FROM o""".replace(" AS on,", ' AS "on",'))
def q_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return alerts.hysteresis(e, ["user_id"], "ts", "event_id", F.col("value") >= 80, F.col("value") <= 60).select("event_id", "on", "fires")


@query("""SELECT event_id, n < 2 AS sent FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) + row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) - 1 AS n FROM events WHERE event_type = 'view')""")
def q_rate_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a user's views two a day are sent at once."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "user_id", "ts")
    return alerts.capped(e, ["user_id"], "ts", "event_id", 86_400, 2).select("event_id", "sent")


@query("""SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm, CAST(p_size % 2 AS VARCHAR) AS alias_type, count(DISTINCT p_partkey) AS n_models FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1""")
def q_alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(keys.alias_key_ascii(F.col("p_name")).alias("norm"), (F.col("p_size") % 2).cast("string").alias("alias_type"), F.lit(None).cast("int").alias("site"), F.col("p_partkey").alias("model_id"))
    return resolve.conflicting(p).select("norm", "alias_type", "n_models")


# streams: a table is read as a stream to its end, the sink is a folder of files


def _drained(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    path = work_path(spark, name)
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType.fromJson(table(spark, sf_dir, "events").schema.jsonValue())
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT event_id, user_id FROM events")
def q_stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come twice are kept once, however late they are."""
    e, path = _event_stream(spark, sf_dir), work_path(spark, "replay")
    heartbeat.append_history(e.union(e), ["event_id"], "ts", path, f"{path}-checkpoint").awaitTermination()
    return spark.read.parquet(path).select("event_id", "user_id")


@query(f"SELECT user_id AS key, ts, decision FROM ({_DECISIONS_SQL})")
def q_stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's decisions are the batch's."""
    rows = _event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), _stock().alias("stock"))
    return _drained(heartbeat.change_stream(rows, 0.1), spark, "changes").select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "decision")


@query("""SELECT day, event_type, n FROM (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY""")
def q_stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that the watermark has closed."""
    e = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(heartbeat.daily_stream(e, "ts", ["event_type"]), spark, "days")


def _lifecycle_log(events: DataFrame) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, lifecycle.EVENTS)), (F.floor("value") % 10).cast("int"))
    return events.select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("n"), kind.alias("event"))


_LIFECYCLE_SQL = """WITH RECURSIVE l AS (SELECT user_id AS source, event_id AS n, list_extract(['success', 'transient_failure', 'parser_rot', 'anti_bot', 'unknown_failure', 'degradation', 'probe_success', 'probe_failure', 'manual_skip', 'manual_reactivate'], CAST(floor(value) AS BIGINT) % 10 + 1) AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT source, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS i, 'active' AS state, false AS again FROM (SELECT DISTINCT source FROM l)
UNION ALL SELECT f.source, l.n, l.i, CASE WHEN e = 'manual_skip' THEN 'skip' WHEN e = 'manual_reactivate' THEN 'active' WHEN state = 'skip' OR (state = 'paused_pending_fix' AND e <> 'probe_success') THEN state WHEN e IN ('success', 'probe_success') THEN 'active'
WHEN e IN ('anti_bot', 'unknown_failure') OR (e = 'parser_rot' AND again) THEN 'paused_pending_fix' WHEN e IN ('transient_failure', 'parser_rot') THEN 'backing_off' ELSE state END,
CASE WHEN e IN ('success', 'probe_success', 'transient_failure', 'anti_bot', 'parser_rot', 'unknown_failure') THEN e = 'parser_rot' ELSE again END FROM f JOIN l ON l.source = f.source AND l.i = f.i + 1)
SELECT CAST(source AS VARCHAR) AS source, n, state FROM f WHERE i > 0"""


@query(_LIFECYCLE_SQL)
def q_lifecycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows give what the fold over events gives."""
    return lifecycle.lifecycle(_lifecycle_log(table(spark, sf_dir, "events")), "source", "event", ["n"]).select("source", "n", "state")


@query(_LIFECYCLE_SQL)
def q_lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(sources.lifecycle_stream(_lifecycle_log(_event_stream(spark, sf_dir))), spark, "lifecycle")


@query("""WITH RECURSIVE l AS (SELECT user_id AS source, event_id, epoch_us(ts) / 1e6 AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST(3 AS DOUBLE) AS tokens, CAST(NULL AS DOUBLE) AS moment, false AS granted FROM (SELECT DISTINCT source FROM l)
UNION ALL SELECT source, i, full_ - CASE WHEN full_ >= 1 THEN 1 ELSE 0 END, moment, full_ >= 1 FROM (SELECT f.source, l.i, l.moment, CASE WHEN f.moment IS NULL THEN tokens ELSE least(3, tokens + (l.moment - f.moment) / 40000.0) END AS full_ FROM f JOIN l ON l.source = f.source AND l.i = f.i + 1))
SELECT CAST(source AS VARCHAR) AS source, count(*) AS n, count(*) FILTER (WHERE granted) AS granted FROM f WHERE i > 0 GROUP BY source""")
def q_token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tokens and one more every 40,000 seconds."""
    e = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("at"))
    out = _drained(sources.bucket_stream(e, 3.0, 1 / 40_000.0), spark, "buckets")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("granted").alias("granted"))


def queries() -> dict[str, Query]:
    from . import absence_queries, alert_queries, catalog_queries, ledger_queries, read_queries, report_queries, resolve_queries, source_queries, title_queries  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import absence_queries, alert_queries, catalog_queries, ledger_queries, read_queries, report_queries, resolve_queries, source_queries, title_queries  # noqa: F401

    return dict(SQL)
