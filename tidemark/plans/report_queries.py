"""Registered queries of the roll-ups, the cohorts and the later clauses, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import categories, title
from ..operators import cohorts, eligibility, rollups
from .common import table
from .registry import query

_GRAIN_SQL = "CASE l_linenumber % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'family' WHEN 2 THEN 'model' WHEN 3 THEN 'variant' END"
_FACTS_SQL = """SELECT l_suppkey % 7 AS site, l_partkey AS listing, count(*) AS snapshots, count(*) FILTER (s = 0) AS shipping_free, count(*) FILTER (s <> 0) AS shipping_paid, count(*) FILTER (s IS NULL) AS shipping_unknown,
 max(st).f AS flag, max(st).n AS line FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_discount END AS s, {'d': l_shipdate, 'o': l_orderkey, 'n': l_linenumber, 'q': l_quantity, 'f': l_returnflag} AS st FROM lineitem) GROUP BY 1, 2"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("site"), F.col("l_partkey").alias("listing"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity").alias("at"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("shipping"))
    return rollups.listing_facts(rows, ["site", "listing"], "at", ["flag", "line"], "shipping")


@query(_FACTS_SQL)
def q_listing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)


@query(f"""WITH f AS (SELECT *, CASE line % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'family' WHEN 2 THEN 'model' WHEN 3 THEN 'variant' END AS g, CASE line % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'review' WHEN 2 THEN 'error' END AS o FROM ({_FACTS_SQL}))
SELECT site, count(*) AS listings, CAST(sum(snapshots) AS BIGINT) AS snapshots, count(*) FILTER (flag = 'A') AS with_mpn, count(*) FILTER (g IN ('model', 'variant')) AS with_model, count(*) FILTER (flag = 'A' OR g IN ('model', 'variant')) AS with_identifier, count(*) FILTER (flag <> 'N') AS with_condition,
CAST(sum(shipping_free) AS BIGINT) AS shipping_free, CAST(sum(shipping_paid) AS BIGINT) AS shipping_paid, CAST(sum(shipping_unknown) AS BIGINT) AS shipping_unknown,
{", ".join(f"count(*) FILTER (coalesce(g, 'no_edge') = '{g}') AS grain_{g}" for g in rollups.GRAINS)}, {", ".join(f"count(*) FILTER (coalesce(o, 'no_edge') = '{o}') AS outcome_{o}" for o in rollups.OUTCOMES)},
round_even(count(*) FILTER (flag = 'A' OR g IN ('model', 'variant')) / CAST(count(*) AS DOUBLE), 4) AS identifier_coverage, round_even(count(*) FILTER (flag <> 'N') / CAST(count(*) AS DOUBLE), 4) AS condition_coverage,
round_even((sum(shipping_free) + sum(shipping_paid)) / CAST(sum(snapshots) AS DOUBLE), 4) AS shipping_coverage FROM f GROUP BY site""")
def q_category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n, *xs: F.get(F.array(*map(F.lit, xs)), n.cast("int"))
    grain, outcome = pick(F.col("line") % 5, "none", "family", "model", "variant", None), pick(F.col("line") % 4, "accept", "review", "error", None)
    return rollups.category_report(_facts(spark, sf_dir), ["site"], F.col("flag") == "A", F.col("flag") != "N", grain, outcome)


@query("""SELECT o_custkey, count(*) AS scopes, CASE WHEN count(*) = 1 THEN min(c) WHEN bool_and(c = 'complete') THEN 'complete' ELSE 'truncated' END AS completeness, CASE WHEN count(DISTINCT coalesce(r, '')) = 1 THEN max(r) ELSE 'adapter_sweep_incomplete' END AS reason, bool_and(o_orderkey % 5 <> 0) AS stale_allowed
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'partial_failure' ELSE 'complete' END AS c, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS r FROM orders) GROUP BY o_custkey""")
def q_merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("o_orderkey") % 3 == 0
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(bad, "partial_failure").otherwise("complete").alias("completeness"), F.when(bad, F.col("o_orderpriority")).alias("reason"), (F.col("o_orderkey") % 5 != 0).alias("stale_allowed"))
    return rollups.merged_evidence(o, "o_custkey")


@query("""WITH n AS (SELECT user_id, max({'ts': ts, 'id': event_id, 't': event_type, 'p': props}) AS n FROM events WHERE event_type <> 'purchase' GROUP BY user_id), i AS (SELECT user_id AS u, max(ts) AS last FROM events WHERE event_type = 'purchase' GROUP BY user_id),
d AS (SELECT user_id AS source, n.p AS reason FROM n LEFT JOIN i ON user_id = u WHERE n.t = 'error' AND (last IS NULL OR last <= n.ts))
SELECT DISTINCT user_id AS source, 'overrun_latch' AS reason FROM events WHERE user_id % 11 = 0 UNION ALL SELECT * FROM d WHERE source % 11 <> 0""")
def q_paused_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    asked = e.where("event_type <> 'purchase'").select(F.col("user_id").alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "denied").otherwise("granted").alias("status"), F.col("props").alias("reason"))
    imports = e.where("event_type = 'purchase'").select(F.col("user_id").alias("source"), F.col("ts").alias("finished_at"))
    return rollups.paused_sources(asked, imports, e.where("user_id % 11 = 0").select(F.col("user_id").alias("source")))


@query("SELECT s_suppkey AS family_id, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_tax = 0) AND s_suppkey NOT IN (SELECT p_size FROM part)")
def q_unreconciled_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("family_id"), F.col("s_name").alias("name"))
    models = table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_tax = 0").select(F.col("l_suppkey").alias("family_id"))
    return rollups.unreconciled_families(families, models, table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("family_id")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def q_uncounted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", F.col("l_orderkey")).alias("o_orderkey"))
    return rollups.uncounted(table(spark, sf_dir, "orders").select("o_orderkey"), counted, "o_orderkey")


@query("""WITH p AS (SELECT event_type, user_id, min({'ts': ts, 'id': event_id, 'props': props}) AS p FROM events WHERE value > 95 GROUP BY ALL) SELECT event_id, p.id AS payload_event_id, p.props AS payload_props FROM events e LEFT JOIN p ON e.event_type || '/' || e.user_id = p.event_type || '/' || p.user_id""")
def q_payload_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("url", F.concat_ws("/", "event_type", "user_id"))
    bodies = e.where("value > 95").select("url", "ts", "event_id", "props")
    out = rollups.payload_of(e.select("event_id", "url"), bodies, "url", ["ts", "event_id"])
    return out.select("event_id", "payload_event_id", "payload_props")


@query("SELECT event_id, lead(event_id) OVER w AS superseded_by, lead(event_id) OVER w IS NULL AS is_current FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q_edge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.edge_chain(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], "event_id").select("event_id", "superseded_by", "is_current")


@query("""WITH r AS (SELECT user_id, ts, CAST(value > 20 AS INTEGER) AS amount, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events)
SELECT user_id, max(ts) AS ts, max(amount) AS amount FROM r WHERE n <= 3 GROUP BY user_id HAVING count(*) = 3 AND count(DISTINCT amount) = 1 AND min(CASE WHEN n < 3 THEN gap END) >= 3600000000""")
def q_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", (F.col("value") > 20).cast("int").alias("amount"))
    return rollups.settled(e, "user_id", "ts", "amount", 3, 3600)


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, CASE WHEN value > 50 THEN 'sweep' END AS scope FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY scope IS NULL, event_id) = 1""")
def q_scoped_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("scope", F.when(F.col("value") > 50, "sweep"))
    return rollups.one_per_key(e, ["user_id", "event_type"], "scope", ["event_id"]).select("user_id", "event_type", "event_id")


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, nullif(event_type, 'view') AS scope, user_id FROM events), p AS (SELECT day, scope, count(DISTINCT user_id) AS seen FROM e GROUP BY ALL), r AS (SELECT day, count(DISTINCT user_id) AS seen_in_run FROM e GROUP BY day)
SELECT day, scope, seen, seen_in_run, CAST(row_number() OVER (PARTITION BY day ORDER BY scope NULLS FIRST) AS INTEGER) AS position FROM p JOIN r USING (day)""")
def q_scope_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.nullif("event_type", F.lit("view")).alias("scope"), "user_id")
    return rollups.scope_reports(e, "day", "scope", "user_id").select("day", "scope", "seen", "seen_in_run", "position")


@query("""WITH s AS (SELECT *, value > 50 AS hard, event_type AS soft, lag(value > 50) OVER w AS h, lag(event_type) OVER w AS t, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, n = 1 OR hard <> h OR soft <> t AS changed, CAST(sum(CASE WHEN n = 1 OR hard <> h THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS version FROM s""")
def q_requirement_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") > 50).alias("hard"), F.col("event_type").alias("soft"))
    return rollups.requirement_versions(e, "user_id", "event_id", ["hard"], ["soft"]).select("event_id", "changed", "version")


@query("""WITH b AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL), a AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL)
SELECT count(*) FILTER (b.v IS NULL) AS created, count(*) FILTER (a.v <> b.v) AS updated, count(*) FILTER (a.v = b.v) AS unchanged, count(*) FILTER (a.v IS NULL) AS missing FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def q_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    most = lambda part: e.where(part).groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return rollups.change_counts(most("ts < timestamp_ntz'2024-01-15'"), most("ts >= timestamp_ntz'2024-01-10'"), ["user_id", "event_type"], ["v"])


# cohorts

BUCKETS = ("4.000", "8.000", "10.000", "12.000", "16.000", "20.000", "24.000")
PARENTS = {"enterprise": "high_duty", "nas": "high_duty", "desktop": "client", "surveillance": "client", "unknown": "client"}
_COHORT_SQL = f"""SELECT p_partkey, c, b, CASE WHEN c IS NULL THEN NULL WHEN b IS NULL THEN '~' || c ELSE CAST(b AS VARCHAR) END AS bucket, tier, CASE WHEN tier IN ('enterprise', 'nas') THEN 'high_duty' ELSE 'client' END AS parent, ifff, cond, w FROM (
SELECT p_partkey, c, (SELECT min({{'d': abs(c - x) / x, 'b': x}}) FROM (SELECT CAST(unnest({list(BUCKETS)}) AS DECIMAL(7,3)) AS x) WHERE abs(c - x) / x <= 0.05).b AS b, tier, ifff, cond, w FROM (
SELECT p_partkey, CASE WHEN p_size <> 50 THEN CAST(p_size / 2.0 AS DECIMAL(7,3)) END AS c, CASE p_type WHEN 'ECONOMY' THEN 'enterprise' WHEN 'STANDARD' THEN 'nas' WHEN 'PROMO' THEN 'desktop' ELSE 'unknown' END AS tier, CASE WHEN p_partkey % 2 = 0 THEN 'sata-3.5' ELSE 'sas-3.5' END AS ifff, CASE p_partkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'used' ELSE 'recertified' END AS cond, 1 + p_partkey % 2 AS w FROM part))"""


def _cohort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tier = F.when(F.col("p_type") == "ECONOMY", "enterprise").when(F.col("p_type") == "STANDARD", "nas").when(F.col("p_type") == "PROMO", "desktop").otherwise("unknown")
    size = F.when(F.col("p_size") != 50, (F.col("p_size") / 2).cast("decimal(7,3)"))
    condition = F.when(k % 3 == 0, "new").when(k % 3 == 1, "used").otherwise("recertified")
    return table(spark, sf_dir, "part").select(k.alias("offer_id"), cohorts.capacity_bucket(size, list(BUCKETS)).alias("bucket"), tier.alias("tier"), F.when(k % 2 == 0, "sata-3.5").otherwise("sas-3.5").alias("ifff"), condition.alias("condition"), (1.0 + k % 2).alias("w"))


@query(f"SELECT p_partkey, 'cap=' || bucket || '|tier=' || tier || '|ifff=' || ifff || '|cond=' || cond AS cohort FROM ({_COHORT_SQL})")
def q_cohort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cohort_rows(spark, sf_dir)
    interface, form = F.split_part("ifff", F.lit("-"), F.lit(1)), F.split_part("ifff", F.lit("-"), F.lit(2))
    return rows.select(F.col("offer_id").alias("p_partkey"), cohorts.cohort_key(F.col("bucket"), F.col("tier"), interface, form, F.col("condition")).alias("cohort"))


@query(f"""WITH x AS ({_COHORT_SQL}), k AS (SELECT CAST(unnest({list(BUCKETS)}) AS DECIMAL(7,3)) AS v),
v AS (SELECT *, coalesce(b, c) AS val FROM x), m AS (SELECT *, (SELECT CAST(max(k.v) AS VARCHAR) FROM k WHERE k.v < val) AS lo, (SELECT CAST(min(k.v) AS VARCHAR) FROM k WHERE k.v > val) AS hi FROM v),
n AS (SELECT o.p_partkey, sum(CASE WHEN o.bucket = y.bucket AND o.tier = y.tier AND o.cond = y.cond THEN y.w END) AS a0, sum(CASE WHEN o.bucket = y.bucket AND o.tier = y.tier AND o.cond = y.cond THEN y.w * y.w END) AS s0,
 sum(CASE WHEN o.bucket = y.bucket AND o.tier = y.tier THEN y.w END) AS a1, sum(CASE WHEN o.bucket = y.bucket AND o.tier = y.tier THEN y.w * y.w END) AS s1,
 sum(CASE WHEN o.tier = y.tier THEN y.w END) AS a2, sum(CASE WHEN o.tier = y.tier THEN y.w * y.w END) AS s2, sum(y.w) AS a3, sum(y.w * y.w) AS s3
 FROM m o JOIN x y ON o.ifff = y.ifff AND o.parent = y.parent AND y.bucket IN (o.bucket, o.lo, o.hi) GROUP BY o.p_partkey),
e AS (SELECT p_partkey, coalesce(a0 * a0 / s0, 0)::DOUBLE AS n0, coalesce(a1 * a1 / s1, 0)::DOUBLE AS n1, coalesce(a2 * a2 / s2, 0)::DOUBLE AS n2, coalesce(a3 * a3 / s3, 0)::DOUBLE AS n3 FROM n)
SELECT p_partkey, CASE WHEN n0 >= 30 THEN 'none' WHEN n1 >= 30 THEN 'condition' WHEN n2 >= 30 THEN 'capacity' ELSE 'tier' END AS step, round(CASE WHEN n0 >= 30 THEN n0 WHEN n1 >= 30 THEN n1 WHEN n2 >= 30 THEN n2 ELSE n3 END, 6) AS n_eff, n3 < 30 AND n2 < 30 AND n1 < 30 AND n0 < 30 AS exhausted FROM e""")
def q_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cohort_rows(spark, sf_dir).where("bucket is not null")
    out = cohorts.relaxed(rows, rows, list(BUCKETS), PARENTS, "w")
    return out.select(F.col("offer_id").alias("p_partkey"), "step", F.round("n_eff", 6).alias("n_eff"), "exhausted")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, q AS quantity, basis, flag, l_extendedprice / (p_size * q) AS per_tb FROM (SELECT *, CASE WHEN st IS NOT NULL THEN st WHEN ex BETWEEN 1 AND 100 AND conf >= 0.85 THEN ex ELSE 1 END AS q,
CASE WHEN st IS NOT NULL AND ex IS NOT NULL AND st <> ex THEN 'structured_over_extracted' WHEN st IS NOT NULL THEN 'structured' WHEN ex BETWEEN 1 AND 100 AND conf >= 0.85 THEN 'extracted' ELSE 'default_single' END AS basis,
CASE WHEN st IS NOT NULL AND ex IS NOT NULL AND st <> ex THEN 'quantity_conflict' WHEN st IS NOT NULL THEN NULL WHEN ex IS NULL THEN 'quantity_assumed' WHEN ex NOT BETWEEN 1 AND 100 THEN 'quantity_invalid' WHEN NOT coalesce(conf >= 0.85, false) THEN 'quantity_low_confidence' END AS flag
FROM (SELECT *, CASE WHEN l_tax > 0.06 THEN l_linenumber END AS st, CASE WHEN l_discount > 0.01 THEN CAST(l_quantity AS INTEGER) * 3 - 6 END AS ex, CASE WHEN l_returnflag <> 'R' THEN 1 - l_tax * 3 END AS conf FROM lineitem JOIN part ON l_partkey = p_partkey))""")
def q_price_per_tb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    said = F.when(F.col("l_discount") > 0.01, F.col("l_quantity").cast("int") * 3 - 6)
    q = cohorts.unit_quantity(F.when(F.col("l_tax") > 0.06, F.col("l_linenumber")), said, F.when(F.col("l_returnflag") != "R", 1 - F.col("l_tax") * 3))
    rows = rows.withColumn("q", q)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("q.n").alias("quantity"), "q.basis", "q.flag", cohorts.dollars_per_tb(F.col("l_extendedprice"), F.col("p_size"), F.col("q.n")).alias("per_tb"))


@query("""SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND NOT (p_size = 7) AND (p_retailprice < 950 OR p_size > 20) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def q_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("listing_id"), F.col("p_type").alias("source"), F.when(F.col("p_size") == 7, 1).alias("delisted_at"), F.when(F.col("p_retailprice") >= 950, F.col("p_size")).alias("expires_at"))
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("listing_id"))
    return cohorts.population(p, seen, ["ECONOMY", "PROMO"], F.lit(20)).select(F.col("listing_id").alias("p_partkey"))


@query("""WITH RECURSIVE h AS (SELECT *, value > 30 AS holds, value > 97 AS bypass, sum(CASE WHEN value > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
n AS (SELECT *, sum(CAST(holds AS INTEGER)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS k FROM h), s AS (SELECT user_id, event_id, ts, bypass, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM n WHERE holds AND k >= 2),
f AS (SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS last, false AS sent FROM s
UNION ALL SELECT f.user_id, s.event_id, s.i, CASE WHEN f.last IS NULL OR s.bypass OR s.ts - f.last >= INTERVAL '43200 seconds' THEN s.ts ELSE f.last END, f.last IS NULL OR s.bypass OR s.ts - f.last >= INTERVAL '43200 seconds' FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT user_id, event_id FROM f WHERE sent""")
def q_alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") > 30).alias("holds"), (F.col("value") > 97).alias("bypass"))
    return cohorts.steady_alerts(e, "user_id", "ts", "event_id", 2, 43_200).select("user_id", "event_id")


# clauses


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 10 THEN 'match' WHEN conf >= 0.85 AND l_returnflag = 'A' THEN 'match' WHEN conf >= 0.85 AND l_returnflag = 'R' THEN 'no_match' ELSE 'unknown' END AS vendor_lock,
CASE WHEN tm IS NOT NULL THEN CASE WHEN g IS NULL OR g = 'none' OR g = 'family' THEN 'unknown' WHEN l_partkey = tm THEN 'match' ELSE 'no_match' END WHEN tf IS NOT NULL THEN CASE WHEN g IS NULL OR g = 'none' OR fam IS NULL THEN 'unknown' WHEN fam = tf THEN 'match' ELSE 'no_match' END END AS target,
CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_tax < 0.04 THEN true ELSE false END WHEN l_returnflag = 'A' THEN l_tax >= 0.04 ELSE true END AS recording
FROM (SELECT *, 1 - l_discount * 3 AS conf, CASE WHEN l_suppkey % 3 = 0 THEN 5 END AS tm, CASE WHEN l_suppkey % 3 = 1 THEN 2 END AS tf, CASE l_linenumber WHEN 1 THEN 'none' WHEN 2 THEN 'family' WHEN 3 THEN 'model' END AS g, CASE WHEN l_linenumber <> 6 THEN l_partkey % 4 END AS fam FROM lineitem)""")
def q_later_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    lock = F.when(flag == "A", "unlocked").when(flag == "R", "locked")
    grain = F.when(n == 1, "none").when(n == 2, "family").when(n == 3, "model")
    # line numbers beyond have no edge
    target = eligibility.target_outcome(F.when(F.col("l_suppkey") % 3 == 1, 2), F.when(F.col("l_suppkey") % 3 == 0, 5), grain, F.when(n != 6, F.col("l_partkey") % 4), F.col("l_partkey"))
    allowed = F.when(F.col("l_tax") < 0.04, F.array(F.lit("cmr"))).otherwise(F.array(F.lit("smr_hm")))
    said = F.when(flag == "R", "smr").when(flag == "A", "cmr").otherwise("hybrid")
    return li.select("l_orderkey", n, "l_partkey", eligibility.vendor_lock_outcome(F.col("l_quantity") > 10, lock, 1 - F.col("l_discount") * 3).alias("vendor_lock"), target.alias("target"), eligibility.recording_contradicted(allowed, said).alias("recording"))


# other categories: titles made of a part's columns are read back


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, F.Column]:
    return table(spark, sf_dir, "part"), F.col("p_partkey")


def _pick(n: F.Column, *xs: object) -> F.Column:
    return F.get(F.array(*map(F.lit, xs)), (n % len(xs)).cast("int"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'nvidia' WHEN 1 THEN 'amd' WHEN 2 THEN 'intel' END AS chip_vendor, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS vram_gb, CASE p_partkey % 3 WHEN 0 THEN 'sxm' WHEN 1 THEN 'pcie' END AS interface, CASE p_partkey % 7 WHEN 0 THEN 'passive' WHEN 1 THEN 'liquid' WHEN 2 THEN 'active' END AS cooling,
concat_ws(',', CASE WHEN p_partkey % 4 IN (1, 2) THEN 'chip_vendor' END, CASE WHEN p_partkey % 5 <> 0 AND p_size <> 24 THEN 'vram_gb' END) AS vetoes FROM part""")
def q_gpu_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, k = _parts(spark, sf_dir)
    size = F.concat(F.col("p_size").cast("string"), F.when(k % 2 == 0, " GB").otherwise("GB"))
    text = F.concat_ws(" ", _pick(k, "NVIDIA GeForce", "Radeon Pro", "Intel Arc", "nvidia amd"), F.lit("RTX 4090"), size, F.when(k % 5 == 0, "and 999gb"), F.lit("12gb/s"), _pick(k, "SXM4", "PCIe 4", "card"), _pick(k, "passively cooled", "water-cooled", "blower", "", "", "fanless liquid", "cooled"))
    rows = parts.select(k, title.canonical_title(text).alias("t"))
    said = categories.gpu_attributes(F.col("t"))
    against = categories.vetoes(said, {"chip_vendor": F.lit("nvidia"), "vram_gb": F.lit(24)})
    return rows.select("p_partkey", *[c.alias(n) for n, c in said.items()], F.array_join(against, ",").alias("vetoes"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'micron' WHEN 1 THEN 'sk_hynix' END AS brand, CASE p_partkey % 4 WHEN 0 THEN 'ddr4' WHEN 1 THEN 'ddr5' WHEN 2 THEN 'ddr3' END AS generation, CASE p_partkey % 5 WHEN 0 THEN 'rdimm' WHEN 1 THEN 'lrdimm' WHEN 2 THEN 'sodimm' WHEN 3 THEN 'udimm' END AS module_type,
CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ecc, p_size AS module_capacity_gb, CASE WHEN p_partkey % 2 = 0 THEN 2 END AS modules_per_kit, CASE p_partkey % 4 WHEN 0 THEN 3200 WHEN 1 THEN 4800 WHEN 2 THEN 1600 END AS speed_mts, CASE p_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 4 END AS ranks FROM part""")
def q_ram_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, k = _parts(spark, sf_dir)
    size = F.concat(F.when(k % 2 == 0, "2 x ").otherwise(""), F.col("p_size").cast("string"), F.lit("GB"))
    text = F.concat_ws(" ", _pick(k, "Crucial", "SK Hynix", "Dell Samsung"), size, _pick(k, "DDR4 PC4-25600", "DDR5-4800", "DDR3L 1600 MHz", "DDR4 DDR5"), _pick(k, "Registered", "Load-Reduced", "SO-DIMM", "unbuffered", "RDIMM UDIMM"), _pick(k, "ECC", "non-ECC", "ecc non ecc"), _pick(k, "2Rx4", "quad rank", "1rx8 2rx8", "", "rank", "x4"))
    rows = parts.select(k, title.canonical_title(text).alias("t"))
    return rows.select("p_partkey", *[c.alias(n) for n, c in categories.ram_attributes(F.col("t")).items()])


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'intel' WHEN 1 THEN 'mellanox' END WHEN 1 THEN CASE p_partkey % 3 WHEN 2 THEN 'broadcom' END WHEN 2 THEN NULL WHEN 3 THEN CASE p_partkey % 3 WHEN 0 THEN NULL END END AS brand FROM part""")
def q_basic_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, k = _parts(spark, sf_dir)
    text = title.canonical_title(_pick(k, "Intel X710 card", "ConnectX-5 dual port", "LSI 9300-8i"))
    return parts.select("p_partkey", categories.basic_brand(_pick(k, "nic", "hba", "motherboard", "server", "drive"), text).alias("brand"))
