"""Registered queries of what stands around the ladder: other makers' grammars, priors, gates, edges, what is learnt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mpn
from ..operators import resolve
from .common import table
from .registry import query


def _pick(n: Column, *xs: str) -> Column:
    return F.get(F.array(*map(F.lit, xs)), (n % len(xs)).cast("int"))


@query("""WITH t AS (SELECT p_partkey AS k, p_size AS s, ['wd' || lpad(CAST(p_size AS VARCHAR), 2, '0'), 'wd' || (100 + p_size), 'wd' || (1000 + p_size), 'wuh', 'hus', 'hdn', 'mg', 'mn'][p_partkey % 8 + 1] AS head, p_partkey % 8 AS kind, ['kfgx', 'efpx', 'zzzz', 'purz'][p_partkey // 8 % 4 + 1] AS tail FROM part),
n AS (SELECT *, CASE WHEN kind < 3 THEN head || tail WHEN kind < 6 THEN head || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') || 'ale6l4' ELSE head || '08aca' || (s % 20) || 't' || 'e' END AS token FROM t)
SELECT k AS p_partkey, token, CASE WHEN kind < 3 THEN CASE WHEN kind = 2 AND tail = 'zzzz' THEN NULL ELSE 'western_digital' END WHEN kind = 3 THEN 'western_digital' WHEN kind < 6 THEN 'hgst' ELSE 'toshiba' END AS vendor,
CASE WHEN kind < 3 THEN CASE tail WHEN 'kfgx' THEN 'red pro' WHEN 'efpx' THEN 'red plus' WHEN 'purz' THEN 'purple' END WHEN kind < 5 THEN 'ultrastar' WHEN kind = 5 THEN 'deskstar nas' WHEN kind = 6 THEN 'mg enterprise capacity' ELSE 'n300' END AS family,
CASE WHEN kind = 0 THEN s * 100000000000 WHEN kind = 1 THEN ((100 + s) // 10) * 1000000000000 WHEN kind > 5 THEN (s % 20) * 1000000000000 END AS capacity_bytes FROM n""")
def q_mpn_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grammars of three more makers, in the one decoder of all."""
    k, s = F.col("p_partkey"), F.col("p_size")
    heads = F.array(F.concat(F.lit("wd"), F.lpad(s.cast("string"), 2, "0")), F.concat(F.lit("wd"), (100 + s).cast("string")), F.concat(F.lit("wd"), (1000 + s).cast("string")), *map(F.lit, ("wuh", "hus", "hdn", "mg", "mn")))
    head, kind, tail = F.get(heads, (k % 8).cast("int")), k % 8, _pick(F.floor(k / 8), "kfgx", "efpx", "zzzz", "purz")
    rest = F.when(kind < 3, tail).when(kind < 6, F.concat(F.lpad((k % 1_000_000).cast("string"), 6, "0"), F.lit("ale6l4"))).otherwise(F.concat(F.lit("08aca"), (s % 20).cast("string"), F.lit("te")))
    rows = table(spark, sf_dir, "part").select(k, F.concat(head, rest).alias("token"))
    return rows.withColumn("d", mpn.decode(F.col("token"))).select("p_partkey", "token", "d.vendor", "d.family", "d.capacity_bytes")


# customers are listings; what was decided about them before and what is said now follows from their columns


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "listing_id")


@query("""WITH p AS (SELECT c_custkey AS listing_id, c_nationkey AS n, c_acctbal AS b, c_mktsegment AS m FROM customer WHERE c_acctbal > 0)
SELECT listing_id, concat_ws(';', CASE WHEN n % 5 = 0 THEN 'matcher_version' END, CASE WHEN b > 7000 THEN 'identifiers' END, CASE WHEN m = 'BUILDING' AND n % 2 = 0 THEN 'brand' END, CASE WHEN b < 1000 THEN 'veto:capacity' END) AS doubts,
 NOT (n % 5 = 0 OR b > 7000 OR (m = 'BUILDING' AND n % 2 = 0)) AS stands FROM p""")
def q_prior_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against a standing decision, and which may be started from."""
    c = _listings(spark, sf_dir)
    n, b, m = F.col("c_nationkey"), F.col("c_acctbal"), F.col("c_mktsegment")
    prior = c.where(b > 0).select("listing_id", F.col("c_name").alias("target"), F.lit("model").alias("grain"), F.lit(0.9).alias("confidence"), F.lit("seagate").alias("brand"), F.lit(2).alias("matcher_version"), F.array(F.lit("b"), F.lit("a")).alias("identifiers"))
    now = c.select("listing_id", F.when(n % 2 == 0, F.when(m == "BUILDING", "wd").otherwise("seagate")).alias("brand"), F.when(n % 5 == 0, 3).otherwise(2).alias("matcher_version"), F.when(b > 7000, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("identifiers"), F.when(b < 1000, F.array(F.lit("capacity"))).otherwise(F.array().cast("array<string>")).alias("vetoes"))
    out = resolve.reconsider(prior, now)
    kept = resolve.standing(out).select(F.col("listing_id").alias("id"))
    return out.join(kept, F.col("listing_id") == F.col("id"), "left").select("listing_id", F.array_join("doubts", ";").alias("doubts"), F.col("id").isNotNull().alias("stands"))


_DECIDED = "SELECT c_custkey AS listing_id, CASE WHEN c_acctbal > 0 THEN 'accept' WHEN c_acctbal > -500 THEN 'review' ELSE 'none' END AS outcome, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_nationkey < 20 THEN 'model' ELSE 'family' END ELSE 'none' END AS grain, CASE WHEN c_acctbal > 0 THEN 'n' || c_nationkey END AS target, c_mktsegment AS segment FROM customer"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    return _listings(spark, sf_dir).select("listing_id", F.when(b > 0, "accept").when(b > -500, "review").otherwise("none").alias("outcome"), F.when(b > 0, F.when(n < 20, "model").otherwise("family")).otherwise("none").alias("grain"), F.when(b > 0, F.concat(F.lit("n"), n.cast("string"))).alias("target"), F.when(b > 0, "alias").otherwise("weak").alias("reason"), F.col("c_mktsegment").alias("segment"), n.alias("nation"))


@query(f"""WITH d AS (SELECT * FROM ({_DECIDED})), r AS (SELECT *, CASE WHEN segment = 'FURNITURE' THEN 'cross_category' WHEN segment = 'HOUSEHOLD' THEN 'no_rules' WHEN segment = 'MACHINERY' THEN 'auto_accept_off' WHEN segment = 'BUILDING' AND grain <> 'model' THEN 'grain_not_accepted' WHEN segment = 'AUTOMOBILE' AND grain = 'family' AND target NOT IN ('n20', 'n21') THEN 'family_not_ratified' END AS failed FROM d)
SELECT listing_id, CASE WHEN outcome = 'accept' AND failed IS NOT NULL THEN 'review' ELSE outcome END AS outcome, CASE WHEN outcome = 'accept' THEN coalesce(failed, 'alias') ELSE 'weak' END AS reason FROM r""")
def q_accept_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepts that a category's rules don't let through, by the first rule that fails."""
    rules = spark.createDataFrame([("AUTOMOBILE", True, None, ["n20", "n21"]), ("BUILDING", True, ["model"], None), ("FURNITURE", True, None, None), ("MACHINERY", False, None, None)], "category string, auto_accept boolean, grains array<string>, families array<string>")
    rows = _decided(spark, sf_dir).withColumn("category", F.col("segment")).withColumn("target_category", F.when(F.col("segment") == "FURNITURE", "AUTOMOBILE"))
    return resolve.gate(rows, rules).select("listing_id", "outcome", "reason")


@query(f"""SELECT listing_id, outcome, grain, target FROM ({_DECIDED}) d WHERE segment IN ('FURNITURE', 'HOUSEHOLD') OR (segment = 'BUILDING' AND outcome = 'accept')""")
def q_changed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only decisions that differ from what stands are appended; what never stood does, too."""
    rows = _decided(spark, sf_dir)
    seg = F.col("segment")
    stood = rows.where(seg != "FURNITURE").select("listing_id", F.when(seg == "HOUSEHOLD", F.concat("outcome", F.lit("d"))).otherwise(F.col("outcome")).alias("outcome"), "grain", F.when((seg != "BUILDING") | (F.col("outcome") != "accept"), F.col("target")).alias("target"), "reason")
    return resolve.changed_edges(rows.drop("segment", "nation"), stood).select("listing_id", "outcome", "grain", "target")


@query(f"""WITH d AS (SELECT * FROM ({_DECIDED}) WHERE outcome = 'accept' AND grain = 'model'), t AS (SELECT *, 'k' || listing_id % 400 AS oem, 'h' || listing_id % 300 AS house, listing_id % 3 AS site FROM d),
x AS (SELECT oem AS norm, 'oem_pn' AS alias_type, NULL AS site, target AS model_id FROM t WHERE segment <> 'BUILDING' UNION SELECT house, 'house_sku', site, target FROM t)
SELECT * FROM x WHERE NOT (alias_type = 'oem_pn' AND norm IN ('k1', 'k2', 'k3')) AND NOT (alias_type = 'house_sku' AND norm LIKE 'h1%' AND site = 1)""")
def q_learned_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of sellers that an accepted model teaches, where they aren't known yet; house numbers for their site alone."""
    rows = _decided(spark, sf_dir)
    at = F.col("listing_id")
    oem = F.when(F.col("segment") == "BUILDING", "unknown_code").otherwise("oem")
    hits = F.array(F.struct(F.concat(F.lit("k"), (at % 400).cast("string")).alias("norm"), oem.alias("kind")), F.struct(F.concat(F.lit("h"), (at % 300).cast("string")).alias("norm"), F.lit("house_sku").alias("kind")))
    listings = rows.select("listing_id", (at % 3).alias("site"), hits.alias("candidates"))
    numbers = spark.range(300).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("norm"), F.lit("house_sku").alias("alias_type"), F.lit(1).cast("long").alias("site")).where("norm like 'h1%'")
    known = numbers.unionByName(spark.createDataFrame([(f"k{i}", "oem_pn", None) for i in (1, 2, 3)], "norm string, alias_type string, site long"))
    return resolve.learned_aliases(rows, listings, known)


@query(f"""SELECT target AS model, count(DISTINCT segment) AS variants, array_to_string(list_sort(list(DISTINCT segment)), ',') AS conditions FROM ({_DECIDED}) WHERE outcome = 'accept' AND grain = 'model' AND segment NOT IN ('MACHINERY') GROUP BY 1""")
def q_variants_on_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that accepted models with a stated condition need, each with an id of its own."""
    rows = _decided(spark, sf_dir)
    out = resolve.variants_on_demand(rows, rows.select("listing_id", F.when(F.col("segment") == "MACHINERY", "unknown").otherwise(F.col("segment")).alias("condition")))
    return out.groupBy("model").agg(F.countDistinct("variant_id").alias("variants"), F.array_join(F.array_sort(F.collect_set("condition")), ",").alias("conditions"))
