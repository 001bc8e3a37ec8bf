"""Registered queries of catalog inputs by grain, the clauses of each category, and canonical records.

Parts are models, their brands families, and line items the listings that were resolved to a grain by their line
number. Some models have no spec; some fields are shared by a whole family and others aren't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_hash
from ..operators import catalog, clauses, eligibility
from .common import table, tasks_for
from .registry import query

CATEGORIES = ("drive", "gpu", "ram", "cpu")

# models, specs and variants, as SQL and as tables
_SPEC_SQL = """SELECT p_partkey AS model, CAST(substr(p_brand, 7) AS BIGINT) AS family, NOT (p_type = 'PROMO' AND p_size < 5) AS has,
 CAST(p_size AS BIGINT) AS size, CASE WHEN p_size % 10 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) % 3 END AS grade, CAST(substr(p_brand, 7) AS BIGINT) % 3 AS line FROM part"""


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    family = F.substring("p_brand", 7, 9).cast("long")
    models = part.select(F.col("p_partkey").alias("model_id"), family.alias("family_id"))
    grade = F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice").cast("long") % 3)
    specs = part.where("not (p_type = 'PROMO' and p_size < 5)").select(F.col("p_partkey").alias("model_id"), F.struct(F.col("p_size").cast("long").alias("size"), grade.alias("grade"), (family % 3).alias("line")).alias("spec"))
    variants = part.select(F.explode(F.array(*map(F.lit, range(3)))).alias("n"), "p_partkey").select((F.col("p_partkey") * 10 + F.col("n")).alias("variant_id"), F.col("p_partkey").alias("model_id"))
    return models, specs, variants


_FAMILY_SQL = """SELECT family, count(*) AS n, bool_and(has) AS known, CASE WHEN bool_and(has) AND min(size) = max(size) THEN min(size) END AS size,
 CASE WHEN bool_and(has) AND count(grade) = count(*) AND min(grade) = max(grade) THEN min(grade) END AS grade, CASE WHEN bool_and(has) AND min(line) = max(line) THEN min(line) END AS line FROM s GROUP BY family"""
_EDGE_SQL = "SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'family' WHEN 2 THEN 'model' ELSE 'variant' END AS grain, ['drive', 'gpu', 'ram', 'cpu'][l_suppkey % 4 + 1] AS category FROM lineitem"
_INPUT_SQL = f"""s AS ({_SPEC_SQL}), f AS ({_FAMILY_SQL}), e AS ({_EDGE_SQL}),
i AS (SELECT e.*, s.family AS model_family, CASE grain WHEN 'family' THEN f.size WHEN 'none' THEN NULL ELSE CASE WHEN has THEN s.size END END AS size, CASE grain WHEN 'family' THEN f.grade WHEN 'none' THEN NULL ELSE CASE WHEN has THEN s.grade END END AS grade,
 CASE grain WHEN 'family' THEN f.line WHEN 'none' THEN NULL ELSE CASE WHEN has THEN s.line END END AS line, CASE grain WHEN 'family' THEN f.n WHEN 'none' THEN NULL ELSE 1 END AS n_members FROM e JOIN s ON s.model = e.l_partkey JOIN f ON f.family = s.family)"""


def _edges(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber") % 4
    family = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 7, 9).cast("long").alias("of"))
    category = F.get(F.array(*map(F.lit, CATEGORIES)), (F.col("l_suppkey") % 4).cast("int"))
    grain = F.when(n == 0, "none").when(n == 1, "family").when(n == 2, "model").otherwise("variant")
    met = li.join(family, "l_partkey") if tasks is None else catalog.merged(li, family, ["l_partkey"], tasks=tasks)
    return met.select(*li.columns, category.alias("category"), grain.alias("grain"), F.when(n == 1, F.col("of")).alias("family_id"), F.when(n == 2, F.col("l_partkey")).alias("model_id"), F.when(n == 3, F.col("l_partkey") * 10 + F.col("l_suppkey") % 3).alias("variant_id"))


def _known(spark: SparkSession, sf_dir: str, tasks: int | None) -> DataFrame:
    models, specs, variants = _models(spark, sf_dir)
    rows = catalog.members(models, specs, tasks)
    return catalog.targets(rows, catalog.families(rows), variants, tasks)


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = tasks_for(table(spark, sf_dir, "lineitem"))
    return catalog.catalog_inputs(_edges(spark, sf_dir), _known(spark, sf_dir, tasks), tasks)


@query(f"""WITH {_INPUT_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, grain, CAST(n_members AS BIGINT) AS n_members, CASE WHEN grain <> 'none' THEN model_family END AS family, CASE WHEN grain IN ('model', 'variant') THEN l_partkey END AS model, size, grade, line FROM i""")
def q_catalog_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog says at each listing's grain: of its variant's model, its model, or all its family."""
    return _inputs(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "grain", "n_members", F.col("live_family").alias("family"), F.col("live_model").alias("model"), "spec.size", "spec.grade", "spec.line")


@query(f"""WITH {_INPUT_SQL}, g AS (SELECT category, grain, CASE grain WHEN 'none' THEN NULL WHEN 'family' THEN model_family WHEN 'model' THEN l_partkey ELSE l_partkey * 10 + l_suppkey % 3 END AS id FROM i)
SELECT category, grain, count(*) AS listings, count(DISTINCT id) + CASE WHEN count(*) > count(id) THEN 1 ELSE 0 END AS inputs, count(DISTINCT id) + CASE WHEN count(*) > count(id) THEN 1 ELSE 0 END AS fingerprints FROM g GROUP BY 1, 2""")
def q_catalog_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many fingerprints as there are different inputs, in each category and grain."""
    tasks = tasks_for(table(spark, sf_dir, "lineitem"))
    asked = catalog.asked(_edges(spark, sf_dir, tasks), ("l_orderkey", "l_linenumber"), tasks)
    return catalog.fingerprint_counts(catalog.catalog_inputs(asked, _known(spark, sf_dir, tasks), tasks), tasks)


@query(f"""WITH s AS (SELECT model, CASE WHEN size > 45 THEN 26 ELSE family END AS family, has OR size < 3 AS has, CASE WHEN family = 7 THEN 1 ELSE size END AS size, grade, line FROM ({_SPEC_SQL})), f AS ({_FAMILY_SQL})
SELECT family, n AS n_members, size, grade, line FROM f""")
def q_family_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models move to a new family, get specs and change a field; only the families they touch are read again."""
    models, specs, _ = _models(spark, sf_dir)
    before = catalog.families(catalog.members(models, specs))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), "p_size", "p_type", F.substring("p_brand", 7, 9).cast("long").alias("was"))
    moved = part.select("model_id", F.when(F.col("p_size") > 45, 26).otherwise(F.col("was")).cast("long").alias("family_id"), "was", "p_size", "p_type")
    grade = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice").cast("long") % 3).alias("grade"))
    has = ~((F.col("p_type") == "PROMO") & (F.col("p_size") < 5)) | (F.col("p_size") < 3)
    spec = F.struct(F.when(F.col("was") == 7, 1).otherwise(F.col("p_size")).cast("long").alias("size"), F.col("grade"), (F.col("was") % 3).alias("line"))
    now = moved.join(grade, "model_id").where(has).select("model_id", spec.alias("spec"))
    touched = (F.col("p_size") > 45) | (F.col("was") == 7) | ((F.col("p_type") == "PROMO") & (F.col("p_size") < 3))
    changed = moved.where(touched).select(F.explode(F.array("was", "family_id")).alias("family_id"))
    out = catalog.refreshed(before, catalog.members(moved.select("model_id", "family_id"), now), changed)
    return out.select(F.col("family_id").alias("family"), "n_members", "spec.size", "spec.grade", "spec.line")


@query(f"""WITH {_INPUT_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_shipdate > DATE '2000-01-01' THEN 'snapshot_observed_at' END, CASE WHEN l_returnflag = 'R' THEN 'resolution_id' END,
 CASE WHEN l_tax > 0.04 THEN 'requirement_version' END, CASE WHEN l_linestatus = 'F' AND l_discount > 0.05 THEN 'evaluator_version' END, CASE WHEN grain <> 'none' AND l_quantity > 25 THEN 'catalog_fingerprint' END) AS stale FROM i""")
def q_stale_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored verdicts against what they would be read from now, all five inputs."""
    rows = _inputs(spark, sf_dir)
    was = F.when((F.col("grain") != "none") & (F.col("l_quantity") > 25), F.sha2(F.col("catalog_fingerprint"), 256)).otherwise(F.col("catalog_fingerprint"))
    live = {"snapshot_observed_at": F.col("l_shipdate"), "resolution_id": F.col("l_orderkey"), "requirement_version": F.lit(3), "evaluator_version": F.lit(2), "catalog_fingerprint": F.col("catalog_fingerprint")}
    stored = {
        "snapshot_observed_at": F.least("l_shipdate", F.to_timestamp(F.lit("2000-01-01")).cast("timestamp_ntz")),
        "resolution_id": F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")),
        "requirement_version": F.when(F.col("l_tax") > 0.04, 2).otherwise(3),
        "evaluator_version": F.when((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.05), 1).otherwise(2),
        "catalog_fingerprint": was,
    }
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(catalog.stale_bindings(stored, live), ",").alias("stale"))


# clauses: a watch's requirement of each category, the same numbers under the names that the category gives them

_NAMES = {"drive": ("sas", "sata", "nvme"), "gpu": ("sxm", "pcie", "oam"), "ram": ("rdimm", "udimm", "sodimm"), "cpu": ("sp3", "sp5", "lga4677")}


def _clause_sql(name: str, free: str, ok: str, said: str = "NULL") -> str:
    """Outcome and tier as one text; ``ok`` and ``said`` are null where nothing is known."""
    return f"'{name}:' || CASE WHEN {free} THEN 'match:none' WHEN NOT ({ok}) THEN 'no_match:catalog' WHEN NOT ({said}) THEN 'no_match:listing' WHEN {ok} THEN 'match:catalog' ELSE 'unknown:none' END"


def _category_sql(category: str) -> str:
    a, b, _ = _NAMES[category]
    word = lambda x: f"CASE {x} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_NAMES[category])) + " END"
    among = lambda x: f"({word(x)}) IN ('{a}', '{b}')"
    open_, size, said = "l_orderkey % 10 = 0", "size >= 20", "CAST(l_quantity AS BIGINT) >= 20"
    maybe = lambda x: f"CASE WHEN l_returnflag <> 'N' THEN {x} END"
    listed = {
        "drive": [_clause_sql("drive.min_capacity_tb", "false", size, maybe(said)), _clause_sql("drive.media_types", open_, "CASE WHEN grade <> 2 THEN grade = 0 END"), _clause_sql("drive.interfaces", open_, among("line"), maybe(among("l_suppkey % 3"))), _clause_sql("drive.form_factors", "true", "true"), _clause_sql("drive.recording_techs", "false", "grade IN (0, 1)", "CASE l_linestatus WHEN 'O' THEN true END")],
        "gpu": [_clause_sql("gpu.min_vram_gb", open_, size, maybe(said)), _clause_sql("gpu.chip_vendors", "false", "grade = 1", maybe("l_linestatus = 'O'")), _clause_sql("gpu.interfaces", open_, among("line"), maybe(among("l_suppkey % 3"))), _clause_sql("gpu.coolings", "true", "true"), _clause_sql("gpu.max_tdp_w", "false", "size * 10 <= 300")],
        "ram": [_clause_sql("ram.generations", "false", "grade IN (1, 2)", maybe("l_linestatus = 'O'")), _clause_sql("ram.module_types", open_, among("line"), maybe(among("l_suppkey % 3"))), _clause_sql("ram.require_ecc", open_, "grade = 1", maybe("l_linestatus = 'O'")), _clause_sql("ram.min_total_capacity_gb", "false", "size * 2 >= 40", "CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) * 2 >= 40 END"), _clause_sql("ram.min_speed_mts", "true", "true")],
        "cpu": [_clause_sql("cpu.sockets", open_, among("line"), maybe(among("l_suppkey % 3"))), _clause_sql("cpu.min_cores", "false", size, maybe(said)), _clause_sql("cpu.max_tdp_w", "false", "size * 10 <= 300"), f"'cpu.vendor_lock:' || CASE WHEN {open_} THEN 'match:none' WHEN l_returnflag = 'A' THEN 'match:listing' WHEN l_returnflag = 'R' THEN 'no_match:listing' ELSE 'unknown:none' END"],
    }[category]
    text = " || ' ' || ".join(listed)
    return f"""WITH {_INPUT_SQL}, c AS (SELECT *, CASE WHEN l_orderkey % 50 = 7 THEN '{category}.requirement:unknown:none' ELSE {text} END AS clauses FROM i WHERE category = '{category}')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, clauses, CASE WHEN clauses LIKE '%:no_match:%' THEN 'no_match' WHEN clauses LIKE '%:unknown:%' THEN 'unknown' ELSE 'match' END AS verdict FROM c"""


def _judged(category: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inputs(spark, sf_dir).where(F.col("category") == category)
    words = F.array(*map(F.lit, _NAMES[category]))
    free, size, grade = F.col("l_orderkey") % 10 == 0, F.col("spec.size"), F.col("spec.grade")
    line = F.get(words, F.col("spec.line").cast("int"))
    two = F.when(~free, F.array(*map(F.lit, _NAMES[category][:2])))
    told = F.col("l_returnflag") != "N"
    quantity, open_, stated = F.when(told, F.col("l_quantity").cast("long")), F.col("l_linestatus") == "O", F.when(told, F.get(words, (F.col("l_suppkey") % 3).cast("int")))
    lock = None
    if category == "drive":
        kind = F.when(grade == 0, "hdd").when(grade == 1, "ssd").when(grade == 2, "unknown")
        recording = F.when(grade == 0, "cmr").when(grade == 1, "smr_dm").when(grade == 2, "smr_ha")
        spec = F.struct(size.alias("capacity_tb"), clauses.known(kind).alias("media_type"), clauses.token_of(F.concat(F.upper(line), F.lit(" 12Gb/s")), clauses.DRIVE_INTERFACES).alias("interface"), F.lit("3.5").alias("form_factor"), recording.alias("recording_tech"))
        need = F.struct(F.lit(20).cast("long").alias("min_capacity_tb"), F.when(~free, F.array(F.lit("hdd"))).alias("media_types"), two.alias("interfaces"), F.array().cast("array<string>").alias("form_factors"), F.array(F.lit("cmr"), F.lit("smr_dm")).alias("recording_techs"))
        said = {"capacity_tb": quantity, "interface": stated, "recording": F.when(open_, "smr")}
    elif category == "gpu":
        spec = F.struct(size.alias("vram_gb"), F.get(F.array(F.lit("amd"), F.lit("nvidia"), F.lit("intel")), grade.cast("int")).alias("chip_vendor"), line.alias("interface"), F.lit("passive").alias("cooling"), (size * 10).alias("tdp_w"))
        need = F.struct(F.when(~free, 20).cast("long").alias("min_vram_gb"), F.array(F.lit("nvidia")).alias("chip_vendors"), two.alias("interfaces"), F.lit(None).cast("array<string>").alias("coolings"), F.lit(300).cast("long").alias("max_tdp_w"))
        said = {"vram_gb": quantity, "chip_vendor": F.when(told, F.when(open_, "nvidia").otherwise("amd")), "interface": stated}
    elif category == "ram":
        spec = F.struct(F.get(F.array(F.lit("ddr3"), F.lit("ddr4"), F.lit("ddr5")), grade.cast("int")).alias("generation"), line.alias("module_type"), (grade == 1).alias("ecc"), clauses.kit_total(F.lit(2).cast("long"), size).alias("total_capacity_gb"), F.lit(3200).cast("long").alias("speed_mts"))
        need = F.struct(F.array(F.lit("ddr4"), F.lit("ddr5")).alias("generations"), two.alias("module_types"), F.when(~free, F.lit(True)).alias("require_ecc"), F.lit(40).cast("long").alias("min_total_capacity_gb"), F.lit(None).cast("long").alias("min_speed_mts"))
        kit = F.when(F.col("l_returnflag") == "A", 2).cast("long")
        said = {"generation": F.when(told, F.when(open_, "ddr5").otherwise("ddr3")), "module_type": stated, "ecc": F.when(told, open_), "total_capacity_gb": clauses.kit_total(kit, quantity)}
    else:
        spec = F.struct(line.alias("socket"), size.alias("cores"), (size * 10).alias("tdp_w"))
        need = F.struct(two.alias("sockets"), F.lit(20).cast("long").alias("min_cores"), F.lit(300).cast("long").alias("max_tdp_w"), (~free).alias("require_vendor_unlocked"))
        said = {"socket": stated, "cores": quantity}
        lock = (F.when(F.col("l_returnflag") == "A", "unlocked").when(F.col("l_returnflag") == "R", "locked"), F.lit(0.9))
    need = F.when(F.col("l_orderkey") % 50 != 7, need)
    rows = rows.withColumn("need", need).withColumn("view", F.when(F.col("spec").isNotNull(), spec))
    rows = rows.withColumn("c", clauses.product_clauses(category, F.col("need"), F.col("view"), said, lock))
    text = F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["clause"], c["outcome"], c["tier"])), " ")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("clauses"), eligibility.verdict(F.col("c")).alias("verdict"))


@query(_category_sql("drive"))
def q_drive_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged("drive", spark, sf_dir)


@query(_category_sql("gpu"))
def q_gpu_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged("gpu", spark, sf_dir)


@query(_category_sql("ram"))
def q_ram_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged("ram", spark, sf_dir)


@query(_category_sql("cpu"))
def q_cpu_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged("cpu", spark, sf_dir)


@query("""SELECT event_id, sha256('{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '","clicked":' || CASE WHEN event_type = 'click' THEN 'true' ELSE 'false' END || ',"said":[' || CASE WHEN value > 50 THEN '"a\\n\\u00e9\\ud83d\\ude42"' ELSE 'null' END
 || ',"' || replace(props, '"', '\\"') || '"],"user":{"id":' || user_id || ',"value":' || CASE WHEN value IS NULL THEN 'null' ELSE '"' || regexp_replace(regexp_replace(CAST(CAST(value AS DECIMAL(12, 3)) AS VARCHAR), '0+$', ''), '[.]$', '') || '"' END || '}}') AS record FROM events""")
def q_record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash for one record, however nested."""
    e = table(spark, sf_dir, "events")
    said = F.array(F.when(F.col("value") > 50, F.lit("a\né🙂")), F.col("props"))
    user = F.struct(F.col("value").cast("decimal(12,3)").alias("value"), F.col("user_id").alias("id"))
    rows = e.select("event_id", F.struct(user.alias("user"), said.alias("said"), F.col("ts").cast("timestamp_ntz").alias("at"), (F.col("event_type") == "click").alias("clicked")).alias("r"))
    return rows.select("event_id", canonical_hash(F.col("r"), rows.schema["r"].dataType).alias("record"))
