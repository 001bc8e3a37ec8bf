"""Registered queries of wording: processors, offer terms and masking, on titles put together from a part's columns.

What is asserted, what negates it and how far away it stands vary independently, so that the SQL can say the
reading from the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import candidates, processors, spans, title
from ..operators import resolve
from .common import spread, table
from .registry import query


def _pick(n: Column, *xs: str) -> Column:
    return F.get(F.array(*map(F.lit, xs)), (n % len(xs)).cast("int"))


def _processor_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    intel = k % 7 == 0
    name = F.when(intel, "Intel Xeon Gold 6338").otherwise(F.concat(F.lit("AMD EPYC "), _pick(k, "7763", "7742", "9354P", "7H12")))
    second = F.when(k % 11 == 0, F.when(intel, " / Platinum 8358").otherwise("/7402")).otherwise("")
    words = F.array_join(F.slice(F.array(*map(F.lit, ("clean", "tested", "server", "grade"))), F.lit(1), (F.col("p_size") % 5).cast("int")), " ")
    lock = F.concat_ws(" ", _pick(k, "", "not", "no longer", "never", "isn't", "without"), words, _pick(F.floor(k / 6), "", "a Dell", "the vendor"), _pick(F.floor(k / 18), "unlocked", "LOCKED", "PSB-unlocked", "boxed"))
    text = F.concat(name, second, F.lit(" "), "p_size", F.lit("-Core "), F.when(intel, "FCLGA 4189").otherwise("Socket SP3 4094"), F.lit(" - "), lock, F.when(k % 13 == 0, " | QS").otherwise(""), F.when(k % 17 == 0, " + Motherboard").otherwise(""), F.when(k % 5 == 0, ", replacement for (EPYC 9654 ES, 2x CPU) unit").otherwise(""))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", title.canonical_title(text).alias("t"))


_LOCK_SQL = """SELECT *, p_partkey % 6 AS neg, p_partkey // 6 % 3 AS qual, p_partkey // 18 % 4 AS said, p_size % 5 AS words, p_partkey % 7 = 0 AS intel, p_partkey % 11 = 0 AS two, p_partkey % 13 = 0 AS qs, p_partkey % 17 = 0 AS board, p_partkey % 4 AS m FROM part"""


@query(f"""WITH t AS ({_LOCK_SQL}),
d AS (SELECT *, neg > 0 AND words + CASE neg WHEN 2 THEN 1 ELSE 0 END < 3 AS denied, neg IN (1, 4) AND words = 0 AND qual = 0 AND said = 1 AS owned FROM t),
r AS (SELECT *, CASE WHEN intel THEN CASE WHEN two THEN NULL ELSE '6338' END WHEN two THEN NULL ELSE ['7763', '7742', '9354p', '7h12'][m + 1] END AS model,
 CASE WHEN intel OR said = 3 THEN NULL WHEN owned THEN 'unlocked' WHEN denied THEN NULL WHEN said = 1 THEN 'locked' ELSE 'unlocked' END AS vendor_lock FROM d)
SELECT p_partkey, CASE WHEN intel THEN 'intel' ELSE 'amd' END AS brand, CASE WHEN intel THEN 'lga4189' ELSE 'sp3' END AS socket, CAST(p_size AS INTEGER) AS cores, model,
 CASE WHEN two THEN CASE WHEN intel THEN '6338 8358' ELSE array_to_string(list_sort([['7763', '7742', '9354p', '7h12'][m + 1], '7402']), ' ') END END AS multi_model,
 CASE WHEN qs THEN 'qs' END AS sample, CASE WHEN board THEN 'motherboard' END AS bundle, vendor_lock,
 CASE WHEN intel THEN 'xeongold6338' WHEN two THEN NULL WHEN m = 3 THEN NULL ELSE 'epyc' || ['7763', '7742', '9354p'][m + 1] END AS best,
 concat_ws(',', CASE WHEN qs THEN 'sample' END, CASE WHEN board THEN 'bundle' END, CASE WHEN two THEN 'multi_model' END, CASE WHEN intel THEN 'socket' END, CASE WHEN p_size <> 32 THEN 'cores' END, CASE WHEN model <> '7763' THEN 'model' END) AS vetoes FROM r""")
def q_processor_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers, models, markers and locks, negated at every distance and cited beside; vetoes against one of the catalog."""
    rows = _processor_titles(spark, sf_dir)
    rows = rows.select("p_partkey", processors.attributes(F.col("t")).alias("a"), processors.candidates(F.col("t")).alias("c"))
    against = processors.vetoes(F.col("a"), F.lit("sp3"), F.lit(32), F.lit("7763"))
    return rows.select("p_partkey", *[f"a.{x}" for x in ("brand", "socket", "cores", "model", "multi_model", "sample", "bundle", "vendor_lock")], F.get("c", F.lit(0))["norm"].alias("best"), F.array_join(against, ",").alias("vetoes"))


@query("""WITH w AS (SELECT * FROM (VALUES (0, 'used', NULL, 6), (1, 'new', NULL, 7), (2, 'recertified', 'factory', 1), (3, 'recertified', NULL, 2), (4, 'open_box', NULL, 5), (5, 'for_parts', NULL, 0), (6, 'refurbished', 'seller', 3)) v(i, value, channel, rank)),
p AS (SELECT p_partkey, p_partkey % 2 = 0 AS store, [{'v': a.value, 'c': a.channel, 'r': a.rank, 'd': p_size % 3 = 0}, {'v': b.value, 'c': b.channel, 'r': b.rank, 'd': p_size % 4 = 0}] AS s FROM part JOIN w a ON a.i = p_partkey % 7 JOIN w b ON b.i = p_partkey // 7 % 7),
q AS (SELECT *, list_sort(list_transform(list_filter(s, lambda x: NOT x.d), lambda x: {'r': x.r, 'v': x.v, 'c': x.c})) AS y, list_sort(list_transform(list_filter(s, lambda x: x.d), lambda x: {'r': x.r, 'v': x.v, 'c': x.c})) AS n FROM p),
r AS (SELECT *, y[1].v AS value, y[1].c AS channel, CASE WHEN len(y) = 2 AND y[1].v <> y[2].v THEN y[1].v || ',' || y[2].v END AS conflict,
 list_filter(list_distinct(list_transform(n, lambda x: x.v)), lambda v: NOT list_contains(list_transform(y, lambda x: x.v), v)) AS denied,
 list_filter(list_transform(n, lambda x: x.c), lambda c: c IS NOT NULL AND NOT coalesce(list_contains(list_transform(y, lambda x: x.c), c), false)) AS off FROM q),
f AS (SELECT *, store AND conflict LIKE '%recertified%' AS bad, NOT store OR list_contains(off, 'factory') OR (value IS NULL AND len(denied) > 0) OR coalesce(value <> 'recertified', false) OR coalesce(channel <> 'factory', false) AS asis FROM r)
SELECT p_partkey, value AS stated, conflict, nullif(array_to_string(list_sort(denied), ','), '') AS denied, CASE WHEN coalesce(bad, false) THEN NULL WHEN asis THEN value ELSE 'recertified' END AS condition,
 CASE WHEN coalesce(bad, false) THEN NULL WHEN asis THEN channel ELSE 'factory' END AS channel, coalesce(bad, false) AS review FROM f""")
def q_offer_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two statements on the condition, each asserted or denied, and what a store declares for all it sells."""
    k = F.col("p_partkey")
    said = ("used", "NEW", "Factory Recertified", "recertified", "open box", "for parts", "seller refurbished")
    text = F.concat_ws(" ", F.lit("Seagate Exos 16TB"), F.when(F.col("p_size") % 3 == 0, "not"), _pick(k, *said), F.lit("-"), F.when(F.col("p_size") % 4 == 0, "never a"), _pick(F.floor(k / 7), *said), F.lit(", replaces (Toshiba, new) drive used"))
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select(k, title.canonical_title(text).alias("t"))
    rows = rows.select(k, title.offer_terms(title.without_citations(F.col("t"))).alias("o"))
    store = k % 2 == 0
    rows = rows.withColumn("d", title.with_declared(F.col("o"), F.when(store, "recertified"), F.when(store, "factory")))
    return rows.select(k, F.col("o.condition.value").alias("stated"), F.array_join("o.conflict", ",").alias("conflict"), F.array_join(F.array_sort("o.denied"), ",").alias("denied"), F.col("d.condition.value").alias("condition"), F.col("d.channel").alias("channel"), F.col("d.conflict").isNotNull().alias("review"))


@query("""WITH p AS (SELECT p_partkey, p_size % 6 AS depth, p_partkey % 4 AS kind, replace(p_name, ' ', 'x') || p_size AS own FROM part),
s AS (SELECT *, repeat('(', depth) || 'wd gold - ' || repeat(')', depth) AS cited FROM p),
t AS (SELECT *, CASE kind WHEN 0 THEN own || ' comparable to ' || cited || ' hgst - ' || own WHEN 1 THEN own || ' (replaces ' || cited || ' hgst) ' || own WHEN 2 THEN 'for ' || own || ' ' || cited ELSE own || ' ' || cited END AS t FROM s)
SELECT p_partkey, length(t) AS n, CASE kind WHEN 0 THEN CASE WHEN depth = 0 THEN own || ' ' || repeat(' ', length('comparable to wd gold')) || ' -  hgst - ' || own ELSE own || repeat(' ', 21 + length(cited)) || '- ' || own END
 WHEN 1 THEN CASE WHEN depth = 0 THEN own || ' (' || repeat(' ', 16) || ' -  hgst) ' || own ELSE own || ' (' || repeat(' ', 14 + length(cited)) || ') ' || own END
 WHEN 2 THEN CASE WHEN depth = 0 THEN repeat(' ', 12 + length(own)) || ' - ' ELSE repeat(' ', length(t)) END ELSE t END AS masked FROM t""")
def q_citation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited products in brackets of every depth, blanked out without moving what stands beside them."""
    k, depth = F.col("p_partkey"), (F.col("p_size") % 6).cast("int")
    own = F.concat(F.replace("p_name", F.lit(" "), F.lit("x")), "p_size")
    cited = F.concat(F.repeat(F.lit("("), depth), F.lit("wd gold - "), F.repeat(F.lit(")"), depth))
    texts = (F.concat(own, F.lit(" comparable to "), cited, F.lit(" hgst - "), own), F.concat(own, F.lit(" (replaces "), cited, F.lit(" hgst) "), own), F.concat(F.lit("for "), own, F.lit(" "), cited))
    text = F.concat(own, F.lit(" "), cited)
    for i, x in enumerate(texts):
        text = F.when(k % 4 == i, x).otherwise(text)
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select(k, text.alias("t"))
    return rows.select(k, F.length("t").cast("long").alias("n"), spans.masked(F.col("t"), spans.DRIVE_REFERENCES, spans.LEADING).alias("masked"))


@query("""WITH t AS (SELECT p_partkey AS k, p_partkey, 'st' || (1000 + p_partkey % 9000) || 'nm' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS mpn, '00' || (4000000 + p_partkey) AS emc, lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') || '-ba1' AS hp, '0f' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') AS retail FROM part),
c AS (SELECT *, list_filter([CASE WHEN k % 2 = 0 THEN mpn || ':manufacturer_mpn:seagate:' || CASE WHEN k % 3 = 0 THEN 'structured' ELSE 'title' END WHEN k % 3 = 0 THEN mpn || ':manufacturer_mpn:seagate:structured' END,
 CASE WHEN k % 5 IN (0, 1) THEN emc || ':oem:dell_emc:title' END, CASE WHEN k % 7 < 3 THEN replace(hp, '-', '') || ':oem:hpe:title' END,
 CASE WHEN k % 7 IN (3, 4) THEN replace(hp, '-', '') || ':unknown_code::title' END, CASE WHEN k % 11 = 0 THEN retail || ':unknown_code::review' END], lambda x: x IS NOT NULL) AS found FROM t)
SELECT p_partkey, array_to_string(found, ' ') AS found, CASE WHEN k % 2 = 0 THEN mpn ELSE '' END AS mpns FROM c""")
def q_number_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of makers and resellers, with and without the word that opens their gate, cited beside, and the structured field."""
    k = F.col("p_partkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    mpn = F.concat(F.lit("ST"), (1000 + k % 9000).cast("string"), F.lit("NM"), pad(F.col("p_size"), 3))
    emc, hp, retail = F.concat(F.lit("00"), (4_000_000 + k).cast("string")), F.concat(pad(k % 1_000_000, 6), F.lit("-BA1")), F.concat(F.lit("0F"), pad(k % 100_000, 5))
    bits = [
        F.lit("Drive"),
        F.when(k % 2 == 0, mpn),
        F.when(k % 5 == 0, F.concat(F.lit("Dell "), emc)).when(k % 5 == 1, F.concat(F.lit("EMC "), emc)).when(k % 5 == 2, emc),
        F.when(k % 7 < 3, F.concat(F.lit("for HPE ProLiant "), hp)).when(k % 7 < 5, hp),
        F.when(k % 11 == 0, retail),
        F.when(k % 13 == 0, ", replacement for (NetApp X477A, HP 999999-B99) drives"),
    ]
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select(k, title.canonical_title(F.concat_ws(" ", *bits)).alias("t"), F.when(k % 3 == 0, mpn).alias("m"))
    rows = rows.select(k, candidates.candidates(F.col("t"), F.col("m")).alias("c"))
    said = F.transform("c", lambda c: F.concat_ws(":", c["norm"], c["kind"], c["vendor"], F.when(c["structured"], "structured").when(c["review_only"], "review").otherwise("title")))
    return rows.select(k, F.array_join(said, " ").alias("found"), F.array_join(candidates.mpns(F.col("c")), " ").alias("mpns"))


@query(f"""WITH t AS ({_LOCK_SQL}), h AS (SELECT *, CASE WHEN intel THEN '3' WHEN two OR m > 1 THEN NULL WHEN m = 0 THEN '1' ELSE '2' END AS model, two OR qs OR board OR p_size <> 32 AS bad FROM t)
SELECT p_partkey, CASE WHEN model IS NULL THEN 'none' WHEN bad THEN 'review' ELSE 'accept' END AS outcome, CASE WHEN model IS NOT NULL AND NOT bad THEN model END AS target, CASE WHEN model IS NULL THEN 'no_evidence' WHEN bad THEN 'veto' ELSE 'exact_alias' END AS reason FROM h""")
def q_processor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processor listings from title to decision: candidates meet the catalog's names, and the category's vetoes the ladder."""
    catalog = spark.createDataFrame([("epyc7763", "1", "amd", "sp3", 32, "7763"), ("epyc7742", "2", "amd", "sp3", 32, "7742"), ("xeongold6338", "3", "intel", "lga4189", 32, "6338")], "norm string, model_id string, brand string, socket string, cores int, model string")
    aliases = catalog.select("norm", F.lit("mpn").alias("alias_type"), F.lit(None).cast("int").alias("site"), "model_id", F.lit(None).cast("string").alias("family_id"), "brand")
    rows = _processor_titles(spark, sf_dir).select(F.col("p_partkey").alias("listing_id"), F.lit(1).alias("site"), processors.attributes(F.col("t")).alias("a"), processors.candidates(F.col("t")).alias("candidates"))
    rows = rows.withColumn("brand", F.col("a.brand"))
    known = catalog.select(F.col("model_id").alias("of"), "socket", "cores", "model")
    # three rows, whose size Spark doesn't know: it would broadcast the listings' candidates instead
    hits = resolve.alias_hits(rows, F.broadcast(aliases)).join(rows.select("listing_id", "a").hint("merge"), "listing_id").join(F.broadcast(known), F.col("model_id") == F.col("of"))
    hits = hits.withColumn("vetoes", processors.vetoes(F.col("a"), F.col("socket"), F.col("cores"), F.col("model"))).drop("a", "of", "socket", "cores", "model")
    none = spark.createDataFrame([], "listing_id long, vendor string, family string")
    out = resolve.decide(rows.select("listing_id", "brand"), hits, none)
    return out.select(F.col("listing_id").alias("p_partkey"), "outcome", "target", "reason")
