"""The registered queries of this package, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_trees, read_loss, read_turns, thread_messages
from .common import new_path, read_table, written
from .decontaminate import contaminated
from .kdtree import top_k
from .line_dedup import line_dedup
from .piece_bpe import encode_decode
from .prefix_trie import grafted, ordered_turns, prefix_trie
from .quality import learn, scored
from .sharding import lpt_shards
from .simhash import simhash_classes
from .token_counts import token_counts
from .token_file import read_tokens, write_tokens
from .vector_codes import codebooks_sha256, compress
from .warc import read_warc, write_warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP1_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ln FROM documents),
w AS (
  SELECT doc_id, i, ln[i] || chr(10) || ln[i + 1] || chr(10) || ln[i + 2] AS k
  FROM (SELECT doc_id, ln, unnest(range(1, len(ln) - 1)) AS i FROM d WHERE len(ln) >= 3)
),
f AS (SELECT k, i, doc_id, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM w),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM f WHERE rn > 1),
l AS (SELECT doc_id, unnest(range(1, len(ln) + 1)) AS i, unnest(ln) AS line FROM d),
k AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text,
         count(*) AS n_lines, count(g.i) AS n_removed
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(read_table(spark, sf_dir, "documents"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        model = file.read()
    path = new_path(spark, "token-file")
    index = write_tokens(read_table(spark, sf_dir, "documents"), path, model)

    out = read_tokens(spark, path, index)
    return out.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(read_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_warc(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS d, html FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM b)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM r
"""


def op6_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    out = lpt_shards(rows, group=F.struct("text_hash", "size"), size=F.col("size"), shards=40, order=[F.col("doc_id")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    out = encode_decode(read_table(spark, sf_dir, "documents"), model)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    out = scored(docs, learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    out = format_trees(thread_messages(rows.union(extra), "conv_id", "turn", "role", "text"))
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    out = out.select("tree", "formatted", turns.alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_OP9_TAILS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>"
OP9_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '([<\[])(\\*)({_OP9_TAILS})', '\1\\\2\3', 'g'))
                + length(regexp_replace(text, '([<\[])(\\*)({_OP9_TAILS})', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        model = file.read()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, model, limit=1024).select("doc_id", "counts.n_bytes", "counts.n_tokens", "counts.over_limit")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordered_turns(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    c = F.col("c")
    return prefix_trie(*grafted(turns, heads=5, base=c - c % 100, taken=F.crc32(c.cast("string").cast("binary")) % 6))


OP12_SQL = """
WITH o AS (
  SELECT conv_id AS c, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS d
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
b AS (SELECT c, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: CAST(ascii((c::VARCHAR)[i:i]) AS UBIGINT)) AS bytes FROM (SELECT DISTINCT c FROM o)),
g AS (
  SELECT c, c - c % 100 AS base, (xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda x, y:
    list_reduce(list_prepend(xor(x, y), [1::UBIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda v, one: xor(v >> 1, 3988292384::UBIGINT * (v & one)))), 4294967295::UBIGINT) % 6)::BIGINT AS h
  FROM b
),
t AS (
  SELECT g.c, 0 AS own, o.d, o.role, o.text FROM g JOIN o ON o.c = g.base AND o.d <= g.h
  UNION ALL SELECT g.c, 1, o.d, o.role, o.text FROM g JOIN o ON o.c = g.c AND o.d > g.h
),
p AS (
  SELECT g.c, coalesce(list(struct_pack(r := t.role, x := t.text) ORDER BY t.own, t.d) FILTER (WHERE t.c IS NOT NULL), []) AS path
  FROM g LEFT JOIN t ON t.c = g.c GROUP BY g.c
),
m AS (SELECT c, len(path) AS e, unnest(range(0, len(path) + 1)) AS d, path FROM p),
v AS (
  SELECT d, path[1:d] AS k, min(c) AS conv_id, count(*) AS n_convs, CAST(coalesce(any_value(length(path[d].x)), 0) AS BIGINT) AS len,
         count(*) = count(*) FILTER (WHERE e = d) AS leaf,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE e = d), '')) AS ends_sha256
  FROM m GROUP BY 1, 2
),
s AS (
  SELECT i AS d, k[1:i] AS k, sum((n_convs - 1) * len) AS saved, count(*) FILTER (WHERE leaf) AS leaves, count(*) FILTER (WHERE d = i + 1) AS children
  FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM v) GROUP BY 1, 2
)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, s.children AS n_children, s.leaves AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s ON s.d = v.d AND s.k = v.k LEFT JOIN v u ON u.d = v.d - 1 AND u.k = v.k[1:v.d - 1]
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    codes, books = compress(vectors, "embedding", "vec_id")
    out = written(codes.select("rec.vec_id", "rec.label", F.lower(F.hex("code")).alias("code"), "error"), "codes")
    by_label = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return out.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _op13_round(n: int) -> str:
    """Codes of round n, and the codebooks that they give."""
    return f"""
a{n} AS (
  SELECT row, p, any_value(x) AS x, CAST(min(dist * 64 + e) % 64 AS BIGINT) AS e, min(dist) AS dist
  FROM (SELECT v.row, v.p, v.x, b.e, CAST(list_sum(list_transform(range(1, w + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))) AS BIGINT) AS dist FROM v JOIN b{n - 1} b ON b.p = v.p)
  GROUP BY row, p
),
m{n} AS (
  SELECT p, e, list(m ORDER BY i) AS x
  FROM (SELECT p, e, i, CAST(sum(c) - ((sum(c) % count(*)) + count(*)) % count(*) AS BIGINT) // count(*) AS m FROM (SELECT p, e, unnest(range(1, w + 1)) AS i, unnest(x) AS c FROM (SELECT a.*, len(x) AS w FROM a{n} a)) GROUP BY p, e, i)
  GROUP BY p, e
),
b{n} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{n - 1} b LEFT JOIN m{n} m ON m.p = b.p AND m.e = b.e)"""


OP13_SQL = f"""
WITH q AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
r AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS row FROM q),
v AS (SELECT row, p, len(e) // 16 AS w, e[p * (len(e) // 16) + 1:(p + 1) * (len(e) // 16)] AS x FROM (SELECT row, e, unnest(range(16)) AS p FROM r)),
b0 AS (SELECT p, row - 1 AS e, x FROM v WHERE row <= 64),{_op13_round(1)},{_op13_round(2)},{_op13_round(3)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2),
o AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a3 GROUP BY row)
SELECT r.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY r.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM r JOIN o ON o.row = r.row CROSS JOIN h
"""


def queries() -> dict[str, Query]:
    named = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(named.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_warc": OP5_SQL, "op9_chat_format": OP9_SQL, "op10_exact_top_k": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_vector_codes": OP13_SQL}
