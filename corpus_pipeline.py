"""The training-text pipeline over documents: each stage is written as Parquet and read again by the next.

1. quality: documents that the classifier scores below 0.5 go. Labels are learnt from the rows that
   op8_quality learns from. A document without a label is scored like any other.
2. line_dedup: lines in repeated three-line windows go, but for each window's first occurrence. A
   document stays even if no line is left (n_chars follows the text).
3. near_dedup: one document of each group of near copies stays, the one with the smallest id. Near
   copies share 0.8 of their five-word shingles (op2's contract, 4 words and 4 bits, is the query's).
4. decontamination: documents that hold a benchmark item go.
5. pieces: what is left is encoded and decoded; this stage returns doc_id, ids, decoded.

The cases of nulls, empty tables and clashing names are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tidemark.llm.common import read_table, written
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.near_copies import copy_dedup
from tidemark.llm.piece_bpe import encode_decode
from tidemark.llm.quality import learn, quality_filter
from tidemark.llm.queries import held_out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return quality_filter(docs, learn(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs)
    kept = {"n_chars": F.length("text").cast("long")}
    return out.select(*[kept.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copy_dedup(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return encode_decode(docs, file.read())


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_free),
    ("pieces", pieces),
]

#: A classifier that is fitted and 64-bit hashes can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
