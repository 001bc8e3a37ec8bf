"""The quality classifier on held-out rows, its odd inputs, and the pipeline stage by stage."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.common import read_table
from tidemark.llm.quality import learn, quality_filter, scored, tree_rules
from tidemark.llm.queries import held_out, op8_quality, oracle_sql, queries

from .test_decontaminate import brute, shingles, words
from .test_files_and_pieces import SP
from .test_lines_and_near import dedup_brute
from .test_near_copies import kept_brute

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    out = op8_quality(spark, SF).join(read_table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in out)
    assert right / len(out) > 0.97
    assert sum(r.predicted for r in out if r.quality == 1) / sum(r.quality for r in out) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_every_row_is_scored(spark, table):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) + "."
    bad = lambda: " ".join(["spam!!"] * 60)
    rows = [(i, good() if i % 2 else bad()) for i in range(120)]
    labels = table("doc_id long, quality int", [(i, i % 2) for i in range(100)] + [(5, None), (None, 1), (7, 0), (7, 1)])
    odd = [(None, None), (900, ""), (901, good()), (901, good()), (902, bad()), (903, "x " * 100_000), (904, None)]
    df = table("doc_id long, text string, score string, _text int, rec int", [(*r, "clash", 1, 1) for r in rows + odd])
    model = learn(df, labels)
    out = scored(df, model)
    assert sorted(out.columns) == sorted(df.columns)
    got = out.collect()
    assert len(got) == len(rows) + len(odd) and not any(math.isnan(r.score) for r in got)
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and r.doc_id in range(100, 120))
    kept = quality_filter(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.score >= 0.5 for r in got)
    assert scored(df.where("false"), model).collect() == []


@pytest.mark.parametrize(("labels", "want"), [([], 0.5), ([(1, 1), (2, 1)], 0.75), ([(1, 0)], 1 / 3)])
def test_without_two_classes(table, labels, want):
    df = table("doc_id long, text string", [(1, "a"), (2, "b"), (3, None)])
    model = learn(df, table("doc_id long, quality int", labels))
    assert [round(r.score, 9) for r in scored(df, model).collect()] == [round(want, 9)] * 3


def test_tree_paths_are_rules():
    said = "Model\n  Tree 0 (weight 1.0):\n    If (feature 2 <= 0.5)\n     If (feature 2 <= 0.25)\n      Predict: 1.0\n     Else (feature 2 > 0.25)\n      Predict: 0.0\n    Else (feature 2 > 0.5)\n     Predict: 0.0\n"
    assert tree_rules(said) == [((2, "<=", 0.5),), ((2, "<=", 0.25),), ((2, "<=", 0.5), (2, ">", 0.25)), ((2, ">", 0.5),)]


def test_labels_of_held_out_rows_are_not_learnt(spark):
    labels = read_table(spark, SF, "labels")
    docs = read_table(spark, SF, "documents")
    learnt = labels.where(~held_out(F.col("doc_id")))
    turned = learnt.unionByName(labels.where(held_out(F.col("doc_id"))).withColumn("quality", 1 - F.col("quality")))
    pick = lambda ls: learn(docs, ls.where(~held_out(F.col("doc_id")))).rules
    assert [r for r, _ in pick(learnt)] == [r for r, _ in pick(turned)]


def test_pipeline_stages_are_brute_force(spark, tmp_path):
    """Each stage, on what the one before kept, against a plain version over the same rows."""
    docs = read_table(spark, SMALL, "documents")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in read_table(spark, SMALL, "benchmark").collect()]
    labels = read_table(spark, SMALL, "labels").where(~held_out(F.col("doc_id")))
    shared = lambda text: [(i, t) for i, t in items if set(shingles(words(text), 5)) & set(shingles(words(t), 5))]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r for r in out.collect()}
        if name == "quality":
            want = {r.doc_id: before[r.doc_id] for r in scored(docs, learn(docs, labels)).collect() if r.score >= 0.5}
        elif name == "line_dedup":
            want = dedup_brute(before.items())
            assert all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "near_dedup":
            want = {i: before[i] for i in kept_brute(list(before.items()))}
        elif name == "decontamination":
            want = {i: t for i, t in before.items() if not brute([(i, t)], shared(t))}
        else:
            ids = {i: SP.encode(t or "", add_eos=True) for i, t in before.items()}
            assert {i: (list(r.ids), r.decoded) for i, r in rows.items()} == {i: (x, SP.decode(x)) for i, x in ids.items()}
            break
        assert out.columns == columns and out.count() == len(rows)
        assert {i: r.text for i, r in rows.items()} == want
        docs = out


def test_pipeline_of_nothing(spark, table):
    docs = read_table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_names():
    assert [n.split("_")[0] for n in queries()] == [f"op{k}" for k in range(1, 14)]
    assert set(oracle_sql()) <= set(queries())
