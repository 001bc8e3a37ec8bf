"""Streams against their batch forms, and the later steps of resolution."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.functions import states
from tidemark.operators import alerts, completeness, lifecycle, resolve, runs
from tidemark.streaming import sources


def drained(spark, df, tmp_path):
    run = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_lifecycle_stream_is_the_batch(spark, table, tmp_path):
    rng = random.Random(7)
    rows = [(f"s{k}", i, rng.choice(lifecycle.EVENTS)) for i in range(40) for k in range(3)]
    df = table("source string, n long, event string", rows)
    for part in range(4):  # four micro-batches
        df.where(f"n div 10 = {part}").coalesce(1).sortWithinPartitions("n").write.parquet(str(tmp_path / f"in/p={part}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(*[str(tmp_path / "in/*")])
    got = {(r.source, r.n): r.state for r in drained(spark, sources.lifecycle_stream(stream), tmp_path).collect()}
    assert got == {(r.source, r.n): r.state for r in lifecycle.lifecycle(df, "source", "event", ["n"]).collect()}


def test_lifecycle_stream_puts_the_files_of_a_trigger_in_order(spark, table, tmp_path):
    rng = random.Random(11)
    rows = [(f"s{k}", i, rng.choice(lifecycle.EVENTS)) for i in range(60) for k in range(2)]
    df = table("source string, n long, event string", rows)
    for part in (3, 0, 2, 1):  # every file holds rows from all over the log, backwards
        df.where(f"n % 4 = {part}").orderBy(F.desc("n")).coalesce(1).write.parquet(str(tmp_path / f"in/p={part}"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*"))
    got = {(r.source, r.n): r.state for r in drained(spark, sources.lifecycle_stream(stream), tmp_path).collect()}
    assert got == {(r.source, r.n): r.state for r in lifecycle.lifecycle(df, "source", "event", ["n"]).collect()}


def test_buckets(spark, table, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = table("source string, at timestamp", [("a", t0 + dt.timedelta(seconds=s)) for s in (0, 1, 2, 3, 20)] + [("b", t0)])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = drained(spark, sources.bucket_stream(stream, 2.0, 0.1), tmp_path).orderBy("source", "at").collect()
    assert [r.granted for r in got] == [True, True, False, False, True, True]


def with_spec(rows):
    """The capacity alone, as a whole spec."""
    text = lambda n: F.lit(None).cast("string").alias(n)
    return rows.withColumn("spec", F.when(F.col("spec").isNotNull(), F.struct(F.col("spec.capacity").alias("capacity"), *map(text, resolve._WORDS), F.lit(None).cast("struct<brand: string, name: string>").alias("family"))))


def test_priors_and_gates(table):
    now = table("listing_id int, brand string, matcher_version int, identifiers array<string>, vetoes array<string>", [(1, "x", 2, ["a", "b"], []), (2, "y", 2, ["a"], []), (3, None, 3, ["a"], ["capacity"]), (4, "x", 2, None, []), (5, "x", 2, ["a"], ["capacity", "interface"])])
    prior = table("listing_id int, target string, grain string, confidence double, brand string, matcher_version int, identifiers array<string>", [(1, "10", "model", 0.9, "x", 2, ["b", "a"]), (2, "11", "model", 0.9, "x", 2, ["a"]), (3, "12", "model", 0.9, "x", 2, ["c"]), (5, "13", "model", 0.9, "x", 2, ["a"])])
    priors = resolve.reconsider(prior, now)
    assert {r.listing_id: r.doubts for r in priors.collect()} == {1: [], 2: ["brand"], 3: ["matcher_version", "identifiers", "veto:capacity"], 5: ["veto:capacity,interface"]}
    spec = "struct<capacity: bigint>"
    said = table(f"listing_id int, brand string, quantity int, spec {spec}", [(1, "x", None, (1,)), (2, "y", None, (1,)), (3, None, None, (1,)), (4, "x", None, None), (5, "x", None, (900,)), (6, "x", 4, None)])
    prior6 = table("listing_id int, prior_target string, prior_grain string, prior_confidence double, doubts array<string>", [(6, "14", "model", 0.9, [])])
    of_targets = table(f"listing_id int, model_id string, spec {spec}", [(5, "13", (1,))])
    none = table("listing_id int, norm string, alias_type string, brand string", [])
    got = resolve.decide(with_spec(said), none, table("listing_id int, vendor string, family string", []), with_spec(resolve.standing(priors.unionByName(prior6), of_targets)))
    # a lot demotes an inherited prior as it does any other
    assert {r.listing_id: (r.outcome, r.target, r.reason) for r in got.collect()} == {1: ("accept", "10", "prior"), 5: ("review", None, "veto"), 6: ("review", None, "lot"), **{i: ("none", None, "no_evidence") for i in (2, 3, 4)}}
    rules = table("category string, auto_accept boolean, grains array<string>, families array<string>", [("drive", True, None, None), ("gpu", False, None, None), ("cpu", True, ["family"], ["epyc"])])
    d = "listing_id int, outcome string, grain string, target string, reason string, category string, target_category string"
    rows = [(1, "accept", "model", "1", "alias", "drive", "drive"), (2, "accept", "model", "1", "alias", "drive", "gpu"), (3, "accept", "model", "1", "alias", "gpu", None), (4, "accept", "model", "1", "alias", "cpu", None), (5, "accept", "family", "xeon", "decoded", "cpu", None), (6, "accept", "family", "epyc", "decoded", "cpu", None), (7, "accept", "model", "1", "alias", "toy", None), (8, "none", "none", None, "no_evidence", "gpu", None)]
    got = {r.listing_id: (r.outcome, r.reason) for r in resolve.gate(table(d, rows), rules).collect()}
    assert got == {1: ("accept", "alias"), 2: ("review", "cross_category"), 3: ("review", "auto_accept_off"), 4: ("review", "grain_not_accepted"), 5: ("review", "family_not_ratified"), 6: ("accept", "decoded"), 7: ("review", "no_rules"), 8: ("none", "no_evidence")}


def test_what_is_learnt(table):
    c = "array<struct<norm: string, kind: string>>"
    lst = table(f"listing_id int, site int, candidates {c}", [(1, 7, [("o1", "oem"), ("h1", "house_sku"), ("m1", "manufacturer_mpn")]), (2, 7, [("o2", "oem")])])
    dec = table("listing_id int, outcome string, grain string, target string", [(1, "accept", "model", "10"), (2, "review", "none", None)])
    old = table("norm string, alias_type string, site int", [("h1", "house_sku", 8)])
    assert sorted((r.norm, r.alias_type, r.site, r.model_id) for r in resolve.learned_aliases(dec, lst, old).collect()) == [("h1", "house_sku", 7, "10"), ("o1", "oem_pn", None, "10")]
    made = resolve.variants_on_demand(dec, table("listing_id int, condition string", [(1, "used"), (2, "new")])).collect()
    assert [(r.model, r.condition) for r in made] == [("10", "used")]


REPORT = "struct<schema_ok: boolean, valid: boolean, scope_ok: boolean, complete: boolean, truncated: boolean, succeeded: boolean, limits: array<string>, items_emitted: int, items_declared: int, pages_fetched: int, pages_declared: int, errors: array<string>>"
FINE = {"schema_ok": True, "valid": True, "scope_ok": True, "complete": True, "truncated": False, "succeeded": True, "limits": [], "items_emitted": 3, "items_declared": None, "pages_fetched": 1, "pages_declared": None, "errors": []}


def test_run_classes_in_order(table):
    empty = {"items_emitted": 0, "items_declared": 0}
    cases = [
        ("SUCCEEDED", {}, 3, 3, ("complete", "complete", None)),
        ("SUCCEEDED", None, 3, 3, ("failed", "missing_output", None)),
        ("SUCCEEDED", {"schema_ok": False, "scope_ok": False}, 3, 3, ("failed", "unknown_schema_version", None)),
        ("SUCCEEDED", {"scope_ok": False, "limits": ["time"]}, 3, 3, ("failed", "scope_mismatch", None)),
        ("SUCCEEDED", {"limits": ["items"], "truncated": True}, 3, 3, ("failed", "contradictory_report: complete_with_limit_hit, complete_and_truncated", None)),
        ("SUCCEEDED", {"complete": False, "truncated": True}, 3, 3, ("failed", "contradictory_report: truncated_without_limit_hit", None)),
        ("SUCCEEDED", {"succeeded": False, "items_emitted": 2, "items_declared": 9}, 3, 3, ("failed", "contradictory_report: status_mismatch, count_mismatch", None)),
        ("SUCCEEDED", {"items_declared": 9, "pages_declared": 2}, 3, 3, ("failed", "contradictory_report: complete_with_items_declared_mismatch, complete_with_pages_unfetched", None)),
        ("SUCCEEDED", {"pages_declared": 1, "pages_fetched": 2}, 3, 3, ("failed", "contradictory_report: pages_fetched_exceed_declared", None)),
        ("FAILED", {"complete": False, "succeeded": False}, 3, 0, ("failed", "no_usable_items", None)),
        ("FAILED", {"complete": False, "succeeded": False}, 3, 3, ("partial_failure", "remote_failed_with_items", None)),
        ("ABORTED", {"complete": False, "succeeded": False} | {"items_emitted": 0}, 0, 0, ("failed", "remote_failed_empty", None)),
        ("SUCCEEDED", {"complete": False, "limits": ["pages"], "truncated": True, "errors": ["z", "a", "z"]}, 3, 3, ("partial_failure", "errors_reported: a, z", None)),
        ("SUCCEEDED", {"complete": False, "limits": ["items", "bytes"], "truncated": True}, 3, 2, ("truncated", "truncated: bytes, items", "bytes")),
        ("TIMED-OUT", {"complete": False, "truncated": True, "succeeded": False, "limits": ["items"]}, 3, 3, ("truncated", "truncated: time, items", "time")),
        ("SUCCEEDED", empty, 0, 0, ("complete", "complete_empty", None)),
        ("SUCCEEDED", empty | {"items_declared": None}, 0, 0, ("failed", "ambiguous_empty", None)),
        ("SUCCEEDED", {"complete": False}, 3, 3, ("failed", "unexplained_incomplete", None)),
        ("SUCCEEDED", {}, 3, 2, ("partial_failure", "unusable_items", None)),
    ]
    df = table(f"i int, status string, report {REPORT}, counted int, usable int", [(i, s, None if r is None else FINE | r, n, u) for i, (s, r, n, u, _) in enumerate(cases)])
    got = [tuple(r.c) for r in df.select("i", completeness.run_class(*[F.col(x) for x in df.columns[1:]]).alias("c")).orderBy("i").collect()]
    assert got == [c[-1] for c in cases]


def test_response_classes_in_order(table):
    cases = [(503, True, True, False, 9, 9, "anti_bot"), (408, True, True, True, 9, 9, "transient"), (200, False, True, False, 9, 9, "anti_bot"), (200, False, False, False, 9, 9, None), (404, False, True, False, 9, 9, "anti_bot"), (404, True, True, False, 9, 9, "unknown"), (200, True, True, True, 9, 9, "anti_bot"), (200, True, True, None, 1, 9, "anti_bot"), (200, True, True, None, 0, 0, None), (505, None, False, None, None, None, "unknown")]
    df = table("i int, s int, j boolean, e boolean, c boolean, n int, m int", [(i, *c[:-1]) for i, c in enumerate(cases)])
    got = [r.c for r in df.select("i", runs.response_class(*[F.col(x) for x in df.columns[1:]]).alias("c")).orderBy("i").collect()]
    assert got == [c[-1] for c in cases]


def test_first_bad_page_decides(table):
    kind = "s string, page_no int, parsed boolean, offset int, total int, items int, distinct_ids array<int>, has_next boolean, dropped int"
    fine = lambda s, n, **k: tuple(({"s": s, "page_no": n, "parsed": True, "offset": n * 10, "total": 2, "items": 1, "distinct_ids": [n], "has_next": False, "dropped": 0} | k).values())
    pages = [fine("total", 0, total=None), fine("total", 1, offset=5), fine("gap", 0), fine("gap", 1, offset=5, total=None), fine("one", 0, total=1), fine("more", 0), fine("two", 0), fine("two", 1), fine("drop", 0, dropped=1, parsed=False), fine("cap", 0), fine("cap", 1, has_next=True)]
    got = {r.s: r.verdict for r in completeness.sweep_verdicts(table(kind, pages), ["s"], 10, 2, table("s string", [("none",), ("one",), *{(p[0],) for p in pages}])).collect()}
    assert got == {"total": "total_missing", "gap": "offset_gap", "one": None, "more": "total_exceeds_seen", "two": "multi_page_unprovable", "drop": "parse_drop", "cap": "page_cap", "none": "empty"}


def test_pause_outlasts_reactivation_between_parser_failures(table):
    events = ["parser_rot", "manual_reactivate", "parser_rot", "manual_reactivate", "success", "parser_rot"]
    df = table("k string, n int, e string", [("a", i, e) for i, e in enumerate(events)])
    assert [r.state for r in lifecycle.lifecycle(df, "k", "e", ["n"]).orderBy("n").collect()] == ["backing_off", "active", "paused_pending_fix", "active", "active", "backing_off"]


def test_denials_in_order(table):
    df = table("e boolean, s string, p boolean, b int, t double", [(False, "skip", False, 9, 0.0), (True, "skip", False, 9, 0.0), (True, "paused_pending_fix", False, None, 1.0), (True, "paused_pending_fix", True, None, 1.0), (True, "active", False, 9, 1.0), (True, "active", False, 3, 0.5), (True, "active", False, None, 1.0)])
    got = [r[0] for r in df.select(completeness.start_denied(F.col("e"), F.col("s"), F.col("p"), F.col("b"), F.lit(5), F.col("t"))).collect()]
    assert got == ["disabled", "skipped", "paused", None, "backing_off", "no_tokens", None]


def test_states(table):
    df = table("e string, g string, h string", [('{"error": 1}', "model", "cpu"), ('{"outcome": "review"}', "model", None), (None, "model", "Bad Slug"), ("{}", "none", "")])
    got = [(r.o, r.d.category, r.d.reject) for r in df.select(states.edge_outcome(F.col("e"), F.col("g")).alias("o"), states.dispatch_category(F.col("h")).alias("d")).collect()]
    assert got == [("error", "cpu", None), ("review", "drive", None), ("accept", None, "bad_category"), ("none", None, "bad_category")]


def test_alert_states(table):
    df = table("k int, t int, v int", [(1, i, v) for i, v in enumerate([5, 9, 7, 9, 5, 9])])
    got = [(r.on, r.fires) for r in alerts.hysteresis(df, ["k"], "t", "v", F.col("v") >= 9, F.col("v") <= 6).orderBy("t").collect()]
    assert got == [(False, False), (True, True), (True, False), (True, False), (False, False), (True, True)]
