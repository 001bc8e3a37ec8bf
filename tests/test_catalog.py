"""Catalog inputs by grain, refreshed families, clauses and canonical records."""

import datetime as dt
import json
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.canonical import canonical, canonical_hash
from tidemark.operators import catalog, clauses
from tidemark.plans import catalog_queries, common

SPEC = "struct<size: long, kind: string>"


def catalog_of(table, models, specs):
    return catalog.members(table("model_id long, family_id long", models), table(f"model_id long, spec {SPEC}", specs))


def plain(fams):
    return sorted((r.family_id, r.n_members, r.spec["size"], r.spec["kind"], r.s0, r.s3) for r in fams.collect())


def test_families_agree_only_where_all_do(table):
    models = [(1, 10), (2, 10), (3, 11), (4, 11), (5, 12), (6, 12), (7, None), (8, 13), (9, 13)]
    specs = [(1, (5, "a")), (2, (5, "b")), (3, (1, "x")), (5, (2, None)), (6, (2, None)), (7, (9, "z")), (8, (3, None)), (9, (3, "q"))]
    got = {r.family_id: (r.n_members, r.spec["size"], r.spec["kind"]) for r in catalog.families(catalog_of(table, models, specs)).collect()}
    assert got == {10: (2, 5, None), 11: (2, None, None), 12: (2, 2, None), 13: (2, 3, None)}


def test_refreshed_families_are_those_made_anew(table):
    rng = random.Random(1)
    models = {m: rng.choice([1, 2, 3, None]) for m in range(30)}
    specs = {m: (rng.randrange(2), rng.choice(["a", None])) for m in range(30) if rng.random() < 0.9}
    fams = catalog.families(catalog_of(table, [*models.items()], [*specs.items()]))
    for _ in range(3):
        before, changed = dict(models), set()
        for m in rng.sample(range(30), 4):
            models[m] = rng.choice([1, 2, 3, 4, None])
            specs[m] = (rng.randrange(2), "n")
            changed |= {before[m], models[m]}
        gone = rng.choice([m for m in models])
        changed.add(models.pop(gone))
        models[gone + 100] = 4
        changed.add(4)
        rows = catalog_of(table, [*models.items()], [*specs.items()])
        new = catalog.refreshed(fams, rows, table("family_id long", [(c,) for c in changed] * 2))
        assert plain(new) == plain(catalog.families(rows))
        fams = table(new.schema.simpleString().removeprefix("struct<").removesuffix(">"), new.collect())


def test_inputs_by_grain(table):
    rows = catalog_of(table, [(1, 10), (2, 10), (3, None)], [(1, (5, "a")), (2, (5, "b"))])
    known = catalog.targets(rows, catalog.families(rows), table("variant_id long, model_id long", [(100, 1), (101, 9)]))
    edges = [(1, "drive", "variant", None, None, 100), (2, "drive", "model", None, 2, None), (3, "drive", "family", 10, None, None), (4, "drive", "none", None, None, None), (5, "drive", None, None, None, None), (6, "drive", "model", None, 3, None), (7, "drive", "model", None, 77, None), (8, "gpu", "model", None, 2, None), (9, "drive", "model", None, 2, None)]
    df = table("listing_id int, category string, grain string, family_id long, model_id long, variant_id long, spec_note string", [(*e, "kept") for e in edges])
    got = {r.listing_id: r for r in catalog.catalog_inputs(df, known).collect()}
    view = lambda r: r.spec and tuple(r.spec)
    assert {i: (view(r), r.n_members, r.live_family, r.live_model) for i, r in got.items()} == {1: ((5, "a"), 1, 10, 1), 2: ((5, "b"), 1, 10, 2), 3: ((5, None), 2, 10, None), 4: (None, None, None, None), 5: (None, None, None, None), 6: (None, 1, None, 3), 7: (None, None, None, None), 8: ((5, "b"), 1, 10, 2), 9: ((5, "b"), 1, 10, 2)}
    prints = {i: r.catalog_fingerprint for i, r in got.items()}
    assert prints[7] is None and prints[4] == prints[5] and prints[2] == prints[9] and len(set(prints.values())) == 7
    assert all(r.spec_note == "kept" for r in got.values())
    later = catalog_of(table, [(1, 10), (2, 10), (3, None)], [(1, (5, "a")), (2, (5, "c"))])
    again = {r.listing_id: r.catalog_fingerprint for r in catalog.catalog_inputs(df, catalog.targets(later, catalog.families(later), table("variant_id long, model_id long", [(100, 1)]))).collect()}
    assert {i for i in prints if prints[i] != again[i]} == {2, 3, 8, 9}


@pytest.mark.parametrize(("grain", "family"), [("none", None), ("family", 10)])
def test_edges_of_one_key_are_dealt_out(spark, table, grain, family):
    rows = catalog_of(table, [(1, 10), (2, 10)], [(1, (5, "a")), (2, (5, "b"))])
    known = catalog.targets(rows, catalog.families(rows), table("variant_id long, model_id long", [(100, 1)]))
    df = table("listing_id int, category string, grain string, family_id long, model_id long, variant_id long", [(i, "drive", grain, family, None, None) for i in range(2000)])
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    was = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        out = catalog.catalog_inputs(df, known).select("listing_id", "n_members", "catalog_fingerprint", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sorted(r.listing_id for r in out) == list(range(2000))
    assert {r.n_members for r in out} == {family and 2} and len({r.catalog_fingerprint for r in out}) == 1
    tasks = [r.task for r in out]
    assert max(map(tasks.count, set(tasks))) < 1000


@pytest.mark.parametrize("tasks", [None, 40])
def test_fingerprints_of_what_is_asked_once(table, tasks):
    rng = random.Random(7)
    models = [(m, rng.choice([10, 11, None])) for m in range(300)]
    rows = catalog_of(table, models, [(m, (m % 3, "a")) for m in range(0, 300, 2)])
    known = catalog.targets(rows, catalog.families(rows), table("variant_id long, model_id long", [(m * 10, m) for m in range(300)]), tasks)
    edges = []
    for i in range(6000):
        grain = rng.choice(["none", None, "family", "model", "variant", "variant"])
        family = rng.choice([10, 11, 99, None]) if grain == "family" else None
        model = rng.choice([7, rng.randrange(350), None]) if grain == "model" else None
        edges.append((i, rng.choice(["drive", "gpu", None]), grain, family, model, rng.randrange(3500) if grain == "variant" else None))
    df = table("listing_id int, category string, grain string, family_id long, model_id long, variant_id long", edges)
    print_of = {r.listing_id: r.catalog_fingerprint for r in catalog.catalog_inputs(df, known).collect()}
    want = {}
    for i, category, grain, *ids in edges:
        n, inputs, prints = want.setdefault((category, grain), ([], set(), set()))
        n.append(i)
        inputs.add(tuple(ids))
        prints |= {print_of[i]} - {None}
    out = catalog.fingerprint_counts(catalog.catalog_inputs(catalog.asked(df, ("listing_id",), tasks), known, tasks), tasks)
    assert {(r.category, r.grain): (r.listings, r.inputs, r.fingerprints) for r in out.collect()} == {k: tuple(map(len, v)) for k, v in want.items()}


def test_tasks_of_fingerprints_follow_the_listings(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_A_TASK", 200, raising=False)
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog_queries.q_catalog_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    # all that is dealt out by an id or a fingerprint; families and the counts by category and grain are few rows
    tasks = [int(n) for keys, n in re.findall(r"hashpartitioning\((.*), (\d+)\)", plan) if re.search("partkey|model|variant|id#|told|print", keys) and not keys.startswith("family_id#") or "deal#" in keys]
    assert len(tasks) >= 6 and set(tasks) == {30}
    assert "Expand" not in plan and "BroadcastHashJoin" not in plan


def test_stale_bindings(table):
    names = catalog.BINDINGS
    df = table("a string, b string, c string, d string, e string, f string", [("1", "1", "1", "1", "1", "1"), (None, "1", "1", "1", "1", "2"), ("1", "1", "1", "1", None, None)])
    live = dict(zip(names, map(F.col, "abcde"), strict=True))
    stored = {n: F.lit("1") for n in names} | {"catalog_fingerprint": F.col("f")}
    assert [r[0] for r in df.select(catalog.stale_bindings(stored, live)).collect()] == [[], ["snapshot_observed_at", "catalog_fingerprint"], list(names)]


@pytest.mark.parametrize(
    ("how", "bound", "value", "said", "want"),
    [
        ("least", None, None, 1, ("match", "none")), ("least", 5, 5, None, ("match", "catalog")), ("least", 5, 4, 9, ("no_match", "catalog")), ("least", 5, 5, 4, ("no_match", "listing")), ("least", 5, None, 4, ("no_match", "listing")), ("least", 5, None, 9, ("unknown", "none")),
        ("most", 5, 5, None, ("match", "catalog")), ("most", 5, 6, None, ("no_match", "catalog")), ("equal", 5, 6, 5, ("no_match", "catalog")), ("equal", 5, 5, 5, ("match", "catalog")),
    ],
)
def test_product_clauses_by_tier(table, how, bound, value, said, want):
    df = table("b int, v int, s int", [(bound, value, said)])
    (r,) = df.select(clauses.product_clause("x", F.col("b"), how, F.col("v"), F.col("s")).alias("c")).collect()
    assert (r.c.outcome, r.c.tier) == want


def test_recordings_conflicts_and_missing_requirements(table):
    df = table("b array<string>, v string, s string", [(["smr_dm"], "smr_dm", "smr"), (["smr_dm"], "smr_dm", "cmr"), (["cmr"], None, "smr"), ([], "x", "y"), (None, None, None)])
    got = df.select(clauses.product_clause("x", F.col("b"), "recording", F.col("v"), F.col("s"), "unknown").alias("c")).collect()
    assert [(r.c.outcome, r.c.tier) for r in got] == [("match", "catalog"), ("unknown", "listing"), ("no_match", "listing"), ("match", "none"), ("match", "none")]
    need = "struct<sockets: array<string>, min_cores: int, max_tdp_w: int, require_vendor_unlocked: boolean>"
    df = table(f"need {need}, spec struct<socket: string, cores: int, tdp_w: int>, lock string, sure double", [(None, None, None, None), ((["sp3"], 8, None, True), ("sp3", 8, 100), "unlocked", 0.9), ((["sp3"], 8, 50, True), None, "unlocked", 0.5), ((None, None, None, False), ("sp3", 8, 100), None, None)])
    c = clauses.product_clauses("cpu", F.col("need"), F.col("spec"), {"socket": F.lit(None).cast("string"), "cores": F.lit(None).cast("int")}, (F.col("lock"), F.col("sure")))
    got = [[(x.clause.split(".")[1], x.outcome, x.tier) for x in r.c] for r in df.select(c.alias("c")).collect()]
    assert got[0] == [("requirement", "unknown", "none")]
    assert got[1] == [("sockets", "match", "catalog"), ("min_cores", "match", "catalog"), ("max_tdp_w", "match", "none"), ("vendor_lock", "match", "listing")]
    assert [x[1] for x in got[2]] == ["unknown"] * 4 and {x[1:] for x in got[3]} == {("match", "none")}
    assert df.select(F.size(clauses.product_clauses("nic", F.col("need"), F.col("spec"), {})).alias("n")).first().n == 0


def test_catalog_texts(table):
    df = table("t string", [("SATA 6Gb/s",), ("12G SAS/SATA",), ("IDE",), ("unknown",), ("",), (None,)])
    assert [r[0] for r in df.select(clauses.token_of(F.col("t"), clauses.DRIVE_INTERFACES)).collect()] == ["sata", "sas", None, None, None, None]
    assert [r[0] for r in df.select(clauses.known(F.col("t"))).collect()] == ["SATA 6Gb/s", "12G SAS/SATA", "IDE", None, None, None]


def test_canonical_is_pythons_json(table):
    schema = "b string, a struct<z: array<long>, y: boolean, x: map<string, string>, e: struct<n: int>>, d decimal(20,4), t timestamp_ntz, u timestamp, day date, w array<struct<q: string, p: decimal(9,0)>>"
    when = dt.datetime(2024, 2, 29, 13, 5, 7, 120)
    texts = ["plain", "", 'q"\\/', "\n\r\t\b\f\x00\x1f\x7f", "é ß 日本", "🙂𝄞", "a" * 300 + " ", None, " ~", "￿"]
    rows = [(x, ([1, None, -(2**62)], i % 2 == 0, {"ß" * (i % 3): x, "a": "1", "B": None}, (i,)), Decimal(i * 1000 - 2500) / 1000, when, when.replace(microsecond=0, tzinfo=dt.timezone.utc), when.date(), [(x, Decimal(100 * i)), None, ("y", None)]) for i, x in enumerate(texts)] + [(None,) * 7]
    df = table(schema, rows)

    def jsonable(x):
        if isinstance(x, Decimal):
            return format(x.normalize(), "f")
        if isinstance(x, dt.datetime | dt.date):
            return x.isoformat()
        if isinstance(x, dict):
            return {k: jsonable(v) for k, v in x.items()}
        return [jsonable(v) for v in x] if isinstance(x, list) else x

    struct = F.struct(*df.columns)
    got = [r[0] for r in df.select(canonical(struct, df.schema)).collect()]
    want = []
    for b, a, d, t, u, day, w in rows:
        record = {"b": b, "d": d, "t": t, "u": u, "day": day, "a": None if a is None else dict(zip(("z", "y", "x", "e"), (*a[:3], {"n": a[3][0]}), strict=True)), "w": None if w is None else [None if e is None else {"q": e[0], "p": e[1]} for e in w]}
        want.append(json.dumps(jsonable(record), sort_keys=True, separators=(",", ":"), allow_nan=False))
    assert got == want
    assert len(df.select(canonical_hash(struct, df.schema)).first()[0]) == 64
    with pytest.raises(TypeError):
        canonical(F.lit(1.0), T.DoubleType())
