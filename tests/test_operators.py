"""Cases of the operators that the tables don't hold: ties, nulls, late rows, breaks."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys, money, mpn
from tidemark.operators import asof, eligibility, latest, lifecycle, presence, reports, resolve, runs, score

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_prices(table):
    df = table("i decimal(10,2), s decimal(10,2), t decimal(10,2), r decimal(12,6)", [(Decimal("10"), None, Decimal("1.5"), Decimal("2")), (Decimal("2.34"), None, None, None), (None, Decimal("1"), None, Decimal("1"))])
    got = df.select(money.landed_total(F.col("i"), F.col("s"), F.col("t")), money.usd_item(F.col("i"), F.col("r")), money.stated_usd(F.col("i"), F.col("s"), F.col("t"), F.col("r"))).collect()
    assert [tuple(x) for x in got] == [(Decimal("11.50"), Decimal("20.0000"), Decimal("23.00")), (Decimal("2.34"), None, None), (None, None, None)]


def test_rounding(table):
    df = table("a double, b double", [(1.0, 8.0), (1.0, 0.0), (5.0, 100000.0), (15.0, 100000.0)])
    assert [r[0] for r in df.select(money.share(F.col("a"), F.col("b"))).collect()] == [0.125, None, 0.0, 0.0002]
    one = table("x string", [("0.00001",)]).select(money.reserved_money(F.col("x").cast("decimal(20,10)")))
    assert one.first()[0] == Decimal("0.0001")


def test_alias_key_is_idempotent_and_folds(table):
    df = table("t string", [("ST16000-NM001G ①",), ("STRASSE ß",), (None,), ("",)])
    once = df.select(keys.alias_key(F.col("t")).alias("t"))
    twice = once.select(keys.alias_key(F.col("t")).alias("t"))
    assert [r.t for r in once.collect()] == ["st16000nm001g1", "strassess", None, ""] == [r.t for r in twice.collect()]


def test_record_fingerprint_ignores_field_order(table):
    df = table("a string, b int", [("x\"y", None), ("x", 1)])
    one = df.select(keys.record_fingerprint({"a": F.col("a"), "b": F.col("b")})).collect()
    two = df.select(keys.record_fingerprint({"b": F.col("b"), "a": F.col("a")})).collect()
    assert one == two and one[0] != one[1]


def test_decoding(table):
    df = table("t string", [("st16000nm001g",), ("st8000vn004",), ("wd60efrx",), (None,)])
    got = [r.d and (r.d.vendor, r.d.family, r.d.capacity_bytes, r.d.generation) for r in df.select(mpn.decode_seagate(F.col("t")).alias("d")).collect()]
    assert got == [("seagate", None, 16_000 * 10**9, "g"), ("seagate", "ironwolf", 8_000 * 10**9, None), None, None]


@pytest.mark.parametrize(
    ("catalog", "against", "want"),
    [(True, False, "match"), (True, True, "unknown"), (False, False, "no_match"), (False, True, "no_match"), (None, True, "no_match"), (None, False, "unknown"), (None, None, "unknown")],
)
def test_product_outcome(table, catalog, against, want):
    df = table("c boolean, a boolean", [(catalog, against)])
    assert df.select(eligibility.product_outcome(F.col("c"), F.col("a"))).first()[0] == want


@pytest.mark.parametrize(
    ("most", "price", "known", "quantity", "confidence", "want"),
    [
        (None, None, None, None, None, "match"),
        (10.0, None, True, None, None, "unknown"),
        (10.0, 10.0, True, None, None, "match"),
        (10.0, 10.0, False, None, None, "unknown"),
        (10.0, 10.5, False, None, None, "no_match"),
        (10.0, 20.0, True, 2, 0.9, "match"),
        (10.0, 20.0, True, 2, 0.5, "unknown"),
        (10.0, 9.0, True, 2, 0.5, "match"),
    ],
)
def test_price_outcome(table, most, price, known, quantity, confidence, want):
    df = table("m double, p double, k boolean, q int, c double", [(most, price, known, quantity, confidence)])
    assert df.select(eligibility.price_outcome(*map(F.col, "mpkqc"))).first()[0] == want


def test_verdict_without_clauses_is_an_error(table):
    df = table("x int", [(1,)]).select(F.array().cast("array<struct<clause: string, outcome: string>>").alias("c"))
    with pytest.raises(Exception, match="a verdict needs a clause"):
        df.select(eligibility.verdict(F.col("c"))).collect()


def test_agreement_takes_null_as_a_value(table):
    df = table("k int, a string, b string, s boolean", [(1, "x", "y", True), (1, "x", None, True), (2, "x", "y", True), (2, "x", "y", False), (3, None, "z", True)])
    got = {r.k: (r.a, r.b, r.n_members) for r in eligibility.agreement(df, "k", ["a", "b"], F.col("s")).collect()}
    assert got == {1: ("x", None, 2), 2: (None, None, 2), 3: (None, "z", 1)}


def test_asof_takes_equal_times_and_respects_tolerance(table):
    left = table("id int, k string, t timestamp", [(1, "a", at(5)), (2, "a", at(4)), (3, "a", at(29)), (4, "b", at(5)), (5, None, at(5)), (6, "a", at(29.5))])
    right = table("k string, rt timestamp, v int", [("a", at(5), 50), ("a", at(5), 51), ("a", at(3), 30), ("c", at(1), 1), ("a", None, 9)])
    got = {r.id: r.v for r in asof.asof_backward(left, right, "k", "t", "rt", 86_400, ["rt", "v"]).collect()}
    assert got == {1: 51, 2: 30, 3: 51, 4: None, 5: None, 6: None}


def test_rates(table):
    rates = table("base string, rate_date date, rate decimal(12,6), source string", [("EUR", dt.date(2024, 1, 1), Decimal("1.1"), "s"), ("EUR", dt.date(2024, 1, 5), Decimal("1.2"), "s")])
    rows = table("id int, c string, d date", [(1, "EUR", dt.date(2024, 1, 4)), (2, "EUR", dt.date(2024, 1, 12)), (3, "EUR", dt.date(2024, 1, 13)), (4, "USD", dt.date(2024, 1, 1)), (5, None, dt.date(2024, 1, 1)), (6, "EUR", dt.date(2023, 12, 31))])
    got = {r.id: r.fx_rate and float(r.fx_rate) for r in asof.stamp_rates(rows, rates, "c", "d").collect()}
    assert got == {1: 1.1, 2: 1.2, 3: None, 4: 1.0, 5: None, 6: None}


def test_overlaps_are_made_once(table):
    rng = random.Random(3)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(300))
    spans = lambda: [(i, *sorted((day(), day()))) for i in range(30)]
    a, b = spans(), spans()
    got = asof.overlapping(table("i int, s date, e date", a), table("j int, s2 date, e2 date", b), "s", "e", "s2", "e2").select("i", "j").collect()
    want = sorted((i, j) for i, s, e in a for j, s2, e2 in b if s <= e2 and e >= s2)
    assert sorted(map(tuple, got)) == want


def test_state_does_not_depend_on_arrival(table):
    rows = [(k, i, at(h)) for k in range(3) for i, h in enumerate(random.Random(k).sample(range(50), 12))]
    got = latest.in_arrival_order(table("k int, n int, t timestamp", rows), "k", "n", "t")
    newest = {r.k: r.m for r in got.groupBy("k").agg(F.max_by("state_at", "n").alias("m")).collect()}
    assert newest == {k: max(t for kk, _, t in rows if kk == k) for k in range(3)}


def test_upsert_keeps_known_values(table):
    old = table("k int, t int, a string, scope string", [(1, 1, "x", "s1"), (2, 5, "y", "s2")])
    new = table("k int, t int, a string, scope string", [(1, 2, "z", None), (2, 4, "late", "s3"), (3, 1, "n", None)])
    got = {r.k: (r.t, r.a, r.scope) for r in latest.upsert(old, new, ["k"], "t", ["scope"]).collect()}
    assert got == {1: (2, "z", "s1"), 2: (5, "y", "s2"), 3: (1, "n", None)}


def test_streaks_and_sessions(table):
    log = table("k int, t timestamp, n int, s string", [(1, at(0), 0, "bad"), (1, at(1), 1, "run"), (1, at(2), 2, "bad"), (1, at(3), 3, "ok"), (1, at(4), 4, "bad")])
    got = [(r.failures, r.first_failed, r.recovered, r.recovery_s) for r in runs.failure_streaks(log, "k", "t", "n", F.col("s") == "bad", F.col("s") == "ok").orderBy("first_failed").collect()]
    assert got == [(2, at(0), at(3), 10_800.0), (1, at(4), None, None)]
    found = runs.sessions(log, ["k"], "t", "n", F.lit(3600), F.col("s") == "ok").orderBy("session_start").collect()
    assert [(r.session_start, r.session_end, r.n_runs) for r in found] == [(at(0), at(2), 3), (at(4), at(4), 1)]


def fold(events):
    """The life of a source, step by step."""
    state, rot, out = "active", 0, []
    for e in events:
        if e == "manual_skip":
            state = "skip"
        elif state == "skip":
            state = "active" if e == "manual_reactivate" else state
        elif e == "manual_reactivate" or (state == "paused_pending_fix" and e == "probe_success"):
            state = "active"
        elif state == "paused_pending_fix":
            pass
        elif e in ("success", "probe_success"):
            state = "active"
        elif e in ("anti_bot", "unknown_failure") or (e == "parser_rot" and rot):
            state = "paused_pending_fix"
        elif e in ("transient_failure", "parser_rot"):
            state = "backing_off"
        # neither a hand nor a probe that fails ends a row of parser failures
        rot = e == "parser_rot" if e in ("success", "probe_success", "transient_failure", "anti_bot", "parser_rot", "unknown_failure") else rot
        out.append(state)
    return out


def test_lifecycle_is_the_fold(table):
    rng = random.Random(5)
    logs = {k: [rng.choice(lifecycle.EVENTS) for _ in range(60)] for k in range(8)}
    df = table("k int, n int, e string", [(k, i, e) for k, es in logs.items() for i, e in enumerate(es)])
    got = {(r.k, r.n): r.state for r in lifecycle.lifecycle(df, "k", "e", ["n"]).collect()}
    assert got == {(k, i): s for k, es in logs.items() for i, s in enumerate(fold(es))}


def test_delist(table):
    rows = table("site int, key string, scope string, last_seen timestamp, delisted_at timestamp, delist_reason string", [(1, "seen", "s", at(1), None, None), (1, "gone", "s", at(1), None, None), (1, "newer", "s", at(9), None, None), (1, "other", "x", at(1), None, None), (1, "whole", None, at(1), None, None), (1, "fresh", None, at(5), None, None), (1, "never", None, None, None, None), (1, "lost", "s", None, None, None), (1, "old", "s", at(0), at(0), "before"), (1, "short", "t", at(1), None, None), (1, "shut", "u", at(1), None, None)])
    hour = 3600
    swept = table("site int, scope string, swept_at timestamp, complete boolean, stale_allowed boolean, continuous_since timestamp, grace_s long", [(1, "s", at(5), True, False, None, None), (1, None, at(6), False, True, at(2), 4 * hour), (1, "t", at(6), False, True, at(3), 4 * hour), (1, "u", at(6), False, False, at(0), 4 * hour)])
    got = {r.key: r.delist_reason for r in presence.delist(rows, swept, table("site int, key string", [(1, "seen")])).collect()}
    assert got == {"seen": None, "gone": "absent_from_complete_sweep", "newer": None, "other": None, "whole": "stale", "fresh": None, "never": None, "lost": "absent_from_complete_sweep", "old": "before", "short": None, "shut": None}


def test_resolution_ladder(table):
    c = "array<struct<norm: string, kind: string>>"
    said = [(1, 7, [("a1", "manufacturer_mpn")], "x", 1, ["a1"]), (2, 7, [("a1", "manufacturer_mpn")], "z", 1, ["a1"]), (3, 7, [("o1", "oem")], None, 1, None), (4, 8, [("s1", "house_sku")], None, 1, None), (5, 7, [("a1", "manufacturer_mpn")], "x", 3, ["a1", "b2"]), (6, 7, [], "seagate", 1, None), (7, 7, [("o1", "manufacturer_mpn")], None, 1, ["o1"]), (8, 7, [("a1", "manufacturer_mpn")], None, 1, ["a1"]), (9, 7, [("a1", "structured")], None, 1, None)]
    lst = table(f"listing_id int, site int, candidates {c}, brand string, quantity int, mpns array<string>", said)
    aliases = table("norm string, alias_type string, site int, model_id int, family_id int, brand string, source_kind string", [("a1", "mpn", None, 10, 1, "x", "catalog_authoritative"), ("o1", "oem_pn", None, 11, 2, "x", "manual"), ("o1", "oem_pn", None, 12, 2, "x", "manual"), ("s1", "house_sku", 7, 13, 3, "x", "manual")])
    decoded = table("listing_id int, vendor string, family string", [(6, "seagate", "ironwolf"), (2, "x", "f")])
    out = resolve.decide(lst, resolve.alias_hits(lst, aliases), decoded)
    got = {r.listing_id: (r.outcome, r.rung, r.grain, r.target, r.confidence, r.reason) for r in out.collect()}
    assert got == {
        1: ("accept", 1, "model", "10", 0.98, "exact_alias"),
        2: ("review", 1, "none", None, 0.0, "brand_contradicts_exact_alias"),
        3: ("accept", 1, "family", "2", 0.8, "oem_fan_out"),
        4: ("none", None, "none", None, 0.0, "no_evidence"),
        5: ("review", 1, "none", None, 0.0, "lot,multiple_mpns"),
        6: ("accept", 2, "family", "seagate/ironwolf", 0.75, "mpn_decode"),
        7: ("none", None, "none", None, 0.0, "no_evidence"),
        8: ("review", 1, "none", None, 0.0, "no_brand_evidence"),
        9: ("accept", 1, "model", "10", 0.98, "exact_alias"),
    }
    assert resolve.changed_edges(out, out).count() == 0
    assert resolve.changed_edges(out, out.where("listing_id > 1")).count() == 1


TB = 10**12


def _ladders(table, cases):
    """(outcome, rung, grain, target, confidence, reason) of each case; a case says only what differs from nothing known."""
    spec = "struct<capacity: bigint, interface: string, form_factor: string, sector_format: string, security: string, family: struct<brand: string, name: string>>"
    full = lambda d: {"capacity": None, "interface": None, "form_factor": None, "sector_format": None, "security": None, "family": None} | d
    names = ("norm", "alias_type", "source_kind", "grain", "family_id", "model_id", "variant_id", "brand", "vendor", "structured", "review_only", "spec")
    hit = {"norm": "st1", "alias_type": "mpn", "source_kind": "catalog_authoritative", "grain": "model", "family_id": "f1", "model_id": "m1", "variant_id": None, "brand": "seagate", "vendor": None, "structured": None, "review_only": None, "spec": {}}
    said, hits, decoded, priors = [], [], [], []
    for i, case in enumerate(cases):
        base = {"brand": None, "quantity": None, "mpns": None, "one_mpn": None, "spec": {}, "mentions": None} | case.get("listing", {})
        base["spec"] = full(base["spec"])
        said.append((i, *[base[k] for k in ("brand", "quantity", "mpns", "one_mpn", "spec", "mentions")]))
        for h in case.get("hits", ()):
            h = hit | h
            hits.append((i, *[full(h[k]) if k == "spec" else h[k] for k in names]))
        decoded += [(i, *d) for d in case.get("decoded", ())]
        if "prior" in case:
            priors.append((i, "model", "m1", "m1", 0.9, full(case["prior"])))
    lst = table(f"listing_id int, brand string, quantity int, mpns array<string>, one_mpn boolean, spec {spec}, mentions array<struct<brand: string, name: string>>", said)
    hs = table(f"listing_id int, norm string, alias_type string, source_kind string, grain string, family_id string, model_id string, variant_id string, brand string, vendor string, structured boolean, review_only boolean, spec {spec}", hits)
    ds = table("listing_id int, vendor string, family string, capacity bigint, provenance string", decoded)
    ps = table(f"listing_id int, grain string, target string, model_id string, confidence double, spec {spec}", priors)
    got = {r.listing_id: (r.outcome, r.rung, r.grain, r.target, r.confidence, r.reason) for r in resolve.decide(lst, hs, ds, ps).collect()}
    return [got[i] for i in range(len(cases))]


def test_ladder_by_cases(table):
    sea, four = {"brand": "seagate"}, {"brand": "seagate", "spec": {"capacity": 4 * TB}}
    toshiba = {"norm": "st2", "model_id": "m2", "family_id": "f2", "brand": "toshiba"}
    pro, wolf = {"brand": "seagate", "name": "ironwolf pro"}, {"brand": "seagate", "name": "ironwolf"}
    fan = [{"alias_type": "oem_pn", "model_id": m, "spec": {"capacity": c * TB}} for m, c in (("m1", 4), ("m2", 8))]
    grammar = ("seagate", "ironwolf", 4 * TB, "vendor_official")
    # a number that may only cast doubt: it grounds nothing, but its model's capacity counts
    doubt = {"norm": "0f1", "model_id": "m9", "review_only": True, "spec": {"capacity": 24 * TB}}
    two = sea | {"mpns": ["st1", "st2"]}
    review = lambda rung, why: ("review", rung, "none", None, 0.0, why)
    exact = lambda trust=0.98: ("accept", 1, "model", "m1", trust, "exact_alias")
    cases = [
        # a hit of a contrary brand goes before targets are compared, but the models its number names still count
        ({"listing": sea, "hits": [{}, toshiba | {"norm": "st1"}]}, exact()),
        ({"listing": sea, "hits": [{}, toshiba]}, review(1, "conflicting_alias_models")),
        ({"hits": [{"vendor": "seagate"}, toshiba | {"brand": "seagate"}]}, review(1, "conflicting_targets")),
        ({"listing": {"brand": "hgst"}, "hits": [{"brand": "western_digital"}]}, exact()),
        ({"listing": {"brand": "hgst"}, "hits": [{}]}, review(1, "brand_contradicts_exact_alias")),
        ({"listing": sea | {"spec": {"capacity": 14 * TB}}, "hits": [{"spec": {"capacity": 16 * TB}}]}, review(1, "veto")),
        ({"listing": sea | {"spec": {"capacity": 16 * TB}}, "hits": [{"spec": {"capacity": 16 * TB + 10**11}}]}, exact()),
        ({"listing": sea | {"spec": {"interface": "sas"}}, "hits": [{"spec": {"interface": "sata"}}]}, review(1, "veto")),
        ({"listing": sea | {"spec": {"security": "sed"}}, "hits": [{}]}, exact()),
        ({"listing": sea | {"mentions": [wolf]}, "hits": [{"spec": {"family": pro}}]}, exact()),  # a title may say less
        ({"listing": sea | {"mentions": [pro]}, "hits": [{"spec": {"family": wolf}}]}, review(1, "veto")),
        ({"listing": sea | {"mentions": [{"brand": "toshiba", "name": "n300"}]}, "hits": [{"spec": {"family": pro}}]}, exact()),
        ({"hits": [{}]}, review(1, "no_brand_evidence")),
        ({"hits": [{"vendor": "seagate"}]}, exact()),
        ({"hits": [{"vendor": "toshiba"}]}, review(1, "no_brand_evidence")),
        ({"hits": [{"structured": True}]}, exact()),
        ({"listing": sea, "hits": [{"source_kind": "manual"}]}, exact(0.95)),
        ({"listing": sea, "hits": [{"source_kind": "listing_derived"}]}, exact(0.85)),
        ({"listing": sea, "hits": [{"source_kind": "else"}]}, exact(0.5)),
        ({"listing": four, "hits": fan}, ("accept", 1, "family", "f1", 0.8, "oem_fan_out")),
        ({"listing": sea | {"spec": {"capacity": 2 * TB}}, "hits": fan}, review(1, "conflicting_targets")),  # none is left
        ({"listing": four, "hits": [fan[0], fan[1] | {"family_id": None}]}, review(1, "conflicting_targets")),
        ({"listing": four, "decoded": [grammar]}, ("accept", 2, "family", "seagate/ironwolf", 0.92, "mpn_decode")),
        ({"listing": {"brand": "toshiba"}, "decoded": [grammar]}, review(2, "brand_contradicts_decode")),
        ({"listing": sea | {"mentions": [pro]}, "decoded": [grammar]}, review(2, "family_contradicts_decode")),
        ({"listing": sea | {"spec": {"capacity": TB}}, "decoded": [grammar]}, review(2, "veto")),
        ({"listing": sea, "decoded": [("seagate", None, TB, "inferred")]}, ("none", None, "none", None, 0.0, "no_evidence")),
        ({"listing": four, "hits": [doubt], "decoded": [grammar]}, review(2, "review_only_alias_conflict")),
        ({"listing": four, "hits": [doubt | {"spec": {"capacity": 4 * TB}}], "decoded": [grammar]}, ("accept", 2, "family", "seagate/ironwolf", 0.92, "mpn_decode")),
        ({"listing": sea, "prior": {}}, ("accept", 0, "model", "m1", 0.9, "prior")),
        ({"listing": sea | {"spec": {"capacity": TB}}, "hits": [{}], "prior": {"capacity": 2 * TB}}, review(0, "veto")),
        ({"listing": sea, "hits": [{"model_id": "m2"}], "prior": {}}, review(0, "prior_model_not_named")),
        ({"listing": sea, "hits": [{"model_id": "m2"}, {}], "prior": {}}, ("accept", 0, "model", "m1", 0.9, "prior")),
        ({"listing": sea | {"quantity": 2}, "prior": {}}, review(0, "lot")),
        ({"listing": two, "hits": [{}]}, review(1, "multiple_mpns")),
        ({"listing": two | {"one_mpn": False}, "hits": [{}]}, exact()),
        ({"listing": two, "hits": [{}, {"norm": "st2"}]}, exact()),  # two spellings of one model
    ]
    got = _ladders(table, [c for c, _ in cases])
    assert [(i, g) for i, g in enumerate(got)] == [(i, w) for i, (_, w) in enumerate(cases)]


def test_cohort_rank_counts_ties_half(table):
    df = table("c string, v double, w double", [("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 1.0)])
    got = sorted((r.v, r.q, r.n_eff) for r in score.cohort_rank(df, "c", "v", F.col("w")).collect())
    assert got == [(1.0, 0.125, 4.0), (2.0, 0.5, 4.0), (2.0, 0.5, 4.0), (3.0, 0.875, 4.0)]


def test_score_rounds_half_up_and_caps(table):
    df = table("p double, f double, s double, k double", [(1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0)])
    cols = [F.col(c) for c in "pfsk"]
    assert [r[0] for r in df.select(score.total_score(*cols, F.lit(False), F.lit(False))).collect()] == [100, 2]
    assert [r[0] for r in df.select(score.total_score(*cols, F.lit(True), F.lit(False))).collect()] == [35, 2]


def test_recorded_sums_stay_null(table):
    df = table("k int, f long, v long", [(1, None, None), (1, None, 3), (2, 5, 7)])
    got = {r.k: (r.fetched, r.valid, r.dropped, r.completeness) for r in reports.run_stats(df, ["k"], F.lit(True), F.lit(False), F.lit(True), "f", "v").collect()}
    assert got == {1: (None, 3, None, None), 2: (5, 7, None, None)}


def test_counted_alias_hits_are_those_of_single_hits(table):
    import random

    pick = random.Random(5)
    kinds, types = ["manufacturer_mpn", "oem", "house_sku", "structured"], ["mpn", "oem_pn", "house_sku"]
    aliases = table("norm string, alias_type string, site long, model_id long, family_id string, brand string", [(pick.choice("abc"), pick.choice(types), pick.choice([None, 1, 2]), pick.choice([None, *range(40)]), "f", "b") for _ in range(300)])
    asked = [(i, pick.choice([None, 1, 2, 3]), [(pick.choice("abcd"), pick.choice(kinds)) for _ in range(pick.randrange(4))]) for i in range(80)]
    listings = table("listing_id long, site long, candidates array<struct<norm: string, kind: string>>", asked)
    hits = resolve.alias_hits(listings, aliases)
    want = hits.groupBy("listing_id").agg(F.count(F.lit(1)), F.count_distinct("model_id"), F.sum("model_id"), F.count_if(F.col("alias_type") == "oem_pn")).collect()
    got = resolve.alias_counts(listings, aliases, "oem_pn").collect()
    assert len(want) > 30 and sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


def test_offers_of_one_id_are_told_by_their_own_cohorts(table):
    from tidemark.operators import cohorts

    rows = [(1, "4.000", "nas", "sata-3.5", "new")] * 2 + [(1, "8.000", "nas", "sata-3.5", "used"), (2, "8.000", None, "sata-3.5", None)]
    offers = table("offer_id int, bucket string, tier string, ifff string, condition string", rows)
    baseline = offers.limit(1).select("bucket", "tier", "ifff", "condition", F.explode(F.array_repeat(F.lit(1.0), 40)).alias("w"))
    got = sorted((r.offer_id, r.bucket, r.step, r.n_eff, r.exhausted) for r in cohorts.relaxed(offers, baseline, ["4.000", "8.000"], {}, "w").collect())
    assert got == [(1, "4.000", "none", 40.0, False)] * 2 + [(1, "8.000", "capacity", 40.0, False), (2, "8.000", "tier", 0.0, True)]
