"""Absence by scope against a replay, run by run."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import absence, runs

T0 = dt.datetime(2024, 1, 1)
SIGHT = "site int, key string, run long, at timestamp, scope string"
REPORT = "site int, run long, at timestamp, scope string, complete boolean, gated boolean, eligible boolean, stale_allowed boolean, grace_s long"


def replay(sightings, reports, tolerance):
    """Listings and lanes as they change with each run; yields the episodes."""
    runs = sorted({(s, at, run) for s, _, run, at, _ in sightings} | {(r[0], r[2], r[1]) for r in reports})
    listings, lanes, out = {}, {}, []
    for site, at, run in runs:
        mine = [r for r in reports if r[0] == site and r[1] == run and r[2] == at]
        seen = {}
        for s, key, n, when, scope in sightings:
            if (s, n, when) == (site, run, at):
                seen[key] = max(filter(None, (seen.get(key), scope)), default=None)
        for key, scope in seen.items():
            x = listings.setdefault((site, key), {"scope": None, "open": None, "n": 0})
            x["scope"] = scope or x["scope"]
            if x["open"] is None:
                x["n"] += 1
                x["open"] = [site, key, x["n"], at, at, 0, None, None]
            x["open"][4], x["open"][5] = at, x["open"][5] + 1
        if mine and not any(r[3] is None for r in mine):
            mine = [*mine, (site, run, at, None, False, False, False, False, 0)]
        for _, _, _, scope, complete, gated, eligible, stale_allowed, grace in sorted(mine, key=lambda r: (r[3] is not None, r[3] or "")):
            lane = lanes.setdefault((site, scope), {"since": None, "newest": None, "broken": None})
            if not eligible:
                lane.update(since=None, newest=None, broken=at)
            elif lane["broken"] != at:  # a sweep of the time of a break proves nothing
                if lane["newest"] is None or (at - lane["newest"]).total_seconds() > tolerance:
                    lane["since"] = at
                lane["newest"] = at
            if not gated:
                continue
            for (s, key), x in listings.items():
                if s != site or x["scope"] != scope or x["open"] is None or key in seen:
                    continue
                gap = dt.timedelta(seconds=grace)
                if complete:
                    why = absence.ABSENT
                elif stale_allowed and lane["since"] is not None and at - lane["since"] >= gap and x["open"][4] < at - gap:
                    why = absence.STALE
                else:
                    continue
                out.append((*x["open"][:6], at, why))
                x["open"] = None
    return sorted([*out, *(tuple(x["open"]) for x in listings.values() if x["open"])], key=repr)


def made(table, sightings, reports, tolerance, unit):
    told = absence.continuous(table(REPORT, reports), F.lit(tolerance))
    df = absence.episodes(absence.absences(table(SIGHT, sightings), told, unit))
    return sorted((tuple(r) for r in df.select("site", "key", "episode", "first_seen", "last_seen", "sightings", "delisted_at", "reason").collect()), key=repr)


def test_episodes_are_those_of_a_replay(table):
    rng = random.Random(6)
    for unit in (3_600, 50_000, 10**7):
        sightings, reports = [], []
        for site in (1, 2):
            hour = 0
            for run in range(40):
                hour += rng.choice([0, 1, 1, 2, 9])
                at = T0 + dt.timedelta(hours=hour)
                scopes = rng.sample(["a", "b", None], rng.randrange(1, 4))
                for scope in scopes:
                    gated = rng.random() < 0.8
                    reports.append((site, run, at, scope, rng.random() < 0.25, gated, rng.random() < 0.85, rng.random() < 0.8, rng.choice([3_600, 3_600, 18_000])))
                for key in range(12):
                    if rng.random() < 0.2:
                        sightings += [(site, f"k{key}", run, at, rng.choice([*scopes, None]))] * rng.choice([1, 1, 2])
        got = made(table, sightings, reports, 8 * 3_600, unit)
        assert got == replay(sightings, reports, 8 * 3_600)
        assert {r[7] for r in got} == {None, absence.ABSENT, absence.STALE} and max(r[2] for r in got) > 2


def test_a_scoped_run_breaks_the_null_scope(table):
    at = lambda h: T0 + dt.timedelta(hours=h)
    reports = [(1, n, at(n), s, False, True, True, True, 7_200) for n, s in ((0, None), (1, None), (2, "a"), (3, None), (4, None), (5, None))]
    got = {r.run: r.continuous_since for r in absence.continuous(table(REPORT, reports), F.lit(36_000)).collect()}
    assert got == {0: at(0), 1: at(0), 2: at(2), 3: at(3), 4: at(3), 5: at(3)}


def test_nothing_seen_or_swept(table):
    assert made(table, [], [(1, 1, T0, None, True, True, True, True, 1)], 1, 60) == []
    assert made(table, [(1, "k", 1, T0, None)], [], 1, 60) == [(1, "k", 1, T0, T0, 1, None, None)]


def test_evidence_expires_when_its_listing_is_gone(table):
    at = lambda h: T0 + dt.timedelta(hours=h)
    told = table("site int, key string, absent_at timestamp", [(1, "a", at(5)), (1, "a", at(9)), (1, "a", None), (1, "b", at(1)), (2, "a", at(2))])
    rows = [(1, "a", at(3), at(50), True), (1, "a", at(5), at(50), True), (1, "a", at(6), at(50), True), (1, "a", at(10), at(50), True), (1, "a", at(0), at(4), True), (1, "a", at(3), at(50), False), (1, "b", at(3), None, True), (1, "a", at(3), None, True), (3, "z", at(3), at(4), None)]
    df = table("site int, key string, observed_at timestamp, expires_at timestamp, bounded boolean, n int", [(*r, n) for n, r in enumerate(rows)])
    got = {r.n: r.expires_at for r in absence.pulled_forward(df, told, F.col("bounded"), 3_600).collect()}
    assert got == {0: at(5), 1: at(5), 2: at(9), 3: at(50), 4: at(4), 5: at(50), 6: None, 7: at(5), 8: at(4)}


def test_no_frame_is_gone_through_anew_for_each_row(spark, table):
    """A unit of one scope may hold most of all sightings."""
    n = 40_000
    rows = spark.range(n).select(F.lit(1).alias("site"), F.lit("a").alias("scope"), F.struct(F.col("id").alias("x"), F.lit(0).cast("long").alias("n")).alias("pos"))
    sweeps = rows.where("pos.x % 1000 = 0").withColumn("said", F.struct(F.col("pos.x").alias("at")))
    out = absence.next_sweep(rows, sweeps, ["site", "scope"], n)
    assert out.where("coalesce(next.said.at, -1) <> if(pos.x >= 39000, -1, (pos.x div 1000 + 1) * 1000)").count() == 0
    ends = table("k int, at timestamp, tie int", [])
    streaks = runs.failure_streaks(ends, "k", "at", "tie", F.lit(True), F.lit(False))
    for df in (out, streaks):
        assert "1, unboundedfollowing" not in df._jdf.queryExecution().analyzed().toString().replace("$()", "")
