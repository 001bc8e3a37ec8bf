"""Touching intervals of all lengths against all pairs, split units, and the ledger's lines."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tidemark.operators import ledger

T0 = dt.datetime(2024, 1, 1)


def intervals(rng, n, longest):
    out = []
    for i in range(n):
        a = T0 + dt.timedelta(seconds=rng.randrange(-longest, longest))
        out.append((i, None if rng.random() < 0.05 else a, None if rng.random() < 0.1 else a + dt.timedelta(seconds=rng.choice([0, 1, rng.randrange(100), rng.randrange(longest), -5]))))
    return out


def pairs(left, right, guard):
    g, end = dt.timedelta(seconds=guard), dt.datetime(9999, 1, 1)
    span = lambda a, b, w: None if a is None or (b is not None and b + w < a - w) else (a - w, end if b is None else b + w)
    out = []
    for i, a, b in left:
        for j, c, d in right:
            x, y = span(a, b, g), span(c, d, dt.timedelta())
            if x and y and x[0] <= y[1] and x[1] >= y[0]:
                out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize(("guard", "hot"), [(0, 10**9), (7, 10**9), (0, 3)])
def test_pairs_are_made_once_each(table, monkeypatch, guard, hot):
    monkeypatch.setattr(ledger, "HOT", hot)
    rng = random.Random(guard + hot)
    left, right = intervals(rng, 120, 100_000), intervals(rng, 60, 10_000) + intervals(rng, 30, 10**7)
    right = [(j, c, d) for j, (_, c, d) in enumerate(right)]
    got = ledger.touching(table("i int, a timestamp, b timestamp", left), table("j int, c timestamp, d timestamp", right), "a", "b", "c", "d", guard)
    assert sorted((r.i, r.j) for r in got.select("i", "j").collect()) == pairs(left, right, guard)


def test_nothing_and_clashes(table):
    rows = table("i int, a timestamp, b timestamp", [])
    assert ledger.touching(rows, rows.toDF("j", "c", "d"), "a", "b", "c", "d").collect() == []
    with pytest.raises(ValueError):
        ledger.touching(rows, rows, "a", "b", "a", "b")


def test_lines_on_cycles(table):
    day = lambda n: T0 + dt.timedelta(days=n)
    schema = "id int, kind string, status string, reserved_at timestamp, last_charge_at timestamp, reconciled_at timestamp, monitoring_last_at timestamp, monitoring_open boolean, estimate decimal(9,2), actual decimal(9,2), monitoring decimal(9,2)"
    d = Decimal
    rows = table(schema, [
        (1, "a", "open", day(5), None, None, None, None, d(3), None, d(1)),
        (2, "a", "reconciled", day(1), day(12), day(25), None, False, d(9), d(2), d(5)),
        (3, "a", "reconciled", day(11), day(11), day(12), day(15), True, d(9), None, None),
        (4, "b", "void", day(1), None, None, None, None, d(7), d(7), d(7)),
    ])
    cycles = table("cycle_start timestamp, cycle_end timestamp, note int", [(day(10 * k), day(10 * k + 10) - dt.timedelta(milliseconds=1), k) for k in range(4)])
    got = {((r.cycle_start - T0).days // 10, r.kind, r.line): (r.n, r.amount) for r in ledger.placed(rows, cycles, ["kind"], 3600).collect()}
    assert got == {
        **{(k, "a", "outstanding"): (1, d(4)) for k in range(4)},
        (0, "a", "settled"): (1, d(2)), (1, "a", "settled"): (2, d(2)),
        (1, "a", "monitoring"): (1, d(0)), (2, "a", "monitoring"): (2, d(5)), (3, "a", "monitoring"): (1, d(0)),
    }
