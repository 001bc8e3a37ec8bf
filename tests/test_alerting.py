"""The alert fold against a plain loop, its stream against the fold, expiry by timers, two buckets at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts
from tidemark.operators.alerts import Policy
from tidemark.streaming import alerting

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, n long, at timestamp, price double, enters boolean, leaves boolean"
POLICY = Policy(polls=2, cooldown_s=7_200, gain=5.0, gain_share=0.1, ttl_s=36_000)


def some_rows(rng, keys=4, rows=160):
    out, minute = [], 0
    for n in range(rows):
        minute += rng.choice([1, 10, 40, 90])
        out.append((f"k{rng.randrange(keys)}", n, T0 + dt.timedelta(minutes=minute), rng.choice([None, 50.0, 80.0, 90.0, 100.0]), rng.random() < 0.7, rng.random() < 0.4))
    return out


def looped(rows, policy):
    """Row by row, as it is said in words."""
    until, out = max((r[2] for r in rows), default=T0), []
    cool, ttl = dt.timedelta(seconds=policy.cooldown_s), dt.timedelta(seconds=policy.ttl_s)
    for key in sorted({r[0] for r in rows}):
        on, run, alert, queue, last = False, 0, None, [], None
        for _, n, at, price, enters, leaves in [*sorted(r for r in rows if r[0] == key), (key, None, until, None, None, None)]:
            if alert and at >= alert[0] + cool:
                if queue:
                    out.append((key, None, alert[0] + cool, "digest", min((p for p in queue if p is not None), default=None), len(queue)))
                alert, queue = None, []
            if n is None:
                break
            if last is not None and at - last > ttl:
                on, run = False, 0
            on, last = enters or (on and not leaves), at
            run = run + 1 if on else 0
            if not on:
                event = "cooling" if alert else "none"
            elif run < policy.polls:
                event = "pending"
            elif not alert or (None not in (price, alert[1]) and price <= alert[1] - max(policy.gain, alert[1] * policy.gain_share)):
                event, alert = "firing", (at, price)
            else:
                event = "digested"
                queue.append(price)
            out.append((key, n, at, event, price, None))
    return sorted(out, key=repr)


def made(df):
    return sorted(((r.key, r.n, r.at, r.event, r.price, r.waiting) for r in df.collect()), key=repr)


def test_fold_is_the_loop(table):
    for seed in range(4):
        rows = some_rows(random.Random(seed))
        assert made(alerts.alert_log(table(SCHEMA, rows + rows[:20]), POLICY)) == looped(rows, POLICY)
    assert {e for *_, e, _, _ in looped(rows, POLICY)} == {"none", "pending", "firing", "cooling", "digested", "digest"}
    assert alerts.alert_log(table(SCHEMA, []), POLICY).collect() == []
    with pytest.raises(ValueError):
        Policy(cooldown_s=10, ttl_s=5)


def run_stream(spark, out, path, schema, files, tmp_path):
    session = alerting.stateful_session(spark)
    (tmp_path / "in").mkdir()
    rows = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = out(rows).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / path) + "-check").trigger(availableNow=True)
    for file in files:
        file.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.start(str(tmp_path / path)).awaitTermination()
    return spark.read.parquet(str(tmp_path / path))


def test_replayed_stream_is_the_fold(spark, table, tmp_path):
    rows = some_rows(random.Random(7), keys=3, rows=90)
    files = [table(SCHEMA, rows[a:b][::-1]) for a, b in ((0, 30), (20, 60), (60, 90), (0, 90))]  # parts come twice
    got = run_stream(spark, lambda r: alerting.alert_stream(r, POLICY), "alerts", SCHEMA, files, tmp_path)
    assert made(got) == looped(rows, POLICY)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != alerting._PROVIDER


def test_digests_and_forgetting_come_by_timer(spark, table, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    first = [("a", n, at(n), 100.0, True, False) for n in range(4)]
    other = [("b", 100, at(400), 1.0, False, False)]
    late = [("b", 101, at(2_000), 1.0, False, False)]
    # "a" alone has rows before the watermark passes: its digest comes by timer, and later its state goes by timer
    again = [("a", 9, at(2_001), 100.0, False, False), ("a", 10, at(2_002), 100.0, True, False)]
    files = [table(SCHEMA, f) for f in (first, other, late, again)]
    got = run_stream(spark, lambda r: alerting.alert_stream(r, POLICY), "alerts", SCHEMA, files, tmp_path)
    assert made(got) == looped([*first, *other, *late, *again], POLICY)
    assert [r.event for r in got.where("key = 'a' and n >= 9").orderBy("n").collect()] == ["none", "pending"]


def test_two_buckets_take_both_or_neither(spark, table, tmp_path):
    rng, minute, rows = random.Random(5), 0, []
    for n in range(150):
        minute += rng.choice([0, 1, 2, 7])
        source = rng.choice(["s1", "s2", "s3", "free"])
        rows.append((rng.choice(["x", "y"]), source, n, T0 + dt.timedelta(minutes=minute), None if source == "free" else 2.0, 1 / 600))
    want, domains, sources = {}, {}, {}
    for domain, source, n, at, burst, rate in rows:
        if burst is None:
            want[n] = False
            continue
        now = at.timestamp()
        for buckets, key, full, refill in ((domains, domain, 4.0, 1 / 300), (sources, (domain, source), burst, rate)):
            tokens, then = buckets.get(key, (full, now))
            buckets[key] = (min(full, tokens + (now - then) * refill), now)
        want[n] = domains[domain][0] >= 1 and sources[domain, source][0] >= 1
        for buckets, key in ((domains, domain), (sources, (domain, source))):
            buckets[key] = (buckets[key][0] - want[n], buckets[key][1])
    schema = "domain string, source string, n long, at timestamp, burst double, per_second double"
    files = [table(schema, rows[a:b]).orderBy(F.desc("n")) for a, b in ((0, 70), (70, 150))]
    got = run_stream(spark, lambda r: alerting.admission_stream(r, 4.0, 1 / 300), "granted", schema, files, tmp_path)
    assert {r.n: r.granted for r in got.collect()} == want and 20 < sum(want.values()) < 130
