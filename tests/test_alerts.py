"""Enrichment and admission against brute force, with hot keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import admission, enrich
from logloom.plans import blocks


def replay_admission(rows, window):
    last, out = {}, {}
    for k, t, i in sorted(rows):
        if k in last and t - last[k][0] <= window:
            out[i] = (False, last[k][1])
        else:
            last[k] = (t, i)
            out[i] = (True, None)
    return out


@pytest.mark.parametrize(
    ("seed", "span", "window", "slots", "times"),
    [(0, 4000, 7, 2, 10**6), (1, 400, 5, 1, 10**6), (2, 4000, 3, 5, 20), (3, 400, 50, 256, 10**6), (4, 4000, 9, 256, 7), (5, 40_000, 5, 3, 10**6)],
)
def test_admission(spark, seed, span, window, slots, times):
    """Two thirds of the requests share one key; some keys are NULL."""
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot", "hot", "hot", "hot", "a", ""]), rnd.randrange(span), i) for i in range(1500)]
    df = spark.createDataFrame([(i, "m", k or None, t) for k, t, i in rows], "id int, trigger string, query string, s long")
    df = df.withColumn("create_time", F.timestamp_seconds("s"))
    got = admission.admit_requests(df, window, slots_per_chunk=slots, times_per_chunk=times).collect()
    assert {r.id: (r.admitted, r.blocked_by) for r in got} == replay_admission(rows, window)
    assert len(got) == len(rows)


def test_admission_boundary(spark):
    """A request exactly one window later collides, a microsecond later it does not."""
    rows = [(1, "m", "q", 0), (2, "m", "q", 300_000_000), (3, "m", "q", 300_000_001), (4, "m", "q", 300_000_001)]
    df = spark.createDataFrame(rows, "id int, trigger string, query string, us long").withColumn("create_time", F.timestamp_micros("us"))
    got = {r.id: (r.admitted, r.blocked_by) for r in admission.admit_requests(df).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (False, 3)}


@pytest.mark.parametrize(("window", "k", "slices"), [(100, 5, 900), (100, 20, 7), (30, 20, 900)])
def test_recent_logs(spark, window, k, slices):
    rnd = random.Random(window + k)
    logs = [(i, rnd.choice(["s1", "s1", "s2"]), rnd.randrange(5000), "e", f"b{i}") for i in range(3000)]
    alerts = [(i, rnd.choice(["s1", "s1", "s2", "", "zz"]), rnd.randrange(5500)) for i in range(400)]
    ld = spark.createDataFrame(logs, "id int, service string, s long, severity string, body string").withColumn("ts", F.timestamp_seconds("s"))
    ad = spark.createDataFrame(alerts, "id int, service string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {}
    for r in enrich.recent_logs(ad, ld, window, k, slices).collect():
        got.setdefault(r.alert_id, {})[r["rank"]] = r.id
    want = {}
    for i, s, t in alerts:
        near = sorted((-x[2], x[0]) for x in logs if s and x[1] == s and t - window <= x[2] <= t)[:k]
        if near:
            want[i] = {n + 1: x for n, (_, x) in enumerate(near)}
    assert got == want


def test_enriched_text(spark):
    logs = spark.createDataFrame([(1, "pay", 990, "error", "boom"), (2, "pay", 995, "warn", "slow")], "id int, service string, s long, severity string, body string").withColumn("ts", F.timestamp_seconds("s"))
    alerts = spark.createDataFrame([(1, 1000, "g", "PaymentErrorsHigh", "service=pay error rate > 5%", "{}"), (2, 1000, "g", "x", "y", None)], "id int, s long, source string, alert string, message string, data string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r for r in enrich.enrich_alerts(alerts, logs).collect()}
    lines = "[1970-01-01T00:16:35Z] warn: slow\n[1970-01-01T00:16:30Z] error: boom\n"
    assert got[1].context == f"Source: g\nAlert: PaymentErrorsHigh\nMessage: service=pay error rate > 5%\nData: {{}}\n\n=== Recent Log Context ===\n{lines}"
    assert got[2].context == "Source: g\nAlert: x\nMessage: y\nData: " and got[2].n_logs == 0


def test_find_active(spark):
    rnd = random.Random(9)
    reports = [(i, rnd.choice("ab"), rnd.randrange(1000), rnd.choice(["queued", "pending", "running", "completed"])) for i in range(800)]
    asks = [(i, rnd.choice(["a", "b", None]), rnd.randrange(1100)) for i in range(300)]
    rp = spark.createDataFrame([(i, "m", q, t, s) for i, q, t, s in reports], "id int, trigger string, query string, s long, status string").withColumn("create_time", F.timestamp_seconds("s"))
    rq = spark.createDataFrame([(i, "m", q, t) for i, q, t in asks], "id int, trigger string, query string, s long").withColumn("create_time", F.timestamp_seconds("s"))
    got = {r.id: r.active.id if r.active else None for r in enrich.find_active(rq, rp, 5).collect()}
    want = {}
    for i, q, t in asks:
        live = [(x[2], x[0]) for x in reports if x[1] == q and x[3] != "completed" and t - 5 <= x[2] <= t]
        want[i] = max(live)[1] if live else None
    assert got == want


def test_blocked_running_sum_and_next(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "x", None]), i, rnd.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n int, v int")
    got = {r.n: r.s for r in blocks.blocked_running_sum(df, ["k"], F.floor(F.col("n") / 40), [F.col("n")], F.col("v"), "s").collect()}
    nxt = {r.n: r.x for r in blocks.blocked_next(df, ["k"], F.floor(F.col("n") / 40), F.col("n"), "x").collect()}
    prev = {r.n: r.x for r in blocks.blocked_previous(df, ["k"], F.floor(F.col("n") / 40), ["n"], F.col("v"), "x").collect()}
    run, want, after, seen = {}, {}, {}, {}
    for k, n, v in rows:
        run[k] = run.get(k, 0) + v
        want[n] = run[k]
        assert prev[n] == seen.get(k)
        seen[k] = v
    for k, n, _ in reversed(rows):
        assert nxt[n] == after.get(k)
        after[k] = n
    assert got == want
