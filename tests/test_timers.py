"""Timer streams against their batch forms, over shuffled input in several micro-batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators.admission import admit_requests
from logloom.operators.ingest_filter import apply_retention
from logloom.operators.schedule import schedule_history
from logloom.session import new_table_path
from logloom.streaming.timers import stream_admission_in_order, stream_expired, stream_schedule

T0 = dt.datetime(2024, 5, 1)
MINUTE = dt.timedelta(minutes=1)
FAR = T0 + dt.timedelta(days=30)


def feed(spark, batches, schema):
    """A stream that brings each list of rows in a micro-batch of its own."""
    path = new_table_path(spark, "feed")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def clock(spark, *batches):
    return feed(spark, [[(t,)] for t in batches], "ts timestamp")


def run(spark, df):
    """All micro-batches there are; the rows and the last progress."""
    path = new_table_path(spark, "ran")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        query = df.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/table"), query.recentProgress, f"{path}/check"


REQUEST = "id string, trigger string, query string, create_time timestamp"


def requests(n, seed=1):
    """A third of the rows share one key; some times are equal, some a window apart to the microsecond."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"q{draw.randint(0, 8)}"
        at = T0 + dt.timedelta(seconds=draw.choice([draw.randint(0, 3600), 300 * draw.randint(0, 12)]), microseconds=draw.choice([0, 0, 1]))
        rows.append((f"r{i:04d}", "manual" if i % 2 else None, key, at))
    return rows


@pytest.mark.parametrize("together", [True, False])
def test_admission_in_order(spark, together):
    rows = requests(240)
    draw = random.Random(2)
    arrive = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=draw.uniform(0, 590)))
    parts = [arrive] if together else [arrive[k : k + 80] for k in range(0, len(arrive), 80)]
    got, progress, check = run(spark, stream_admission_in_order(feed(spark, parts, REQUEST), clock=clock(spark, *[T0] * len(parts), FAR)))
    got = got.collect()
    want = {r["id"]: (r["admitted"], r["blocked_by"]) for r in admit_requests(spark.createDataFrame(rows, REQUEST)).collect()}
    assert {r["id"]: (r["admitted"], r["blocked_by"]) for r in got} == want and len(got) == len(rows)
    assert not any(r["late"] for r in got) and any(a for a, _ in want.values()) and any(b for _, b in want.values())
    assert all(r["create_time"] for r in got)
    assert progress[-1].stateOperators[0].numRowsTotal == 0 or spark.read.format("statestore").option("stateVarName", "last").load(check).count() == 0


def test_late_requests_have_their_own_outcome(spark):
    first = [("a", "m", "q", T0), ("b", "m", "q", T0 + 30 * MINUTE)]
    late = [("c", "m", "q", T0 + MINUTE), ("d", "m", "q", T0 + 29 * MINUTE), ("e", "m", "q", T0 + 34 * MINUTE)]
    got, _, _ = run(spark, stream_admission_in_order(feed(spark, [first, [("x", "m", "other", T0 + 31 * MINUTE)], late], REQUEST), clock=clock(spark, T0, T0, T0, FAR)))
    rows = {r["id"]: (r["admitted"], r["blocked_by"], r["late"]) for r in got.collect()}
    assert rows["c"] == (False, None, True)  # behind the watermark: counted, not lost
    assert rows["d"] == (True, None, False) and rows["b"] == (False, "d", False)  # within the delay: it comes first
    assert rows["e"] == (False, "d", False) and rows["a"] == (True, None, False) and len(rows) == 6


RECORD = "id string, ts timestamp"


def test_expired_is_what_retention_drops(spark):
    draw = random.Random(4)
    rows = [(f"r{i}", T0 + dt.timedelta(milliseconds=draw.randint(0, 40 * 3600 * 1000))) for i in range(300)]
    rows += [("edge", T0 + dt.timedelta(hours=10)), ("just", T0 + dt.timedelta(hours=10, milliseconds=-1)), ("r0", T0 + dt.timedelta(hours=39))]
    draw.shuffle(rows)
    parts = [rows[:100], rows[100:200], rows[200:]]
    mark = T0 + dt.timedelta(hours=40)  # the watermark: ten hours are kept... the record on the edge too
    seen, progress, check = run(spark, stream_expired(feed(spark, parts, RECORD), 30 * 3600, "10 minutes", clock(spark, T0, T0, T0, mark + 10 * MINUTE), parts=3))
    gone = {(r["id"], r["ts"]) for r in seen.collect()}
    alive = {(r["id"], r["ts"]) for r in apply_retention(spark.createDataFrame(rows, RECORD), F.lit(mark), 30 * 3600).collect()}
    assert set(rows) - gone == alive and ("edge", rows and T0 + dt.timedelta(hours=10)) in alive and gone
    assert seen.count() == len(gone)
    state = spark.read.format("statestore").option("stateVarName", "alive").load(check)
    assert state.selectExpr("explode(list_value) AS v" if "list_value" in state.columns else "list_element AS v").count() == len(alive)


CHANGE = "ts timestamp, seq long, name string, interval string, metric_query string, log_query string"


def test_schedule_follows_its_changes(spark):
    changes = [
        (T0, 1, "a", "10m", "up", None), (T0, 2, "b", "7m", None, "errors"), (T0 + 25 * MINUTE, 3, "a", "3m", "down", None),
        (T0 + 31 * MINUTE, 4, "a", None, None, None), (T0 + 40 * MINUTE, 5, "a", "5m", None, None), (T0 + 21 * MINUTE, 6, "b", "7m", "x", "y"),
        (T0 + 5 * MINUTE, 7, "c", "bad", None, None), (T0 + 9 * MINUTE, 8, "c", "1h", None, None), (T0 + 40 * MINUTE, 9, "a", "4m", None, None),
    ]
    draw = random.Random(1)
    draw.shuffle(changes)
    end = T0 + 75 * MINUTE
    got, _, _ = run(spark, stream_schedule(feed(spark, [changes[:4], changes[4:]], CHANGE), clock(spark, T0 + 10 * MINUTE, T0 + 12 * MINUTE, T0 + 55 * MINUTE, end + 60 * MINUTE), "60 minutes"))
    want = schedule_history(spark.createDataFrame(changes, CHANGE), F.lit(end))
    rows = lambda df: sorted((r["name"], r["create_time"], r["query"]) for r in df.where(F.col("create_time") < F.lit(end)).collect())
    assert rows(got) == rows(want) and len(rows(got)) > 15
    assert {r[1] for r in rows(got) if r[0] == "a"} == {T0 + m * MINUTE for m in (10, 20, 28, *range(44, 75, 4))}


def test_requests_of_many_keys_wait_in_few_buckets(spark):
    rows = [(f"r{i:03d}", None if i % 3 else "manual", f"q{i % 40}", T0 + dt.timedelta(seconds=7 * i)) for i in range(400)]
    parts = [rows[200:], rows[:200]]
    waits = stream_admission_in_order(feed(spark, parts, REQUEST), delay="2 hours", buckets=3)
    got, _, check = run(spark, waits)
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(check)
    assert got.count() == 0 and 0 < state.select("key").distinct().count() <= 3
    got, _, _ = run(spark, stream_admission_in_order(feed(spark, parts, REQUEST), delay="2 hours", clock=clock(spark, T0, FAR), buckets=3))
    want = {r["id"]: (r["admitted"], r["blocked_by"]) for r in admit_requests(spark.createDataFrame(rows, REQUEST)).collect()}
    assert {r["id"]: (r["admitted"], r["blocked_by"]) for r in got.collect()} == want
