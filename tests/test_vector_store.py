"""The stored vector table: changes against a replay in plain Python, compaction, races, pruned reads, and search."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import ann, knn
from logloom.session import new_table_path
from logloom.sources import vector_store as vs

SCHEMA = "id string, vector array<float>, ts timestamp, service string, severity string, body string"
DAY0 = dt.datetime(2024, 3, 1)


def record(i, day=0, hour=0, body="b", vector=None):
    return f"r{i}", vector or [float(i % 7), float(i % 5), 1.0], DAY0 + dt.timedelta(days=day, hours=hour), f"s{i % 3}", "info", body


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(spark, path, **span):
    return {r["id"]: (r["ts"], r["body"]) for r in vs.read(spark, path, **span).collect()}


@pytest.fixture
def path(spark):
    return new_table_path(spark, "store")


@pytest.mark.parametrize("fold", [(), (3, 4, 9)])
def test_replay(spark, path, fold):
    """Random upserts, deletes and limits; compaction at any place changes nothing that a read sees."""
    draw = random.Random(len(fold))
    want = {}
    first = [record(i, draw.randint(0, 4), draw.randint(0, 23)) for i in range(60)]
    vs.create(frame(spark, first), path, n_cells=3)
    want = {r[0]: (r[2], r[5]) for r in first}
    for n in range(14):
        kind = draw.choice(["upsert", "upsert", "delete", "expire"]) if n % 5 else "upsert"
        ids = draw.sample(range(90), draw.randint(0, 12))
        if kind == "upsert":
            rows = [record(i, draw.randint(0, 6), draw.randint(0, 23), f"v{n}") for i in ids]
            for _ in range(2):
                vs.upsert(frame(spark, rows), path, f"t{n}")
            want |= {r[0]: (r[2], r[5]) for r in rows}
        elif kind == "delete":
            vs.delete(frame(spark, [record(i) for i in ids]), path, f"t{n}")
            for i in ids:
                want.pop(f"r{i}", None)
        else:
            before = DAY0 + dt.timedelta(hours=draw.randint(0, 40 + 3 * n))
            vs.expire(spark, path, before, f"t{n}")
            want = {i: v for i, v in want.items() if v[0] >= before}
        if n in fold:
            vs.compact(spark, path)
            assert state(spark, path) == want
            vs.vacuum(spark, path)
    assert state(spark, path) == want
    since = F.lit(DAY0 + dt.timedelta(days=3))
    assert state(spark, path, since=since) == {i: v for i, v in want.items() if v[0] >= DAY0 + dt.timedelta(days=3)}


def test_compaction_rewrites_touched_days_only(spark, path):
    vs.create(frame(spark, [record(i, i % 5) for i in range(50)]), path, n_cells=2)
    vs.upsert(frame(spark, [record(1, 1, body="new")]), path)
    vs.expire(spark, path, DAY0 + dt.timedelta(days=1))
    snap = vs.compact(spark, path)
    days = {(d - DAY0.date()).days: g for d, g in snap.days.items()}
    assert days == {1: 1, 2: 0, 3: 0, 4: 0}  # day 0 is dropped, day 1 is new, the others are the old files
    assert vs.compact(spark, path) == snap  # nothing left to do
    gone = vs.vacuum(spark, path)
    assert any("day=2024-03-01" in p for p in gone) and not any("day=2024-03-03" in p for p in gone)
    assert len(state(spark, path)) == 40 and state(spark, path)["r1"][1] == "new"


def test_calls_repeat_and_fail_safely(spark, path, monkeypatch):
    vs.create(frame(spark, [record(0)]), path)
    write = vs._write_change

    def broken(*_):
        raise OSError("executor lost")

    monkeypatch.setattr(vs, "_write_change", broken)
    with pytest.raises(OSError, match="lost"):
        vs.upsert(frame(spark, [record(1)]), path, "one")
    monkeypatch.setattr(vs, "_write_change", write)
    vs.upsert(frame(spark, [record(2)]), path, "two")  # another call takes the next place
    assert set(state(spark, path)) == {"r0", "r2"}
    assert vs.compact(spark, path).folded == 0  # the first call may still come
    vs.upsert(frame(spark, [record(1, body="again")]), path, "one")
    vs.upsert(frame(spark, [record(1, body="not this")]), path, "one")
    assert state(spark, path)["r1"][1] == "again" and vs.compact(spark, path).folded == 2
    vs.upsert(frame(spark, [record(1, body="nor this")]), path, "one")  # also after it was folded in
    assert state(spark, path)["r1"][1] == "again"
    assert not vs._create(spark, f"{path}/claims/{1:012d}")


def test_rejects(spark, path):
    rows = [record(1), ("", *record(2)[1:]), ("r3", None, *record(3)[2:]), ("r4", [float("nan")] * 3, *record(4)[2:]), (*record(5)[:5], ""), (*record(6)[:5], "x" * 5000), ("r7", [1.0], None, "s", "info", "b")]
    rejects = vs.create(frame(spark, rows), path)
    assert sorted(r["error"] for r in rejects.collect()) == [
        "record ID is required", "record body is required", "record time is required", "record vector has no number", "record vector is required", "too long: body",
    ]
    assert set(state(spark, path)) == {"r1"}
    assert vs.upsert(frame(spark, [record(8), (None, *record(9)[1:])]), path).count() == 1
    two = frame(spark, [record(1, 0, 1, "older"), record(1, 0, 5, "newer")])
    vs.upsert(two, path)
    assert set(state(spark, path)) == {"r1", "r8"} and state(spark, path)["r1"][1] == "newer"


def test_empty(spark, path):
    vs.create(frame(spark, []), path)
    assert state(spark, path) == {} and vs.compact(spark, path).number == 0
    vs.upsert(frame(spark, [record(1)]), path)
    assert set(state(spark, path)) == {"r1"}
    asked = spark.createDataFrame([(1, [0.0, 0.0, 0.0])], "query_id int, query_vector array<float>")
    for found in (ann.search_store(asked, path, 2), ann.search_store(asked, path, 2, few=True), ann.search_exact(asked, path, 2)):
        assert [r["id"] for r in found.collect()] == ["r1"]
    vs.compact(spark, path)
    vs.delete(frame(spark, [record(1)]), path)
    assert vs.compact(spark, path).days == {} and state(spark, path) == {}


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors in clumps, a third of them equal, over three days."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 8)) * 6
    vectors = [centre[0].astype(np.float32) if i % 3 == 0 else (centre[i % 20] + rng.normal(size=8)).astype(np.float32) for i in range(900)]
    rows = [record(i, i % 3, vector=[float(x) for x in v]) for i, v in enumerate(vectors)]
    path = new_table_path(spark, "store")
    vs.create(frame(spark, rows[:700]), path)
    vs.upsert(frame(spark, rows[700:]), path)  # these go to the cells there are
    vs.delete(frame(spark, rows[10:20]), path)
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 900, 18)], "query_id int, query_vector array<float>")
    return path, queries, vs.read(spark, path)


@pytest.mark.parametrize("few", [True, False])
def test_search_store(spark, clustered, few):
    path, queries, rows = clustered
    exact = knn.knn(queries, rows, 10)
    assert knn.recall(ann.search_store(queries, path, 10, few=few), exact).first()["recall"] >= 0.9
    filtered = ann.search_store(queries, path, 10, n_probe=1000, few=few, where=F.col("service") == "s1")
    assert filtered.orderBy("query_id", "rank").collect() == knn.knn(queries, rows.where("service = 's1'"), 10).orderBy("query_id", "rank").collect()
    day = F.lit(DAY0 + dt.timedelta(days=1))
    assert {r["id"] for r in ann.search_store(queries, path, 3, few=few, since=day).join(rows, "id").where(F.col("ts") < day).collect()} == set()


def test_search_exact(spark, clustered):
    path, queries, rows = clustered
    got = ann.search_exact(queries, path, 10).select("query_id", "id", "rank", "score").orderBy("query_id", "rank").collect()
    assert got == knn.knn(queries, rows, 10).select("query_id", "id", "rank", "score").orderBy("query_id", "rank").collect()
    assert len(ann.search_exact(queries, path, 2000).where("query_id = 0").collect()) == 890  # fewer records than asked for


def test_probes_prune_folders(spark, clustered):
    path, queries, _ = clustered
    snap = vs.snapshot(spark, path)
    assert 1 <= snap.n_probe < vs.cells_for(700)
    plan = ann.search_store(queries.limit(1), path, 5, n_probe=1, few=True)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan
    read = vs.read(spark, path, cells=[0], since=F.lit(DAY0 + dt.timedelta(days=1)))
    files = [f for f in read.inputFiles() if "/base/" in f]
    assert all("cell=0/" in f for f in vs._base(spark, path, snap).where("cell = 0").inputFiles()) or files
    scanned = vs._base(spark, path, snap).where((F.col("cell") == 0) & (F.col("day") >= DAY0.date() + dt.timedelta(days=1)))
    scan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "cell" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "day" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_remeasure(spark, clustered):
    path, _, _ = clustered
    before = vs.snapshot(spark, path)
    after = vs.remeasure(spark, path, target=1.0)
    assert after.number == before.number + 1 and after.n_probe >= before.n_probe and after.days == before.days
