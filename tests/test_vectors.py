"""Search, record checks and the vector table."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import ingest_filter, knn, search
from logloom.operators.embed import HashEmbedder, embed
from logloom.sources import vector_table


def brute(q, v, k, metric):
    out = {}
    for qi, x in q:
        scored = []
        for vi, y in v:
            x64, y64 = np.array(x, float), np.array(y, float)
            if metric == "l2":
                s = ((x64 - y64) ** 2).sum()
            else:
                s = -(x64 @ y64) / ((np.linalg.norm(x64) or 1) * (np.linalg.norm(y64) or 1))
            scored.append((np.float32(s), vi))
        out[qi] = [vi for _, vi in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("metric", knn.METRICS)
@pytest.mark.parametrize("many", [False, True])
def test_knn_with_copies(spark, metric, many, monkeypatch):
    """A third of the vectors are copies of one; small blocks force several of them to meet."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 5)).astype(np.float32)
    vectors = [(f"v{i:03d}", [float(x) for x in (base[0] if i % 3 == 0 else base[i % 60])]) for i in range(150)]
    vectors.append(("zero", [0.0] * 5))
    queries = [(i, [float(x) for x in base[i]]) for i in range(20)]
    if many:
        monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
        monkeypatch.setattr(knn, "VECTOR_BLOCK", 40)
    q = spark.createDataFrame(queries, "query_id int, query_vector array<float>")
    v = spark.createDataFrame(vectors, "id string, vector array<float>").repartition(4)
    got = {}
    for r in sorted(knn.knn(q, v, 7, metric, few=not many).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == brute(queries, vectors, 7, metric)


def test_knn_smaller_than_k_and_empty(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<float>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id int, vector array<float>")
    assert [(r.id, r.rank) for r in knn.knn(q, v, 5).collect()] == [(1, 1)]
    assert knn.knn(q, v.limit(0), 5).count() == 0
    assert knn.knn(q.limit(0), v, 5).count() == 0
    assert knn.knn(q.limit(0), v, 5, few=True).count() == 0
    with pytest.raises(ValueError, match="more than"):
        knn.knn(spark.range(300).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("query_vector")), v, 5, few=True)


def test_exact_search_joins_by_key(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = knn.knn(vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), vectors, 3)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    exact = knn.knn(q, v, 10)
    centroids = knn.train_cells(v, 8)
    some = knn.recall(knn.knn_cells(q, v, centroids, 10, "l2", 4), exact).first()
    whole = knn.recall(knn.knn_cells(q, v, centroids, 10, "l2", 8), exact).first()
    assert whole.recall == 1.0 and 0.5 < some.recall <= 1.0


def _records(spark):
    rows = [(i, dt.datetime(2024, 1, 1, i % 24), f"svc{i % 2}", ["error", "Error"][i % 3 == 0], f"disk {i} full") for i in range(48)]
    return spark.createDataFrame(rows, "id int, ts timestamp, service string, severity string, body string")


def test_search(spark):
    model = HashEmbedder(32)
    records = embed(_records(spark), "body", model)
    asked = spark.createDataFrame([(1, "disk 7 full"), (2, ""), (3, None)], "query_id int, query string")
    hits = search.search(asked, records, model, 5, service="svc1", severity="error")
    rows = hits.collect()
    assert {r.query_id for r in rows} == {1} and len(rows) == 5
    assert all(r.service == "svc1" and r.severity == "error" for r in rows)
    assert min(rows, key=lambda r: r.rank).id == 7
    outcomes = {r.query_id: r.outcome for r in search.search_outcomes(asked, hits).collect()}
    assert outcomes == {1: "success", 2: "error_empty_query", 3: "error_empty_query"}
    none = search.search(asked, records, model, 5, service="svc9")
    assert {r.query_id: r.outcome for r in search.search_outcomes(asked, none).collect()}[1] == "no_results"
    assert [search.clamp_limit(n) for n in (None, 0, -1, 7, 1000)] == [10, 10, 10, 7, 100]


def test_get_context(spark):
    records = _records(spark)
    start, end = dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 9)
    rows = search.get_context(records, "svc1", start, end, 4).collect()
    want = sorted([(-r.ts.timestamp(), r.id) for r in records.collect() if r.service == "svc1" and start <= r.ts <= end])[:4]
    assert [r.id for r in rows] == [i for _, i in want]
    for bad in ((end, start), (start, start)):
        with pytest.raises(ValueError, match="invalid time range"):
            search.get_context(records, "svc1", *bad)


def test_record_checks(spark):
    rows = [("1", [0.1], "t"), (None, [0.1], "t"), ("1", [], "t"), ("1", None, "t"), ("1", [0.1], ""), (None, None, None)]
    df = spark.createDataFrame(rows, "id string, vector array<float>, body string")
    good, bad = ingest_filter.split_valid(ingest_filter.validate_records(df))
    assert good.count() == 1
    assert sorted(r.error for r in bad.collect()) == sorted(
        ["record ID is required", "record vector is required", "record vector is required", "record body is required", "record ID is required"]
    )


def test_vector_table(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = [("a", [1.0], dt.datetime(2024, 1, 1, 1, 0, 0, 123456), "s", "info", "x", {"k": "v"}), ("b", [2.0], dt.datetime(2024, 1, 3), "s", "info", "y", {})]
    df = spark.createDataFrame(rows, "id string, vector array<float>, ts timestamp, service string, severity string, body string, attributes map<string,string>")
    vector_table.write_vectors(df, path)
    back = vector_table.read_vectors(spark, path)
    first = back.filter("id = 'a'").first()
    assert first.attributes == {"k": "v"} and first.ts == dt.datetime(2024, 1, 1, 1, 0, 0, 123000)
    late = vector_table.read_vectors(spark, path, since=F.lit("2024-01-02").cast("timestamp"))
    assert [r.id for r in late.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(day" in late._jdf.queryExecution().executedPlan().toString()
    fresh = df.filter("id = 'b'").withColumn("body", F.lit("new"))
    assert {r.id: r.body for r in vector_table.upsert_vectors(df, fresh).collect()} == {"a": "x", "b": "new"}
    assert [r.id for r in vector_table.delete_vectors(df, df.filter("id = 'a'")).collect()] == ["b"]


def test_filters_reach_the_scan(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_type", "service")
    plan = ingest_filter.metadata_filter(e, service="error")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan
