"""Streams give what the batch jobs give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import admission, templates
from logloom.operators.embed import HashEmbedder
from logloom.sources.vector_table import read_vectors
from logloom.streaming import dedup, ingest
from logloom.streaming.admission import stream_admission

LOGS = "id int, s long, service string, severity string, body string"


def log_rows(n=300, seed=1):
    rnd = random.Random(seed)
    words = ["get", "put", "up", "down", "node", "7", "12"]
    return [(i, i, rnd.choice(["hot", "hot", "b"]), "info", " ".join(rnd.choice(words) for _ in range(rnd.randrange(6)))) for i in range(n)]


def write_parts(spark, rows, ddl, path, parts):
    """One file per part, in time order, so that a stream sees several batches."""
    size = -(-len(rows) // parts)
    for p in range(parts):
        df = spark.createDataFrame(rows[p * size : (p + 1) * size], ddl).coalesce(1)
        df.write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def family_rows(n=300):
    """Rows whose templates do not depend on the order: they differ in parameters only."""
    rnd = random.Random(7)
    forms = ["user {} logged in", "disk {} full at {}", "request {} took {} ms on node {}", "", "cache miss"]
    return [(i, i, rnd.choice(["hot", "hot", "b"]), "info", rnd.choice(forms).format(*(rnd.randrange(99) for _ in range(3)))) for i in range(n)]


def log_stream(spark, rows, path, parts):
    schema = write_parts(spark, rows, LOGS, path, parts)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.withColumn("ts", F.timestamp_seconds("s")), spark.read.parquet(path).withColumn("ts", F.timestamp_seconds("s"))


def test_template_dedup_in_order(spark, tmp_path):
    """The founding rows are those of the batch job."""
    stream, batch = log_stream(spark, log_rows(), str(tmp_path / "in"), 3)
    got = ingest.run_available(dedup.stream_template_dedup(stream), "test-dedup").collect()
    want = templates.dedup_by_template(batch).collect()
    assert sorted((r.id, r.service, r.body) for r in got) == sorted((r.id, r.service, r.body) for r in want)


def test_template_dedup_of_families(spark, tmp_path):
    stream, batch = log_stream(spark, family_rows(), str(tmp_path / "in"), 3)
    got = ingest.run_available(dedup.stream_template_dedup(stream), "test-dedup").collect()
    want = templates.dedup_by_template(batch).collect()
    assert sorted((r.service, r.body) for r in got) == sorted((r.service, r.body) for r in want)


def test_seeded_stream_goes_on_where_the_batch_ended(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, i, "ab"[i % 2], " ".join(rnd.choice("uvw") + rnd.choice("xyz") for _ in range(rnd.choice([3, 4])))) for i in range(300)]
    df = spark.createDataFrame(rows, "s int, id int, service string, body string").select(F.timestamp_seconds("s").alias("ts"), "id", "service", "body")
    past, later = df.where("id < 150"), df.where("id >= 150")
    seed = templates.template_catalogue(templates.mine_patterns(templates.masked_patterns(past)))
    path = str(tmp_path / "later")
    later.write.parquet(path)
    stream = spark.readStream.schema(later.schema).parquet(path)
    got = ingest.run_available(dedup.stream_template_dedup(stream, seed=seed), "test-seed")
    both = {(r["id"], r["body"]) for r in templates.dedup_by_template(df).collect()}
    assert {(r["id"], r["body"]) for r in got.collect()} == {x for x in both if x[0] >= 150}
    assert got.count() < templates.dedup_by_template(later).count()  # the seed knows some of them


def test_capacity_bounds_the_state(spark, tmp_path):
    rows = [(i, i, "s", "info", f"a{chr(97 + i)} b{chr(97 + i)}") for i in range(6)] + [(9, 9, "s", "info", "aa ba")]
    path = str(tmp_path / "in")
    stream, _ = log_stream(spark, rows, path, 7)
    got = ingest.run_available(dedup.stream_template_dedup(stream, capacity=3), "test-capacity")
    assert got.count() == 7  # the first template was evicted, so its repeat is new again


def test_late_rows_are_not_lost(spark, tmp_path):
    """Out of order micro-batches at default arguments; a late row founds a template nobody has seen."""
    rows = [(0, 100_000, "a", "info", "user 1 logged in"), (1, 200_000, "a", "info", "cache miss"), (2, 50, "a", "error", "disk 3 full at 9"), (3, 300_000, "a", "info", "user 7 logged in"), (4, 60, "a", "info", "cache miss")]
    stream, batch = log_stream(spark, rows, str(tmp_path / "in"), 5)
    got = ingest.run_available(dedup.stream_template_dedup(stream), "test-late").collect()
    assert sorted((r.service, r.body) for r in got) == sorted((r.service, r.body) for r in templates.dedup_by_template(batch).collect())
    assert sorted(r.id for r in got) == [0, 1, 2]


def test_stream_counts_and_catalogue(spark, tmp_path):
    rows = family_rows(120)
    out, stats, checkpoint = (str(tmp_path / x) for x in ("out", "stats", "cp"))
    stream, batch = log_stream(spark, rows, str(tmp_path / "in"), 4)
    writer = ingest.stream_ingest(stream, HashEmbedder(8), out, checkpoint, stats_path=stats)
    writer.trigger(availableNow=True).start().awaitTermination()
    total = spark.read.parquet(stats).agg(F.sum("ingested"), F.sum("deduplicated"), F.sum("filtered"), F.count("*")).first()
    mined = templates.mine_patterns(templates.masked_patterns(batch))
    new = mined.filter("is_new").count()
    assert tuple(total) == (new, len(rows) - new, 0, 4)
    want = {(r.template, r.members) for r in templates.template_catalogue(mined).collect()}
    assert {(r.template, r.members) for r in dedup.stream_catalogue(spark, checkpoint).collect()} == want


def test_late_requests(spark, tmp_path):
    """A late row is blocked only by what was admitted in the window before it."""
    path = str(tmp_path / "in")
    rows = [(100_000, 0), (50_000, 1), (100_001, 2), (100_400, 3), (100_200, 4), (49_999, 5)]
    schema = write_parts(spark, rows, "s long, id int", path, 6)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).select(
        "id", F.lit("manual").alias("trigger"), F.lit("q").alias("query"), F.timestamp_seconds("s").alias("create_time")
    )
    got = ingest.run_available(stream_admission(stream, 300, ttl_seconds=None, delay_seconds=100_000), "test-late").collect()
    assert {r.id: (r.admitted, r.blocked_by, r.late) for r in got} == {
        0: (True, None, False), 1: (True, None, True), 2: (False, "0", False), 3: (True, None, False), 4: (False, "0", True), 5: (True, None, True),
    }


def test_admission(spark, tmp_path):
    rnd = random.Random(3)
    rows = sorted((rnd.randrange(3000), i, rnd.choice(["hot", "hot", "q"])) for i in range(400))
    path = str(tmp_path / "in")
    schema = write_parts(spark, rows, "s long, id int, query string", path, 3)

    def requests(df):
        return df.select("id", F.lit("manual").alias("trigger"), "query", F.timestamp_seconds("s").alias("create_time"))

    stream = requests(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    got = ingest.run_available(stream_admission(stream, 20, ttl_seconds=None), "test-admission").collect()
    want = admission.admit_requests(requests(spark.read.parquet(path)), 20).collect()
    assert {r.id: (r.admitted, r.blocked_by and int(r.blocked_by)) for r in got} == {r.id: (r.admitted, r.blocked_by) for r in want}
    with pytest.raises(ValueError, match="outlive"):
        stream_admission(stream, 20, ttl_seconds=10)


def test_ingest_into_vector_table(spark, tmp_path):
    out = str(tmp_path / "out")
    stream, batch = log_stream(spark, family_rows(60), str(tmp_path / "in"), 2)
    ingest.stream_ingest(stream, HashEmbedder(8), out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = templates.dedup_by_template(batch)
    got = read_vectors(spark, out)
    assert sorted(r.body for r in got.collect()) == sorted(r.body for r in batch.collect())
    assert got.filter(F.size("vector") == 8).count() == got.count()


def test_late_rows_and_hourly_counts(spark, tmp_path):
    rows = [(0, 7200), (1, 100)]
    df = spark.createDataFrame(rows, "id int, s long").select("id", F.timestamp_seconds("s").alias("ts"), F.timestamp_seconds(F.lit(7300)).alias("arrived"), F.lit("a").alias("service"))
    on_time, late = ingest.split_late(df)
    assert [r.id for r in on_time.collect()] == [0] and [r.id for r in late.collect()] == [1]
    path = str(tmp_path / "in")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    assert ingest.hourly_counts(stream).isStreaming and ingest.observe_ingest(stream.withColumn("severity", F.lit("x"))).isStreaming
