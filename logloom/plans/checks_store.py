"""Registered queries over the stored vector table, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import ann, knn
from logloom.operators.embed import HashEmbedder
from logloom.plans import oracle_views as ov
from logloom.plans import views
from logloom.plans.checks_logs import _E, _all_queries, _hits, _knn_sql
from logloom.session import new_table_path
from logloom.sources import vector_store
from logloom.streaming.ingest import stream_into_store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(fn):  # noqa: ANN001, ANN202
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- approximate search -------------------------------------------------------------------------------


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """All embeddings as queries, and a store of them."""
    path = new_table_path(spark, "vector-store")
    vector_store.create(views.vectors(spark, sf), path)
    return _all_queries(spark, sf)[0], path


def _found(spark: SparkSession, sf: str) -> DataFrame:
    queries, path = _stored(spark, sf)
    return ann.search_store(queries, path, 10)


@query("knn_ann")
def knn_ann(spark: SparkSession, sf: str) -> DataFrame:
    """Ten neighbours of every embedding in the stored table, by the number of cells that the store measured."""
    return _hits(_found(spark, sf))


@query("ann_recall", "SELECT TRUE AS reached, count(*) * 10 AS expected FROM embeddings")
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the search of `knn_ann`, as it stands, finds nine tenths of the exact neighbours."""
    exact = knn.knn(*_all_queries(spark, sf), 10)
    return knn.recall(_found(spark, sf), exact).select((F.col("recall") >= 0.9).alias("reached"), "expected")


@query("knn_stored_exact", f"WITH {_E}, {_knn_sql('l2', 10)}")
def knn_stored_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The same store searched with its cells as bounds: the rows of a full scan."""
    queries, path = _stored(spark, sf)
    return _hits(ann.search_exact(queries, path, 10))


# --- changes --------------------------------------------------------------------------------------------

START = dt.datetime(2024, 1, 1)
#: (kind, modulus, remainder, days the time moves or hours of the limit): twenty calls, in order.
CALLS = (
    ("upsert", 20, 1, 1), ("delete", 17, 2, 0), ("upsert", 40, 7, 2), ("expire", 0, 0, 2), ("upsert", 20, 5, 0), ("delete", 13, 6, 0),
    ("upsert", 30, 15, 3), ("upsert", 7, 3, 0), ("delete", 11, 9, 0), ("upsert", 11, 9, 1), ("expire", 0, 0, 5), ("upsert", 19, 12, -1),
    ("delete", 7, 3, 0), ("upsert", 14, 3, 4), ("upsert", 2, 1, 0), ("delete", 5, 1, 0), ("expire", 0, 0, 8), ("upsert", 25, 11, -2),
    ("delete", 50, 11, 0), ("upsert", 9, 4, 5),
)


def _call(spark: SparkSession, records: DataFrame, path: str, n: int) -> None:
    kind, modulus, rest, shift = CALLS[n]
    token = f"call-{n}"
    if kind == "expire":
        vector_store.expire(spark, path, START + dt.timedelta(hours=shift), token)
        return
    rows = records.where(F.col("id") % modulus == rest)
    if kind == "delete":
        vector_store.delete(rows, path, token)
        return
    moved = F.timestamp_micros(F.unix_micros("ts") + F.lit(shift * 86_400_000_000))
    vector_store.upsert(rows.withColumn("ts", moved).withColumn("body", F.concat(F.lit(f"{n} "), "body")), path, token)


def _replayed(spark: SparkSession, sf: str, fold: tuple[int, ...] = ()) -> DataFrame:
    """The state after all calls over a store of the even ids; each call is made twice. fold: where the store is compacted."""
    records, path = views.vectors(spark, sf).persist(), new_table_path(spark, "vector-store")
    try:
        vector_store.create(records.where("id % 2 = 0"), path, n_cells=4)
        for n in range(len(CALLS)):
            for _ in range(2):
                _call(spark, records, path, n)
            if n in fold:
                vector_store.compact(spark, path)
                vector_store.vacuum(spark, path)
    finally:
        records.unpersist()
    return vector_store.read(spark, path).select(
        "id", "service", "body", F.unix_millis("ts").alias("ts_ms"), F.size("vector").alias("dim")
    )


_VALUES = ", ".join(f"({n + 1}, '{k}', {max(1, m)}, {r}, {s})" for n, (k, m, r, s) in enumerate(CALLS))
_REPLAY = f"""WITH {ov.VECTORS}, calls(seq, kind, modulus, rest, shift) AS (VALUES {_VALUES}),
  h AS (
    SELECT id, 0 AS seq, 'upsert' AS kind, 0 AS shift, body FROM vectors WHERE id % 2 = 0
    UNION ALL
    SELECT id, seq, kind, shift, (seq - 1) || ' ' || body FROM vectors JOIN calls ON kind <> 'expire' AND id % modulus = rest
  ), l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM h),
  r AS (SELECT v.id, v.service, l.body, l.seq, l.kind, epoch_us(v.ts) // 1000 + l.shift * 86400000 AS ts_ms, CAST(len(v.vector) AS INTEGER) AS dim
        FROM l JOIN vectors v USING (id) WHERE l.k = 1)
  SELECT id, service, body, ts_ms, dim FROM r WHERE kind = 'upsert' AND NOT EXISTS (
    SELECT 1 FROM calls c WHERE c.kind = 'expire' AND c.seq > r.seq AND r.ts_ms < epoch_us(TIMESTAMP '2024-01-01') // 1000 + c.shift * 3600000)"""


@query("vector_store_replay", _REPLAY)
def vector_store_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty upserts, deletes and retention limits, all resolved at read."""
    return _replayed(spark, sf)


@query("vector_store_compacted", _REPLAY)
def vector_store_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The same calls with three compactions between them; what comes after the last is resolved at read."""
    return _replayed(spark, sf, (4, 10, 16))


# --- one pass, several sinks ------------------------------------------------------------------------

_SINK = f"""WITH {ov.LOGS}, r AS (
    SELECT id, ts, severity, CASE WHEN id % 13 = 0 THEN '' WHEN id % 17 = 0 THEN repeat('x', 5000) ELSE body END AS body,
           CASE WHEN id % 11 = 0 THEN 'late' WHEN severity = 'debug' THEN 'filtered' WHEN id % 13 = 0 THEN 'record vector is required'
                WHEN id % 17 = 0 THEN 'too long: body' ELSE 'stored' END AS outcome
    FROM logs)"""


def _sinks(spark: SparkSession, sf: str) -> str:
    """The log stream, with gaps and late rows, through the splitting writer twice; the second run finds all calls made."""
    path = new_table_path(spark, "sinks")
    fields = {"id": "string", "vector": "array<float>", "ts": "timestamp", "service": "string", "severity": "string", "body": "string"}
    vector_store.create(spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in fields.items())), f"{path}/store")
    rows = views.as_logs(views.event_stream(spark, sf))
    rows = rows.select(
        F.col("id").cast("string").alias("id"), "ts", "service", "severity",
        F.when(F.col("id") % 13 == 0, "").when(F.col("id") % 17 == 0, F.repeat(F.lit("x"), F.lit(5000))).otherwise(F.col("body")).alias("body"),
        F.when(F.col("id") % 11 == 0, F.col("ts") + F.expr("INTERVAL 2 HOURS")).otherwise(F.col("ts")).alias("arrived"),
    )
    for run in range(2):
        writer = stream_into_store(rows, HashEmbedder(8), f"{path}/store", f"{path}/side", f"{path}/check{run}", min_severity="info")
        writer.trigger(availableNow=True).start().awaitTermination()
    return path


@query("stream_sinks", f"{_SINK} SELECT outcome, count(*) AS n FROM r GROUP BY 1")
def stream_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every outcome as they lie in the store and the side tables."""
    path = _sinks(spark, sf)
    counts = spark.read.parquet(f"{path}/side/counts").agg(F.sum("filtered").alias("n")).select(F.lit("filtered").alias("outcome"), "n")
    stored = vector_store.read(spark, f"{path}/store").select(F.lit("stored").alias("outcome"))
    rejects = spark.read.parquet(f"{path}/side/rejects").select(F.col("error").alias("outcome"))
    late = spark.read.parquet(f"{path}/side/late").select(F.lit("late").alias("outcome"))
    return stored.union(rejects).union(late).groupBy("outcome").agg(F.count("*").alias("n")).union(counts)


@query(
    "stream_sink_counts",
    f"""{_SINK} SELECT count(*) AS rows, count(*) FILTER (outcome = 'stored') AS stored, 0::BIGINT AS repeated, count(*) FILTER (outcome IN ('record vector is required', 'too long: body')) AS rejected,
      count(*) FILTER (outcome = 'late') AS late, count(*) FILTER (outcome = 'filtered') AS filtered, TRUE AS complete FROM r""",
)
def stream_sink_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of all batches, and whether they add up in each."""
    names = ("rows", "stored", "repeated", "rejected", "late", "filtered")
    counts = spark.read.parquet(f"{_sinks(spark, sf)}/side/counts")
    whole = F.col("rows") == F.col("stored") + F.col("repeated") + F.col("rejected") + F.col("late") + F.col("filtered")
    return counts.agg(*[F.sum(c).alias(c) for c in names], F.bool_and(whole).alias("complete"))
