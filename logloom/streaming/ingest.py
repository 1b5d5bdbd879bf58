"""Streaming ingestion and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logloom.operators.embed import Embedder, embed
from logloom.operators.ingest_filter import check_mode, filter_severity
from logloom.plans.ingest import ingest
from logloom.session import new_table_path
from logloom.sources.vector_store import checked, snapshot, upsert
from logloom.sources.vector_table import write_vectors
from logloom.streaming.dedup import WATERMARK, stream_template_outcomes


def stream_ingest(
    logs: DataFrame,
    embedder: Embedder,
    path: str,
    checkpoint: str,
    mode: str = "template",
    min_severity: str | None = None,
    stats_path: str | None = None,
) -> DataStreamWriter:
    """Writer that ingests a log stream into a vector table; start it with a trigger of your choice.

    Template state lives in the stream, late rows included; each micro-batch of survivors is embedded and lands in its
    own folder, so a batch that is repeated after a failure overwrites itself. With `stats_path` the ingested,
    deduplicated and filtered rows of each micro-batch are written there, one row per batch.
    """
    by_template = check_mode(mode) == "template"
    outcomes = stream_template_outcomes(logs) if by_template else logs
    batch_mode = "all" if by_template else mode

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            rows = batch.filter("deduplicated = 0").drop("deduplicated") if by_template else batch
            records, stats = ingest(rows, embedder, batch_mode, min_severity)
            write_vectors(records, f"{path}/batch={batch_id}", "overwrite")
            if stats_path is not None:
                if by_template:
                    repeats = batch.agg(F.coalesce(F.sum("deduplicated"), F.lit(0)).alias("repeats"))
                    stats = stats.crossJoin(repeats).select(  # one row each
                        "ingested", (F.col("deduplicated") + F.col("repeats")).alias("deduplicated"), "filtered"
                    )
                stats.coalesce(1).write.mode("overwrite").parquet(f"{stats_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return outcomes.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)


def stream_into_store(
    logs: DataFrame,
    embedder: Embedder,
    path: str,
    side: str,
    checkpoint: str,
    *,
    arrived: str = "arrived",
    delay: str = WATERMARK,
    min_severity: str | None = None,
    name: str = "stream",
) -> DataStreamWriter:
    """Writer that splits every micro-batch once, into a stored vector table and three side tables.

    logs: id, ts, service, severity, body, raw or not, and the time of arrival. Rows later than the delay go to
    `side`/late, rows that are no complete record within the column limits to `side`/rejects with the reason in `error`, the
    others are embedded and put into the store in `path`, which must exist. `side`/counts has a row per batch: rows = stored +
    repeated (of an id that comes several times the latest counts) + rejected + late + filtered. Everything is named by the
    batch: one that is repeated after a failure overwrites its own side tables and its call to the store is known.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            on_time, late = split_late(batch, arrived, delay)
            kept = filter_severity(on_time, min_severity)
            schema = snapshot(spark, path).schema
            whole = kept.where("coalesce(body, '') <> ''")  # nothing is embedded for a text that is rejected anyway
            bare = kept.where("coalesce(body, '') = ''").withColumn("vector", F.lit(None).cast(schema["vector"].dataType))
            records = embed(whole, "body", embedder).unionByName(bare).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
            records = records.persist()
            try:
                rejects = checked(records)[1]
                late.write.mode("overwrite").parquet(f"{side}/late/batch={batch_id}")
                rejects.write.mode("overwrite").parquet(f"{side}/rejects/batch={batch_id}")
                upsert(records, path, f"{name}-{batch_id}")
                n = {
                    "rows": batch.count(), "late": late.count(), "kept": kept.count(), "rejected": rejects.count(),
                    "stored": checked(records)[0].select("id").distinct().count(),
                }
            finally:
                records.unpersist()
            counts = [n["rows"], n["stored"], n["kept"] - n["rejected"] - n["stored"], n["rejected"], n["late"], n["rows"] - n["late"] - n["kept"]]
            row = spark.createDataFrame([counts], "rows long, stored long, repeated long, rejected long, late long, filtered long")
            row.coalesce(1).write.mode("overwrite").parquet(f"{side}/counts/batch={batch_id}")
        finally:
            batch.unpersist()

    return logs.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)


def observe_ingest(logs: DataFrame, name: str = "ingest") -> DataFrame:
    """Count rows per severity class on the way through, for stream progress listeners."""
    return logs.observe(name, F.count("*").alias("rows"), F.count_if(F.col("severity").isNull()).alias("no_severity"))


def split_late(logs: DataFrame, as_of_column: str = "arrived", delay: str = WATERMARK) -> tuple[DataFrame, DataFrame]:
    """Rows on time, and rows later than the delay against their arrival, for a side table."""
    late = F.coalesce(F.col("ts") < F.col(as_of_column) - F.expr(f"INTERVAL {delay}"), F.lit(False))
    return logs.filter(~late), logs.filter(late)


def hourly_counts(logs: DataFrame, ttl: str = "72 hours") -> DataFrame:
    """Rows per hour and service of a stream; an hour leaves the state when the watermark is ttl past it."""
    return (
        logs.withWatermark("ts", ttl)
        .groupBy(F.window("ts", "1 hour"), "service")
        .agg(F.count("*").alias("rows"))
    )


def run_available(df: DataFrame, name: str, state_partitions: int | None = None) -> DataFrame:
    """Run a stream over all data there is, into a table in the shared folder, and read that table.

    The number of state partitions is fixed for the life of a checkpoint; by default there is one per core.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    writer = df.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", state_partitions or spark.sparkContext.defaultParallelism)
    try:
        query = writer.trigger(availableNow=True).start()  # the stream keeps its own copy of the settings
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/table")
