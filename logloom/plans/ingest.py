"""Log ingestion end to end: filter or deduplicate, embed, hand over as vector records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.embed import Embedder, embed
from logloom.operators.ingest_filter import check_mode, filter_severity, ingest_outcome, ingest_stats
from logloom.operators.templates import DEPTH, THRESHOLD, first_of_each_template, masked_patterns, mine_patterns
from logloom.sources.vector_table import record_id


def ingest(
    logs: DataFrame,
    embedder: Embedder,
    mode: str = "template",
    min_severity: str | None = None,
    template_threshold: float = THRESHOLD,
    partition_by: tuple[str, ...] = ("service",),
    depth: int = DEPTH,
) -> tuple[DataFrame, DataFrame]:
    """Vector records of a batch of logs, and one row of ingested, deduplicated and filtered counts.

    In template mode the logs are read once: the pattern table carries the founding rows and the counts.
    """
    mode = check_mode(mode)
    if mode == "template":
        mined = mine_patterns(
            masked_patterns(logs, partition_by), partition_by, threshold=template_threshold, depth=depth
        )
        kept = first_of_each_template(mined)
        new = F.when(F.col("is_new"), 1).otherwise(0)
        stats = mined.agg(
            F.coalesce(F.sum(new), F.lit(0)).cast("bigint").alias("ingested"),
            F.coalesce(F.sum(F.col("n_rows") - new), F.lit(0)).cast("bigint").alias("deduplicated"),
            F.lit(0).cast("bigint").alias("filtered"),
        )
    else:
        kept = filter_severity(logs, min_severity) if mode == "severity" else logs
        if "raw_body" not in kept.columns:  # a template stream brings it along
            kept = kept.withColumn("raw_body", F.col("body"))
        stats = ingest_stats(ingest_outcome(logs, mode, min_severity))
    records = embed(kept, "body", embedder)
    source_id = F.col("id")
    return (
        records.withColumn("source_id", source_id).withColumn(
            "id", record_id(F.col("ts"), F.col("service"), F.col("raw_body"), source_id)
        ),
        stats,
    )
