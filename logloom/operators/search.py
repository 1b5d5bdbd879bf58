"""Semantic search over vector records, and the recent context of a service."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.embed import Embedder, embed
from logloom.operators.ingest_filter import metadata_filter
from logloom.operators.knn import hits_by_vector, hits_of_queries, knn

DEFAULT_LIMIT, MAX_LIMIT = 10, 100
NO_RESULTS = "no results"


def clamp_limit(limit: int | None) -> int:
    return DEFAULT_LIMIT if not limit or limit <= 0 else min(limit, MAX_LIMIT)


def with_metadata(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Bring body, service, severity and time to the hits; the vectors are not read for it."""
    cols = [c for c in ("body", "service", "severity", "ts", "attributes") if c in records.columns]
    return hits.join(records.select("id", *cols), "id")


def search(
    queries: DataFrame,
    records: DataFrame,
    embedder: Embedder,
    limit: int | None = None,
    as_of: Column | None = None,
    seconds: float = 0,
    service: str | None = None,
    severity: str | None = None,
    metric: str = "l2",
    few: bool = True,
) -> DataFrame:
    """Hits of every non-empty query text (query_id, query) among the records that pass the filters.

    few: as for knn; search requests come in small numbers. Set it to False for a table of queries: a vector that many of them
    have is searched once.
    """
    asked = embed(queries.filter("coalesce(query, '') <> ''"), "query", embedder, "query_vector")
    kept = metadata_filter(records, as_of, seconds, service, severity)
    k = clamp_limit(limit)
    found = None if few else hits_by_vector(asked, kept, k, metric)
    if found is None:
        return with_metadata(knn(asked, kept, k, metric, few), kept)
    named = kept.join(found.select("id").distinct(), "id", "left_semi")  # few records; the others are not dealt by id
    return with_metadata(hits_of_queries(asked, found, k, metric), named)


def search_outcomes(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Outcome of every query: error_empty_query, no_results or success."""
    found = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    return queries.join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.when(F.coalesce("query", F.lit("")) == "", "error_empty_query")
        .when(F.coalesce("n_hits", F.lit(0)) == 0, "no_results")
        .otherwise("success")
        .alias("outcome"),
    )


def get_context(
    records: DataFrame,
    service: str,
    start: dt.datetime,
    end: dt.datetime,
    limit: int | None = None,
    mode: str = "range",
    as_of: Column | None = None,
    embedder: Embedder | None = None,
    metric: str = "l2",
) -> DataFrame:
    """Recent records of a service.

    range: start <= ts <= end, newest first. duration: the last (end - start) before as_of, nearest to the
    vector of the empty text first, as a vector store answers it.
    """
    if start >= end:
        raise ValueError("invalid time range")
    n = clamp_limit(limit)
    if mode == "range":
        kept = metadata_filter(records, service=service).filter(F.col("ts").between(F.lit(start), F.lit(end)))
        return kept.orderBy(F.col("ts").desc(), F.col("id")).limit(n)
    if mode != "duration" or as_of is None or embedder is None:
        raise ValueError("duration mode needs as_of and an embedder")
    kept = metadata_filter(records, as_of, (end - start).total_seconds(), service)
    blank = records.sparkSession.createDataFrame([(0, "")], "query_id int, query string")
    hits = knn(embed(blank, "query", embedder, "query_vector"), kept, n, metric, few=True)
    return with_metadata(hits, kept)
