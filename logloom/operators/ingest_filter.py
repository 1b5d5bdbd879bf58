"""Row filters of ingestion, search and retention, and record checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.severity import rank_of, severity_rank

MODES = ("all", "severity", "template")

# fixed values: byte limits of the vector table columns
COLUMN_LIMITS = {"id": 64, "service": 128, "severity": 32, "body": 4096}
RETENTION_SECONDS = 72 * 3600


def check_mode(mode: str) -> str:
    mode = (mode or "").lower()
    if mode not in MODES:
        raise ValueError(f"unknown filter mode {mode!r}; use one of {', '.join(MODES)}")
    return mode


def filter_severity(df: DataFrame, min_severity: str | None, col: str = "severity") -> DataFrame:
    """Keep rows at or above a severity; an empty minimum keeps all, an unknown one ranks 0."""
    return df if not min_severity else df.filter(severity_rank(F.col(col)) >= rank_of(min_severity))


def time_range(df: DataFrame, as_of: Column, seconds: float, ts: str = "ts") -> DataFrame:
    """Rows not older than as_of - seconds; 0 keeps all."""
    if not seconds:
        return df
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)")))


def equals_if_given(df: DataFrame, col: str, value: str | None) -> DataFrame:
    """Exact, case-sensitive equality; empty means no filter."""
    return df if not value else df.filter(F.col(col) == value)


def metadata_filter(
    df: DataFrame,
    as_of: Column | None = None,
    seconds: float = 0,
    service: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    """The filters of a search; they stay plain comparisons so the scan can push them down."""
    out = df if as_of is None else time_range(df, as_of, seconds)
    return equals_if_given(equals_if_given(out, "service", service), "severity", severity)


def apply_retention(df: DataFrame, as_of: Column, seconds: float = RETENTION_SECONDS, ts: str = "ts") -> DataFrame:
    """Rows still inside the retention time."""
    return time_range(df, as_of, seconds, ts)


def validate_records(df: DataFrame) -> DataFrame:
    """Add `error`: the first missing part of a vector record, NULL when complete."""
    return df.withColumn(
        "error",
        F.when(F.coalesce("id", F.lit("")) == "", "record ID is required")
        .when(F.coalesce(F.size("vector"), F.lit(0)) <= 0, "record vector is required")
        .when(F.coalesce("body", F.lit("")) == "", "record body is required"),
    )


def check_column_limits(df: DataFrame) -> DataFrame:
    """Add `too_long`: names of the columns over their byte limit."""
    over = [F.when(F.octet_length(c) > n, F.lit(c)) for c, n in COLUMN_LIMITS.items()]
    return df.withColumn("too_long", F.array_compact(F.array(*over)))


def split_valid(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows without the error column, and the rejects with it."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def ingest_outcome(df: DataFrame, mode: str, min_severity: str | None = None) -> DataFrame:
    """Add `outcome` (ingested or filtered) for the modes that decide row by row."""
    if check_mode(mode) == "severity" and min_severity:
        keep = severity_rank(F.col("severity")) >= rank_of(min_severity)
        return df.withColumn("outcome", F.when(keep, "ingested").otherwise("filtered"))
    return df.withColumn("outcome", F.lit("ingested"))


def ingest_stats(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row: ingested, deduplicated and filtered counts of an outcome column."""
    one = F.lit(1) if weight is None else weight

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("outcome") == name, one)), F.lit(0)).cast("bigint").alias(name)

    return df.agg(total("ingested"), total("deduplicated"), total("filtered"))
