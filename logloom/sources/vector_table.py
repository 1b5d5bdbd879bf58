"""The vector table: parquet, partitioned by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def record_id(*cols: Column) -> Column:
    """Stable id of a record from its content."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def write_vectors(df: DataFrame, path: str, mode: str = "append") -> None:
    """Insert records. Millisecond times, as the table keeps them."""
    rows = df.withColumn("ts", F.timestamp_millis(F.unix_millis("ts"))).withColumn("day", F.to_date("ts"))
    rows.write.mode(mode).partitionBy("day").parquet(path)


def read_vectors(
    spark: SparkSession, path: str, since: Column | None = None, until: Column | None = None
) -> DataFrame:
    """Records of a time span; the day bounds prune partitions, the exact bounds reach the scan."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.filter((F.col("day") >= F.to_date(since)) & (F.col("ts") >= since))
    if until is not None:
        df = df.filter((F.col("day") <= F.to_date(until)) & (F.col("ts") <= until))
    return df.drop("day", "batch")


def newest_per_id(df: DataFrame, order: list[str]) -> DataFrame:
    """Last version of every id; versions meet in a partial aggregate before the shuffle."""
    return df.groupBy("id").agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("v")).select("v.*")


def upsert_vectors(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming records replace current ones with the same id; the newest incoming version of an id counts.

    Only ids of the incoming side move when it is small: the planner turns the anti join into a broadcast.
    """
    fresh = newest_per_id(incoming, ["ts", "body"])
    return current.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def delete_vectors(current: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose id is not listed."""
    return current.join(ids.select("id").distinct(), "id", "left_anti")
