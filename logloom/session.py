"""Session settings the operators rely on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings the operators need; nothing about cluster size is touched."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # duplicate JSON keys: the last one wins, as in the payload producers
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # the stateful processors keep several states per key
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def local_session(
    cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own. shared: spark.checkpoint.dir."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    builder = SparkSession.builder if shared is None else SparkSession.builder.config("spark.checkpoint.dir", shared)
    spark = (
        builder.master(f"local[{cores}]")
        .appName("logloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir, else the warehouse, which all executors share as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


_made: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables that this process wrote; results that still read them must be stored before."""
    conf = spark._jsc.hadoopConfiguration()
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def new_table_path(spark: SparkSession, name: str) -> str:
    """Path of a new table in the shared folder; `release` deletes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def write_table(df: DataFrame, path: str, **options: str) -> None:
    """Write an intermediate table, and delete the shuffle files of the write as soon as it has ended.

    Nothing reads them again; without the setting they stay until the driver happens to collect its garbage, so that the
    shuffles of many writes are on disk at once.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            conf.unset(FREE_SHUFFLES)
        else:
            conf.set(FREE_SHUFFLES, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage where several branches read one costly result; a lost executor then re-reads files
    instead of recomputing the branch.
    """
    path = new_table_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
