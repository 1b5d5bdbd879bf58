"""Helpers shared by the operators of this folder.

Conventions of all operators: they select the columns they need by name, so further columns, whatever their names, neither
clash nor travel along; a null text is an empty text; a null id is a value like any other; rows that are equal get equal
results; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.session import materialize, new_table_path, write_table

__all__ = ["bucket_of_id", "drop", "id_and_bytes", "labelled", "map_rows", "materialize", "stored", "table", "to_arrow"]

#: The only characters that separate words, as a pattern of the regular-expression engines.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As materialize, compressed harder and with the path, for large tables that `drop` deletes when they have served."""
    path = new_table_path(df.sparkSession, name)
    write_table(df, path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the UTF-8 bytes of the whole text; a null text is empty."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )


def bucket_of_id(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def map_rows(
    df: DataFrame, schema: T.StructType, rows: Callable[[Iterator[tuple]], Iterable[tuple]], size: int = 4096
) -> DataFrame:
    """`rows` turns the tuples of a partition, read lazily, into tuples of `schema`; both travel as Arrow batches."""
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):  # Python objects of a few rows at a time
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)

        out: list[tuple] = []
        for row in rows(tuples()):
            out.append(row)
            if len(out) == size:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int = 5, id_col: str = "doc_id"
) -> DataFrame:
    """At most `most` labelled documents for training: (doc_id, text bytes, label), never one whose id has remainder 0.

    The rows are those with the smallest hashes of their id, so the sample does not follow the order of the table. Of
    several labels of one id the larger counts; null labels are none. `most` bounds the id list that is broadcast and
    what the caller may collect.
    """
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of_id(modulus) != 0))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return id_and_bytes(docs, id_col).join(F.broadcast(chosen), "doc_id")


def crc(text: bytes) -> int:
    return zlib.crc32(text)
