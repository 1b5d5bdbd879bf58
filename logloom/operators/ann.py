"""Search in a stored vector table: approximate by the measured number of cells, or exact with the cells as bounds.

A query meets the records of its nearest cells only. With few queries the cells are a filter of the read, so folders of other
cells stay unread; with many, queries and records meet by cell in blocks of a bounded size. The number of cells is the
one the store measured, unless it is given.

`search_exact` uses the same cells as bounds: no record of a cell is nearer to a query than the distance to the cell's centre
less that of the cell's farthest record. After the first probes every cell that the bound does not rule out is probed
as well, so the answer is that of a full scan whatever the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.knn import FEW_QUERIES, _by_blocks, _cells_in_blocks, _one_cell, _prepared, _scan_with, _top, probes
from logloom.session import materialize
from logloom.sources import vector_store


def _records(spark, path: str, where: Column | None, **span) -> DataFrame:
    rows = vector_store.read(spark, path, meta=True, **span)
    return rows if where is None else rows.where(where)


def _sizes(v: DataFrame) -> list:
    """(cell, n, reach) of the cells that have records, in order: one row for a cell."""
    return v.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("reach")).orderBy("cell").collect()


def _in_blocks(q: DataFrame, v: DataFrame, centres: np.ndarray, sizes: list, opened) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    v = v.select("id", "vector", "cell")
    if len(centres) == 1:
        return _one_cell(q, v)
    return _cells_in_blocks(q, v, [(r["cell"], r["n"]) for r in sizes], centres.shape[1], opened)


def search_store(
    queries: DataFrame, path: str, k: int = 10, metric: str = "l2", n_probe: int | None = None, few: bool = False,
    where: Column | None = None, since: Column | None = None, until: Column | None = None,
) -> DataFrame:
    """Nearest records of every query (query_id, query_vector): query_id, id, score, rank.

    where: a condition on the records' columns; it is put to the records before they are compared. few: as for `knn`.
    """
    spark = queries.sparkSession
    snap = vector_store.snapshot(spark, path)
    centres, n = vector_store.centroids(spark, path), n_probe or snap.n_probe
    if few:
        rows = queries.select("query_id", "query_vector").where("query_vector is not null").limit(FEW_QUERIES + 1).collect()
        if len(rows) > FEW_QUERIES:
            raise ValueError(f"more than {FEW_QUERIES} queries: leave out `few`")
        m = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
        cells = sorted(set(vector_store.probe_order(m, centres)[:, :n].ravel().tolist())) if rows else []
        v = _records(spark, path, where, since=since, until=until, cells=cells)
        _, v, ddl, arrow = _prepared(queries, v, metric)
        return _top(_scan_with(rows, v, k, metric, ddl, arrow), k, metric)
    v = _records(spark, path, where, since=since, until=until)
    q, _, ddl, arrow = _prepared(queries, v, metric)
    sizes = _sizes(v) if len(centres) > 1 else []
    met = _in_blocks(q, v, centres, sizes, lambda _, m: probes(m, centres, n))
    return _top(_by_blocks(*met, k, metric, ddl, arrow), k, metric)


def search_exact(queries: DataFrame, path: str, k: int = 10, first_probe: int = 1) -> DataFrame:
    """The k nearest records of every query by Euclidean distance, exactly: query_id, id, score, rank."""
    spark = queries.sparkSession
    centres = vector_store.centroids(spark, path)
    v = _records(spark, path, None)
    sizes = _sizes(v)
    q, _, ddl, arrow = _prepared(queries, v, "l2")
    met = _in_blocks(q, v, centres, sizes, lambda _, m: probes(m, centres, first_probe))
    first = _top(_by_blocks(*met, k, "l2", ddl, arrow), k, "l2")
    if len(centres) == 1:
        return first
    first = materialize(first, "first-hits")  # the bounds and the result read it
    least = first.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).cast("double").alias("least"))
    far = np.full(len(centres), -np.inf)
    far[[r["cell"] for r in sizes]] = [r["reach"] for r in sizes]

    def open_cells(rows: pa.RecordBatch, m: np.ndarray) -> np.ndarray:
        bound = rows.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
        away = np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] - 2 * m @ centres.T + (centres * centres).sum(1)))
        limit = np.where(np.isnan(bound), np.inf, np.sqrt(np.maximum(bound, 0)))
        open_ = away - far <= limit[:, None] * (1 + 1e-5) + 1e-6  # scores are single precision
        return open_ & ~probes(m, centres, first_probe)

    more = q.join(least, "query_id", "left").select("query_id", "query_vector", "least")
    rest = _by_blocks(*_in_blocks(more, v, centres, sizes, open_cells), k, "l2", ddl, arrow)
    return _top(first.select("query_id", "id", "score").union(rest.select("query_id", "id", "score")), k, "l2")
