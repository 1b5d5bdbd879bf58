"""Nearest-neighbour search over vector tables, exact and by cells.

Queries meet vectors in blocks of bounded size: both are cut into blocks, and every pair of blocks is one cogroup
that returns its k best per query, never the pairs. Cells lie one after another in the blocks of vectors, small ones together, so a
query travels once to a block, whatever number of its cells it probes, and gets one list of hits from it. With `few`, which the caller chooses, the queries are fetched once,
travel to the scan tasks, and the vectors stay where they are. Queries of equal vectors have equal hits, so a table of queries with few
different vectors is searched like that too (`hits_by_vector`). A last window keeps the k best over all blocks. Exact search
of many queries is quadratic by definition; `knn_cells` is the way for large numbers of both.

Scores are FLOAT: squared distance for l2 (smaller first), similarity for cosine (larger first). Ties go to
the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from logloom.session import materialize

METRICS = ("l2", "cosine")
FEW_QUERIES = 256
#: Queries and vectors of a block at most, and numbers, which is what bounds it for long vectors.
QUERY_BLOCK, VECTOR_BLOCK, BLOCK_NUMBERS = 65_536, 65_536, 1 << 22
#: Queries from which a table of them is cut, up to so many parts, that the blocks occupy more tasks.
SMALL_PART, SMALL_PARTS = 4_096, 4
#: Rows of queries that are compared or sent at once, and distances of one comparison.
ROWS_AT_ONCE, DISTANCES_AT_ONCE = 512, 1 << 21


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(arr):
        return np.zeros((0, 0))
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.size % len(arr) or (np.diff(arr.offsets.to_numpy()) != flat.size // len(arr)).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(arr), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def _best(q: np.ndarray, v: np.ndarray, v_order: np.ndarray, k: int, metric: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query row the positions and float32 scores of its k best vectors.

    A matrix product narrows the field with a margin; the survivors are scored term by term, so equal
    vectors get equal scores whatever block they sit in.
    """
    if metric == "cosine":
        q, v = _unit(q), _unit(v)
    v_norm = (v * v).sum(axis=1)
    out, step = [], max(1, min(256, DISTANCES_AT_ONCE // max(1, len(v))))
    for start in range(0, len(q), step):
        part = q[start : start + step]
        p_norm = (part * part).sum(axis=1)
        rough = v_norm - 2 * (part @ v.T) if metric == "l2" else -(part @ v.T)
        margin = 1e-6 * (1 + p_norm + v_norm.max())
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(v) else np.full(len(part), np.inf)
        for i, x in enumerate(part):
            near = np.flatnonzero(rough[i] <= kth[i] + margin[i])
            cand = v[near]
            exact = ((cand - x) ** 2).sum(axis=1) if metric == "l2" else (cand * x).sum(axis=1)
            score = exact.astype(np.float32)
            order = np.lexsort((v_order[near], score if metric == "l2" else -score))[:k]
            out.append((near[order], score[order]))
    return out


def _order_of(ids: pa.Array) -> np.ndarray:
    """Sort rank of every id."""
    return pc.rank(ids, tiebreaker="dense").to_numpy()


def _hits(q_ids: pa.Array, v_ids: pa.Array, best: list, schema: pa.Schema) -> pa.RecordBatch:
    sizes = [len(p) for p, _ in best]
    rows = np.repeat(np.arange(len(best)), sizes)
    cols = np.concatenate([p for p, _ in best]) if best else np.zeros(0, dtype=int)
    scores = np.concatenate([s for _, s in best]) if best else np.zeros(0, dtype=np.float32)
    return pa.RecordBatch.from_arrays(
        [q_ids.take(pa.array(rows)), v_ids.take(pa.array(cols)), pa.array(scores, pa.float32())], schema=schema
    )


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _top(found: DataFrame, k: int, metric: str, ids: Column | None = None) -> DataFrame:
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    w = Window.partitionBy("query_id").orderBy(order, F.col("id") if ids is None else ids)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _prepared(queries: DataFrame, vectors: DataFrame, metric: str) -> tuple[DataFrame, DataFrame, str, pa.Schema]:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    q = queries.select("query_id", "query_vector").filter("query_vector is not null")
    v = vectors.select("id", "vector").filter("vector is not null")
    q_type, v_type = q.schema["query_id"].dataType, v.schema["id"].dataType
    ddl = f"query_id {q_type.simpleString()}, id {v_type.simpleString()}, score float"
    arrow = pa.schema(
        [("query_id", to_arrow_type(q_type)), ("id", to_arrow_type(v_type)), ("score", pa.float32())]
    )
    return q, v, ddl, arrow


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "l2", few: bool = False) -> DataFrame:
    """The k nearest vectors of every query: query_id, id, score, rank.

    queries: query_id, query_vector; vectors: id, vector. few: there are at most FEW_QUERIES queries; this runs them at
    once, when the plan is built, and more are an error. By default nothing runs before the result is asked for.
    """
    q, v, ddl, arrow = _prepared(queries, vectors, metric)
    if few:
        rows = q.limit(FEW_QUERIES + 1).collect()
        if len(rows) > FEW_QUERIES:
            raise ValueError(f"more than {FEW_QUERIES} queries: leave out `few`")
        return _top(_scan_with(rows, vectors.select("id", "vector"), k, metric, ddl, arrow), k, metric)
    return _top(_by_blocks(*_one_cell(q, v), k, metric, ddl, arrow), k, metric)


def hits_by_vector(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame | None:
    """The k nearest vectors of every different vector of the queries: query_vector, id, score; None if there are more than FEW_QUERIES.

    This runs the search when the plan is built and writes its hits, which are few whatever number of queries there is.
    """
    # the count keeps a `distinct` of the queries in the plan, and a filter would go below it: a model would get their repeats
    rows = queries.groupBy("query_vector").count().limit(FEW_QUERIES + 2).collect()
    own = [(r.query_vector, r.query_vector) for r in rows if r.query_vector is not None]
    if len(own) > FEW_QUERIES:
        return None
    _, _, ddl, arrow = _prepared(queries.select(F.col("query_vector").alias("query_id"), "query_vector"), vectors, metric)
    scanned = _scan_with(own, vectors.select("id", "vector"), k, metric, ddl, arrow)
    found = _top(scanned, k, metric, F.col("id").asc_nulls_last())  # a missing id last, as in a block
    return materialize(found.select(F.col("query_id").alias("query_vector"), "id", "score"), "hits")


def hits_of_queries(queries: DataFrame, found: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """What `knn` returns for the queries, from the hits of their vectors."""
    same = F.col("q.query_vector").eqNullSafe(F.col("v.query_vector"))  # a plain comparison brings a filter along, see above
    return _top(queries.alias("q").join(found.alias("v"), same).select("q.query_id", "v.id", "v.score"), k, metric)


def _scan_with(few: list, v: DataFrame, k: int, metric: str, ddl: str, arrow: pa.Schema) -> DataFrame:
    """At most FEW_QUERIES queries go along with the tasks that scan the vectors.

    Missing vectors are left out here: a filter on a column that a model makes would make it twice.
    """
    q_ids = pa.array([r[0] for r in few], arrow.field("query_id").type)
    q = np.array([r[1] for r in few], dtype=np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_ids, kept = None, None  # the k best so far are part of the next round
        for b in batches:
            if not len(q_ids):
                continue
            if b.column("vector").null_count:
                b = b.filter(b.column("vector").is_valid())
            if not b.num_rows:
                continue
            ids, m = b.column("id"), _matrix(b.column("vector"))
            if kept is not None:
                ids = pa.concat_arrays([kept_ids, ids])
                m = np.concatenate([kept, m])
            best = _best(q, m, _order_of(ids), k, metric)
            used = np.unique(np.concatenate([p for p, _ in best]))
            kept_ids, kept = ids.take(pa.array(used)), m[used]
        if kept is not None:
            yield _hits(q_ids, kept_ids, _best(q, kept, _order_of(kept_ids), k, metric), arrow)

    return v.mapInArrow(scan, ddl)


def _block_rows(dim: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(VECTOR_BLOCK), F.floor(F.lit(BLOCK_NUMBERS) / F.greatest(dim, F.lit(1)))))


def _one_cell(q: DataFrame, v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and vectors with their blocks, if every query meets every vector; nothing runs for it."""
    # one cell, as an expression that is no literal: the key of the joins stays a key
    q, v = (df.withColumn("cell", F.pmod(F.xxhash64(key), F.lit(1)).cast("int")) for df, key in ((q, "query_id"), (v, "id")))
    size = F.broadcast(
        v.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"))
        .select("cell", F.ceil(F.col("n") / _block_rows(F.col("dim"))).cast("int").alias("blocks"))
    )
    sent = q.join(size, "cell").select(
        "query_id", "query_vector", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.array(F.lit(0)).alias("cells")
    )
    dealt = v.join(size, "cell").select("id", "vector", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "cell")
    return sent, dealt


def _cells_in_blocks(
    q: DataFrame, v: DataFrame, sizes: list[tuple[int, int]], dim: int, opened: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]
) -> tuple[DataFrame, DataFrame]:
    """Queries and vectors (id, vector, cell) with their blocks; sizes: the number of vectors of every cell that has some.

    opened: from a batch of at most ROWS_AT_ONCE rows of q and its matrix, whether a query probes a cell, a column per cell.
    """
    spark, rows = v.sparkSession, max(1, min(VECTOR_BLOCK, BLOCK_NUMBERS // max(1, dim)))
    cells = np.array([c for c, _ in sizes], np.int64)
    end = np.cumsum([n for _, n in sizes]).astype(np.int64)
    begin = end - np.array([n for _, n in sizes], np.int64)
    first, last = begin // rows, (end - 1) // rows
    places = spark.createDataFrame(
        [(int(c), int(e - n), int(n)) for (c, n), e in zip(sizes, end, strict=True)], "cell int, begin long, n long"
    )
    at = F.floor((F.col("begin") + F.pmod(F.xxhash64("id"), F.col("n"))) / rows).cast("int")
    dealt = v.join(F.broadcast(places), "cell").select("id", "vector", at.alias("block"), "cell")
    held = [(b, np.flatnonzero((first <= b) & (last >= b))) for b in range(int(last[-1]) + 1 if len(last) else 0)]
    names = ["query_id", "query_vector", "block", "cells"]
    schema = T.StructType([
        *(q.schema[n] for n in names[:2]), T.StructField("block", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))
    ])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                ids, vectors = part.column("query_id"), part.column("query_vector")
                probed = opened(part, _matrix(vectors))[:, cells]
                for b, own in held:
                    here = probed[:, own]
                    some = np.flatnonzero(here.any(axis=1))
                    if not len(some):
                        continue
                    row, cell = np.nonzero(here[some])
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(some)))])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cells[own[cell]], pa.int32()))
                    taken = pa.array(some)
                    yield pa.RecordBatch.from_arrays([ids.take(taken), vectors.take(taken), pa.array(np.full(len(some), b), pa.int32()), lists], names=names)

    return q.mapInArrow(send, schema), dealt


def _best_of_cells(
    q: np.ndarray, probed: pa.Array, v: np.ndarray, cell: np.ndarray, v_order: np.ndarray, k: int, metric: str
) -> list[tuple[np.ndarray, np.ndarray]]:
    """As `_best`, where a query meets the vectors of the cells in its list only."""
    here, sizes = np.unique(cell, return_counts=True)
    by_cell = np.split(np.argsort(cell, kind="stable"), np.cumsum(sizes)[:-1])
    offsets, values = probed.offsets.to_numpy(), probed.flatten().to_numpy()
    row = np.repeat(np.arange(len(q)), np.diff(offsets))
    if len(here) == 1 or len(row) == len(q) * len(here) and np.isin(values, here).all():
        meets = np.isin(values, here)
        if len(here) > 1 or np.bincount(row[meets], minlength=len(q)).all():
            return _best(q, v, v_order, k, metric)
    rows, found, scores = [], [], []
    for c, members in zip(here.tolist(), by_cell, strict=True):
        asked = row[values == c]
        if not len(asked):
            continue
        best = _best(q[asked], v[members], v_order[members], k, metric)
        rows.append(np.repeat(asked, [len(p) for p, _ in best]))
        found.append(members[np.concatenate([p for p, _ in best])])
        scores.append(np.concatenate([s for _, s in best]))
    if not rows:
        return [(np.zeros(0, int), np.zeros(0, np.float32))] * len(q)
    at, pos, score = np.concatenate(rows), np.concatenate(found), np.concatenate(scores)
    order = np.lexsort((v_order[pos], score if metric == "l2" else -score, at))
    cuts = np.searchsorted(at[order], np.arange(len(q) + 1))
    picked = [order[a : min(b, a + k)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [(pos[p], score[p]) for p in picked]


def _by_blocks(q: DataFrame, v: DataFrame, k: int, metric: str, ddl: str, arrow: pa.Schema) -> DataFrame:
    """Cogroup queries (query_id, query_vector, block, cells) with vectors (id, vector, block, cell); both sides of a block are bounded."""
    dim = F.coalesce(F.max(F.size("query_vector")), F.lit(1))
    large = F.ceil(F.count("*") / F.least(F.lit(QUERY_BLOCK), _block_rows(dim)))
    some = F.least(F.lit(SMALL_PARTS), F.ceil(F.count("*") / SMALL_PART))
    parts = F.broadcast(q.groupBy("block").agg(F.greatest(large, some).cast("int").alias("parts")))
    ql = q.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts"))).drop("parts")
    vl = v.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - F.lit(1).cast("long")))).drop("parts")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        v_ids = _flat(right.column("id"))
        m, cell, order = _matrix(right.column("vector")), right.column("cell").to_numpy(), _order_of(v_ids)
        batches = []
        for start in range(0, left.num_rows, SMALL_PART):
            part = left.slice(start, SMALL_PART).combine_chunks()
            found = _best_of_cells(_matrix(part.column("query_vector")), _flat(part.column("cells")), m, cell, order, k, metric)
            batches.append(_hits(_flat(part.column("query_id")), v_ids, found, arrow))
        return pa.Table.from_batches(batches, schema=arrow)

    return ql.groupBy("block", "part").cogroup(vl.groupBy("block", "part")).applyInArrow(best, ddl)


def train_cells(vectors: DataFrame, n_cells: int, seed: int = 7, iterations: int = 10) -> np.ndarray:
    """Centroids of n_cells cells, found by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=iterations, initMode="random").fit(data)
    return np.array(model.clusterCenters())


def assign_cells(df: DataFrame, vector: str, centroids: np.ndarray, n_probe: int = 1) -> DataFrame:
    """Add `cells`: the n_probe cells nearest to a vector, nearest first."""
    c_norm = (centroids * centroids).sum(axis=1)
    n = min(n_probe, len(centroids))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(col: pd.Series) -> pd.Series:
        found = []
        for i in range(0, len(col), 1024):
            m = np.stack(col.iloc[i : i + 1024].to_numpy()).astype(np.float64)
            order = np.argsort(c_norm - 2 * (m @ centroids.T), axis=1, kind="stable")[:, :n]
            found.extend(order.astype(np.int32))
        return pd.Series(found)

    return df.withColumn("cells", nearest(vector))


def probes(m: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Whether a cell is among the n nearest of a vector: a row per vector, a column per cell."""
    order = np.argsort((centroids * centroids).sum(axis=1) - 2 * (m @ centroids.T), axis=1, kind="stable")[:, :n]
    out = np.zeros((len(m), len(centroids)), bool)
    np.put_along_axis(out, order, True, axis=1)
    return out


def knn_cells(
    queries: DataFrame, vectors: DataFrame, centroids: np.ndarray, k: int = 10, metric: str = "l2", n_probe: int = 8
) -> DataFrame:
    """Approximate nearest neighbours: a query only meets the vectors of its n_probe nearest cells.

    Large cells are cut into blocks like the exact search, so a cell may hold any share of the vectors.
    """
    q, v, ddl, arrow = _prepared(queries, vectors, metric)
    v = assign_cells(v, "vector", centroids).select("id", "vector", F.col("cells")[0].alias("cell"))
    sizes = [tuple(r) for r in v.groupBy("cell").count().orderBy("cell").collect()]  # one row per cell
    sent, dealt = _cells_in_blocks(q, v, sizes, centroids.shape[1], lambda _, m: probes(m, centroids, n_probe))
    return _top(_by_blocks(sent, dealt, k, metric, ddl, arrow), k, metric)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact hits that the approximate search found."""
    found = approximate.select("query_id", "id").withColumn("hit", F.lit(1))
    return exact.join(found, ["query_id", "id"], "left").agg(
        (F.count("hit") / F.count("*")).alias("recall"), F.count("*").alias("expected")
    )
