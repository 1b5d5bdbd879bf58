"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Dong, Moses, Li, "Efficient K-Nearest Neighbor Graph Construction for Generic Similarity Measures", WWW 2011; search over a
neighbour graph with a bounded list of best nodes as in Malkov et al., 2014.

Building: equal vectors are one node, so any number of copies costs one. The first lists come from a few random partitions by
hyperplanes, whose large cells are divided by a hash. A round joins every node with its neighbours and with the nodes it is a
neighbour of, both limited to the list size, and the vectors of all these; among them, which are neighbours of neighbours of
each other, all distances are taken, and pairs that improve a list travel to it, the best few of a task only. Lists are
written after every round.

Searching: a query keeps its best nodes and those it has seen. Per step the nodes to visit are sent to the blocks of the graph
that hold them, a block answers with distances and the neighbours of the near ones, and the answers meet the query again. It
ends when no query finds a nearer unseen node. Queries are handled together but independently; their number may grow.

Distances are Euclidean, in double precision on the original components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import map_rows, materialize, table, to_arrow

#: Neighbours of a list, rounds, random partitions and their cell size, and best nodes that a query keeps.
LIST, ROUNDS, TREES, CELL, KEEP = 32, 3, 3, 512, 160
MOST_STEPS = 12
#: Nodes without further reason that a search may start from.
ENTRIES = 8
BLOCK_BYTES = 4 << 20

_LISTS = T.StructType([T.StructField("node", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("dists", T.BinaryType())])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor zero, all components finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part, components as bytes of doubles."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vec", T.BinaryType())])

    def rows(inputs: Iterator[tuple]) -> Iterator[tuple]:
        return ((i, (np.array(v, np.float64) + 0.0).tobytes()) for i, v in inputs)

    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    return map_rows(given, schema, rows)


def _matrix(column) -> np.ndarray:
    """Rows of bytes as a matrix of doubles."""
    column = list(column)
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _merge(lists: list[tuple[bytes, bytes]], k: int, node: int) -> tuple[bytes, bytes]:
    """The k nearest distinct nodes of several lists, without the node itself; ties to the smaller node."""
    ids = np.concatenate([np.frombuffer(a, np.int64) for a, _ in lists])
    dists = np.concatenate([np.frombuffer(b, np.float64) for _, b in lists])
    order = np.lexsort((ids, dists))
    ids, dists = ids[order], dists[order]
    first = np.sort(np.unique(ids, return_index=True)[1])
    first = first[ids[first] != node][:k]
    return ids[first].tobytes(), dists[first].tobytes()


def _joined(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray, k: int) -> Iterator[tuple]:
    """Lists (node, ids, dists) of the pairs a -> b at distance d, at most k of each a."""
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, d = a[fresh], b[fresh], d[fresh]
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
        e = min(e, s + k)
        yield int(nodes[a[s]]), b[s:e].tobytes(), d[s:e].tobytes()


def first_lists(nodes: DataFrame, n: int, k: int, trees: int, cell: int, seed: int) -> DataFrame:
    """Lists from random partitions of the nodes: exact inside a cell of about `cell` nodes."""
    row = nodes.select(F.octet_length("vec")).first()
    width = row[0] // 8
    schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("node", T.LongType()), T.StructField("vec", T.BinaryType())])
    depth = max(0, math.ceil(math.log2(max(1, n / cell))))
    sums = T.StructType([T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def add(rows: Iterator[tuple]) -> Iterator[tuple]:
        total, count = np.zeros(width), 0
        for (v,) in rows:
            total += np.frombuffer(v, np.float64)
            count += 1
        yield count, total.tolist()

    parts = map_rows(nodes.select("vec"), sums, add).select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.round("x", 6).cast("decimal(38,6)")).alias("x"))
    middle = np.zeros(width)
    for r in parts.collect():  # one number per component
        middle[r["at"]] = float(r["x"]) / n

    def coded(rows: Iterator[tuple]) -> Iterator[tuple]:
        planes = np.random.default_rng(seed).normal(size=(width, trees * max(1, depth)))
        for node, v in rows:
            side = ((np.frombuffer(v, np.float64) - middle) @ planes > 0).reshape(trees, -1)[:, :depth]
            for t in range(trees if depth else 1):
                yield t, int(side[t] @ (1 << np.arange(depth))), node, v

    cells = materialize(map_rows(nodes, schema, coded), "cells")
    sizes = cells.groupBy("tree", "code").count()
    divided = cells.join(sizes, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("count") / (1.5 * cell))))
    arrow = to_arrow(_LISTS)

    def inside(group: pa.Table) -> pa.Table:
        ids, x = np.array(group.column("node").to_pylist(), np.int64), _matrix(group.column("vec").to_pylist())
        m, out = min(k, len(ids) - 1), ([], [], [])
        for at in range(0, len(ids) if m > 0 else 0, 256):
            d = _distances(x[at : at + 256], x)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            for r in range(len(d)):
                out[0].append(int(ids[at + r]))
                out[1].append(ids[near[r]].tobytes())
                out[2].append(d[r, near[r]].tobytes())
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return divided.groupBy("tree", "code", "part").applyInArrow(inside, _LISTS)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows by the scalar product; good to order pairs, not the exact score."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def _together(lists: DataFrame, k: int) -> DataFrame:
    """One list per node."""

    def rows(inputs: Iterator[tuple]) -> Iterator[tuple]:
        for node, given in inputs:
            yield node, *_merge([(g["ids"], g["dists"]) for g in given], k, node)

    return map_rows(lists.groupBy("node").agg(F.collect_list(F.struct("ids", "dists")).alias("all")), _LISTS, rows, size=1024)


def _edges(graph: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("d", T.DoubleType())])

    def rows(inputs: Iterator[tuple]) -> Iterator[tuple]:
        for node, ids, dists in inputs:
            for b, d in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(dists, np.float64).tolist(), strict=True):
                yield node, b, d

    return map_rows(graph.select("node", "ids", "dists"), schema, rows, size=16384)


def _reverse(edges: DataFrame, k: int) -> DataFrame:
    """(a, b): for each a the k nearest nodes b that have a in their list; limited before and after the shuffle."""
    rank = F.row_number().over(Window.partitionBy("b").orderBy("d", "a"))
    return edges.withColumn("r", rank).where(F.col("r") <= k).select(F.col("b").alias("a"), F.col("a").alias("b"))


def _descend(nodes: DataFrame, graph: DataFrame, k: int, sent: int) -> DataFrame:
    """Lists after a round of neighbours of neighbours."""
    edges = materialize(_edges(graph), "graph_edges")
    around = edges.select("a", "b").union(_reverse(edges, k)).union(graph.select(F.col("node").alias("a"), F.col("node").alias("b"))).distinct()
    worst = edges.groupBy("a").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
    known = nodes.join(worst.withColumnRenamed("a", "node"), "node", "left").select(
        F.col("node").alias("b"), "vec", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(float("inf"))).alias("worst")
    )
    met = around.join(known, "b").groupBy("a").agg(F.collect_list(F.struct("b", "worst", "vec")).alias("all"))

    def rows(inputs: Iterator[tuple]) -> Iterator[tuple]:
        pairs: list[tuple] = []
        size = 0

        def flush() -> Iterator[tuple]:
            a, b, d = (np.concatenate([p[j] for p in pairs]) for j in range(3))
            names, at = np.unique(a, return_inverse=True)
            yield from _joined(names, at, b, d, k)

        for (given,) in inputs:
            if len(given) < 2:
                continue
            ids = np.array([g["b"] for g in given], np.int64)
            worst = np.array([g["worst"] for g in given])
            d = _distances(*(2 * [_matrix(g["vec"] for g in given)]))
            np.fill_diagonal(d, np.inf)
            if len(ids) > sent:  # of each node the nearest few of this meeting
                near = np.argpartition(d, sent - 1, axis=1)[:, :sent]
            else:
                near = np.tile(np.arange(len(ids)), (len(ids), 1))
            dn = np.take_along_axis(d, near, 1)
            r, c = np.nonzero(dn < worst[:, None])
            pairs.append((ids[r], ids[near[r, c]], dn[r, c]))
            size += len(r)
            if size > 1_000_000:
                yield from flush()
                pairs, size = [], 0
        if size:
            yield from flush()

    better = map_rows(met.select("all"), _LISTS, rows, size=2048)
    return _together(better.union(graph.select("node", "ids", "dists")), k)


def build(vectors: DataFrame, k: int = LIST, rounds: int = ROUNDS, trees: int = TREES, cell: int = CELL, sent: int = 12, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The index of the rows that take part: (node, vec, near) and (node, vec_id).

    A node is a distinct vector, named by its smallest id; near: bytes of the nodes of its list and of the nodes that have
    it in theirs. Every row is indexed.
    """
    rows = materialize(packed(vectors, id_col, vector_col).distinct(), "vectors")
    nodes = materialize(rows.groupBy("vec").agg(F.min("vec_id").alias("node")).select("node", "vec"), "nodes")
    members = materialize(rows.join(nodes, "vec").select("node", "vec_id"), "members")
    n = nodes.count()
    near = T.StructType([T.StructField("node", T.LongType()), T.StructField("near", T.BinaryType())])
    if n < 2:
        return nodes.withColumn("near", F.lit(b"")), members
    graph = materialize(_together(first_lists(nodes, n, k, trees, cell, seed), k), "graph")
    for _ in range(rounds if n > cell else 0):
        graph = materialize(_descend(nodes, graph, k, sent), "graph")
    edges = _edges(graph)

    def lists(inputs: Iterator[tuple]) -> Iterator[tuple]:
        return ((a, np.array(bs, np.int64).tobytes()) for a, bs in inputs)

    around = edges.select("a", "b").union(_reverse(edges, 2 * k)).distinct().groupBy("a").agg(F.collect_list("b").alias("all"))
    linked = map_rows(around, near, lists, size=1024)
    index = nodes.join(linked, "node", "left").select("node", "vec", F.coalesce("near", F.lit(b"")).alias("near"))
    return materialize(index, "index"), members


_STATE = T.StructType(
    [
        T.StructField("query_id", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("ids", T.BinaryType()),
        T.StructField("dists", T.BinaryType()), T.StructField("seen", T.BinaryType()), T.StructField("visit", T.BinaryType()),
    ]
)
_ASK = T.StructType([T.StructField("block", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("visit", T.BinaryType()), T.StructField("worst", T.DoubleType())])
_ANSWER = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("dists", T.BinaryType()), T.StructField("near", T.ArrayType(T.BinaryType()))])


def search(index: DataFrame, queries: DataFrame, keep: int = KEEP, most_steps: int = MOST_STEPS) -> DataFrame:
    """(query_id, node, dist): the `keep` nearest nodes found of each query; `queries` has query_id, vec and start.

    start: bytes of the nodes to begin with. A step visits all unseen neighbours of all nodes that came among the best in the
    step before, so the work of a query is bounded by the nodes it finds near.
    """
    n, width = index.agg(F.count("*"), F.max(F.octet_length("vec") + F.octet_length("near"))).first()
    blocks = max(1, math.ceil((n or 0) * (width or 0) / BLOCK_BYTES))
    held = materialize(index.withColumn("block", F.pmod("node", F.lit(blocks))), "blocks")
    state = materialize(
        queries.select(F.col("query_id").cast("long"), "vec", F.lit(b"").alias("ids"), F.lit(b"").alias("dists"), F.lit(b"").alias("seen"), F.col("start").alias("visit")), "search"
    )

    def ask(rows: Iterator[tuple]) -> Iterator[tuple]:
        for query, vec, ids, dists, _, visit in rows:
            nodes = np.frombuffer(visit, np.int64)
            worst = float(np.frombuffer(dists, np.float64)[-1]) if len(ids) >= 8 * keep else math.inf
            at = nodes % blocks
            for b in np.unique(at).tolist():
                yield b, query, vec, nodes[at == b].tobytes(), worst

    def answer(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in _ANSWER.names}
        if len(block):
            order = np.argsort(block["node"].to_numpy())
            names, x, near = block["node"].to_numpy()[order], _matrix(block["vec"])[order], block["near"].to_numpy()[order]
            for query, vec, visit, worst in zip(asked["query_id"], asked["vec"], asked["visit"], asked["worst"], strict=True):
                ids = np.frombuffer(visit, np.int64)
                at = np.minimum(np.searchsorted(names, ids), len(names) - 1)
                at = at[names[at] == ids]
                d = np.sqrt(((x[at] - np.frombuffer(vec, np.float64)) ** 2).sum(1))
                best = np.argsort(d, kind="stable")[:keep]
                best = best[d[best] <= worst]
                for c, v in zip(_ANSWER.names, (query, names[at[best]].tobytes(), d[best].tobytes(), [bytes(z) for z in near[at[best]]]), strict=True):
                    out[c].append(v)
        return pd.DataFrame(out, dtype=object)  # without rows, too

    def merged(before: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in _STATE.names}
        for r in before.itertuples():
            lists = [np.frombuffer(r.ids, np.int64), *(np.frombuffer(b, np.int64) for b in found["ids"])]
            ids = np.concatenate(lists)
            dists = np.concatenate([np.frombuffer(r.dists, np.float64), *(np.frombuffer(b, np.float64) for b in found["dists"])])
            fresh = np.arange(len(ids)) >= len(lists[0])
            near = [z for row in found["near"] for z in row]
            order = np.lexsort((ids, dists))[:keep]
            chosen = [near[k - len(lists[0])] for k in order[fresh[order]].tolist()]
            seen = np.union1d(np.frombuffer(r.seen, np.int64), np.frombuffer(r.visit, np.int64))
            around = np.unique(np.frombuffer(b"".join(chosen), np.int64))
            visit = np.setdiff1d(around, seen, assume_unique=True)
            for c, v in zip(_STATE.names, (r.query_id, r.vec, ids[order].tobytes(), dists[order].tobytes(), seen.tobytes(), visit.tobytes()), strict=True):
                out[c].append(v)
        return pd.DataFrame(out, dtype=object)  # without rows, too

    for _ in range(most_steps):
        asked = map_rows(state.where(F.octet_length("visit") > 0), _ASK, ask, size=512)
        answers = asked.groupBy("block").cogroup(held.groupBy("block")).applyInPandas(answer, _ANSWER)
        state = materialize(state.groupBy("query_id").cogroup(answers.groupBy("query_id")).applyInPandas(merged, _STATE), "search")
        if state.where(F.octet_length("visit") > 0).isEmpty():
            break
    flat = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("dist", T.DoubleType())])

    def rows(inputs: Iterator[tuple]) -> Iterator[tuple]:
        for query, ids, dists in inputs:
            for a, d in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(dists, np.float64).tolist(), strict=True):
                yield query, a, d

    return map_rows(state.select("query_id", "ids", "dists"), flat, rows)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that `queries`, a condition on vec_id, selects: the k nearest others found.

    Ties go to the smaller id, copies of a vector included. Rows that do not take part are neither queries nor candidates;
    a row that is repeated counts once. Queries start at their own node of the graph and at a few others.
    """
    index, members = build(vectors, id_col=id_col, vector_col=vector_col, **options)
    entries = [r[0] for r in index.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES).collect()]
    own = members.where(queries).join(index.select("node", "vec"), "node")
    starts = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("start", T.BinaryType())])

    def begin(rows: Iterator[tuple]) -> Iterator[tuple]:
        for query, node, vec in rows:
            yield query, vec, np.unique(np.array([node, *entries], np.int64)).tobytes()

    found = search(index, map_rows(own.select("vec_id", "node", "vec"), starts, begin))
    by_id = Window.partitionBy("node").orderBy("vec_id")
    firsts = members.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).drop("r")  # no more of a node can be among k
    by_near = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return (
        found.join(firsts, "node")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(by_near))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("dist").alias("score"))
    )


def op5_nn_descent(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
