"""Connected components of an edge table by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014. Every round is two joins on a node and its
smallest neighbour; the edges of a round are written to the shared folder, so a lost executor repeats one round at most
and nothing of the graph passes through the driver but a count and a checksum, which the write itself observes. The joins are
merges: a round is one job without broadcasts, each of which would cost the driver a job, a thread and a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logloom.llm.common import drop, stored

#: Edges of a partition: a table of few edges is not spread over many tasks, each of which would leave files behind.
EDGES_AT_ONCE = 1 << 18


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge, its root being the smallest node reachable, itself included.

    `edges` has two columns of one ordered type, in any direction; loops and repeated edges are harmless, edges with a
    null end are no edges. An empty table gives an empty result.
    """
    a, b = edges.columns
    spark = edges.sparkSession
    now, path, mark = _stored_marked(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    before = None
    for _ in range(most_rounds):
        if mark[0] == 0 or mark == before:
            break
        before, parts = mark, 1 + mark[0] // EDGES_AT_ONCE
        old = path
        now, path, mark = _stored_marked(_small_star(_large_star(now.coalesce(parts), parts), parts).coalesce(parts))
        drop(spark, old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()


def _stored_marked(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The edges written and read again, the path, and their number and checksums."""
    seen, of = Observation(), F.xxhash64("u", "v")
    marks = [F.count("*").alias("n"), F.bit_xor(of).alias("xor"), F.sum(of % 1_000_003).alias("sum")]
    now, path = stored(edges.observe(seen, *marks), "edges")
    got = seen.get
    return now, path, (got.get("n") or 0, got.get("xor"), got.get("sum"))


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.union(edges.select("v", "u"))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts)
    moved = both.where("v > u").join(smallest.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    moved = edges.join(smallest.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(smallest).coalesce(parts).distinct()
