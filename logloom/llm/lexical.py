"""Ranked lexical search by norm buckets.

Teflioudi, Gemulla, Mykytiuk, "LEMP: Fast Retrieval of Large Entries in a Matrix Product", SIGMOD 2015. A score is the inner
product of a query with a document's impact vector. With both sides scaled by the root of the term's weight, a document is
the vector of sqrt(w) * impact over its terms and a query that of sqrt(w) over its own, so terms that are in nearly all
documents add next to nothing to a length. Vectors are sorted by length over the cluster and dealt into buckets; a task reads its
buckets in descending length.

* Cauchy-Schwarz: a bucket whose longest vector times the query's length is below the query's threshold holds no answer. The
  thresholds known before a pass are put to the scan as a filter on the length, so row groups that no query needs stay unread.
* Coordinates: inside a bucket a query looks at its heaviest terms only, as many as are needed so that what the others can add,
  again by Cauchy-Schwarz, is below the threshold. The postings of those terms give the candidates; what their other
  coordinates can add at most is bounded by what is left of both lengths.
* Survivors are scored anew in 64-bit integers over all terms.

Thresholds come from a first pass over the buckets with the longest vectors: the score of the last answer found so far, which
only rises. No bound drops a document whose score equals the threshold, so ties are whole and the answer is exact.

Queries are worked off in blocks of a bounded number of words; what is broadcast is a block's terms. Only terms of the block
are coordinates of a vector.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import drop, id_and_bytes, map_rows, materialize, stored, table, to_arrow
from logloom.llm.decontamination import words_of

#: Words of the queries that one block carries to the tasks, at most but for the last query.
BLOCK_WORDS = 500_000
#: Vectors of a bucket of the stored table, about, and the share of the buckets that gives the first thresholds.
BUCKET_ROWS, FIRST_SHARE = 20_000, 16
#: Bounds are held to this share more than themselves, far above the errors of their sums.
SLACK = 1 + 1e-9


class Block:
    """Queries with their distinct terms, numbered; weights are set once the corpus is counted."""

    def __init__(self, items: list[tuple]):
        self.number: dict[bytes, int] = {}
        self.items, self.terms = [], []
        for i, text in items:
            found = sorted({self.number.setdefault(w, len(self.number)) for w in words_of(text)})
            if found:
                self.items.append(i)
                self.terms.append(np.array(found, np.int64))
        self.weights = np.zeros(len(self.number), np.int64)

    def weigh(self, documents: int, holding: dict[int, int]) -> None:
        """floor(1000 ln((2 N + 2) / (2 df + 1))) of every term."""
        for k in range(len(self.weights)):
            self.weights[k] = math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(k, 0) + 1)))


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The queries in blocks, one of them in the driver at a time."""
    held, words = [], 0
    for row in id_and_bytes(items, id_col, text_col).orderBy("doc_id", "text").toLocalIterator():
        held.append((row["doc_id"], bytes(row["text"])))
        words += len(held[-1][1]) // 2 + 1  # at most so many
        if words >= block_words:
            yield Block(held)
            held, words = [], 0
    if held:
        yield Block(held)


def _counted(docs: DataFrame, block, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tf) of the texts with at least one term; n counts all their terms, the lists hold those of the block."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType())),
        ]
    )

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        get = block.value.number.get
        for i, text in texts:
            words = words_of(text)
            if words:
                found = Counter(map(get, words))
                found.pop(None, None)
                terms = sorted(found)
                yield i, len(words), terms, [found[t] for t in terms]

    return map_rows(id_and_bytes(docs, id_col, text_col), schema, rows, size=1024)


def _vectors(counted: DataFrame, block, documents: int, total: int) -> DataFrame:
    """(doc_id, length, terms, impacts) of the documents with a term of the block."""
    schema = T.StructType(
        [
            T.StructField("doc_id", counted.schema["doc_id"].dataType), T.StructField("length", T.DoubleType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("impacts", T.ArrayType(T.LongType())),
        ]
    )
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = block.value.weights
        for batch in batches:
            ids, n, terms, tf = (batch.column(k) for k in range(4))
            sizes = np.diff(terms.offsets.to_numpy())
            m = np.array([50 + (50 * x * documents) // total for x in n.to_pylist()], np.int64)
            flat, often = terms.flatten().to_numpy(), tf.flatten().to_numpy()
            impacts = (1_000_000_000 * often) // (1000 * often + 20 * np.repeat(m, sizes))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            length = np.sqrt(np.add.reduceat(weights[flat] * impacts.astype(np.float64) ** 2, offsets[:-1])) if len(ids) else np.zeros(0)
            lists = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(length), pa.ListArray.from_arrays(lists, pa.array(flat, pa.int32())), pa.ListArray.from_arrays(lists, pa.array(impacts, pa.int64()))],
                schema=arrow,
            )

    return counted.where(F.size("terms") > 0).mapInArrow(run, schema)


class Bucket:
    """Vectors of about one length, by rows and by terms."""

    def __init__(self, ids: list, length: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.ids, self.length, self.offsets, self.terms, self.impacts = ids, length, offsets, terms, impacts
        self.longest = float(length.max(initial=0))
        order = np.argsort(terms, kind="stable")
        self._rows = np.repeat(np.arange(len(ids)), np.diff(offsets))[order]
        self._of_term, self._impacts = terms[order], impacts[order]

    def postings(self, focus: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, impacts and index in `focus` of all entries of these terms."""
        low, high = (np.searchsorted(self._of_term, focus, side=s) for s in ("left", "right"))
        sizes = high - low
        at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self._rows[at], self._impacts[at], np.repeat(np.arange(len(focus)), sizes)

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Scores of some rows in integers; query: the weight of every term that it holds, else 0."""
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        at = np.repeat(self.offsets[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out = np.zeros(len(rows), np.int64)
        np.add.at(out, np.repeat(np.arange(len(rows)), sizes), query[self.terms[at]] * self.impacts[at])
        return out


class Searcher:
    """The answers of a task so far, for every query of a block."""

    def __init__(self, block: Block, k: int, thresholds: list[int]):
        self.block, self.k, self.weights = block, k, block.weights
        self.found: list[list[tuple]] = [[] for _ in block.items]
        self.least = list(thresholds)
        self.order, self.rest = [], []
        for terms in block.terms:
            heavy = terms[np.argsort(-self.weights[terms], kind="stable")]
            self.order.append(heavy)
            self.rest.append(np.sqrt(np.append(np.cumsum(self.weights[heavy][::-1])[::-1], 0).astype(np.float64)))
        self._query = np.zeros(len(self.weights), np.int64)
        self.scored = 0

    def read(self, bucket: Bucket) -> None:
        for q in range(len(self.order)):
            self._search(q, bucket)

    def _search(self, q: int, bucket: Bucket) -> None:
        least, rest = self.least[q], self.rest[q]
        if rest[0] * bucket.longest * SLACK < least:  # Cauchy-Schwarz
            return
        # the fewest heavy terms without which no row can reach the threshold; all of them while there is none
        upto = int(np.argmax(np.append(rest[:-1] * bucket.longest * SLACK < least, True)))
        focus = self.order[q][:upto]
        rows, impacts, of = bucket.postings(focus)
        weights = self.weights[focus][of].astype(np.float64)
        n = len(bucket.ids)
        part = np.bincount(rows, weights * impacts, n)
        if upto < len(self.order[q]):
            known = np.bincount(rows, weights * impacts.astype(np.float64) ** 2, n)
            part = part + rest[upto] * np.sqrt(np.maximum(0, bucket.length**2 * SLACK - known))
        rows = np.flatnonzero((part * SLACK >= least) & (part > 0))
        if not len(rows):
            return
        terms = self.block.terms[q]
        self._query[terms] = self.weights[terms]
        scores = bucket.exact(rows, self._query)
        self._query[terms] = 0
        self.scored += len(rows)
        keep = np.flatnonzero(scores >= max(1, least))
        if len(keep) > self.k:  # the best only, and all that equal the last of them
            keep = keep[scores[keep] >= np.partition(scores[keep], -self.k)[-self.k]]
        new = [(-int(scores[k]), bucket.ids[r] is None, bucket.ids[r]) for k, r in zip(keep.tolist(), rows[keep].tolist(), strict=True)]
        if new:
            self.found[q] = sorted([*self.found[q], *new])[: self.k]
            if len(self.found[q]) == self.k:
                self.least[q] = max(least, -self.found[q][-1][0])

    def answers(self) -> Iterator[tuple]:
        for q, found in enumerate(self.found):
            for score, _, i in found:
                yield q, i, -score


def _pass(vectors: DataFrame, block, k: int, thresholds: list[int]) -> DataFrame:
    """(query, doc_id, score): the k best of every task's vectors with the thresholds or more."""
    schema = T.StructType(
        [T.StructField("query", T.IntegerType()), T.StructField("doc_id", vectors.schema["doc_id"].dataType), T.StructField("score", T.LongType())]
    )
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Searcher(block.value, k, thresholds)
        for batch in batches:
            ids, length, terms, impacts = (batch.column(c) for c in range(4))
            offsets = terms.offsets.to_numpy().astype(np.int64)
            task.read(Bucket(ids.to_pylist(), length.to_numpy(), offsets - offsets[0], terms.flatten().to_numpy(), impacts.flatten().to_numpy()))
        rows = list(task.answers())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return vectors.select("doc_id", "length", "terms", "impacts").mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(spark: SparkSession, docs: DataFrame, block: Block, k: int, id_col: str, text_col: str, bucket_rows: int) -> DataFrame:
    """(query, doc_id, score, rank) of one block, written."""
    sent = spark.sparkContext.broadcast(block)
    counted, counted_path = stored(_counted(docs, sent, id_col, text_col), "term_counts")
    row = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for a term of the block at most
    block.weigh(row["docs"], {r["term"]: r["count"] for r in holding})
    sent.unpersist()
    sent = spark.sparkContext.broadcast(block)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-row["docs"] // bucket_rows))
    sized = _vectors(counted, sent, row["docs"], row["total"] or 1)
    dealt = sized.repartitionByRange(buckets, F.desc("length"), F.xxhash64("doc_id")).withColumn("bucket", F.spark_partition_id())
    vectors, path = stored(dealt.sortWithinPartitions(F.desc("length")), "impact_vectors")
    drop(spark, counted_path)

    first = -(-buckets // FIRST_SHARE)
    seen = materialize(_best(_pass(vectors.where(F.col("bucket") < first), sent, k, [0] * len(block.items)), k), "answers")
    last = {r["query"]: r["score"] for r in seen.where(F.col("rank") == k).select("query", "score").collect()}  # one for a query at most
    thresholds = [last.get(q, 0) for q in range(len(block.items))]
    reach = min((t / math.sqrt(s) for t, terms in zip(thresholds, block.terms, strict=True) if (s := int(block.weights[terms].sum()))), default=0.0)
    more = _pass(vectors.where((F.col("bucket") >= first) & (F.col("length") >= reach / SLACK)), sent, k, thresholds)
    out = materialize(_best(seen.drop("rank").union(more), k), "answers")
    drop(spark, path)
    return out


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_words: int = BLOCK_WORDS, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of every item with the highest scores above 0; equal scores by id, null last.

    Every row of `items` is a query of its own and every row of `docs` a document, also where rows or ids repeat; queries
    without terms have no answers. Terms, weights and scores are whole numbers as described in `Block.weigh` and `_vectors`:
    the score is the sum of w * ((10^9 tf) div (1000 tf + 20 m)) over the distinct terms of the query, with
    m = 50 + (50 n N) div L. A null text has no terms; no documents give no rows.
    """
    spark = docs.sparkSession
    kind = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", items.schema[item_col].dataType)])
    parts = []
    for block in blocks(items, item_col, item_text_col, block_words):
        if block.items:
            found = _search_block(spark, docs, block, k, id_col, text_col, bucket_rows)
            names = spark.createDataFrame(list(enumerate(block.items)), kind)  # bounded by the block
            parts.append(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return docs.limit(0).select(
            F.lit(None).cast(items.schema[item_col].dataType).alias("item_id"), F.lit(0).alias("rank"),
            F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("score"),
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents of every item of the benchmark."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), q AS (
  SELECT row_number() OVER () AS q, item_id,
         list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM benchmark WHERE text IS NOT NULL
), c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * n) // l AS m FROM d, c WHERE len(w) > 0),
qt AS (SELECT q, item_id, unnest(w) AS t FROM q),
t AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY r, t),
wt AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, c GROUP BY t, n),
s AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM qt JOIN t USING (t) JOIN wt USING (t) JOIN m USING (r) GROUP BY q, item_id, r, doc_id
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
