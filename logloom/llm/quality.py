"""Quality classifier: random-indexing word vectors, pooled per document, into a small calibrated network.

Kanerva, Kristofersson, Holst, "Random Indexing of Text Samples for Latent Semantic Analysis", CogSci 2000; Guo et al., "On
Calibration of Modern Neural Networks", ICML 2017.

Word vectors: every token has a sparse random index vector of +1 and -1; a token's context vector is the sum of the index
vectors of its neighbours, over all tokens of all documents. Tokens are hashed to `BUCKETS` buckets, so the sum is a matrix of
fixed size: each task adds up its own in integers, and the tasks' matrices are summed by a grouped aggregation over blocks
of buckets. Integer sums do not depend on the order, so reruns agree.

A document is the mean and the spread of the vectors of its tokens, and the logarithm of their number. A network with one
hidden layer, trained with numpy on a bounded sample of labelled rows, gives a logit, and a temperature fitted on rows that
the training did not see turns it into a probability.

Text becomes tokens as follows: runs of letters and digits (all bytes beyond ASCII are letters) keep their case, runs of
other visible characters are tokens of their own, and a run equal to the one before it is the token "=", so repetition has a
context of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import bucket_of_id, id_and_bytes, labelled, map_rows, table, to_arrow

BUCKETS, DIMS, NONZERO, WINDOW = 8192, 32, 4, 2
#: Labelled rows that the network is fitted on, at most.
SAMPLE = 20_000
#: Buckets per row while the matrices of tasks are summed.
BLOCK = 512
#: Tokens that are turned into vectors at once; a longer text is added up piece by piece.
PIECE = 1 << 17

_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x00-\x20\x7f]+")


def tokens(text: bytes) -> np.ndarray:
    """Buckets of the tokens of a text."""
    found = _TOKEN.findall(text)
    if not found:
        return np.zeros(0, np.int64)
    ids = np.fromiter(map(zlib.crc32, found), np.int64, len(found))
    ids[1:][ids[1:] == ids[:-1]] = zlib.crc32(b"=")
    return ids % BUCKETS


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of the index vector of every bucket, from a fixed seed."""
    rng = np.random.default_rng(20)
    where = rng.permuted(np.tile(np.arange(DIMS), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    return where, rng.choice([-1, 1], (BUCKETS, NONZERO))


def _context_sums(texts: Iterator[bytes]) -> np.ndarray:
    """Sum of the index vectors of the neighbours within the window, per bucket."""
    where, sign = index_vectors()
    total = np.zeros(BUCKETS * DIMS, np.int64)
    held, size = [], 0

    def add() -> None:
        ids = np.concatenate([held[0], *(x for t in held[1:] for x in (gap, t))])
        for step in range(1, WINDOW + 1):
            for at, by in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
                good = (at >= 0) & (by >= 0)
                at_, by_ = at[good] * DIMS, by[good]
                for k in range(NONZERO):
                    cell = at_ + where[by_, k]
                    plus = sign[by_, k] > 0
                    total[:] += np.bincount(cell[plus], minlength=total.size) - np.bincount(cell[~plus], minlength=total.size)

    gap = np.full(WINDOW, -1)
    for text in texts:
        ids = tokens(text)
        for a in range(0, len(ids), 4 * PIECE):
            held.append(ids[a : a + 4 * PIECE + WINDOW])  # neighbours across pieces of a very long text count from both
            size += len(held[-1])
            if size >= 4 * PIECE:
                add()
                held, size = [], 0
    if held:
        add()
    return total.reshape(BUCKETS, DIMS)


def word_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Context vectors of all buckets over all documents, of length 1, as float32 (BUCKETS, DIMS)."""
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _context_sums(t for b in batches for t in b.column(0).to_pylist())
        rows = sums.reshape(BUCKETS // BLOCK, BLOCK * DIMS)
        yield pa.RecordBatch.from_pydict({"block": np.arange(len(rows), dtype=np.int32), "sums": list(rows)}, arrow)

    parts = id_and_bytes(docs, id_col, text_col).select("text").mapInArrow(run, schema)
    summed = T.StructType(schema.fields)

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK * DIMS, np.int64)
        for batch in tables:
            for row in batch.column("sums"):
                total += row.values.to_numpy()
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "sums": [total]}, arrow)

    whole = np.zeros((BUCKETS // BLOCK, BLOCK * DIMS))
    for row in parts.groupBy("block").applyInArrow(add, summed).collect():  # BUCKETS x DIMS numbers, whatever the input
        whole[row["block"]] = row["sums"]
    vectors = whole.reshape(BUCKETS, DIMS)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a text's tokens, and the logarithm of their number; zeros for an empty text."""
    ids = tokens(text)
    n = len(ids)
    out = np.zeros(2 * vectors.shape[1] + 1)
    if n:
        first, second = np.zeros(vectors.shape[1]), np.zeros(vectors.shape[1])
        counts = np.bincount(ids, minlength=len(vectors)) if n > PIECE else None
        if counts is None:
            v = vectors[ids]
            first, second = v.sum(0, dtype=np.float64), np.einsum("ij,ij->j", v, v, dtype=np.float64)
        else:  # very long texts by the counts of their buckets
            first, second = counts @ vectors, counts @ (vectors.astype(np.float64) ** 2)
        mean = first / n
        out[: len(mean)], out[len(mean) : -1] = mean, np.sqrt(np.maximum(second / n - mean * mean, 0))
        out[-1] = np.log1p(n)
    return out


class Network:
    """Two layers with a hyperbolic tangent between them, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 7):
        """Fit to rows in hash order: the last fifth only sets the temperature. Without rows of both classes it is constant."""
        self.constant = None
        if len(x) < 2 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        cut = max(1, len(x) * 4 // 5)
        self.shift, self.scale = x[:cut].mean(0), x[:cut].std(0) + 1e-6
        z = (x - self.shift) / self.scale
        self.w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        t = 0
        for _ in range(rounds):
            for rows in np.array_split(rng.permutation(cut), max(1, cut // 128)):
                a, target = z[rows], y[rows]
                h = np.tanh(a @ self.w[0] + self.w[1])
                p = _sigmoid(h @ self.w[2] + self.w[3])
                d = (p - target) / len(rows)
                back = d[:, None] * self.w[2] * (1 - h * h)
                grads = [a.T @ back, back.sum(0), h.T @ d, d.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):  # Adam
                    g = g + decay * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        held, target = self.logit(x[cut:]), y[cut:]
        if len(held):
            tries = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
            loss = [np.logaddexp(0, np.where(target > 0, -1, 1) * held / s).mean() for s in tries]
            self.temperature = float(tries[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def score_quality(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    score is the probability that a text has quality 1, for null and empty texts too. Labels are read of at most `sample`
    rows whose crc32 of the id has remainder 1 to 4 modulo 5; with no such rows, or of one class only, the score is constant.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, id_col, text_col))
    width = 2 * DIMS + 1
    seen = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("order", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def features(rows: Iterator[tuple]) -> Iterator[tuple]:
        for label, order, text in rows:
            yield label, order, pooled(text, vectors.value).tolist()

    train = labelled(docs.withColumnRenamed(text_col, "text") if text_col != "text" else docs, labels, "quality", sample, id_col=id_col)
    got = map_rows(train.select("label", F.xxhash64("doc_id", "text").alias("order"), "text"), seen, features).collect()
    got.sort(key=lambda r: (r["order"], r["label"]))
    x = np.array([r["x"] for r in got]).reshape(len(got), width)
    model = spark.sparkContext.broadcast(Network(x, np.array([float(r["label"]) for r in got])))

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def scores(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        for row in rows:
            held.append((row[0], pooled(row[1], vectors.value)))
            if len(held) == 512:
                yield from _scored(held)
                held = []
        yield from _scored(held)

    def _scored(held: list[tuple]) -> Iterator[tuple]:
        if held:
            p = model.value.probability(np.array([x for _, x in held]))
            yield from zip((i for i, _ in held), p.tolist(), strict=True)

    return map_rows(id_and_bytes(docs, id_col, text_col), out, scores).select(
        "doc_id", (bucket_of_id(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` whose document is not rejected, with the same columns; of several rows with one id all must pass."""
    bad = score_quality(docs, labels, id_col=id_col, **options).where("predicted = 0").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
