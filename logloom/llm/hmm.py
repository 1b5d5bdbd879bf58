"""Language-model scoring with a hidden Markov model over word classes.

Rabiner, "A Tutorial on Hidden Markov Models", Proc. IEEE 1989; Brown et al., "Class-Based n-gram Models of Natural Language",
1992. A text is its words and one end. A word is emitted by its class, a class by a latent state, and the states form a Markov
chain that stops after the end:

    P(text) = sum over state paths of  prod P(state | state before) P(class of word | state)   x   prod P(word | class)

P(word | class) comes from the counts of all training words, by a grouped aggregation whose size follows the vocabulary. The
classes are a fixed number: the most frequent words alone, all others by a hash of their last letters. So the tables that the
states need, states x classes, have a fixed size whatever the corpus: each task of a Baum-Welch round runs the scaled forward
and backward recursions over its texts and returns the expected counts, which are summed by a grouped aggregation.

Training sequences are runs of at most `SEGMENT` words, all of all training texts. Scoring is the exact scaled forward
recursion over whole texts.

Words meet their counts without a row per word and text: runs of texts are batches of a bounded size, each batch asks for the
counts of its distinct words once, and batch and answers meet in a cogroup. Batches are written when they are numbered, so
their numbers hold whatever is computed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import bucket_of_id, drop, id_and_bytes, map_rows, materialize, stored, table, to_arrow

STATES, HEAD_WORDS, TAIL_CLASSES, ROUNDS, SEGMENT = 8, 3000, 1024, 4, 256
#: Texts that the first emissions are taken from.
SEEDS = 400
#: Bytes of text of a batch that is scored at once, about.
BATCH_BYTES = 8 << 20
#: Positions that a training task holds at once.
CELLS = 1 << 18
#: Bytes of text whose words are counted or coded at once, about, and distinct words whose counts a task holds at most.
SLICE_BYTES, HELD_WORDS = 4 << 20, 400_000
END = b"\n"  # no word holds it
ALPHA = 0.1

COUNTS = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("c", T.LongType())])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between white space of ASCII, A-Z in lower case, of all texts end to end, and their number in each text; no ends."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, last = split.flatten().view(pa.binary()), np.cumsum(split.value_lengths().to_numpy())
    full = pc.greater(pc.binary_length(words), 0)  # white space at either side of a text leaves empty ones
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[np.concatenate([[0], last])]
    return words.filter(full), np.diff(upto)


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the end last; their numbers in all texts end to end, each with its end; tokens of each text."""
    words, lengths = words_of(texts)
    found = words.dictionary_encode()
    ids = np.insert(found.indices.to_numpy(), np.cumsum(lengths), len(found.dictionary))
    return pa.concat_arrays([found.dictionary, pa.array([END])]), ids, lengths + 1


def _slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of the texts of about `size` bytes, or one text."""
    run = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // size
    cuts = [*np.flatnonzero(np.diff(run, prepend=-1)).tolist(), len(run)]
    for a, b in zip(cuts, cuts[1:]):
        yield texts.slice(a, b - a)


class Classes:
    """Class of every word: its own for a frequent one, else one by the hash of its last letters."""

    def __init__(self, head: list[bytes]):
        self.own = {w: k for k, w in enumerate(head)}
        self.n = len(head) + TAIL_CLASSES

    def of(self, words: list[bytes]) -> np.ndarray:
        get, first, crc = self.own.get, len(self.own), zlib.crc32
        return np.fromiter(
            [k if (k := get(w)) is not None else first + crc(w.rstrip(b".,;:!?")[-3:]) % TAIL_CLASSES for w in words], np.int32, len(words)
        )


def _word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all training texts; tasks add up words before they shuffle them."""
    schema = to_arrow(COUNTS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for texts in _slices(batch.column(0), SLICE_BYTES):
                words, _ = words_of(texts)
                found = pc.value_counts(words)
                ends = pa.table([pa.array([END]), pa.array([len(texts)])], schema=schema)
                held += [pa.table(list(found.flatten()), schema=schema), ends]
                if sum(map(len, held)) > 2 * HELD_WORDS:
                    held = [_summed(held)]
                    if len(held[0]) > HELD_WORDS:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from _summed(held).to_batches()

    return train.select("text").mapInArrow(rows, COUNTS).groupBy("word").agg(F.sum("c").alias("c"))


def _summed(parts: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")])
    return total.select(["word", "c_sum"]).rename_columns(["word", "c"]).cast(parts[0].schema)


def _segments(texts: pa.Array, classes: Classes) -> Iterator[tuple[int, np.ndarray]]:
    """(1 if it begins a text, classes) of the runs of the texts."""
    for some in _slices(texts, SLICE_BYTES):
        words, ids, lengths = coded(some)
        ids = classes.of(words.to_pylist())[ids]
        for end, n in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
            for a in range(end - n, end, SEGMENT):
                yield int(a == end - n), ids[a : min(end, a + SEGMENT)]


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Time by sequence, longest first, padded with 0; lengths."""
    parts = sorted(parts, key=len, reverse=True)
    lengths = np.array([len(p) for p in parts])
    out = np.zeros((lengths[0], len(parts)), np.int32)
    for k, p in enumerate(parts):
        out[: len(p), k] = p
    return out, lengths


class Chain:
    """Probabilities of the chain; rows of `move` and `emit` sum to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def log10(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log10 probability of each sequence of classes, by the scaled forward recursion; longest first."""
        by_class, total = np.ascontiguousarray(self.emit.T), np.zeros(len(lengths))
        alive = np.searchsorted(-lengths, -np.arange(len(ids)), side="left")  # sequences longer than t
        alpha = np.tile(self.start, (len(lengths), 1))
        for t, n in enumerate(alive.tolist()):
            alpha = (alpha[:n] @ self.move if t else alpha) * by_class[ids[t, :n]]
            scale = alpha.sum(1)
            total[:n] += np.log10(scale)
            alpha /= scale[:, None]
        return total

    def expected(self, ids: np.ndarray, lengths: np.ndarray, first: np.ndarray, into: np.ndarray) -> None:
        """Add the expected counts of one Baum-Welch step to `into`: starts, moves, then emissions by state."""
        steps, k = len(ids), len(self.start)
        single = np.float32  # enough for counts of scaled probabilities; sums over sequences are double
        by_class, move = np.ascontiguousarray(self.emit.T, single), self.move.astype(single)
        alive = np.searchsorted(-lengths, -np.arange(steps), side="left")
        ends = np.cumsum(alive).tolist()
        at = [slice(end - n, end) for n, end in zip(alive.tolist(), ends, strict=True)]  # rows of a time, without padding
        flat = ids[np.arange(steps)[:, None] < lengths].astype(np.intp)
        likely = by_class[flat]
        alphas, scales = np.empty((len(flat), k), single), np.empty((len(flat), 1), single)
        for t, rows in enumerate(at):
            now = alphas[rows]
            if t:
                np.matmul(alphas[at[t - 1]][: len(now)], move, out=now)
            else:
                now[:] = self.start
            now *= likely[rows]
            now.sum(1, keepdims=True, out=scales[rows])
            now /= scales[rows]
        beta = np.ones((len(lengths), k), single)
        moves = np.zeros((k, k))
        for t in range(steps - 1, -1, -1):
            now = alphas[at[t]]
            if t + 1 < steps:
                ahead = likely[at[t + 1]]  # has served, so it may be overwritten
                ahead *= beta[: len(ahead)]
                ahead /= scales[at[t + 1]]
                moves += now[: len(ahead)].T @ ahead
                np.matmul(ahead, move.T, out=beta[: len(ahead)])
            now *= beta[: len(now)]  # now the probability of each state
        into[:k] += alphas[at[0]][first > 0].sum(0)
        into[k : k + k * k] += (moves * self.move).ravel()
        n = by_class.shape[0]
        for s, gamma in enumerate(np.ascontiguousarray(alphas.T, np.float64)):
            here = k + k * k + s * n
            into[here : here + n] += np.bincount(flat, weights=gamma, minlength=n)

    @staticmethod
    def of_counts(counts: np.ndarray, k: int, n: int) -> Chain:
        start = counts[:k] + 1e-2
        move = counts[k : k + k * k].reshape(k, k) + 1e-2
        emit = counts[k + k * k :].reshape(k, n)
        share = emit.sum(0) / max(1.0, emit.sum())
        emit = emit + 50 * (share + 1 / n)  # no state rules out a class
        return Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def first_chain(texts: list[np.ndarray], n: int, states: int, per_class: np.ndarray) -> Chain:
    """States that stay, with emissions of groups of sample texts: spherical k-means over square roots of class shares."""
    share = (per_class + 1.0) / (per_class.sum() + n)
    x = np.zeros((len(texts), n), np.float32)
    for k, ids in enumerate(texts):
        x[k] = np.sqrt(np.bincount(ids, minlength=n) / max(1, len(ids)))
    centres: list[np.ndarray] = []
    if len(texts):
        centres = [x[0]]
        while len(centres) < min(states, len(texts)):
            centres.append(x[int(np.argmin(np.max(x @ np.array(centres).T, axis=1)))])
        for _ in range(10):
            of = np.argmax(x @ np.array(centres).T, axis=1)
            centres = [m / max(1e-9, np.linalg.norm(m)) if (m := x[of == c].sum(0)).any() else centres[c] for c in range(len(centres))]
    emit = np.tile(share, (states, 1))
    for c, centre in enumerate(centres):
        emit[c] = 0.5 * share + 0.5 * centre**2 / max(1e-9, (centre**2).sum())
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


def train_chain(train: DataFrame, classes: Classes, per_class: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch over all texts of `train` (text): each round sums the expected counts of the tasks."""
    spark = train.sparkSession
    sent = spark.sparkContext.broadcast(classes)
    run = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    schema = to_arrow(run)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(first, ids.astype("<u2").tobytes()) for first, ids in _segments(batch.column(0), sent.value)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    runs, path = stored(train.select("text").mapInArrow(encode, run), "classes")  # read again in every round
    sample = runs.where("first = 1").orderBy(F.xxhash64("ids"), "ids").limit(SEEDS).collect()
    chain = first_chain([np.frombuffer(r["ids"], "<u2").astype(np.int64) for r in sample], classes.n, states, per_class)
    part = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    size = states + states * states + states * classes.n
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(chain)

        def expect(rows: Iterator[tuple], now=now) -> Iterator[tuple]:
            into, held, cells = np.zeros(size), [], 0

            def add() -> None:
                order = sorted(range(len(held)), key=lambda k: len(held[k][1]), reverse=True)
                ids, lengths = _padded([held[k][1] for k in order])
                now.value.expected(ids, lengths, np.array([held[k][0] for k in order]), into)

            for first, raw in rows:
                held.append((first, np.frombuffer(raw, "<u2")))
                cells += SEGMENT
                if cells >= CELLS:
                    add()
                    held, cells = [], 0
            if held:
                add()
            for b, piece in enumerate(np.array_split(into, states)):
                yield b, piece.tolist()

        summed = (
            map_rows(runs, part, expect, size=states)
            .select("block", F.posexplode("sums").alias("at", "v"))
            .groupBy("block", "at")
            .agg(F.sum(F.round("v", 6).cast("decimal(30,6)")).cast("double").alias("v"))  # exact, so in any order
            .groupBy("block")
            .agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("all"))  # as many as the tables of the chain hold
            .collect()
        )
        if not summed:
            break
        counts = np.concatenate([[x["v"] for x in r["all"]] for r in sorted(summed, key=lambda r: r["block"])])
        chain = Chain.of_counts(counts, states, classes.n)
    drop(spark, path)
    return chain


def score_texts(
    docs: DataFrame, modulus: int = 10, states: int = STATES, rounds: int = ROUNDS, head_words: int = HEAD_WORDS,
    batch_bytes: int = BATCH_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Training texts are those whose crc32 of the id has no remainder modulo `modulus` 0. base_score: log10 probability under
    single words with ALPHA added to each count and one unknown word; score: under the chain. A null text is empty and has
    one token, its end. Without training texts every word is unknown and the chain is uniform.
    """
    spark = docs.sparkSession
    texts = id_and_bytes(docs, id_col, text_col)
    train = texts.where(bucket_of_id(modulus) != 0)
    counts = materialize(_word_counts(train), "word_counts")
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = int(totals[0] or 0), int(totals[1] or 0)
    head = [bytes(r["word"]) for r in counts.orderBy(F.desc("c"), "word").limit(head_words).collect()]
    classes = Classes(head)
    sent = spark.sparkContext.broadcast(classes)
    sized = T.StructType([T.StructField("class", T.IntegerType()), T.StructField("c", T.LongType()), T.StructField("v", T.LongType())])

    def by_class(rows: Iterator[tuple]) -> Iterator[tuple]:
        c, k = np.zeros(classes.n, np.int64), np.zeros(classes.n, np.int64)
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == 65536:
                _tally(held, sent.value, c, k)
                held = []
        _tally(held, sent.value, c, k)
        yield from zip(range(classes.n), c.tolist(), k.tolist(), strict=True)

    per = np.zeros((classes.n, 2), np.int64)
    for r in map_rows(counts, sized, by_class).groupBy("class").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        per[r["class"]] = r["c"], r["v"]
    chain = train_chain(train, classes, per[:, 0].astype(float), states, rounds)
    model = spark.sparkContext.broadcast((chain, per))

    batched = T.StructType([*texts.schema.fields, T.StructField("batch", T.LongType())])

    def number(rows: Iterator[tuple]) -> Iterator[tuple]:
        batch, held = TaskContext.get().partitionId() << 32, 0
        for doc_id, text in rows:
            yield doc_id, text, batch
            held += len(text) + 64
            if held >= batch_bytes:
                batch, held = batch + 1, 0

    gathered, _ = stored(map_rows(texts, batched, number, size=256), "batches")
    asked = T.StructType([T.StructField("batch", T.LongType()), T.StructField("word", T.BinaryType())])

    question = to_arrow(asked)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(number: int, words: pa.Array) -> pa.RecordBatch:
            words = pa.concat_arrays([words, pa.array([END])])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), number)), words], schema=question)

        now, held = -1, pa.array([], pa.binary())
        for rows in batches:
            ids = rows.column(1).to_numpy()
            cuts = [*np.flatnonzero(np.diff(ids, prepend=-1)).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):  # the texts of a batch lie together
                words = pc.unique(words_of(rows.column(0).slice(a, b - a))[0])
                if ids[a] == now:
                    held = pc.unique(pa.concat_arrays([held, words]))
                    continue
                if now >= 0:
                    yield of(now, held)
                now, held = int(ids[a]), words
        if now >= 0:
            yield of(now, held)

    wanted = gathered.select("text", "batch").mapInArrow(ask, asked)
    answers = wanted.join(counts, "word").select("batch", "word", "c")
    out = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
            T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
        ]
    )

    result = to_arrow(out)

    def score(mine: pa.Table, found: pa.Table) -> pa.Table:
        chain, per = model.value
        distinct, flat, lengths = coded(mine["text"].combine_chunks())
        order = np.argsort(-lengths, kind="stable")
        words = distinct.to_pylist()
        counts = np.zeros(len(words), np.int64)
        counts[pc.index_in(found["word"].combine_chunks(), value_set=distinct).to_numpy()] = found["c"].to_numpy()
        kind = sent.value.of(words)
        own_of = np.log10((counts + ALPHA) / (per[kind, 0] + ALPHA * (per[kind, 1] + 1)))
        base_of = np.log10((counts + ALPHA) / (n + ALPHA * (v + 1)))
        of_class = kind[flat]
        c, own, base = counts[flat], own_of[flat], base_of[flat]
        first = np.cumsum(lengths) - lengths
        path = np.zeros(len(lengths))
        for part in _slabs(order, lengths):
            ids, long = _padded([of_class[first[k] : first[k] + lengths[k]] for k in part])
            path[part] = chain.log10(ids, long)
        known = np.add.reduceat((c > 0).astype(np.int64), first)
        columns = [lengths, known, np.add.reduceat(base, first), np.add.reduceat(own, first) + path]
        return pa.table([mine["doc_id"], *map(pa.array, columns)], schema=result)

    scored = gathered.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, out)
    return scored.select(
        "doc_id", (bucket_of_id(modulus) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _slabs(order: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of texts, longest first, whose padded matrix is bounded; a longer text is a run of its own."""
    start, budget = 0, 8_000_000
    while start < len(order):
        width = max(1, int(budget // max(1, lengths[order[start]])))
        yield order[start : start + width]
        start += width


def _tally(held: list[tuple], classes: Classes, c: np.ndarray, k: np.ndarray) -> None:
    if held:
        ids = classes.of([w for w, _ in held])
        np.add.at(c, ids, np.array([n for _, n in held]))
        np.add.at(k, ids, 1)


def op9_hmm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return score_texts(table(spark, sf_dir, "documents"))
