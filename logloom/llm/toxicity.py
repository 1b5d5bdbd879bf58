"""Toxicity: a support vector machine over a gapped-subsequence string kernel with Nyström landmarks.

Lodhi et al., "Text Classification using String Kernels", JMLR 2002; Williams and Seeger, "Using the Nyström Method to Speed Up
Kernel Machines", NIPS 2000; Andrews et al., "Support Vector Machines for Multiple-Instance Learning", NIPS 2002.

Words: two words are alike by the letters they share in order, taken three at a time; each triple counts DECAY to the power of
the stretch of letters it covers in either word. Digits and punctuation are no letters, so "i.d.i.o.t" is "idiot", and an inserted
letter only lengthens some stretches, so "idxiot" stays close to it. Similarities to a landmark are divided by the landmark's own and cut at 1, so a landmark inside a longer
word counts as the landmark itself, and are sharpened by a power.
Sentences: the kernel of two sentences is the sum over the pairs of their distinct words. Landmark words, chosen among the
labelled texts, span the space that stands for it (Nyström), so a sentence is the sum of vectors of its words and the
machine's decision is a sum of one number per word.

Labels are of documents. A toxic document has a toxic sentence, the others need not be; a clean document has none. Training
therefore alternates between the machine and the choice of the most toxic sentence of every document, and a document's
decision is that of its worst sentence, made a probability by a logistic curve.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import bucket_of_id, id_and_bytes, labelled, map_rows, table

#: Labelled rows that the machine is fitted on, at most.
SAMPLE = 3_000
LANDMARKS, CLEAN_LANDMARKS = 40, 8
DECAY, POWER, LETTERS = 0.7, 3, 32
#: Letters that a triple covers at most; the weight of longer stretches is next to nothing.
STRETCH = 7
#: Characters of a word that are compared at once; longer words are windows that overlap by half.
SPAN = 24
#: Words of a sentence at most; what runs on is several sentences.
SENTENCE = 40
#: Places of triples that are looked up at once, about.
CELLS = 300_000
#: Words whose decision a task keeps at most before it starts anew.
KNOWN_WORDS = 500_000

#: Letter of each byte: a to z, five classes for bytes beyond ASCII, the mark of a beginning, and none (-1) for all others.
_LETTER = np.full(256, -1, np.int8)
_LETTER[97:123] = np.arange(26)
_LETTER[65:91] = np.arange(26)
_LETTER[128:] = 26 + np.arange(128) % 5
_EDGE = bytes(b for b in range(128) if _LETTER[b] < 0 and not 48 <= b <= 57)
#: Two of these begin every word, so that beginnings of words are told from their middles.
_START = b"\x01\x01"
_LETTER[1] = 31
#: The same for bytes.translate: the numbers, and the bytes that are no letters.
_CODES, _NO_LETTERS = _LETTER.astype(np.uint8).tobytes(), bytes(b for b in range(256) if _LETTER[b] < 0)
#: All white space of ASCII but the line end becomes a space.
_SPACES = bytes(32 if b in (9, 11, 12, 13) else b for b in range(256))


def canonical(word: bytes) -> bytes:
    """Lower case of ASCII without punctuation at the ends, behind the marks of a beginning."""
    return _START + word.strip(_EDGE).lower()


def _letters(piece: bytes) -> bytes:
    """Numbers of the letters of a piece of a word, in order."""
    return piece.translate(_CODES, _NO_LETTERS)


def _triples(letters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letter triples of words of one number of letters, by word and place, and the weights of the places."""
    code = np.frombuffer(b"".join(letters), np.uint8).reshape(len(letters), len(letters[0])).astype(np.int32)
    picks = np.array([x for x in combinations(range(code.shape[1]), 3) if x[2] - x[0] < STRETCH], np.int64).reshape(-1, 3)
    a, b, c = (code[:, picks[:, k]] for k in range(3))
    weight = DECAY ** (picks[:, 2] - picks[:, 0] + 1.0)
    return (a * LETTERS + b) * LETTERS + c, weight.astype(np.float32)


class Kernel:
    """Similarities of words to a list of landmark words."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        self.table = np.zeros((LETTERS**3 + 1, max(1, len(landmarks))), np.float32)
        for k, w in enumerate(landmarks):
            triple, weight = _triples([_letters(w[:SPAN])])
            np.add.at(self.table[:, k], triple[0], weight)
        self.own = np.einsum("ij,ij->j", self.table, self.table)
        used = self.table.any(1)
        self.table /= np.where(self.own > 0, self.own, 1)
        #: Number of each triple among those in any landmark, from 1, and by landmark their shares; 0 is in none.
        self.place = np.where(used, np.cumsum(used), 0).astype(np.int32)
        self.shares = np.ascontiguousarray(np.vstack([self.table[-1:], self.table[used]]).T)

    def middle(self) -> np.ndarray:
        """Normalised kernel of the landmarks with each other."""
        raw = self.table * self.own
        norm = np.sqrt(np.where(self.own > 0, self.own, 1))
        return ((raw.T @ raw) / norm / norm[:, None]).astype(np.float64) ** POWER

    def rows(self, words: list[bytes]) -> np.ndarray:
        """(words, landmarks); of the windows of a long word the closest counts for each landmark."""
        out = self._near([_letters(w[:SPAN]) for w in words])
        pieces, owner = [], []
        for k, w in enumerate(words):
            for s in range(SPAN // 2, len(w) - SPAN // 2, SPAN // 2) if len(w) > SPAN else ():
                pieces.append(_letters(w[s : s + SPAN]))
                owner.append(k)
        if pieces:
            np.maximum.at(out, owner, self._near(pieces))
        return out

    def _near(self, pieces: list[bytes]) -> np.ndarray:
        """The same for pieces of words, given as letters; those with equally many letters are compared at once."""
        out = np.zeros((len(pieces), self.table.shape[1]), np.float32)
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(k)
        for length, ks in by_length.items():
            if length < 3:
                continue
            step = max(16, CELLS // (min(length - 2, STRETCH) ** 2 * length))
            for a in range(0, len(ks), step):
                part = ks[a : a + step]
                triple, weight = _triples([pieces[k] for k in part])
                which = self.place[triple].ravel()
                held = np.flatnonzero(which)  # few triples are in any landmark
                if not len(held):
                    continue
                of, pick = np.divmod(held, len(weight))
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                values = np.take(self.shares, which[held], axis=1, mode="clip")  # all in range, so none is checked
                values *= weight[pick]
                total = np.add.reduceat(values, starts, axis=1)
                out[np.array(part)[of[starts]]] = (np.minimum(total, 1.0) ** POWER).T
        return out


def sentences(text: bytes) -> Iterator[set[bytes]]:
    """Distinct words of every sentence; a sentence ends with a line, a full stop, ! or ?, or after SENTENCE words."""
    text = text.translate(_SPACES)
    for stop in (b". ", b"! ", b"? "):
        text = text.replace(stop, stop[:1] + b"\n")
    for line in text.split(b"\n"):
        words = line.split()
        for at in range(0, len(words), SENTENCE):
            yield set(words[at : at + SENTENCE])


def _stems(word: bytes) -> Iterator[bytes]:
    """The first three to eight bytes of a word of canonical form, and all of it."""
    most = len(word) - len(_START)
    for size in range(3, min(8, most) + 1):
        yield word[: size + len(_START)]
    if 8 < most <= SPAN - len(_START):
        yield word


class Machine:
    """The trained machine; travels to the tasks."""

    def __init__(self, texts: list[bytes], labels: list[int]):
        """Fit; with no rows of both classes every score is the share of toxic rows (0.5 without rows)."""
        self.constant: float | None = None
        y = np.array(labels)
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        bags = [[{canonical(w) for w in s} for s in sentences(t)] or [set()] for t in texts]
        number: dict[bytes, int] = {}
        for bag in bags:
            for s in bag:
                for w in sorted(s):
                    number.setdefault(w, len(number))
        words = list(number)
        odds = self._choose(bags, y, words)
        close = self.kernel.rows(words)
        value, vector = np.linalg.eigh(self.kernel.middle())
        root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
        flat = [s for bag in bags for s in bag]
        bag_of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        ids = np.fromiter((number[w] for s in flat for w in s), np.int64)
        lengths = np.array([len(s) for s in flat])
        first_of = np.cumsum([0, *map(len, bags)])[:-1]
        of_sentence = np.repeat(np.arange(len(flat)), lengths)

        def summed(per_word: np.ndarray) -> np.ndarray:
            return np.bincount(of_sentence, weights=per_word[ids], minlength=len(flat))

        decision = summed(odds)
        weights = None
        for _ in range(5):
            worst = self._worst(decision, bag_of, first_of)
            hard = np.flatnonzero((y[bag_of] == 0) & (decision > -0.5)) if weights is not None else np.zeros(0, np.int64)
            hard = hard[np.argsort(-decision[hard], kind="stable")][: 4 * len(y)]
            rows = np.unique(np.concatenate([worst, hard]))
            x = np.stack([close[list(map(number.get, sorted(flat[r])))].sum(0) if flat[r] else np.zeros(close.shape[1]) for r in rows]) @ root
            weights = _svm(x, np.where(y[bag_of[rows]] > 0, 1.0, -1.0))
            decision = summed(close @ (root @ weights[:-1])) + weights[-1]
        self.per_landmark, self.bias = (root @ weights[:-1]).astype(np.float32), float(weights[-1])
        self.slope, self.offset = _logistic(decision[self._worst(decision, bag_of, first_of)], y)

    def _choose(self, bags: list, y: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Set the landmarks and return a first idea of each word's toxicity.

        Landmarks are words and beginnings of words. One after another, the one that tells toxic documents
        best by a two-sample test is taken and the toxic documents that hold it are set aside, until none tells the
        others; then the best over all toxic documents follow, if they are unlike those chosen. The most frequent words of clean documents are landmarks too. Equal scores go to the longer, then the
        greater sequence.
        """
        grams_of: dict[bytes, tuple] = {w: tuple(_stems(w)) for w in words}
        clean, open_ = Counter(), []
        common = Counter()
        for bag, label in zip(bags, y, strict=True):
            inside = set().union(*bag)
            grams = set().union(*(grams_of[w] for w in inside)) if inside else set()
            if label:
                open_.append(grams)
            else:
                clean.update(grams)
                common.update(inside)
        n1, n0, all_toxic = len(open_), len(y) - len(open_), open_
        chosen: list[bytes] = []

        def told(grams_of_docs: list, least: float) -> list[tuple]:
            """(score, length, sequence) of all that tell these documents, least first."""
            out = []
            for g, a in Counter(g for grams in grams_of_docs for g in grams).items():
                p, q, both = a / n1, clean[g] / n0, (a + clean[g]) / (n1 + n0)
                z = (p - q) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
                if z > least:
                    out.append((round(float(z), 6), len(g), g))
            return sorted(out)

        while open_ and len(chosen) < LANDMARKS - CLEAN_LANDMARKS:
            best = told(open_, 3)[-1:]
            if not best:
                break
            chosen.append(best[0][2])
            open_ = [grams for grams in open_ if best[0][2] not in grams]
        rest = [g for _, _, g in told(all_toxic, 5)[:-2000:-1]]
        while rest and len(chosen) < LANDMARKS - CLEAN_LANDMARKS:  # then the best of all that are unlike those
            like = Kernel(chosen).rows(rest).max(1) if chosen else np.zeros(len(rest))
            rest = [
                g for g, x in zip(rest, like, strict=True)
                if x < 0.8**POWER and not any(g.startswith(c) or c.startswith(g) for c in chosen)
            ]
            chosen += rest[:1]
        self.stems = list(chosen)
        for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])):
            if len(chosen) - len(self.stems) >= CLEAN_LANDMARKS:
                break
            if 3 + len(_START) <= len(w) <= SPAN and w not in chosen:
                chosen.append(w)
        self.kernel = Kernel(chosen or [b"none"])
        toxic = set(self.stems)
        return np.array([1.0 if toxic.intersection(grams_of[w]) else 0.0 for w in words])

    @staticmethod
    def _worst(decision: np.ndarray, bag_of: np.ndarray, first_of: np.ndarray) -> np.ndarray:
        """The sentence of each document with the highest decision, the first of equals."""
        order = np.lexsort((np.arange(len(decision)), -decision, bag_of))
        return order[first_of]

    def of_words(self, words: list[bytes]) -> np.ndarray:
        return self.kernel.rows(words) @ self.per_landmark

    def score(self, decision: float) -> float:
        return float(0.5 * (1 + np.tanh(0.5 * (self.slope * decision + self.offset))))


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 400) -> np.ndarray:
    """Linear machine with squared hinge loss, classes weighing alike, by Newton steps; the last weight is the bias."""
    z = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * cost
    w, keep = np.zeros(z.shape[1]), np.eye(z.shape[1])
    keep[-1, -1] = 1e-3
    last = np.inf
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ w))
        loss = 0.5 * w @ keep @ w + 0.5 * share @ slack**2
        if last - loss < 1e-7 * max(1.0, loss):
            break
        last, active = loss, slack > 0
        za = z[active]
        step = np.linalg.solve(keep + (za * share[active, None]).T @ za, keep @ w - za.T @ (share * y * slack)[active])
        size = 1.0
        while size > 1e-4:
            now = w - size * step
            if 0.5 * now @ keep @ now + 0.5 * share @ np.maximum(0, 1 - y * (z @ now)) ** 2 <= loss:
                break
            size /= 2
        w = now
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with the prior counts of Platt, by Newton steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(100):
        p = 0.5 * (1 + np.tanh(0.5 * (z @ w)))
        g = z.T @ (p - t) + 1e-4 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2), g)
        w = w - step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _score_texts(rows: Iterable[tuple], machine: Machine) -> Iterator[tuple]:
    """(id, score); the words of some documents at a time are compared with the landmarks, those known are not again."""
    known: dict[bytes, float] = {}

    def flush(held: list[tuple]) -> Iterator[tuple]:
        words = set().union(*(s for _, ss in held for s in ss))
        new = [w for w in words if w not in known]
        if len(known) + len(new) > KNOWN_WORDS:
            known.clear()
            new = list(words)
        forms = list(map(canonical, new))
        distinct = list(set(forms))
        value = dict(zip(distinct, machine.of_words(distinct).tolist(), strict=True))
        known.update(zip(new, map(value.__getitem__, forms), strict=True))
        get = known.__getitem__
        for i, ss in held:
            yield i, machine.score(max((sum(map(get, s)) for s in ss), default=0.0) + machine.bias)

    if machine.constant is not None:
        yield from ((i, machine.constant) for i, _ in rows)
        return
    held, size = [], 0
    for i, text in rows:
        held.append((i, list(sentences(text))))
        size += len(text)
        if size > 1 << 20:
            yield from flush(held)
            held, size = [], 0
    yield from flush(held)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    score is the probability that the worst sentence of a text is toxic; null and empty texts have the score of no words.
    Labels are read of at most `sample` rows whose crc32 of the id has remainder 1 to 4 modulo 5.
    """
    spark = docs.sparkSession
    train = labelled(docs.withColumnRenamed(text_col, "text") if text_col != "text" else docs, labels, "toxic", sample, id_col=id_col)
    got = train.select("label", F.xxhash64("doc_id", "text").alias("order"), "text").collect()
    got.sort(key=lambda r: (r["order"], r["label"]))
    machine = spark.sparkContext.broadcast(Machine([bytes(r["text"]) for r in got], [int(r["label"] > 0) for r in got]))
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def scores(rows: Iterator[tuple]) -> Iterator[tuple]:
        return _score_texts(rows, machine.value)

    return map_rows(id_and_bytes(docs, id_col, text_col), out, scores).select(
        "doc_id", (bucket_of_id(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
