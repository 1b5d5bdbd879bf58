"""Benchmark decontamination over suffix arrays of the training texts.

Lee et al., "Deduplicating Training Data Makes Language Models Better", ACL 2022. Every task reads its documents in shards of
a bounded number of words and sorts the word positions of a shard by the words that follow, up to the length of the longest
benchmark item: a suffix array. Every suffix of every benchmark item is located in it by binary search; the neighbours of
the place it would take have its longest verbatim matches, and the run of positions that share a window of words with it are
the locations.

Suffix arrays never leave their task and no document is shuffled. The benchmark travels to the tasks in blocks whose number
of words is bounded by a parameter; each block is one job over the documents, and what blocks find is merged per document.

Two exact prunings: words are numbered by the vocabulary of the block, all others are one number that matches nothing; and
a position enters the array only if it lies in a run of vocabulary words as long as the shortest window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import id_and_bytes, map_rows, materialize, table

#: Lower case letters, digits and every byte beyond ASCII stay, A-Z become lower case, all else separates words.
_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

#: Words of the benchmark that one job carries to the tasks, and words of a shard of documents.
BLOCK_WORDS = 2_000_000
SHARD_WORDS = 1_000_000


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(_KEEP).split()


class Suffixes:
    """Suffix array of a sequence of numbers, 0 matching nothing, to the depth that items need."""

    def __init__(self, text: np.ndarray, depth: int, least: int):
        # only runs of known words that are long enough enter, each with a 0 behind it
        edges = np.flatnonzero(np.diff(text > 0, prepend=False, append=False))
        begins, ends = edges[::2], edges[1::2]
        begins, ends = (x[ends - begins >= least] for x in (begins, ends))
        lengths = ends - begins + 1
        firsts = np.cumsum(lengths) - lengths
        n = int(lengths.sum())
        #: position in `text` of each position here
        self.origin = np.arange(n) + np.repeat(begins - firsts, lengths)
        self.text = np.zeros(n + 2 * depth + 1, text.dtype)
        self.text[:n] = np.append(text, 0)[self.origin] if n else 0
        where = np.flatnonzero(np.repeat(firsts + lengths - 1, lengths) - np.arange(n) >= least)
        rank, span = self.text.astype(np.int64), 1
        while span < depth and len(where):  # ranks by 1, 2, 4, ... words
            key = rank[:n] * (int(rank.max()) + 1) + rank[span : span + n]
            rank = np.zeros(n + 2 * depth + 1, np.int64)
            rank[:n] = np.unique(key, return_inverse=True)[1]
            span *= 2
        self.at = where[np.argsort(rank[where], kind="stable")] if len(where) else where

    def place(self, items: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
        """First index whose suffix is not less than each row of `items`, cut to its length; with `after`, greater than it."""
        low, high = np.zeros(len(items), np.int64), np.full(len(items), len(self.at))
        width = np.arange(items.shape[1])
        inside = width < lengths[:, None]
        while (low < high).any():
            mid = (low + high) // 2
            text = self.text[self.at[np.minimum(mid, len(self.at) - 1)][:, None] + width]
            differs = (text != items) & inside
            first = differs.argmax(1)
            rows = np.arange(len(items))
            found = differs[rows, first]
            less = found & (text[rows, first] < items[rows, first]) | (~found if after else False)
            open_ = low < high
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        return low

    def common(self, items: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Words each row shares with the suffix at an index of the array, from the start; 0 beyond its ends."""
        ok = (index >= 0) & (index < len(self.at))
        if not len(self.at):
            return np.zeros(len(items), np.int64)
        width = np.arange(items.shape[1])
        text = self.text[self.at[np.clip(index, 0, len(self.at) - 1)][:, None] + width]
        differs = (text != items) | (width >= lengths[:, None])
        return np.where(ok, np.where(differs.any(1), differs.argmax(1), items.shape[1]), 0)


class Block:
    """Items of the benchmark, their vocabulary, suffixes and windows, as it travels to the tasks."""

    def __init__(self, items: list[tuple], window: int):
        split = [(i, words_of(t)) for i, t in items]
        self.items = [(i, w) for i, w in split if w]
        self.number: dict[bytes, int] = {}
        for _, words in self.items:
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
        self.depth = max((len(w) for _, w in self.items), default=1)
        suffixes, windows = {}, {}
        for k, (_, words) in enumerate(self.items):
            ids = tuple(self.number[w] for w in words)
            size = min(window, len(ids))
            for a in range(len(ids) - size + 1):
                suffixes.setdefault(ids[a:], []).append((k, a))
                windows.setdefault(ids[a : a + size], set()).add(k)
        self.owners = [sorted(x) for x in windows.values()]
        self.least = min(map(len, windows), default=1)
        self.windows, self.window_lengths = _padded(list(windows))
        self.suffixes, self.suffix_lengths = _padded(list(suffixes))
        self.sources = list(suffixes.values())

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter([get(w, 0) for w in words], np.int32, len(words))


def _padded(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), int(lengths.max(initial=1))), np.int32)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, lengths


def _shards(rows: Iterator[tuple], block: Block, shard_words: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, offsets, numbers) of runs of documents with about `shard_words` words; a 0 follows each document."""
    ids, parts, total = [], [], 0
    for i, text in rows:
        numbers = block.numbers(words_of(text))
        ids.append(i)
        parts.append(np.append(numbers, np.int32(0)))
        total += len(numbers)
        if total >= shard_words:
            yield ids, np.cumsum([0, *map(len, parts)]), np.concatenate(parts)
            ids, parts, total = [], [], 0
    if ids:
        yield ids, np.cumsum([0, *map(len, parts)]), np.concatenate(parts)


def _scan(rows: Iterator[tuple], block: Block, shard_words: int) -> Iterator[tuple]:
    """(doc_id, number of words, starts and ends of the hit runs, ids of the items) of every document."""
    for ids, offsets, text in _shards(rows, block, shard_words):
        array = Suffixes(text, block.depth, block.least)
        step = max(1, 4_000_000 // max(1, block.windows.shape[1]))  # bounds the memory of a comparison
        marks = np.zeros(len(text) + 1, np.int32)
        seen: dict[int, set[int]] = {}
        if len(array.at):
            for a in range(0, len(block.windows), step):
                w, n = block.windows[a : a + step], block.window_lengths[a : a + step]
                low, high = array.place(w, n, after=False), array.place(w, n, after=True)
                for k in np.flatnonzero(high > low):
                    at = array.origin[array.at[low[k] : high[k]]]
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + n[k], -1)
                    for d in np.unique(np.searchsorted(offsets, at, side="right") - 1).tolist():
                        seen.setdefault(d, set()).update(block.owners[a + k])
        hit = np.cumsum(marks[:-1]) > 0
        edges = np.diff(hit.astype(np.int8), prepend=0, append=0)
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        owner = np.searchsorted(offsets, begins, side="right") - 1
        of: dict[int, list[int]] = {}
        for r, d in enumerate(owner.tolist()):
            of.setdefault(d, []).append(r)
        for d, i in enumerate(ids):
            base, mine = offsets[d], of.get(d, [])
            items = [block.items[k][0] for k in seen.get(d, ())]
            yield i, int(offsets[d + 1] - base - 1), (begins[mine] - base).tolist(), (ends[mine] - base).tolist(), items


def _blocks(spark, bench: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Block]:
    """The items in blocks of a bounded number of words, one block in the driver at a time; at least one block."""
    sized = id_and_bytes(bench, id_col, text_col).withColumn("n", F.octet_length("text") + 1)
    items, total, any_yet = [], 0, False
    for row in sized.orderBy("doc_id").toLocalIterator():
        items.append((row["doc_id"], bytes(row["text"])))
        total += row["n"] // 2  # at most so many words
        if total >= block_words:
            yield Block(items, window)
            items, total, any_yet = [], 0, True
    if items or not any_yet:
        yield Block(items, window)


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row: words that lie in an occurrence of a window of an item, and the items.

    A window is `window` consecutive words of an item, or a whole shorter item. Items without words have none; a null text
    has no words. Rows of one id and different texts are answered row by row if the benchmark is one block, and as one
    document with the words of the longest if it is several.
    """
    spark = docs.sparkSession
    kind, item = docs.schema[id_col].dataType, bench.schema[item_col].dataType
    runs = T.ArrayType(T.LongType())
    found = T.StructType(
        [
            T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("begins", runs),
            T.StructField("ends", runs), T.StructField("items", T.ArrayType(item)),
        ]
    )
    parts = []
    for block in _blocks(spark, bench, item_col, "text", window, block_words):
        sent = spark.sparkContext.broadcast(block)

        def rows(texts: Iterator[tuple], sent=sent) -> Iterable[tuple]:
            return _scan(texts, sent.value, shard_words)

        part = map_rows(id_and_bytes(docs, id_col, text_col), found, rows)
        parts.append(part)
    if len(parts) == 1:
        whole = parts[0].select("doc_id", "n_words", F.array(F.struct("begins", "ends")).alias("runs"), F.array_distinct("items").alias("items"))
    else:  # written one by one: a task holds one block
        whole = materialize(parts[0], "hits")
        for part in parts[1:]:
            whole = whole.union(materialize(part, "hits"))
        whole = whole.groupBy("doc_id").agg(
            F.max("n_words").alias("n_words"), F.collect_list(F.struct("begins", "ends")).alias("runs"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    return whole.select("doc_id", "n_words", _covered("runs").alias("n_hit"), "items")


def _covered(runs: str):
    """Words in the union of runs; each element's runs are disjoint and in order."""
    flat = F.array_sort(F.flatten(F.transform(runs, lambda r: F.arrays_zip(r["begins"], r["ends"]))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def step(acc, r):
        more = F.greatest(F.lit(0), r["ends"] - F.greatest(acc["upto"], r["begins"]))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["upto"], r["ends"]).alias("upto"))

    return F.aggregate(flat, start, step, lambda acc: acc["n"])


def longest_matches(
    docs: DataFrame, bench: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(item_id, item_word, doc_id, doc_word, words): the longest verbatim match of every suffix of an item in every shard.

    Every suffix of an item with at least `min_words` words, or the whole of a shorter item, is looked up in each shard; of
    the longest matches in a shard the one at the smallest position is given. Suffixes without a match of `min_words` words
    (whole, for shorter items) give no row. Positions count words from 0.
    """
    spark = docs.sparkSession
    schema = T.StructType(
        [
            T.StructField("item_id", bench.schema[item_col].dataType), T.StructField("item_word", T.LongType()),
            T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("doc_word", T.LongType()), T.StructField("words", T.LongType()),
        ]
    )
    out = None
    for block in _blocks(spark, bench, item_col, "text", min_words, block_words):
        sent = spark.sparkContext.broadcast(block)

        def rows(texts: Iterator[tuple], sent=sent) -> Iterator[tuple]:
            b = sent.value
            for ids, offsets, text in _shards(texts, b, shard_words):
                array = Suffixes(text, b.depth, b.least)
                if not len(array.at) or not len(b.suffixes):
                    continue
                place = array.place(b.suffixes, b.suffix_lengths, after=False)
                longest = np.maximum(*(array.common(b.suffixes, b.suffix_lengths, p) for p in (place - 1, place)))
                good = np.flatnonzero(longest >= np.minimum(min_words, b.suffix_lengths))
                low, high = (array.place(b.suffixes[good], longest[good], after=x) for x in (False, True))
                for k, a, z in zip(good.tolist(), low, high, strict=True):
                    p = int(array.origin[array.at[a:z]].min())
                    d = int(np.searchsorted(offsets, p, side="right") - 1)
                    for item, start in b.sources[k]:
                        yield b.items[item][0], start, ids[d], p - int(offsets[d]), int(longest[k])

        part = map_rows(id_and_bytes(docs, id_col, text_col), schema, rows)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` whose document holds no window of the benchmark, with the same columns."""
    bad = contamination(docs, bench, id_col=id_col, **options).where("n_hit > 0").select(F.col("doc_id").alias("__hit"))
    return docs.join(bad.distinct(), F.col(id_col).eqNullSafe(F.col("__hit")), "left_anti")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words of every document that lie in the benchmark, and a digest of the items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - n + 2)) u(i)
), hit AS (
  SELECT r, i, n, item_id FROM occ JOIN win USING (n, k)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
