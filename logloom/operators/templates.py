"""Log template mining.

Greedy online clustering of token arrays: a row joins the most similar template at or above a threshold
(the earliest wins ties) and turns differing positions into wildcards, or it founds a new template.

Rows are grouped by (partition columns, token count), the first layer of the Drain tree (He et al.,
ICWS 2017), and with `depth` by that many leading tokens as well, its next layers. The depth holds for every
bucket whatever its size, so rows that are added elsewhere never change what a template is. Inside a bucket
rows with the same masked tokens behave alike: the first shuffle carries one row per distinct pattern, and only
patterns reach the greedy fold. The fold walks through the patterns of a bucket in time order and holds its
templates, not its patterns; candidates come from an index by position and token.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logloom.functions.tokens import WILDCARD, count_tokens, mask_text, token_text
from logloom.plans.groups import group_changes
from logloom.session import materialize

THRESHOLD = 0.7
CAPACITY = 10_000
DEPTH = 0
#: Numbers up to which a list of templates is a plain one.
SHORT = 16
_WILD, _MASKED = -1, -2


class Posting:
    """Template numbers as a growing array; one is added or removed in constant time."""

    __slots__ = ("numbers", "n", "place")

    def __init__(self, numbers: list[int]):
        self.n, self.place = len(numbers), {i: k for k, i in enumerate(numbers)}
        self.numbers = np.zeros(2 * self.n, np.int64)
        self.numbers[: self.n] = numbers

    def add(self, i: int) -> None:
        if i in self.place:
            return
        if self.n == len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        self.numbers[self.n], self.place[i] = i, self.n
        self.n += 1

    def remove(self, i: int) -> None:
        k = self.place.pop(i, None)
        if k is None:
            return
        self.n -= 1
        if k < self.n:
            last = int(self.numbers[self.n])
            self.numbers[k], self.place[last] = last, k


class TemplateSet:
    """Templates of one bucket, all of the same token count, as a growing integer matrix.

    `at` lists the templates that have a token at a position, a short list as it is and a long one as a Posting. A position that
    turned into a wildcard stays listed; the matrix decides. With a capacity, `uses` is a heap of (count, number): entries
    that no longer hold are passed over, so the least used template is found without a scan.
    """

    def __init__(self, width: int, threshold: float = THRESHOLD, capacity: int | None = None):
        self.width, self.threshold, self.capacity = width, threshold, capacity
        self.codes: dict[str, int] = {}
        self.words: list[str] = []
        self.rows = np.zeros((64, width), dtype=np.int64)
        self.counts = np.zeros(64, dtype=np.int64)
        self.wild = np.zeros(64, dtype=np.int64)
        self.at: dict[tuple[int, int], list[int] | Posting] = {}
        self.uses: list[tuple[int, int]] = []
        self.size = 0

    def encode(self, tokens: list[str], masked: int) -> np.ndarray:
        out = np.empty(self.width, dtype=np.int64)
        for i, t in enumerate(tokens):
            if t == WILDCARD:
                out[i] = masked
                continue
            code = self.codes.get(t)
            if code is None:
                code = self.codes[t] = len(self.words)
                self.words.append(t)
            out[i] = code
        return out

    def closest(self, x: np.ndarray) -> tuple[int, float]:
        """The earliest of the templates with the highest share of equal or wildcard positions."""
        if not self.size:
            return -1, 0.0
        hits = self.wild[: self.size].copy()
        for p, code in enumerate(x.tolist()):
            listed = self.at.get((p, code))
            if listed is not None:
                long = isinstance(listed, Posting)
                at = listed.numbers[: listed.n] if long else np.array(listed, np.int64)
                kept = at[self.rows[at, p] == code]
                if long and len(kept) < len(at) // 2:
                    self.at[p, code] = Posting(kept.tolist())
                hits[kept] += 1
        best = int(hits.argmax())
        return best, float(hits[best]) / self.width

    def add(self, tokens: list[str], rows: int = 1) -> tuple[int, bool]:
        """Index of the template the masked tokens belong to, and whether they founded it."""
        x = self.encode(tokens, _MASKED)
        best, score = self.closest(x)
        if best >= 0 and 0 < score >= self.threshold:
            row = self.rows[best]
            row[row != x] = _WILD
            self.wild[best] = int((row == _WILD).sum())
            self.counts[best] += rows
            self._used(best)
            return best, False
        if self.capacity is not None and self.size >= self.capacity:
            self.evict()
        self._append(np.where(x == _MASKED, _WILD, x), rows)
        return self.size - 1, True

    def _append(self, row: np.ndarray, count: int) -> None:
        if self.size == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.wild = np.concatenate([self.wild, np.zeros_like(self.wild)])
        self._put(self.size, row, count)
        self.size += 1

    def _put(self, i: int, row: np.ndarray, count: int) -> None:
        self.rows[i], self.counts[i], self.wild[i] = row, count, int((row == _WILD).sum())
        for p, code in enumerate(row.tolist()):
            if code != _WILD:
                listed = self.at.setdefault((p, code), [])
                if isinstance(listed, Posting):
                    listed.add(i)
                elif i not in listed:
                    listed.append(i)
                    if len(listed) > SHORT:
                        self.at[p, code] = Posting(listed)
        self._used(i)

    def _used(self, i: int) -> None:
        if self.capacity is None:
            return
        heapq.heappush(self.uses, (int(self.counts[i]), i))
        if len(self.uses) > 4 * self.size + 64:
            self.uses = [(int(n), k) for k, n in enumerate(self.counts[: max(self.size, i + 1)])]
            heapq.heapify(self.uses)

    def evict(self) -> None:
        """Drop the least used template, of equals that with the lowest number; the last one takes its place."""
        if not self.size:
            return
        while self.uses[0][1] >= self.size or self.uses[0][0] != self.counts[self.uses[0][1]]:
            heapq.heappop(self.uses)
        worst = heapq.heappop(self.uses)[1]
        self.size -= 1
        for i in {worst, self.size}:
            for p, code in enumerate(self.rows[i].tolist()):
                if code != _WILD:
                    self.at[p, code].remove(i)
        if worst != self.size:
            self._put(worst, self.rows[self.size].copy(), int(self.counts[self.size]))

    def restore(self, text: str, count: int) -> None:
        self._append(self.encode(text.split(" "), _WILD), count)

    def text(self, i: int) -> str:
        return " ".join(WILDCARD if c == _WILD else self.words[c] for c in self.rows[i])


def with_tokens(logs: DataFrame, body: str = "body") -> DataFrame:
    """Add n_tokens and the masked text of a body; tokens hold no spaces, so the text is a faithful key."""
    return (
        logs.withColumn("_text", token_text(F.col(body)))
        .withColumn("n_tokens", count_tokens(F.col("_text")))
        .withColumn("masked", mask_text(F.col("_text")))
        .drop("_text")
    )


def masked_patterns(
    logs: DataFrame,
    partition_by: tuple[str, ...] = ("service",),
    ts: str = "ts",
    id_col: str = "id",
    body: str = "body",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row per (partition columns, token count, masked text): row count and the whole first-seen row.

    Rows without tokens never match anything: each stays a pattern of its own (`lone` is its id). keep: the columns of the first-seen
    row that are wanted, with ts and id_col; a catalogue does without the body, which is as long as the masked text.
    """
    t = with_tokens(logs, body)
    first = F.min_by(F.struct(*(keep or logs.columns)), F.struct(ts, id_col))
    return (
        t.withColumn("lone", F.when(F.col("n_tokens") == 0, F.col(id_col)))
        .groupBy(*partition_by, "n_tokens", "masked", "lone")
        .agg(first.alias("first"), F.count("*").alias("n_rows"))
    )


def mine_patterns(
    patterns: DataFrame,
    partition_by: tuple[str, ...] = ("service",),
    ts: str = "ts",
    id_col: str = "id",
    threshold: float = THRESHOLD,
    depth: int = DEPTH,
) -> DataFrame:
    """Greedy fold of distinct patterns: adds prefix, is_new, template_no, created_template and template (final).

    prefix: the first `depth` tokens, NULL at depth 0. The folded patterns are written to the shared folder, once; they stand for the one
    pass over the logs. The final templates are joined to them when the result is read, so columns that a reader leaves out, above all
    the texts, do not travel again.
    """
    prefix = F.concat_ws(" ", F.slice(F.split("masked", " "), 1, depth)) if depth else F.lit(None).cast("string")
    # rows without tokens go through as they are, `lone` spreads them
    keyed = patterns.withColumn("prefix", F.when(F.col("n_tokens") > 0, prefix))
    added = T.StructType.fromDDL("is_new boolean, template_no int, created_template string, template string")
    group = [*partition_by, "n_tokens", "prefix"]
    # the rows that stand for templates have nulls in all columns but their key
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in keyed.schema.fields if f.name != "lone"] + added.fields)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, layout = None, None, to_arrow_schema(schema)

        def catalogue() -> pa.RecordBatch:
            # a row per template of a finished bucket: its key, number and final text, all else null
            texts = [known.text(i) for i in range(known.size)]
            take = pa.array([0] * known.size, pa.int32())
            columns = []
            for f in layout:
                if f.name in group:
                    columns.append(last.column(f.name).take(take))
                elif f.name == "template_no":
                    columns.append(pa.array(range(known.size), f.type))
                else:
                    columns.append(pa.array(texts, f.type) if f.name == "template" else pa.nulls(known.size, f.type))
            return pa.RecordBatch.from_arrays(columns, schema=layout)

        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = set(group_changes(batch, group, last).tolist())
            number, new, created = [], [], []
            widths, finished = batch.column("n_tokens"), []
            for k, text in enumerate(batch.column("masked").to_pylist()):
                if k in cuts or last is None:
                    if known is not None:
                        finished.append(catalogue())
                    width = widths[k].as_py()
                    known, last = TemplateSet(width, threshold) if width else None, batch.slice(k, 1)
                if known is None:
                    number.append(None)
                    new.append(True)
                    created.append(None)
                    continue
                i, is_new = known.add(text.split(" "))
                number.append(i)
                new.append(is_new)
                created.append(known.text(i) if is_new else None)
            columns = (
                pa.array(new, pa.bool_()), pa.array(number, pa.int32()), pa.array(created, pa.string()),
                pa.nulls(batch.num_rows, pa.string()),
            )
            out = batch
            for name, column in zip(added.names, columns):
                out = out.append_column(name, column)
            yield out.cast(layout)
            yield from finished
        if known is not None:
            yield catalogue()

    folded = materialize(
        keyed.repartition(*group, "lone")
        .drop("lone")
        .sortWithinPartitions(*group, F.col(f"first.{ts}"), F.col(f"first.{id_col}"))
        .mapInArrow(fold, schema),
        "folded",
    )
    # struct keys compare NULL services and prefixes as equal
    key = F.struct(*group, "template_no").alias("_key")
    final = folded.filter("n_tokens > 0 AND masked IS NULL").select(key, "template")
    named = folded.filter("n_tokens > 0 AND masked IS NOT NULL").drop("template").withColumn("_key", key).join(final, "_key").drop("_key")
    return named.unionByName(folded.filter("n_tokens = 0"))


def mine_templates(
    logs: DataFrame,
    partition_by: tuple[str, ...] = ("service",),
    ts: str = "ts",
    id_col: str = "id",
    body: str = "body",
    threshold: float = THRESHOLD,
    depth: int = DEPTH,
) -> DataFrame:
    """Every log row with its template and whether it founded it.

    Adds n_tokens, masked, template (final text, the body for rows without tokens), template_key and is_new.
    """
    patterns = masked_patterns(logs, partition_by, ts, id_col, body)
    mined = mine_patterns(patterns, partition_by, ts, id_col, threshold, depth)
    key = F.struct(*partition_by, "n_tokens", "masked").alias("_key")
    per_pattern = mined.filter("n_tokens > 0").select(
        key, "template", "created_template", "prefix", "template_no",
        F.when(F.col("is_new"), F.col(f"first.{id_col}")).alias("_founder"),
    )
    rows = with_tokens(logs, body).withColumn("_key", key).join(per_pattern, "_key", "left")
    return rows.select(
        *logs.columns, "n_tokens", "masked",
        F.coalesce("template", F.col(body)).alias("template"),
        F.when(F.col("n_tokens") == 0, F.col(body))
        .when(F.col("_founder") == F.col(id_col), F.col("created_template"))
        .alias("created_template"),
        F.coalesce("prefix", F.lit("")).alias("prefix"), "template_no",
        ((F.col("n_tokens") == 0) | F.coalesce(F.col("_founder") == F.col(id_col), F.lit(False))).alias("is_new"),
    )


def mine_with_capacity(
    logs: DataFrame,
    capacity: int = CAPACITY,
    partition_by: tuple[str, ...] = ("service",),
    ts: str = "ts",
    id_col: str = "id",
    body: str = "body",
    threshold: float = THRESHOLD,
    depth: int = DEPTH,
) -> DataFrame:
    """The fold over all rows, in the order of their times, with at most `capacity` templates in a bucket.

    (id, the partition columns, n_tokens, prefix, is_new, created_template, template_no, template, members): a row for every log
    row with tokens, its template's number when it came and, if it founded one, the text of then; and a row for every template that
    is left in the end, with id null, its text and how many rows it stands for. A template that was evicted is founded
    again by the next row like it, so rows do not collapse before the fold; it reads the ids and masked texts only.
    """
    t = with_tokens(logs, body).filter("n_tokens > 0")
    prefix = F.concat_ws(" ", F.slice(F.split("masked", " "), 1, depth)) if depth else F.lit(None).cast("string")
    group = [*partition_by, "n_tokens", "prefix"]
    keyed = t.select(F.col(id_col).alias("id"), F.col(ts).alias("_ts"), *partition_by, "n_tokens", prefix.alias("prefix"), "masked")
    added = T.StructType.fromDDL("is_new boolean, created_template string, template_no int, template string, members bigint")
    schema = T.StructType([keyed.schema["id"], *(keyed.schema[c] for c in group), *added.fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, known, last = to_arrow_schema(schema), None, None

        def left() -> pa.RecordBatch:
            take = pa.array([0] * known.size, pa.int32())
            own = {
                "template_no": range(known.size), "template": [known.text(i) for i in range(known.size)],
                "members": known.counts[: known.size].tolist(),
            }
            columns = [last.column(f.name).take(take) if f.name in group else pa.array(own[f.name], f.type) if f.name in own else pa.nulls(known.size, f.type) for f in layout]
            return pa.RecordBatch.from_arrays(columns, schema=layout)

        for batch in batches:
            if not batch.num_rows:
                continue
            cuts, finished = set(group_changes(batch, group, last).tolist()), []
            number, new, created = [], [], []
            widths = batch.column("n_tokens")
            for k, text in enumerate(batch.column("masked").to_pylist()):
                if k in cuts or known is None:
                    if known is not None:
                        finished.append(left())
                    known, last = TemplateSet(widths[k].as_py(), threshold, capacity), batch.slice(k, 1)
                i, is_new = known.add(text.split(" "))
                number.append(i)
                new.append(is_new)
                created.append(known.text(i) if is_new else None)
            n, own = batch.num_rows, {"is_new": new, "created_template": created, "template_no": number}
            columns = [batch.column(f.name) if f.name in ("id", *group) else pa.array(own[f.name], f.type) if f.name in own else pa.nulls(n, f.type) for f in layout]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, layout)], schema=layout)
            yield from finished
        if known is not None:
            yield left()

    return keyed.repartition(*group).sortWithinPartitions(*group, "_ts", "id").mapInArrow(fold, schema)


def first_of_each_template(
    patterns_mined: DataFrame, body: str = "body"
) -> DataFrame:
    """The founding rows with the template as of creation for a body; raw_body keeps the original text.

    They come out of the pattern table itself, the logs are not read again.
    """
    row = patterns_mined.filter("is_new").select("first.*", "created_template")
    return row.withColumn("raw_body", F.col(body)).withColumn(
        body, F.coalesce("created_template", F.col(body))
    ).drop("created_template")


def dedup_by_template(
    logs: DataFrame,
    partition_by: tuple[str, ...] = ("service",),
    ts: str = "ts",
    id_col: str = "id",
    body: str = "body",
    threshold: float = THRESHOLD,
    depth: int = DEPTH,
) -> DataFrame:
    """Only the first row of each template, body replaced by the template text."""
    patterns = masked_patterns(logs, partition_by, ts, id_col, body)
    return first_of_each_template(
        mine_patterns(patterns, partition_by, ts, id_col, threshold, depth), body
    )


def template_catalogue(mined: DataFrame, partition_by: tuple[str, ...] = ("service",)) -> DataFrame:
    """Final templates with their member counts, from the output of mine_patterns."""
    return (
        mined.filter("n_tokens > 0")
        .groupBy(*partition_by, "n_tokens", "prefix", "template_no", "template")
        .agg(F.sum("n_rows").alias("members"), F.count("*").alias("patterns"))
    )


def mask_template_counts(logs: DataFrame, body: str = "body") -> DataFrame:
    """Row count per masked text, the cheap catalogue that needs no clustering."""
    # the filter reads an aggregate: on the rows it would run the tokenizer once more
    counts = with_tokens(logs, body).groupBy("masked").agg(F.count("*").alias("members"), F.max("n_tokens").alias("n"))
    return counts.filter("n > 0").drop("n")
