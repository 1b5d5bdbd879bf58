"""Streaming template de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.operators.templates import THRESHOLD, TemplateSet, with_tokens
from logloom.streaming.frames import collect_batch, with_object_strings

WATERMARK = "10 minutes"


def drop_repeats(logs: DataFrame, delay: str = WATERMARK, by: tuple[str, ...] = ("service",)) -> DataFrame:
    """Drop rows whose masked text was seen within the watermark delay; rows without tokens all stay.

    Rows that are later than the delay are dropped with the repeats, as a watermark does; where that must not be, use
    stream_template_dedup, which has none. The state is keyed by the masked text too, so a hot service spreads.
    """
    keyed = with_tokens(logs).withColumn(
        "lone", F.when(F.col("n_tokens") == 0, F.col("id").cast("string")).otherwise(F.lit(""))
    )
    return (
        keyed.withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark([*by, "n_tokens", "masked", "lone"])
        .drop("lone")
    )


def combine_repeats(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row per masked text and Arrow batch, the earliest, with the number it stands for in `members`.

    No state and no watermark: nothing is lost, and a hot key brings its distinct texts to its task, not its rows.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("members", T.LongType())])
    keys = [*by, "n_tokens", "masked"]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df = batch.select([*keys, "ts", "id"]).to_pandas()
            df["members"] = 1
            lone = df["n_tokens"] == 0
            df["lone"] = df.index.where(lone, -1)
            df = df.sort_values(["ts", "id"], kind="stable")
            groups = df.groupby([*keys, "lone"], dropna=False, sort=False)
            members = groups["members"].transform("size")
            first = ~df.duplicated([*keys, "lone"])
            at = df.index[first].to_numpy()
            yield batch.take(pa.array(at)).append_column("members", pa.array(members[first].to_numpy(), pa.int64()))

    return rows.mapInArrow(combine, schema)


class TemplateProcessor(StatefulProcessor):
    """Greedy template state of one (service, token count) key.

    Emits the rows that found a template, and per call one row with the number of the others in `deduplicated`.
    """

    def __init__(self, out: T.StructType, threshold: float, capacity: int | None, ttl_ms: int):
        self.out, self.threshold, self.capacity, self.ttl_ms = out, threshold, capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = T.StructType([T.StructField("number", T.IntegerType())])
        value = T.StructType([T.StructField("template", T.StringType()), T.StructField("members", T.LongType())])
        self.state = handle.getMapState("templates", number, value, self.ttl_ms or None)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: ANN001, N802, N803
        for number, text, members in zip(initialState["template_no"], initialState["template"], initialState["members"]):
            self.state.updateValue((int(number),), (str(text), int(members)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        width = int(key[-1])
        known, stored = TemplateSet(max(width, 1), self.threshold, self.capacity), {}
        if width:
            stored = {number[0]: tuple(value) for number, value in self.state.iterator()}
            for number in sorted(stored):  # the order of founding decides ties
                known.restore(*stored[number])
        batch = with_object_strings(collect_batch(rows, ["ts", "id"]))
        body, new, repeats = [], [], 0
        for text, raw, members in zip(batch["masked"], batch["body"], batch["members"]):
            if not width:
                i, is_new = None, True
            else:
                i, is_new = known.add(text.split(" "), int(members))
            repeats += int(members) - is_new
            body.append(raw if i is None else known.text(i) if is_new else None)
            new.append(is_new)
        now = {k: (known.text(k), int(known.counts[k])) for k in range(known.size)} if width else {}
        # numbers grow with time and templates that expired leave gaps, so the stored numbers are kept where they can be
        names = sorted(stored)
        if self.capacity is None:
            free = names[-1] + 1 if names else 0
            now = {names[k] if k < len(names) else free + k - len(names): v for k, v in now.items()}
        for number, value in now.items():
            if stored.get(number) != value:
                self.state.updateValue((number,), value)
        for number in stored.keys() - now.keys():
            self.state.removeKey((number,))
        first = batch[pd.Series(new, index=batch.index)].copy()
        first["raw_body"] = first["body"]
        first["body"] = pd.Series([b for b, n in zip(body, new) if n], index=first.index, dtype=object)
        first["deduplicated"] = 0
        if len(first):
            yield first[self.out.names]
        if repeats:
            yield pd.DataFrame({c: [repeats if c == "deduplicated" else None] for c in self.out.names})

    def close(self) -> None:
        pass


def stream_template_outcomes(
    logs: DataFrame,
    threshold: float = THRESHOLD,
    capacity: int | None = None,
    by: tuple[str, ...] = ("service",),
    ttl_seconds: float = 0,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Founding rows, deduplicated = 0, and counts of the rows that found none, deduplicated > 0 and all else null."""
    named = [T.StructField(f.name, f.dataType, True) for f in logs.schema.fields]
    out = T.StructType([*named, T.StructField("raw_body", T.StringType()), T.StructField("deduplicated", T.LongType())])
    rows = combine_repeats(with_tokens(logs), by)
    first = None if seed is None else seed.select(*by, "n_tokens", "template_no", "template", "members").groupBy(*by, "n_tokens")
    return rows.groupBy(*by, "n_tokens").transformWithStateInPandas(
        TemplateProcessor(out, threshold, capacity, int(ttl_seconds * 1000)), out, "Append", "ProcessingTime" if ttl_seconds else "None", first
    )


def stream_template_dedup(
    logs: DataFrame,
    threshold: float = THRESHOLD,
    capacity: int | None = None,
    by: tuple[str, ...] = ("service",),
    ttl_seconds: float = 0,
    seed: DataFrame | None = None,
) -> DataFrame:
    """First row of every template of a log stream, body replaced by the template.

    Rows are taken as they come, however late; inside a micro-batch in the order of time. The state holds the
    templates per (by, token count), of which changed ones are written. `capacity` limits their number, the one with
    the fewest rows leaving first, and `ttl_seconds` lets templates expire that no row touched for so long; both are off by
    default, as in the batch job. A run with a TTL does not end by itself, as Spark goes on with batches for expiry.

    seed: a catalogue (`template_catalogue` at depth 0), whose templates are there before the first row, so a batch over the past
    and a stream over what follows give what a batch over both would. It is read when a new checkpoint starts.
    """
    out = stream_template_outcomes(logs, threshold, capacity, by, ttl_seconds, seed)
    return out.filter("deduplicated = 0").drop("deduplicated")


def stream_catalogue(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, template_no, template, members) of a stream of stream_template_dedup, read from its checkpoint.

    A stream is reset by starting it with a new checkpoint.
    """
    state = spark.read.format("statestore").option("stateVarName", "templates").load(checkpoint)
    return state.select("key", F.col("user_map_key.number").alias("template_no"), "user_map_value.template", "user_map_value.members")
