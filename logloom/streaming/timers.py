"""Streams that act when event time passes a moment: admission in the order of events, expiry of records, schedules.

All three are keyed state with one self-renewing event-time timer per key (in admission, per bucket of keys), set to the earliest moment that something of the key
is due. A row waits in the state until the watermark passes its time, so the order of arrival does not matter within the
delay. Rows behind the watermark are not dropped by the engine, they reach the state and get an outcome of their own: the
watermark is taken from the time column, which then goes on as a plain one.

`clock`, where it is given, is a second stream with a `ts` column, whose rows only move the watermark on; without one the last
rows of a stream wait for later ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.functions.analysis import compose_query
from logloom.functions.times import parse_duration
from logloom.streaming.frames import with_object_strings

DELAY = "10 minutes"


def clocked(rows: DataFrame, ts: str, delay: str, clock: DataFrame | None = None) -> DataFrame:
    """`rows` with `_us`, the time in microseconds; the watermark follows it and the clock, and no row is dropped for being late."""
    marked = rows.where(F.col(ts).isNotNull()).withColumn("_us", F.unix_micros(ts)).withColumn("_clock", F.col(ts)).withColumn("_row", F.lit(True))
    if clock is not None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
        ticks = clock.select(*blank, F.lit(None).cast("long").alias("_us"), F.col("ts").cast("timestamp").alias("_clock"), F.lit(False).alias("_row"))
        marked = marked.unionByName(ticks)
    # the condition names _clock, so that it stays behind the watermark; rows of the clock never meet it
    kept = marked.withWatermark("_clock", delay).where(F.when(F.col("_row"), F.lit(True)).otherwise(F.col("_clock") < F.lit("0001-01-01").cast("timestamp")))
    return kept.drop("_clock", "_row")  # the watermark belongs to _clock, which ends here


def _reset(handle: StatefulProcessorHandle, due_us: int | None) -> None:
    """One timer, at the first millisecond that is past `due_us`; none without it."""
    wanted = None if due_us is None else due_us // 1000 + 1
    found = False
    for at in list(handle.listTimers()):
        if at == wanted:
            found = True
        else:
            handle.deleteTimer(at)
    if wanted is not None and not found:
        handle.registerTimer(wanted)


def _passed_us(timer_values) -> int:  # noqa: ANN001
    """What the watermark has passed, in microseconds: all times whose timers are due."""
    return timer_values.getCurrentWatermarkInMs() * 1000 - 1


# --- admission ---------------------------------------------------------------------------------------------------------


#: Rows of one piece of the state, and buckets of keys.
PIECE, BUCKETS = 1 << 16, 1024


def _packed(rows: pa.Table) -> list[tuple[bytes]]:
    """The rows as elements of a list state, of a bounded number of rows each."""
    packed = []
    for at in range(0, rows.num_rows, PIECE):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.slice(at, PIECE))
        packed.append((sink.getvalue().to_pybytes(),))
    return packed


def _unpacked(pieces: Iterable[tuple], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(bytes(p[0])).read_all() for p in pieces)])


class OrderedAdmission(StatefulProcessor):
    """Waiting requests of a bucket of keys (trigger, query), and the last admitted one of each key.

    A call of the state or a frame for every key would cost more than the decisions, so the rows of a bucket are read and written together.
    """

    PIECES = T.StructType([T.StructField("rows", T.BinaryType())])

    def __init__(self, row: T.StructType, out: T.StructType, window_us: int):
        self.row, self.out, self.window_us = row, out, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.PIECES)
        self.last = handle.getListState("last", self.PIECES)
        self.schema = to_arrow_schema(self.row)
        self.last_schema = pa.schema([self.schema.field("trigger"), self.schema.field("query"), ("us", pa.int64()), ("id", pa.string())])

    def _frame(self, rows: pa.Table, admitted: list, blocked_by: list, late: bool) -> pd.DataFrame:
        out = rows.to_pandas(integer_object_nulls=True)
        out["admitted"], out["blocked_by"], out["late"] = admitted, pd.Series(blocked_by, dtype=object), late
        return with_object_strings(out[self.out.names])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        passed = _passed_us(timer_values)
        parts = [pa.Table.from_pandas(part[self.row.names], self.schema, preserve_index=False) for part in rows]
        came = pa.concat_tables([self.schema.empty_table(), *parts])
        is_late = pc.less_equal(came.column("us"), passed)
        new, late = came.filter(pc.invert(is_late)), came.filter(is_late)
        if new.num_rows:
            held, least = list(self.handle.listTimers()), pc.min(new.column("us")).as_py()
            self.waiting.appendList(_packed(new))
            if not held or least // 1000 + 1 < min(held):
                _reset(self.handle, least)
        if late.num_rows:
            yield self._frame(late, [False] * late.num_rows, [None] * late.num_rows, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = _passed_us(timerValues)
        rows = _unpacked(self.waiting.get(), self.schema)
        is_due = pc.less_equal(rows.column("us"), passed)
        due, rest = rows.filter(is_due).sort_by([("us", "ascending"), ("id", "ascending")]), rows.filter(pc.invert(is_due))
        if due.num_rows:
            if rest.num_rows:
                self.waiting.put(_packed(rest))
            else:
                self.waiting.clear()
        before = _unpacked(self.last.get(), self.last_schema).to_pydict()
        last = {(t, q): (us, i) for t, q, us, i in zip(*before.values(), strict=True)}
        admitted, blocked_by = [], []
        for t, q, us, i in zip(*(due.column(c).to_pylist() for c in ("trigger", "query", "us", "id")), strict=True):
            at, owner = last.get((t, q), (None, None))
            free = at is None or us - at > self.window_us
            admitted.append(free)
            blocked_by.append(None if free else owner)
            if free:
                last[t, q] = us, str(i)
        # the state of a key ends with its window, when it can block no row that is still to come
        alive = [(t, q, us, i) for (t, q), (us, i) in last.items() if us + self.window_us > passed]
        if alive:
            columns = zip(zip(*alive, strict=True), self.last_schema, strict=True)
            self.last.put(_packed(pa.Table.from_arrays([pa.array(c, f.type) for c, f in columns], schema=self.last_schema)))
        else:
            self.last.clear()
        moments = [us + self.window_us for _, _, us, _ in alive]
        if rest.num_rows:
            moments.append(pc.min(rest.column("us")).as_py())
        _reset(self.handle, min(moments, default=None))
        if due.num_rows:
            yield self._frame(due, admitted, blocked_by, False)

    def close(self) -> None:
        pass


def stream_admission_in_order(
    requests: DataFrame, window_seconds: float = 300, delay: str = DELAY, clock: DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Requests (id, trigger, query, create_time) with `admitted`, `blocked_by` and `late`, decided in the order of their times.

    A request is decided once the watermark is past its time, so requests that arrive in any order within the delay get the
    decisions of `admit_requests`, and one without a time is not admitted. A request that arrives behind the watermark is `late`, is not admitted and blocks nothing. A key
    leaves the state when its window is over. The state is kept for `buckets` of keys, whose waiting requests a task reads together.
    """
    times = [f.name for f in requests.schema.fields if isinstance(f.dataType, T.TimestampType)]  # numbers in the state, so no zone shifts them
    columns = [T.StructField(f.name, T.LongType() if f.name in times else f.dataType) for f in requests.schema.fields]
    row = T.StructType([*columns, T.StructField("us", T.LongType())])
    out = T.StructType([*columns, *(T.StructField(n, t) for n, t in (("admitted", T.BooleanType()), ("blocked_by", T.StringType()), ("late", T.BooleanType())))])
    keyed = clocked(requests, "create_time", delay, clock)
    keyed = keyed.select(*[F.unix_micros(f.name).alias(f.name) if f.name in times else f.name for f in columns], F.col("_us").alias("us"))
    bucket = F.pmod(F.xxhash64("trigger", "query"), F.lit(buckets)).alias("_bucket")
    decided = keyed.select("*", bucket).groupBy("_bucket").transformWithStateInPandas(
        OrderedAdmission(row, out, int(window_seconds * 1_000_000)), out, "Append", "EventTime"
    )
    decided = decided.select(*[F.timestamp_micros(n).alias(n) if n in times else n for n in out.names])
    timeless = requests.where("create_time is null").withColumn("admitted", F.lit(False)).withColumn("blocked_by", F.lit(None).cast("string"))
    return decided.unionByName(timeless.withColumn("late", F.lit(False)))


# --- expiry ------------------------------------------------------------------------------------------------------------


class Expiry(StatefulProcessor):
    """Records of one bucket of times that are alive."""

    def __init__(self, row: T.StructType, retention_us: int):
        self.row, self.retention_us = row, retention_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alive = handle.getListState("alive", self.row)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["id", "us"])
        out["id"] = out["id"].astype(object)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        passed, new, gone = _passed_us(timer_values), [], []
        for part in rows:
            for i, us in zip(part["id"].tolist(), part["us"].tolist(), strict=True):
                (gone if us + self.retention_us <= passed else new).append((i, us))
        if new:
            self.alive.appendList(new)
            least = min(us for _, us in new) + self.retention_us
            held = list(self.handle.listTimers())
            if not held or least // 1000 + 1 < min(held):
                _reset(self.handle, least)
        if gone:  # they were over when they came
            yield self._frame(gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = _passed_us(timerValues)
        rows = [tuple(r) for r in self.alive.get()]
        gone = [r for r in rows if r[1] + self.retention_us <= passed]
        rest = [r for r in rows if r[1] + self.retention_us > passed]
        if rest:
            self.alive.put(rest)
        else:
            self.alive.clear()
        _reset(self.handle, min((us for _, us in rest), default=None) + self.retention_us if rest else None)
        if gone:
            yield self._frame(gone)

    def close(self) -> None:
        pass


def stream_expired(
    records: DataFrame, retention_seconds: float = 72 * 3600, delay: str = DELAY, clock: DataFrame | None = None,
    bucket: str = "hour", parts: int = 8,
) -> DataFrame:
    """(id, ts) of every record (id, ts) of a stream once the watermark is `retention_seconds` past its time.

    Times count in milliseconds, as the vector table keeps them. What has come and has not been given out is what
    `apply_retention` keeps of the records at the watermark. Buckets of time are keys, cut in `parts` by the id, so a full hour
    spreads; a bucket is read when its first record is due and is gone with its last. A record that comes again with another
    time is another record.
    """
    row = T.StructType([T.StructField("id", records.schema["id"].dataType), T.StructField("us", T.LongType())])
    keyed = clocked(records.select("id", "ts"), "ts", delay, clock).select(
        "id", (F.floor(F.col("_us") / 1000) * 1000).alias("us"), F.date_trunc(bucket, "ts").alias("bucket"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"),
    )
    out = keyed.groupBy("bucket", "part").transformWithStateInPandas(Expiry(row, int(retention_seconds * 1_000_000)), row, "Append", "EventTime")
    return out.select("id", F.timestamp_micros("us").alias("ts"))


# --- schedules ---------------------------------------------------------------------------------------------------------


class Scheduler(StatefulProcessor):
    """One job: its changes that wait for the watermark, what is in force, and when it fires next."""

    CHANGE = T.StructType(
        [
            T.StructField("us", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("every", T.LongType()),
            T.StructField("metric_query", T.StringType()), T.StructField("log_query", T.StringType()),
        ]
    )
    JOB = T.StructType([T.StructField("next", T.LongType()), *CHANGE.fields[2:]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getListState("changes", self.CHANGE)
        self.job = handle.getValueState("job", self.JOB)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        new = []
        for part in rows:
            for r in with_object_strings(part).itertuples(index=False):
                every = None if pd.isna(r.every) else int(r.every)
                new.append((int(r.us), int(r.seq), every, None if r.metric_query is None or pd.isna(r.metric_query) else r.metric_query, None if r.log_query is None or pd.isna(r.log_query) else r.log_query))
        if new:
            self.changes.appendList(new)
            self._renew(new)
        yield from ()

    def _renew(self, waiting: list[tuple]) -> None:
        moments = [c[0] for c in waiting]
        if self.job.exists():
            moments.append(self.job.get()[0])
        held = list(self.handle.listTimers())
        if moments and (not held or min(moments) // 1000 + 1 < min(held)):
            _reset(self.handle, min(moments))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = _passed_us(timerValues)
        waiting = [tuple(c) for c in self.changes.get()]
        due = sorted((c for c in waiting if c[0] <= passed), key=lambda c: c[:2])
        rest = [c for c in waiting if c[0] > passed]
        job = tuple(self.job.get()) if self.job.exists() else None
        fired = []

        def fire(upto: int) -> None:
            nonlocal job
            while job is not None and job[0] <= upto:
                fired.append((key[0], job[0], job[2], job[3]))
                job = (job[0] + job[1], *job[1:])

        for us, _, every, metric_query, log_query in due:
            fire(us - 1)  # at the moment of a change the new state of the job holds
            job = (us + every, every, metric_query, log_query) if every is not None and every > 0 else None
        fire(passed)
        if job is None:
            self.job.clear()
        else:
            self.job.update(job)
        if rest:
            self.changes.put(rest)
        else:
            self.changes.clear()
        moments = [c[0] for c in rest] + ([] if job is None else [job[0]])
        _reset(self.handle, min(moments) if moments else None)
        if fired:
            out = pd.DataFrame(fired, columns=["name", "us", "metric_query", "log_query"])
            yield out.astype({"name": object, "metric_query": object, "log_query": object})

    def close(self) -> None:
        pass


def _ticks(fired: DataFrame) -> DataFrame:
    named = F.concat(F.lit("Scheduled inspection: "), F.col("name"))
    return fired.select(
        "name", F.lit("scheduled").alias("trigger"), compose_query(named, F.col("metric_query"), F.col("log_query")).alias("query"),
        F.timestamp_micros("us").alias("create_time"),
    )


def stream_schedule(changes: DataFrame, clock: DataFrame, delay: str = DELAY) -> DataFrame:
    """Inspection requests of jobs that a stream of changes puts in force, changes and removes.

    changes: ts, seq, name, interval, metric_query, log_query; `seq` orders changes of one moment. A change puts its job in force
    from its time on: the first request comes one interval later. A null or bad interval ends the job. The clock is any
    stream with `ts`; requests come once the watermark is past them, however many are due at once.
    """
    rows = changes.select(F.col("ts").cast("timestamp").alias("ts"), "seq", "name", parse_duration(F.col("interval")).alias("every"), "metric_query", "log_query")
    keyed = clocked(rows, "ts", delay, clock).select("name", F.col("_us").alias("us"), F.col("seq").cast("long").alias("seq"), F.col("every").cast("long").alias("every"), "metric_query", "log_query")
    out = T.StructType(
        [
            T.StructField("name", rows.schema["name"].dataType), T.StructField("us", T.LongType()),
            T.StructField("metric_query", T.StringType()), T.StructField("log_query", T.StringType()),
        ]
    )
    return _ticks(keyed.groupBy("name").transformWithStateInPandas(Scheduler(), out, "Append", "EventTime"))
