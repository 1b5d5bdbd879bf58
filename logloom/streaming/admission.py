"""Streaming admission window."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.streaming.frames import collect_batch, with_object_strings


class AdmissionProcessor(StatefulProcessor):
    """Admitted times of one (trigger, query), as far back as late rows are decided."""

    def __init__(self, out: T.StructType, window_us: int, delay_us: int, ttl_ms: int):
        self.out, self.window_us, self.delay_us, self.ttl_ms = out, window_us, delay_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("us", T.LongType()), T.StructField("id", T.StringType())])
        self.admitted = handle.getListState("admitted", schema, self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        past = sorted((us, owner) for us, owner in self.admitted.get())
        times, owners = [us for us, _ in past], [owner for _, owner in past]
        batch = with_object_strings(collect_batch(rows, ["request_us", "id"]))
        us, ids = batch["request_us"].to_numpy(), batch["id"].astype(str).tolist()
        n = len(us)
        admitted, blocked_by = np.zeros(n, bool), [None] * n
        newest = times[-1] if times else None
        late = int(np.searchsorted(us, newest)) if times else 0
        for k in range(late):  # few: before the last admitted time
            at = bisect.bisect_right(times, us[k])
            if at and us[k] - times[at - 1] <= self.window_us:
                blocked_by[k] = owners[at - 1]
            else:
                admitted[k] = True
                times.insert(at, int(us[k]))
                owners.insert(at, ids[k])
        k = late
        while k < n:  # from one admitted row to the next
            if times:
                blocked = int(np.searchsorted(us, times[-1] + self.window_us, side="right"))
                blocked_by[k:blocked] = [owners[-1]] * max(0, blocked - k)
                k = max(k, blocked)
            if k < n:
                admitted[k] = True
                times.append(int(us[k]))
                owners.append(ids[k])
                k += 1
        keep = bisect.bisect_left(times, times[-1] - self.window_us - self.delay_us)
        self.admitted.put(list(zip(times[keep:], owners[keep:])))
        batch["admitted"] = admitted
        batch["blocked_by"] = pd.Series(blocked_by, index=batch.index, dtype=object)
        batch["late"] = np.arange(n) < late
        yield batch[self.out.names]

    def close(self) -> None:
        pass


def stream_admission(
    requests: DataFrame, window_seconds: float = 300, *, ttl_seconds: float | None, delay_seconds: float = 600
) -> DataFrame:
    """Requests (id, trigger, query, create_time) with `admitted`, `blocked_by` and `late`, decided in arrival batches.

    A row is blocked if a row admitted at most the window before it, in its own time, is known. A row that is older
    than the last admitted one is `late`; admitted times are kept for the window and `delay_seconds`, and a late row
    that none of them blocks is admitted. What was decided before stays: a late admission never blocks a row
    that arrived earlier. ttl_seconds bounds the state by processing time and has to exceed the window plus the delay;
    None, to be said expressly, keeps every query for ever. Spark goes on with batches for the sake of expiry, so a run with
    a TTL does not end by itself, also not with the trigger availableNow.
    """
    if ttl_seconds is not None and ttl_seconds <= window_seconds:
        raise ValueError("the state has to outlive the window")
    out = T.StructType(
        [
            *requests.schema.fields,
            T.StructField("admitted", T.BooleanType()),
            T.StructField("blocked_by", T.StringType()),
            T.StructField("late", T.BooleanType()),
        ]
    )
    processor = AdmissionProcessor(out, int(window_seconds * 1_000_000), int(delay_seconds * 1_000_000), int((ttl_seconds or 0) * 1000))
    return (
        requests.withColumn("request_us", F.unix_micros("create_time"))
        .groupBy("trigger", "query")
        .transformWithStateInPandas(processor, out, "Append", "ProcessingTime" if ttl_seconds else "None")
    )
