"""Admission of inspection requests: a request is turned away while one like it is active.

Per (trigger, query), in time order, a request is admitted when the last admitted one is more than the window
away. The rule is a chain, but it cuts well:

* equal times of a key collapse first (one is admitted, the rest collide), before any shuffle of rows;
* a pause longer than the window starts a new, independent segment;
* two admitted requests are more than a window apart, so a window-wide slot holds at most one of them;
* a long segment is cut into chunks of slots. What a chunk does to the chain depends only on the last
  admitted time before it, and is a step function of it. The steps of all chunks are computed in parallel,
  one streaming pass threads the chain through them, and a second parallel pass lists the admitted times.

So a single hot key still spreads over its chunks. Tasks see sorted rows of many chunks and work on whole
Arrow batches of them at once; of a chunk they hold the times only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.plans.groups import group_changes
from logloom.session import materialize

WINDOW_SECONDS = 300
SLOTS_PER_CHUNK, TIMES_PER_CHUNK = 256, 2_000_000


def admit_requests(
    requests: DataFrame,
    window_seconds: float = WINDOW_SECONDS,
    keys: tuple[str, ...] = ("trigger", "query"),
    ts: str = "create_time",
    id_col: str = "id",
    slots_per_chunk: int = SLOTS_PER_CHUNK,
    times_per_chunk: int = TIMES_PER_CHUNK,
) -> DataFrame:
    """Every request with `admitted` and, when turned away, `blocked_by`: the id of the active request.

    A request without a time is not admitted.
    """
    width = int(window_seconds * 1_000_000)
    if width <= 0:
        raise ValueError("the window must be positive")
    us = F.unix_micros(ts)
    slot = ((us - F.pmod(us, F.lit(width))) / width).cast("bigint")
    marked = requests.withColumn("_key", F.struct(*keys)).withColumn("_us", us).withColumn("_slot", slot)
    times = materialize(marked.filter("_us is not null").groupBy("_key", "_slot", "_us").agg(F.min(id_col).alias("_id")), "request-times")
    slots = materialize(_chunks(times, width, slots_per_chunk, times_per_chunk), "request-slots")
    # of a segment no longer than the window only the first time is admitted
    brief = slots.filter("_brief and _slot = _segment").select("_key", F.col("_lo").alias("_us"))
    placed = times.select("_key", "_slot", "_us").join(slots.filter("not _brief").drop("_lo", "_brief"), ["_key", "_slot"])
    span = width * (slots_per_chunk + 2)
    entries = _entries(placed.filter("_last_chunk > 0"), width, span)
    admitted = (
        _walk(placed.join(entries, ["_key", "_segment", "_chunk"], "left"), width, span)
        .unionByName(brief)
        .join(times, ["_key", "_us"])
        .select("_key", "_slot", F.col("_us").alias("_adm_us"), F.col("_id").alias("_adm_id"))
    )
    # what a slot needs to know: the time admitted in it, and the one admitted in the slot before
    ways = F.explode(F.array(F.lit(0), F.lit(1))).alias("_later")
    known = (
        admitted.select("*", ways)
        .groupBy("_key", (F.col("_slot") + F.col("_later")).alias("_slot"))
        .agg(
            F.max(F.when(F.col("_later") == 0, F.col("_adm_us"))).alias("_adm_us"),
            F.max(F.when(F.col("_later") == 0, F.col("_adm_id"))).alias("_adm_id"),
            F.max(F.when(F.col("_later") == 1, F.col("_adm_id"))).alias("_prev_id"),
        )
    )
    here = F.coalesce(F.col("_adm_us") <= F.col("_us"), F.lit(False))
    is_admitted = here & (F.col("_adm_us") == F.col("_us")) & (F.col("_adm_id") == F.col(id_col))
    return marked.join(known, ["_key", "_slot"], "left").select(
        *requests.columns,
        is_admitted.alias("admitted"),
        F.when(~is_admitted, F.when(here, F.col("_adm_id")).otherwise(F.col("_prev_id"))).alias("blocked_by"),
    )


def _chunks(times: DataFrame, width: int, slots_per_chunk: int, times_per_chunk: int) -> DataFrame:
    """Segment (its first slot), chunk number, last chunk and briefness of the segment of every (key, slot).

    A chunk ends after so many slots or so many times, whichever comes first.
    """
    by_slot = Window.partitionBy("_key").orderBy("_slot")
    in_segment = Window.partitionBy("_key", "_segment")
    slots = times.groupBy("_key", "_slot").agg(
        F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.count("*").alias("_n")
    )
    starts = F.coalesce(F.col("_lo") - F.lag("_hi").over(by_slot) > width, F.lit(True))
    before = F.sum("_n").over(in_segment.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    chunk = F.floor((F.col("_slot") - F.col("_segment")) / slots_per_chunk) + F.floor(
        F.coalesce(before, F.lit(0)) / times_per_chunk
    )
    return (
        slots.withColumn("_start", F.when(starts, F.col("_slot")))
        .withColumn("_segment", F.last("_start", ignorenulls=True).over(by_slot))
        .withColumn("_chunk", chunk)
        .select(
            "_key", "_slot", "_segment", "_chunk", "_lo", F.max("_chunk").over(in_segment).alias("_last_chunk"),
            (F.max("_hi").over(in_segment) - F.min("_lo").over(in_segment) <= width).alias("_brief"),
        )
    )


class _Groups:
    """Complete chunks of sorted rows: key rows, and the times with their chunk number."""

    def __init__(self, head: pa.RecordBatch, group: np.ndarray, t: np.ndarray, width: int, span: int):
        n = len(t)
        self.head, self.group, self.t, self.width = head, group, t, width
        self.first = np.flatnonzero(np.diff(group, prepend=-1))
        self.rel = t - t[self.first][group]
        # one increasing axis for all chunks: those of different chunks lie more than a window apart
        self.axis = group * span + self.rel
        self.span = span
        follow = np.searchsorted(self.axis, self.axis + width, side="right")
        inside = (follow < n) & (group[np.minimum(follow, n - 1)] == group)
        self.follow = np.where(inside, follow, n)  # n: the chain leaves the chunk


def _complete_groups(
    batches: Iterator[pa.RecordBatch], names: list[str], width: int, span: int
) -> Iterator[_Groups]:
    """Cut sorted batches into sets of complete chunks. Of an unfinished chunk only its times are kept."""
    head, times = None, []  # the open chunk: its first row and its times so far
    limit = max(2**62 // span, 1)
    for b in batches:
        if not b.num_rows:
            continue
        t = b.column("_us").to_numpy()
        cuts = group_changes(b, names, head)
        if head is None:
            head = b.slice(0, 1)
        if not len(cuts):
            times.append(t)
            continue
        starts = cuts[:-1]
        heads = pa.concat_batches([head, *([b.take(pa.array(starts))] if len(starts) else [])])
        done = np.concatenate([*times, t[: cuts[-1]]])
        sizes = np.concatenate([[sum(map(len, times)) + cuts[0]], np.diff(cuts)])
        head, times = b.slice(int(cuts[-1]), 1), [t[cuts[-1] :]]
        for i in range(0, len(sizes), limit):
            part = sizes[i : i + limit]
            skip = int(sizes[:i].sum())
            group = np.repeat(np.arange(len(part)), part)
            yield _Groups(heads.slice(i, len(part)), group, done[skip : skip + len(group)], width, span)
    if head is not None:
        t = np.concatenate(times)
        yield _Groups(head, np.zeros(len(t), dtype=np.int64), t, width, span)


def _flat_keys(df: DataFrame) -> tuple[DataFrame, list[str], str, Column]:
    """Key fields as plain columns for Arrow, their DDL, and the struct to restore."""
    fields = df.schema["_key"].dataType.fields
    names = [f"_k{i}" for i in range(len(fields))]
    flat = df.select(
        *[F.col("_key").getField(f.name).alias(n) for f, n in zip(fields, names)],
        *[c for c in df.columns if c != "_key"],
    )
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for f, n in zip(fields, names))
    return flat, names, ddl, F.struct(*[F.col(n).alias(f.name) for f, n in zip(fields, names)]).alias("_key")


def _entries(placed: DataFrame, width: int, span: int) -> DataFrame:
    """Last admitted time before every chunk but the first of a segment."""
    flat, names, ddl, key = _flat_keys(placed.select("_key", "_segment", "_chunk", "_us"))
    group = [*names, "_segment", "_chunk"]
    lowest = np.iinfo(np.int64).min

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _complete_groups(batches, group, width, span):
            n = len(g.t)
            jump = np.where(g.follow < n, g.follow, np.arange(n))
            while True:  # follow the chains to their ends by doubling
                further = jump[jump]
                if (further == jump).all():
                    break
                jump = further
            is_first = np.zeros(n, dtype=bool)
            is_first[g.first] = True
            before = np.concatenate([[0], g.t[:-1]])
            near = g.rel < width
            # the first admitted time of a chunk is among these; each rules from the time before it, less the window
            may_lead = near | (~is_first & np.concatenate([[False], near[:-1]]))
            at = np.flatnonzero(may_lead)
            floor = np.where(is_first[at], lowest, before[at] - width)
            end = g.t[jump[at]]
            keep = np.concatenate([[True], (end[1:] != end[:-1]) | (g.group[at][1:] != g.group[at][:-1])])
            last = np.concatenate([g.first[1:], [n]]) - 1
            skipped = np.flatnonzero(near[last])  # all its times may be blocked, then nothing is admitted
            owner = np.concatenate([g.group[at][keep], skipped])
            floors = np.concatenate([floor[keep], g.t[last[skipped]] - width])
            ends = pa.concat_arrays([pa.array(end[keep], pa.int64()), pa.nulls(len(skipped), pa.int64())])
            heads = g.head.select(group).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [*heads.columns, pa.array(floors, pa.int64()), ends], names=[*group, "_floor", "_end"]
            )

    def thread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = chunk = last = end = None
        for b in batches:
            owners = zip(*(b.column(c).to_pylist() for c in [*names, "_segment"]))
            rows = zip(owners, *(b.column(c).to_pylist() for c in ("_chunk", "_floor", "_end")))
            at, entry = [], []
            for i, (owner, ch, floor, stop) in enumerate(rows):
                if segment != owner:
                    segment, chunk, last, end = owner, ch, None, stop
                elif chunk != ch:
                    last = last if end is None else end
                    chunk, end = ch, stop
                    at.append(i)
                    entry.append(last)
                elif last is not None and floor <= last:
                    end = stop
            if at:
                heads = b.select(group).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(entry, pa.int64())], names=[*group, "_entry"])

    head = f"{ddl}, _segment bigint, _chunk bigint"
    pieces = (
        flat.repartition(*group).sortWithinPartitions(*group, "_us").mapInArrow(steps, f"{head}, _floor bigint, _end bigint")
    )
    threaded = (
        pieces.repartition(*names, "_segment")
        .sortWithinPartitions(*names, "_segment", "_chunk", "_floor")
        .mapInArrow(thread, f"{head}, _entry bigint")
    )
    return threaded.select(key, "_segment", "_chunk", "_entry")


def _walk(placed: DataFrame, width: int, span: int) -> DataFrame:
    """Admitted times of every chunk, given the entry."""
    flat, names, ddl, key = _flat_keys(placed.select("_key", "_segment", "_chunk", "_us", "_entry"))
    group = [*names, "_segment", "_chunk"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _complete_groups(batches, group, width, span):
            n, start = len(g.t), g.first.copy()
            entry = g.head.column("_entry")
            known = np.flatnonzero(entry.is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                free_after = entry.take(pa.array(known)).to_numpy() + width - g.t[g.first[known]]
                # nothing is free before the first time, and everything a window after it
                reach = known * g.span + np.clip(free_after, -1, width)
                found = np.searchsorted(g.axis, reach, side="right")
                inside = (found < n) & (g.group[np.minimum(found, n - 1)] == known)
                start[known] = np.where(inside, found, n)
            taken, at = [], start[start < n]
            while len(at):
                taken.append(at)
                at = g.follow[at]
                at = at[at < n]
            if taken:
                rows = np.concatenate(taken)
                heads = g.head.select(names).take(pa.array(g.group[rows]))
                yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(g.t[rows], pa.int64())], names=[*names, "_us"])

    return (
        flat.repartition(*group).sortWithinPartitions(*group, "_us").mapInArrow(walk, f"{ddl}, _us bigint").select(key, "_us")
    )
