"""Rows by their place in an ordering, without sorting what comes before them.

The keys of the ordering are cut into ranges at sampled bounds and the rows of every range are counted, with partial sums; only the
range that holds the wanted place is cut again, until it is small. So a place far down costs a few counting passes over narrow
columns, of which a condition on the first column reaches the scan, and a sort of a few rows; no task holds the rows before it.

The bounds are values, so a repeated task counts the same rows. Equal keys stay in one range: where a single key fills it, its rows
are alike to the ordering, and any of them fill the places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of a pass, sampled keys for each, and rows that are sorted at once in the end.
RANGES, SAMPLED, SORTED_ROWS = 32, 20, 50_000

Order = list[tuple[str, bool]]


def parsed(order: list[str]) -> Order:
    """(column, descending) of names with a leading '-' for descending."""
    return [(n.removeprefix("-"), n.startswith("-")) for n in order]


def sorting(order: Order) -> list[Column]:
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in order]


def not_before(key: tuple, order: Order, strictly: bool = False) -> Column:
    """Whether a row stands at or behind a key; nulls stand first where a column ascends and last where it descends."""
    out = F.lit(not strictly)
    for (name, down), value in reversed(list(zip(order, key, strict=True))):
        c = F.col(name)
        if value is None:
            behind = F.lit(False) if down else c.isNotNull()
        else:
            behind = F.coalesce(c < F.lit(value), F.lit(True)) if down else F.coalesce(c > F.lit(value), F.lit(False))
        out = behind | (c.eqNullSafe(F.lit(value)) & out)
    return out


def _between(df: DataFrame, low: tuple | None, high: tuple | None, order: Order) -> DataFrame:
    if low is not None:
        df = df.where(not_before(low, order))
    return df if high is None else df.where(~not_before(high, order))


def locate(df: DataFrame, order: list[str], place: int, rows: int = SORTED_ROWS) -> tuple[tuple | None, tuple | None, int, int]:
    """(low, high, before, inside): a range of keys that holds the place, the rows before it and in it.

    Ends when the range has at most `rows` rows or a single key. An end that is None is open.
    """
    spec = parsed(order)
    keys = df.select(*[c for c, _ in spec])
    low = high = None
    before, inside = 0, keys.count()
    while inside > rows and place < before + inside:
        part = _between(keys, low, high, spec)
        share = min(1.0, RANGES * SAMPLED / inside)
        found = [tuple(r) for r in part.sample(share, seed=7).orderBy(*sorting(spec)).limit(4 * RANGES * SAMPLED).collect()]
        bounds = list(dict.fromkeys(found[k * len(found) // RANGES] for k in range(1, RANGES))) if found else []
        bounds = [b for b in bounds if b != low]
        if not bounds:  # few keys: cut off the first one that is not the lowest, if there is any
            other = part.where(not_before(low, spec, strictly=True)).orderBy(*sorting(spec)).limit(1).collect() if low is not None else part.orderBy(*sorting(spec)).limit(1).collect()
            if not other:
                break
            bounds = [tuple(other[0])]
        at = sum((F.when(not_before(b, spec), 1).otherwise(0) for b in bounds[1:]), F.when(not_before(bounds[0], spec), 1).otherwise(0))
        counts = {r["at"]: r["count"] for r in part.groupBy(at.alias("at")).count().collect()}  # a row for each range
        edges = [low, *bounds, high]
        for k in range(len(bounds) + 1):
            n = counts.get(k, 0)
            if place < before + n or k == len(bounds):
                if (edges[k], edges[k + 1]) == (low, high) and n == inside:
                    return low, high, before, inside
                low, high, inside = edges[k], edges[k + 1], n
                break
            before += n
    return low, high, before, inside


def rows_at(df: DataFrame, order: list[str], offset: int, limit: int | None = None, rows: int = SORTED_ROWS) -> DataFrame:
    """The rows offset … offset + limit of an ordering, in order; without a limit all from the offset on.

    Counting passes run when it is called. Rows with equal keys are in any order; name a unique column last to fix it.
    """
    spec = parsed(order)
    low, high, before, inside = locate(df, order, offset, rows)
    skip = offset - before
    if skip >= inside:  # beyond the last row
        return df.limit(0)
    if limit is not None:
        # the wanted rows start in the range that was found and end in it or behind it
        end = None if offset + limit > before + inside else high
        part = _between(df, low, end, spec)
        if inside > rows:  # a single key: its rows are alike, those behind it are few
            same, behind = _between(df, low, high, spec), max(0, offset + limit - before - inside)
            part = same.limit(max(0, min(limit, inside - skip)))
            if behind:
                part = part.union(rows_at(df, order, before + inside, behind, rows))
            return part.orderBy(*sorting(spec))
        return part.orderBy(*sorting(spec)).offset(skip).limit(limit)
    tail = df.where(not_before(high, spec)) if high is not None else df.limit(0)
    here = _between(df, low, high, spec)
    here = here.limit(max(0, inside - skip)) if inside > rows else here.orderBy(*sorting(spec)).offset(skip)
    return here.union(tail).orderBy(*sorting(spec))
