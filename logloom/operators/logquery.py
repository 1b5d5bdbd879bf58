"""Line and field filters over log tables, as the log stores offer them."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.jsonv import json_document
from logloom.plans.ranks import rows_at

DEFAULT_LIMIT = 50
#: Offsets from which the place is found by counts instead of a top-k of all lines before it.
DEEP_OFFSET = 10_000
DIRECTIONS = ("backward", "forward")
_EDGE = "[0-9A-Za-z_]"


def line_contains(line: Column, part: str, negated: bool = False) -> Column:
    hit = line.contains(part)
    return ~hit if negated else hit


def line_matches(line: Column, pattern: str, negated: bool = False) -> Column:
    hit = line.rlike(pattern)
    return ~hit if negated else hit


def has_labels(labels: Column, wanted: dict[str, str]) -> Column:
    """All labels of a map column have the wanted values."""
    out = F.lit(True)
    for name, value in wanted.items():
        out = out & (F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit("")) == value)
    return out


def has_phrase(line: Column, phrase: str) -> Column:
    """A word or phrase that is not part of longer words."""
    return line.rlike(f"(?<!{_EDGE}){re.escape(phrase)}(?!{_EDGE})")


def json_field(line: Column, path: str) -> Column:
    """Text of a field of a JSON line, NULL when the line is no JSON or lacks it."""
    return F.try_variant_get(json_document(line), path, "string")


def format_line(template: str, *cols: Column) -> Column:
    return F.format_string(template, *cols)


def query_logs(
    logs: DataFrame,
    predicate: Column | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    since_seconds: float | None = None,
    direction: str = "backward",
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    deep: int = DEEP_OFFSET,
) -> DataFrame:
    """Matching lines of a time span (end exclusive), newest or oldest first; start wins over since.

    Lines behind an offset of `deep` or more are found by counting passes (`plans.ranks`), which run when this is called.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    if start is None and since_seconds is not None:
        if end is None:
            raise ValueError("since needs an end")
        start = end - dt.timedelta(seconds=since_seconds)
    out = logs
    if start is not None:
        out = out.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("ts") < F.lit(end))
    if predicate is not None:
        out = out.filter(predicate)
    if offset >= deep:
        return rows_at(out, ["-ts" if direction == "backward" else "ts", "id"], offset, limit)
    ts = F.col("ts").desc() if direction == "backward" else F.col("ts").asc()
    return out.orderBy(ts, F.col("id")).offset(offset).limit(limit)
