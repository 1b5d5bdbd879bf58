"""Severity ranks of logs, reports and notifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: log severity order, unknown names rank 0
LOG_RANK = {
    "debug": 0,
    "info": 1,
    "notice": 2,
    "warning": 3,
    "warn": 3,
    "error": 4,
    "err": 4,
    "critical": 5,
    "crit": 5,
    "alert": 6,
    "emergency": 7,
    "fatal": 7,
    "panic": 7,
}
# fixed values: report severity order, everything else ranks 0
REPORT_RANK = {"warning": 1, "critical": 2}
# fixed values: emoji by report severity
EMOJI = {"critical": ":rotating_light:", "warning": ":warning:", "info": ":information_source:"}
EMOJI_OTHER = ":question:"


def lookup(col: Column, table: dict, default) -> Column:
    """Value of a small literal table, or the default."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), col), F.lit(default))


def severity_rank(col: Column) -> Column:
    """Log severity as 0..7, case-insensitive, unknown or NULL as 0."""
    return lookup(F.lower(F.coalesce(col, F.lit(""))), LOG_RANK, 0)


def rank_of(name: str | None) -> int:
    return LOG_RANK.get((name or "").lower(), 0)


def report_rank(col: Column) -> Column:
    return lookup(F.coalesce(col, F.lit("")), REPORT_RANK, 0)


def severity_emoji(col: Column) -> Column:
    return lookup(F.coalesce(col, F.lit("")), EMOJI, EMOJI_OTHER)
