"""Time and duration texts in mixed formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: duration units in nanoseconds
UNIT_NS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
_UNIT = "ns|us|µs|μs|ms|s|m|h"
_NUMBER = r"(?:\d+\.?\d*|\.\d+)"
_DURATION = rf"^[-+]?(?:{_NUMBER}(?:{_UNIT}))+\z"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[-+]\d{2}:\d{2})\z"
_FLOAT = rf"^[-+]?{_NUMBER}(?:[eE][-+]?\d+)?\z"


def parse_duration(text: Column, default_us: int | None = None) -> Column:
    """Microseconds of a duration such as 1h30m or 250ms; bad text gives the default (NULL if none)."""
    numbers = F.regexp_extract_all(text, F.lit(rf"({_NUMBER})({_UNIT})"), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(rf"({_NUMBER})({_UNIT})"), F.lit(2))
    table = F.create_map(*[F.lit(x) for pair in UNIT_NS.items() for x in pair])
    parts = F.zip_with(
        numbers,
        units,
        lambda n, u: (n.try_cast("decimal(28,9)") * F.try_element_at(table, u).cast("decimal(14,0)")).cast("decimal(38,0)"),
    )
    total = F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    micros = (signed / 1000).cast("bigint")
    parsed = F.when(text.rlike(_DURATION), micros).when(text.rlike(r"^[-+]?0\z"), F.lit(0).cast("bigint"))
    return parsed if default_us is None else F.coalesce(parsed, F.lit(default_us).cast("bigint"))


def parse_time(text: Column, as_of: Column) -> Column:
    """RFC 3339 time, else Unix seconds (fraction dropped), else a duration before as_of, else NULL."""
    stamp = F.when(text.rlike(_RFC3339), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))
    unix = F.when(text.rlike(_FLOAT), F.timestamp_seconds(text.try_cast("double").try_cast("bigint")))
    back = F.timestamp_micros(F.unix_micros(as_of) - parse_duration(text))
    return F.coalesce(stamp, unix, back)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def slot_of(ts: Column, width_us: int) -> Column:
    """Number of the fixed-width time slot a timestamp falls into."""
    us = F.unix_micros(ts)
    return ((us - F.pmod(us, F.lit(width_us))) / F.lit(width_us)).cast("bigint")
