"""Metric samples: instant and range queries, counter rates, quantiles, histograms, log rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.times import slot_of
from logloom.plans.blocks import blocked_next, blocked_previous

LOOKBACK_SECONDS = 300
# fixed values: default bounds of a latency histogram, in seconds
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def instant(
    samples: DataFrame, keys: list[str], at: Column, lookback_seconds: float | None = None, id_col: str = "id"
) -> DataFrame:
    """Latest sample of every series at a time; with a look-back, none older than it."""
    seen = samples.filter(F.col("ts") <= at)
    if lookback_seconds:
        seen = seen.filter(F.unix_micros("ts") > F.unix_micros(at) - int(lookback_seconds * 1_000_000))
    return (
        seen.groupBy(*keys)
        .agg(F.max_by(F.struct("ts", "value"), F.struct("ts", id_col)).alias("s"))
        .select(*keys, "s.ts", "s.value")
    )


def counter_rate(samples: DataFrame, keys: list[str], range_seconds: int, id_col: str = "id") -> DataFrame:
    """Per-second increase of counters per fixed range; a drop is a reset, so the new value counts whole.

    Increases are taken between samples of the same range, as a range selector sees them, without
    extrapolation. Ranges are cut into blocks, so a busy series with a long range stays spread out.
    """
    width = range_seconds * 1_000_000
    ranged = samples.withColumn("slot", slot_of(F.col("ts"), width))
    block = slot_of(F.col("ts"), max(width // 16, 1_000_000))
    seen = blocked_previous(ranged, [*keys, "slot"], block, ["ts", id_col], F.col("value"), "before")
    before = F.col("before")
    step = F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return (
        seen.groupBy(*keys, "slot")
        .agg(F.sum(step).alias("increase"), F.count("*").alias("samples"))
        .select(
            *keys, F.timestamp_micros(F.col("slot") * width).alias("start"),
            (F.col("increase") / range_seconds).alias("rate"), "samples",
        )
    )


def rate_query(
    samples: DataFrame,
    keys: list[str],
    start: Column,
    end: Column,
    step_seconds: int,
    range_seconds: int,
    id_col: str = "id",
    parts: int | None = None,
) -> DataFrame:
    """Per-second increase of counters over the range before every step (the step included, the range's start not).

    Each sample knows the one before it and emits the steps whose range holds it; its increase counts where the range
    holds both. Sums are combined before the shuffle, so a busy series costs its samples times range / step. With `parts`
    the samples are dealt to so many tasks (`parts_of` their number).
    """
    step, width = step_seconds * 1_000_000, range_seconds * 1_000_000
    first, last, us = F.unix_micros(start), F.unix_micros(end), F.unix_micros("ts")
    near = samples.filter((us > first - width) & (F.col("ts") <= end))
    before = F.struct(us.alias("us"), F.col("value").alias("value"))
    seen = blocked_previous(near, keys, slot_of(F.col("ts"), 3_600_000_000), ["ts", id_col], before, "_before", parts)

    def floor_div(x: Column) -> Column:
        return ((x - F.pmod(x, F.lit(step))) / step).cast("bigint")

    low = F.greatest(floor_div(us - first + step - 1), F.lit(0).cast("bigint"))
    high = floor_div(F.least(us + width - 1, last) - first)
    gain = F.when(F.col("value") >= F.col("_before.value"), F.col("value") - F.col("_before.value")).otherwise(F.col("value"))
    at = first + F.col("_n") * step
    inside = F.col("_us") + width > at
    return (
        seen.withColumn("_low", low).withColumn("_high", high)
        .filter("_low <= _high")
        .select(*keys, F.col("_before.us").alias("_us"), gain.alias("_gain"), F.explode(F.sequence("_low", "_high")).alias("_n"))
        .groupBy(*keys, "_n")
        .agg(F.sum(F.when(F.coalesce(inside, F.lit(False)), F.col("_gain")).otherwise(0.0)).alias("_sum"), F.count("*").alias("samples"))
        .select(*keys, F.timestamp_micros(at).alias("step_ts"), (F.col("_sum") / range_seconds).alias("rate"), "samples")
    )


def quantile_of_rate(
    buckets: DataFrame, keys: list[str], q: float, start: Column, end: Column, step_seconds: int, range_seconds: int,
    le: str = "le", id_col: str = "id", parts: int | None = None,
) -> DataFrame:
    """Quantile of the rates of cumulative bucket counters (upper bound le, +Inf included) at every step."""
    rates = rate_query(buckets, [*keys, le], start, end, step_seconds, range_seconds, id_col, parts)
    return histogram_quantile(rates, [*keys, "step_ts"], q, le, "rate")


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float, le: str = "le", value: str = "value") -> DataFrame:
    """Quantile from cumulative buckets (upper bound le, +Inf included) by linear interpolation.

    One histogram has as many rows as bounds, so the windows are small.
    """
    w = Window.partitionBy(*keys).orderBy(le)
    whole = Window.partitionBy(*keys)
    b = (
        buckets.groupBy(*keys, le).agg(F.sum(value).alias("cum"))
        .withColumn("low", F.lag(le).over(w))
        .withColumn("below", F.lag("cum").over(w))
        .withColumn("total", F.max("cum").over(whole))
        .withColumn("rank", F.col("total") * q)
    )
    hit = b.filter(F.col("cum") >= F.col("rank")).groupBy(*keys).agg(F.min_by(F.struct("*"), le).alias("h"))
    h = F.col("h")
    low = F.coalesce(h["low"], F.when(h[le] > 0, 0.0))
    inside = h["cum"] - F.coalesce(h["below"], F.lit(0))
    share = (h["rank"] - F.coalesce(h["below"], F.lit(0))) / F.nullif(inside, F.lit(0))
    infinite = h[le] == float("inf")
    return hit.select(
        *keys,
        F.when(h["total"] == 0, F.lit(None).cast("double"))
        .when(infinite, h["low"])
        .when(low.isNull(), h[le])
        .otherwise(low + (h[le] - low) * F.coalesce(share, F.lit(0.0)))
        .alias("quantile"),
    )


def cumulative_histogram(df: DataFrame, by: list[str], value: Column, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative bucket counts, sum and count per group in one aggregation; one row per bound and +Inf."""
    counts = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*counts, F.count(value).alias("n"), F.sum(value).alias("total"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("value")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("n").alias("value")))
    return wide.select(*by, "n", "total", F.explode(F.array(*rows)).alias("x")).select(
        *by, "x.le", "x.value", F.col("total").alias("sum"), F.col("n").alias("count")
    )


def range_query(
    samples: DataFrame,
    keys: list[str],
    start: Column,
    end: Column,
    step_seconds: int,
    lookback_seconds: int = LOOKBACK_SECONDS,
    id_col: str = "id",
) -> DataFrame:
    """Value of every series at every step: the latest sample not older than the look-back.

    Each sample knows its successor and emits just the steps it answers, so the work is samples plus output
    rows and no step grid is joined. Series are cut into hour blocks for the successor.
    """
    step, back = step_seconds * 1_000_000, lookback_seconds * 1_000_000
    hour = slot_of(F.col("ts"), 3_600_000_000)
    first, last = F.unix_micros(start), F.unix_micros(end)
    near = samples.filter((F.unix_micros("ts") > first - back) & (F.col("ts") <= end))
    seen = blocked_next(near, keys, hour, F.struct(F.unix_micros("ts").alias("us"), F.col(id_col).alias("i")), "_next")
    us = F.unix_micros("ts")
    until = F.least(F.coalesce(F.col("_next.us"), us + back), us + back, last + 1)

    def floor_div(x: Column) -> Column:
        return ((x - F.pmod(x, F.lit(step))) / step).cast("bigint")

    low = F.greatest(floor_div(us - first + step - 1), F.lit(0).cast("bigint"))
    high = floor_div(until - 1 - first)
    return (
        seen.withColumn("_low", low).withColumn("_high", high)
        .filter("_low <= _high")
        .select(*keys, "value", F.explode(F.sequence("_low", "_high")).alias("_n"))
        .select(*keys, F.timestamp_micros(first + F.col("_n") * step).alias("step_ts"), "value")
    )


def log_rate(logs: DataFrame, by: list[str], window_seconds: int = 300) -> DataFrame:
    """Lines per second per fixed window."""
    width = window_seconds * 1_000_000
    return (
        logs.groupBy(*by, slot_of(F.col("ts"), width).alias("slot"))
        .agg(F.count("*").alias("lines"))
        .select(
            *by, F.timestamp_micros(F.col("slot") * width).alias("start"), "lines",
            (F.col("lines") / window_seconds).alias("rate"),
        )
    )


def outcome_counts(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Counter per outcome label."""
    return df.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("count"))
