"""Ordered computations over keys of any size.

A window over a key puts all rows of the key into one task. These helpers cut every key into blocks of
its order column (a time slot, a range of turns), work inside the blocks, and carry one value per block
across: the block table is pre-aggregated, so a key that holds a third of all rows still spreads over
as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.times import slot_of


#: Rows of blocks that one task sorts.
ROWS_AT_ONCE = 250_000


def parts_of(rows: int) -> int:
    """Tasks for this many rows, so that what a task holds does not grow with the table."""
    return 1 + rows // ROWS_AT_ONCE


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add `_key`, a struct of the keys: unlike plain columns it joins NULL to NULL."""
    return df.withColumn("_key", F.struct(*keys))


def _dealt(marked: DataFrame, parts: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows, to be aggregated by key and block, and the same rows in `parts` tasks by them.

    Floating numbers of the key become text, 0.0 for both zeros: windows and joins would bring them to one form themselves, and
    then deal the rows again.
    """
    if not parts:
        return marked, marked
    fields = [(F.col("_key")[f.name], f.name, isinstance(f.dataType, T.FloatType | T.DoubleType)) for f in marked.schema["_key"].dataType]
    key = F.struct(*[((c + F.lit(0.0)).cast("string") if floating else c).alias(name) for c, name, floating in fields])
    marked = marked.withColumn("_key", key)
    return marked, marked.repartition(parts, "_key", "_block")


def blocked_running_sum(
    df: DataFrame, keys: list[str], block: Column, order: list[Column], value: Column, out: str, parts: int | None = None
) -> DataFrame:
    """Running sum of value per key in the given order, this row included.

    The block must not decrease along the order. With `parts` the blocks are dealt to so many tasks.
    """
    marked, dealt = _dealt(keyed(df, keys).withColumn("_block", block).withColumn("_value", value), parts)
    inner = Window.partitionBy("_key", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy("_key", "_block")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    return (
        dealt.withColumn("_inner", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
        .join(carried, ["_key", "_block"])
        .withColumn(out, F.col("_inner") + F.col("_carry"))
        .drop("_key", "_block", "_value", "_inner", "_carry")
    )


def blocked_next(df: DataFrame, keys: list[str], block: Column, order: Column, out: str) -> DataFrame:
    """Value of the order column in the next row of the key; the first row of the next block closes a block."""
    marked = keyed(df, keys).withColumn("_block", block).withColumn("_order", order)
    inner = Window.partitionBy("_key", "_block").orderBy("_order")
    firsts = (
        marked.groupBy("_key", "_block")
        .agg(F.min("_order").alias("_first"))
        .withColumn("_next_block", F.lead("_first").over(Window.partitionBy("_key").orderBy("_block")))
        .drop("_first")
    )
    return (
        marked.withColumn("_lead", F.lead("_order").over(inner))
        .join(firsts, ["_key", "_block"])
        .withColumn(out, F.coalesce("_lead", "_next_block"))
        .drop("_key", "_block", "_order", "_lead", "_next_block")
    )


def blocked_previous(
    df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, out: str, parts: int | None = None
) -> DataFrame:
    """Value in the row before of the key; the last row of the block before opens a block. `parts` as in the running sum."""
    marked, dealt = _dealt(keyed(df, keys).withColumn("_block", block).withColumn("_value", value), parts)
    inner = Window.partitionBy("_key", "_block").orderBy(*order)
    lasts = (
        marked.groupBy("_key", "_block")
        .agg(F.max_by("_value", F.struct(*order)).alias("_last"))
        .withColumn("_last_block", F.lag("_last").over(Window.partitionBy("_key").orderBy("_block")))
        .drop("_last")
    )
    return (
        dealt.withColumn("_no", F.row_number().over(inner))
        .withColumn("_lag", F.lag("_value").over(inner))
        .join(lasts, ["_key", "_block"])
        .withColumn(out, F.when(F.col("_no") == 1, F.col("_last_block")).otherwise(F.col("_lag")))
        .drop("_key", "_block", "_value", "_no", "_lag", "_last_block")
    )


def latest_before(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    right_id: str,
    width_us: int,
    out: str,
) -> DataFrame:
    """For every left row the newest right row of the same keys with left_ts - width <= right_ts <= left_ts.

    No pairs are formed: both sides meet in thin time blocks, a running last value answers inside the block,
    and the newest row of all blocks before is carried in as one value. The result keeps all left rows; `out`
    is a struct of the right columns or NULL. Equal times go to the highest id.
    """
    thin = max(width_us // 16, 1_000_000)
    r = (
        keyed(right, keys)
        .select(
            "_key", F.col(right_ts).alias("_ts"),
            F.struct(F.col(right_ts).alias("_t"), F.col(right_id).alias("_i"), F.struct(*right.columns).alias("_row"))
            .alias("_r"),
        )
        # equal times keep one row, so a burst of copies shrinks before the shuffle
        .groupBy("_key", "_ts")
        .agg(F.max_by("_r", "_r._i").alias("_r"))
    )
    l = keyed(left, keys).select("_key", F.col(left_ts).alias("_ts"), F.struct(*left.columns).alias("_l"))
    both = (
        r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType))
        .unionByName(l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)))
        .withColumn("_block", slot_of(F.col("_ts"), thin))
        .withColumn("_side", F.col("_l").isNotNull().cast("int"))
    )
    inside = Window.partitionBy("_key", "_block").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        both.groupBy("_key", "_block")
        .agg(F.max_by("_r", F.when(F.col("_side") == 0, F.col("_ts"))).alias("_newest"))
        .withColumn("_prev", F.last("_newest", ignorenulls=True).over(before))
        .drop("_newest")
    )
    here = both.withColumn("_here", F.last("_r", ignorenulls=True).over(inside)).filter("_side = 1")
    found = F.coalesce("_here", "_prev")
    return here.join(carried, ["_key", "_block"]).select(
        "_l.*",
        F.when(F.unix_micros(found["_t"]) >= F.unix_micros("_ts") - width_us, found["_row"]).alias(out),
    )
