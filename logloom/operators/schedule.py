"""Scheduled inspections as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.analysis import compose_query
from logloom.functions.times import parse_duration


def schedule_ticks(jobs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Inspection requests of jobs (name, interval, metric_query, log_query) between start and end.

    A job first fires one interval after start, then every interval; jobs with a bad interval are left out.
    """
    every = parse_duration(F.col("interval"))
    first, last = F.unix_micros(start), F.unix_micros(end)
    good = jobs.withColumn("_every", every).filter((F.col("_every") > 0) & (first + F.col("_every") <= last))
    ticks = good.withColumn("_us", F.explode(F.sequence(first + F.col("_every"), last, F.col("_every"))))
    return ticks.select(
        "name",
        F.lit("scheduled").alias("trigger"),
        compose_query(
            F.concat(F.lit("Scheduled inspection: "), F.col("name")), F.col("metric_query"), F.col("log_query")
        ).alias("query"),
        F.timestamp_micros("_us").alias("create_time"),
    )


def schedule_history(changes: DataFrame, end: Column) -> DataFrame:
    """Inspection requests up to `end` of jobs that were put in force, changed and removed: the batch form of stream_schedule.

    changes: ts, seq, name, interval, metric_query, log_query. From a change on its job fires every interval, first one interval
    later, until the next change of the job; at the moment of a change the new state holds. A null or bad interval ends the job.
    """
    us, last = F.unix_micros("ts"), F.unix_micros(end)
    order = Window.partitionBy("name").orderBy("ts", "seq")
    spans = changes.select(
        "name", "metric_query", "log_query", us.alias("_from"), parse_duration(F.col("interval")).alias("_every"),
        F.least(F.lead(us - 1).over(order), last).alias("_to"),
    )
    good = spans.filter((F.col("_every") > 0) & (F.col("_from") + F.col("_every") <= F.col("_to")))
    ticks = good.withColumn("_us", F.explode(F.sequence(F.col("_from") + F.col("_every"), F.col("_to"), F.col("_every"))))
    return ticks.select(
        "name",
        F.lit("scheduled").alias("trigger"),
        compose_query(
            F.concat(F.lit("Scheduled inspection: "), F.col("name")), F.col("metric_query"), F.col("log_query")
        ).alias("query"),
        F.timestamp_micros("_us").alias("create_time"),
    )
