"""Registered timer streams over shuffled arrivals, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators import schedule
from logloom.plans import oracle_views as ov
from logloom.plans import views
from logloom.plans.checks_reports import _ADMIT, DAY
from logloom.session import new_table_path
from logloom.streaming.ingest import run_available
from logloom.streaming.timers import stream_admission_in_order, stream_expired, stream_schedule

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

JITTER_SECONDS, PARTS, DELAY = 6 * 3600, 3, "20 days"
#: Later than every event by more than the delay and the retention.
FAR = "2030-01-01 00:00:00"


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(fn):  # noqa: ANN001, ANN202
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def shuffled_stream(rows: DataFrame, ts: str, key: str, end: str = FAR) -> tuple[DataFrame, DataFrame]:
    """The rows as a stream in which each comes up to six hours late, in PARTS stretches, and a clock that ends at `end`.

    A stretch is written whole before the next; its files are read in any order, which the delay allows for.
    """
    spark, path = rows.sparkSession, new_table_path(rows.sparkSession, "arrivals")
    at = F.unix_micros(ts) + F.pmod(F.xxhash64(key), F.lit(JITTER_SECONDS * 1_000_000))
    placed = rows.withColumn("_at", at)
    low, high = placed.agg(F.min("_at"), F.max("_at")).first()
    step = ((high or 0) - (low or 0)) // PARTS + 1
    for k in range(PARTS):
        part = placed.where((F.col("_at") >= F.lit((low or 0) + k * step)) & (F.col("_at") < F.lit((low or 0) + (k + 1) * step)))
        part.drop("_at").withColumn("_clock", F.lit(None).cast("timestamp")).write.parquet(f"{path}/{k}")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
    spark.range(1).select(*blank, F.lit(end).cast("timestamp").alias("_clock")).write.parquet(f"{path}/{PARTS}")
    schema = T.StructType([*rows.schema.fields, T.StructField("_clock", T.TimestampType())])
    files = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/*")
    clock = files().where("_clock is not null").select(F.col("_clock").alias("ts"))
    return files().where("_clock is null").drop("_clock"), clock


@query("stream_admission_in_order", _ADMIT)
def admission_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The decisions of `admit_requests` by the stream with a reorder buffer."""
    requests, clock = shuffled_stream(views.requests(spark, sf), "create_time", "id")
    out = run_available(stream_admission_in_order(requests, DAY, DELAY, clock), "stream-admission")
    return out.select("id", "admitted", F.coalesce(F.col("blocked_by").cast("bigint"), F.lit(-1)).alias("blocked_by"))


RETENTION_DAYS, MARK = 9, "2024-01-25 00:00:00"


@query(
    "stream_expired",
    f"WITH {ov.LOGS} SELECT id, epoch_us(ts) // 1000 AS ts_ms FROM logs WHERE ts < TIMESTAMP '{MARK}' - INTERVAL {RETENTION_DAYS} DAY",
)
def expired(spark: SparkSession, sf: str) -> DataFrame:
    """What the retention has taken out once the watermark stands at MARK; no row comes later than the clock says."""
    kept = views.logs(spark, sf).where(F.col("ts") < F.lit(MARK).cast("timestamp")).select("id", "ts")
    end = str(spark.range(1).select((F.lit(MARK).cast("timestamp") + F.expr(f"INTERVAL {DELAY}")).cast("string")).first()[0])
    records, clock = shuffled_stream(kept, "ts", "id", end)
    out = run_available(stream_expired(records, RETENTION_DAYS * 86_400, DELAY, clock), "stream-expired")
    return out.select("id", F.unix_millis("ts").alias("ts_ms"))


SCHEDULE_END = "2024-02-20 00:00:00"


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups put jobs in force or change them, every seventh of them ends its job."""
    e = views.events(spark, sf).where("event_type = 'signup'")
    hours = (F.col("event_id") % 7 + 5).cast("string")
    return e.select(
        "ts", F.col("event_id").alias("seq"), F.concat(F.lit("job "), (F.col("user_id") % 50).cast("string")).alias("name"),
        F.when(F.col("event_id") % 7 != 0, F.concat(hours, F.lit("h"))).alias("interval"),
        F.lit("up").alias("metric_query"), F.concat(F.lit("by "), F.col("event_id").cast("string")).alias("log_query"),
    )


_SCHEDULE = f"""WITH c AS (
    SELECT event_id, 'job ' || (user_id % 50) AS name, epoch_us(ts) AS us, CASE WHEN event_id % 7 <> 0 THEN (event_id % 7 + 5) * 3600000000 END AS every,
           lead(epoch_us(ts)) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS upto
    FROM events WHERE event_type = 'signup'
  ), s AS (SELECT *, least(coalesce(upto, 9000000000000000000), epoch_us(TIMESTAMP '{SCHEDULE_END}')) AS stop FROM c WHERE every IS NOT NULL)
  SELECT name, 'Scheduled inspection: ' || name || chr(10) || 'Check logs: by ' || event_id AS query,
         unnest(range(us + every, stop, every)) AS tick_us FROM s"""


@query("schedule_history", _SCHEDULE)
def history(spark: SparkSession, sf: str) -> DataFrame:
    end = F.lit(SCHEDULE_END).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    return schedule.schedule_history(_changes(spark, sf), end).select("name", "query", F.unix_micros("create_time").alias("tick_us"))


@query("stream_schedule", _SCHEDULE)
def scheduled(spark: SparkSession, sf: str) -> DataFrame:
    """The same requests by one timer for each job, the changes in shuffled order."""
    end = str(spark.range(1).select((F.lit(SCHEDULE_END).cast("timestamp") + F.expr(f"INTERVAL {DELAY}")).cast("string")).first()[0])
    changes, clock = shuffled_stream(_changes(spark, sf), "ts", "seq", end)
    out = run_available(stream_schedule(changes, clock, DELAY), "stream-schedule")
    return out.select("name", "query", F.unix_micros("create_time").alias("tick_us"))
