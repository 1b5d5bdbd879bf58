"""Recent log context of alerts, and active reports of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom import schemas
from logloom.functions.analysis import alert_context
from logloom.functions.services import extract_service
from logloom.functions.text import rfc3339
from logloom.functions.times import slot_of
from logloom.plans.blocks import latest_before
from logloom.session import materialize

WINDOW_SECONDS, CONTEXT_ROWS = 15 * 60, 20


def with_service(alerts: DataFrame, store: bool = False) -> DataFrame:
    """Add the service an alert names, '' when none is found.

    store: write the result to the shared folder, for callers that read it more than once.
    """
    out = alerts.withColumn("service", extract_service(F.col("alert"), F.col("message"), F.col("data")))
    return materialize(out, "alerts") if store else out


def recent_logs(
    alerts: DataFrame,
    logs: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    k: int = CONTEXT_ROWS,
    slices: int = 900,
) -> DataFrame:
    """The k newest log rows of the alert's service with alert.ts - window <= ts <= alert.ts.

    alerts: id, service, ts; logs: id, service, ts, severity, body. Result: alert_id, rank, id, ts, severity, body.

    An alert storm meets a log burst here, so no alert-log pairs are formed. Logs are numbered in time order
    inside window-wide slots of their service: counted per thin time slice, the slices summed up, and the
    row number inside the slice added. An alert then asks for at most k numbers of its slot and the slot
    before. Slots without alerts leave before the first shuffle of log rows.
    """
    width = window_seconds * 1_000_000
    thin = max(width // slices, 1)
    a = alerts.filter(F.coalesce("service", F.lit("")) != "").select(
        "service", "ts", F.col("id").alias("alert_id"), slot_of(F.col("ts"), width).alias("slot")
    )
    wanted = a.select("service", F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("slot")).distinct()
    rows = (
        logs.select("service", "ts", "id", "severity", "body")
        .withColumn("slot", slot_of(F.col("ts"), width))
        .join(wanted, ["service", "slot"], "left_semi")
    )
    both = (
        rows.withColumn("is_log", F.lit(1))
        .unionByName(a.withColumn("is_log", F.lit(0)), allowMissingColumns=True)
        .withColumn("slice", slot_of(F.col("ts"), thin))
    )
    slot = ["service", "slot"]
    earlier = Window.partitionBy(*slot).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = both.groupBy(*slot, "slice").agg(F.sum("is_log").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = (
        Window.partitionBy(*slot, "slice")
        .orderBy("ts", F.col("is_log").desc(), F.col("id").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    numbered = (
        both.withColumn("n", F.sum("is_log").over(inside))
        .join(base, [*slot, "slice"])
        .withColumn("no", F.col("base") + F.col("n"))
    )
    totals = counts.groupBy(*slot).agg(F.sum("n").alias("before")).withColumn("slot", F.col("slot") + 1)

    def last_numbers(upto, n):  # noqa: ANN001, ANN202
        return F.when((upto > 0) & (n > 0), F.sequence(F.greatest(upto - n + 1, F.lit(1)), upto)).otherwise(
            F.array().cast("array<bigint>")
        )

    before = F.coalesce("before", F.lit(0))
    here = F.transform(last_numbers(F.col("no"), F.lit(k)), lambda x: F.struct(F.col("slot").alias("slot"), x.alias("no")))
    prev = F.transform(
        last_numbers(before, k - F.col("no")), lambda x: F.struct((F.col("slot") - 1).alias("slot"), x.alias("no"))
    )
    asked = (
        numbered.filter("is_log = 0")
        .join(totals, slot, "left")
        .select("service", "alert_id", F.col("ts").alias("alert_ts"), F.explode(F.concat(here, prev)).alias("w"))
        .select("service", "alert_id", "alert_ts", "w.slot", "w.no")
    )
    newest = Window.partitionBy("alert_id").orderBy(F.col("ts").desc(), F.col("id"))  # at most k rows
    return (
        asked.join(numbered.filter("is_log = 1").select(*slot, "no", "id", "ts", "severity", "body"), [*slot, "no"])
        .filter(F.unix_micros("ts") >= F.unix_micros("alert_ts") - width)
        .select("alert_id", F.row_number().over(newest).alias("rank"), "id", "ts", "severity", "body")
    )


def enrich_alerts(
    alerts: DataFrame, logs: DataFrame, window_seconds: int = WINDOW_SECONDS, k: int = CONTEXT_ROWS
) -> DataFrame:
    """Alerts with `service`, `n_logs`, `log_context` and the analysis `context`; alerts without logs stay."""
    a = with_service(alerts, store=True)
    line = F.concat(F.lit("["), rfc3339(F.col("ts")), F.lit("] "), F.col("severity"), F.lit(": "), F.col("body"), F.lit("\n"))
    texts = (
        recent_logs(a, logs, window_seconds, k)
        .groupBy("alert_id")
        # at most k lines per alert
        .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
        .select(
            F.col("alert_id").alias("id"), F.size("lines").alias("n_logs"),
            F.array_join(F.col("lines.line"), "").alias("log_context"),
        )
    )
    joined = a.join(texts, "id", "left").fillna({"n_logs": 0, "log_context": ""})
    return joined.withColumn(
        "context",
        alert_context(F.col("source"), F.col("alert"), F.col("message"), F.col("data"), F.col("log_context")),
    )


def find_active(requests: DataFrame, reports: DataFrame, window_seconds: float = 300) -> DataFrame:
    """Requests with `active`: the newest queued, pending or running report of the same trigger and query
    that is at most a window old, as a struct, or NULL."""
    live = reports.filter(F.col("status").isin(*schemas.ACTIVE_STATUS) & F.col("query").isNotNull()).select(
        "trigger", "query", "create_time", "id", "status"
    )
    return latest_before(
        requests, live, ["trigger", "query"], "create_time", "create_time", "id", int(window_seconds * 1_000_000), "active"
    )
