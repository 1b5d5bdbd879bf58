"""Registered queries over the report table, its life cycle, admission and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import analysis
from logloom.operators import admission, enrich, lifecycle, notify, reports, schedule
from logloom.plans import oracle_views as ov
from logloom.plans import ranks
from logloom.plans import views
from logloom.schemas import REPORT_ENUMS
from logloom.session import new_table_path
from logloom.streaming.admission import stream_admission
from logloom.streaming.ingest import run_available

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-02-01 00:00:00"
DAY = 86_400


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(fn):  # noqa: ANN001, ANN202
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _as_of():  # noqa: ANN202
    return F.lit(AS_OF).cast("timestamp")


def _plain(df: DataFrame) -> DataFrame:
    """Report rows with comparable column types."""
    return df.select(
        "id", F.unix_micros("create_time").alias("created_us"), "trigger", "status", "severity", "summary", "detail",
        F.coalesce("query", F.lit("-")).alias("query"), F.array_join("datasources", ",").alias("datasources"), "iterations",
    )


_PLAIN = (
    "id, epoch_us(create_time) AS created_us, trigger, status, severity, summary, detail, coalesce(query, '-') AS query, "
    "array_to_string(datasources, ',') AS datasources, iterations"
)

# --- predicates, order, aggregates ----------------------------------------------------------------

_WHERE = {
    "eq": (lambda: reports.all_of(reports.eq("status", "running"), reports.neq("severity", "info")), "status = 'running' AND severity <> 'info'"),
    "in": (
        lambda: reports.all_of(reports.is_in("trigger", ["manual", "webhook"]), reports.not_in("iterations", [0, 5])),
        "trigger IN ('manual', 'webhook') AND iterations NOT IN (0, 5)",
    ),
    "range": (
        lambda: reports.all_of(
            reports.gte("create_time", F.lit("1996-01-01").cast("timestamp")), reports.lt("create_time", F.lit("1998-01-01").cast("timestamp")),
            reports.gt("iterations", 2), reports.lte("iterations", 7),
        ),
        "create_time >= TIMESTAMP '1996-01-01' AND create_time < TIMESTAMP '1998-01-01' AND iterations > 2 AND iterations <= 7",
    ),
    "substring": (
        lambda: reports.all_of(reports.contains("summary", "URGENT"), reports.has_prefix("query", "check cust 1"), reports.has_suffix("query", "7")),
        "contains(summary, 'URGENT') AND starts_with(query, 'check cust 1') AND ends_with(query, '7')",
    ),
    "fold": (
        lambda: reports.any_of(reports.equal_fold("status", "RUNNING"), reports.contains_fold("summary", "2-high")),
        "lower(status) = 'running' OR contains(lower(summary), '2-high')",
    ),
    "nil": (lambda: reports.is_nil("query"), "query IS NULL"),
    "not_nil": (lambda: reports.not_nil("query"), "query IS NOT NULL"),
    "bool": (
        lambda: reports.negate(reports.any_of(reports.eq("status", "completed"), reports.all_of(reports.eq("severity", "info"), reports.gt("iterations", 4)))),
        "NOT (status = 'completed' OR (severity = 'info' AND iterations > 4))",
    ),
}


def _where(condition):  # noqa: ANN001, ANN202
    return lambda spark, sf: _plain(views.reports(spark, sf).filter(condition()))


for _name, (_condition, _sql) in _WHERE.items():
    query(f"report_where_{_name}", f"WITH {ov.REPORTS} SELECT {_PLAIN} FROM reports WHERE {_sql}")(_where(_condition))


@query(
    "report_where_in_table",
    f"WITH {ov.REPORTS} SELECT id, status FROM reports WHERE query IN (SELECT 'check cust ' || c_custkey FROM customer WHERE c_acctbal < 0)",
)
def report_where_in_table(spark: SparkSession, sf: str) -> DataFrame:
    poor = views.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("check cust "), F.col("c_custkey").cast("string")))
    return reports.where_in_table(views.reports(spark, sf), "query", poor).select("id", "status")


@query(
    "report_group_agg",
    f"WITH {ov.REPORTS} SELECT trigger, status, count(*) AS n, CAST(sum(iterations) AS BIGINT) AS total, round(avg(iterations), 6) AS mean, "
    "min(iterations) AS low, max(iterations) AS high FROM reports GROUP BY 1, 2",
)
def report_group_agg(spark: SparkSession, sf: str) -> DataFrame:
    return reports.aggregate(
        views.reports(spark, sf), ["trigger", "status"], n=reports.count(), total=reports.total("iterations"),
        mean=F.round(reports.mean("iterations"), 6), low=reports.minimum("iterations"), high=reports.maximum("iterations"),
    )


@query(
    "report_global_agg",
    f"WITH {ov.REPORTS} SELECT count(*) AS n, CAST(sum(iterations) AS BIGINT) AS total, round(avg(iterations), 6) AS mean, "
    "epoch_us(min(create_time)) AS first_us, max(summary) AS high FROM reports",
)
def report_global_agg(spark: SparkSession, sf: str) -> DataFrame:
    return reports.aggregate(
        views.reports(spark, sf), [], n=reports.count(), total=reports.total("iterations"),
        mean=F.round(reports.mean("iterations"), 6), first_us=F.unix_micros(reports.minimum("create_time")), high=reports.maximum("summary"),
    )


@query("report_distinct", f"WITH {ov.REPORTS} SELECT DISTINCT trigger, query FROM reports WHERE query IS NOT NULL")
def report_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return reports.distinct_fields(views.reports(spark, sf).filter(reports.not_nil("query")), "trigger", "query")


@query("report_count", f'WITH {ov.REPORTS} SELECT count(*) AS "count" FROM reports WHERE status = \'queued\'')
def report_count(spark: SparkSession, sf: str) -> DataFrame:
    return reports.count_rows(views.reports(spark, sf).filter(reports.eq("status", "queued")))


@query("report_count_distinct", f'WITH {ov.REPORTS} SELECT count(*) AS "count" FROM (SELECT DISTINCT query, severity FROM reports)')
def report_count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return reports.count_rows(views.reports(spark, sf), "query", "severity")


@query("report_list", f"WITH {ov.REPORTS} SELECT {_PLAIN} FROM reports ORDER BY create_time DESC, id LIMIT 50")
def report_list(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(reports.list_reports(views.reports(spark, sf)))


@query(
    "report_page",
    f"WITH {ov.REPORTS} SELECT id, severity, iterations FROM reports ORDER BY severity, iterations DESC, id LIMIT 25 OFFSET 40",
)
def report_page(spark: SparkSession, sf: str) -> DataFrame:
    return reports.page(views.reports(spark, sf).select("id", "severity", "iterations"), ["severity", "-iterations", "id"], 25, 40)


@query(
    "report_exist",
    f"WITH {ov.REPORTS}, s AS (SELECT unnest(['queued', 'pending', 'running', 'completed', 'failed']) AS status) "
    "SELECT status, EXISTS (SELECT 1 FROM reports r WHERE r.status = s.status) AS found FROM s",
)
def report_exist(spark: SparkSession, sf: str) -> DataFrame:
    """Whether there is a report of each status."""
    r = views.reports(spark, sf)
    found = [(s, reports.exists(r.filter(reports.eq("status", s)))) for s in REPORT_ENUMS["status"]]
    return spark.createDataFrame(found, "status string, found boolean")


@query(
    "report_first",
    f"""WITH {ov.REPORTS} SELECT 'oldest' AS asked, id FROM (SELECT id FROM reports ORDER BY create_time, id LIMIT 1)
      UNION ALL SELECT 'busiest' AS asked, id FROM (SELECT id FROM reports ORDER BY iterations DESC, id DESC LIMIT 1)""",
)
def report_first(spark: SparkSession, sf: str) -> DataFrame:
    r = views.reports(spark, sf)
    found = [("oldest", reports.first(r, ["create_time", "id"])["id"]), ("busiest", reports.first_id(r, ["-iterations", "-id"]))]
    return spark.createDataFrame(found, "asked string, id long")


@query(
    "report_only",
    f"""WITH {ov.REPORTS}, m AS (SELECT max(id) AS id FROM reports), n AS (SELECT count(*) AS n FROM reports WHERE status = 'queued')
      SELECT 'one' AS asked, id FROM m UNION ALL SELECT 'none', -1 UNION ALL SELECT 'several', CASE WHEN n > 1 THEN -2 ELSE NULL END FROM n""",
)
def report_only(spark: SparkSession, sf: str) -> DataFrame:
    """The single report of a condition; -1 where there is none and -2 where there are several."""
    r = views.reports(spark, sf)
    last = r.agg(F.max("id")).first()[0]
    found = []
    for asked, rows in (("one", r.filter(reports.eq("id", last))), ("none", r.filter(reports.eq("id", -5))), ("several", r.filter(reports.eq("status", "queued")))):
        try:
            found.append((asked, reports.only(rows)["id"] if asked == "one" else reports.only_id(rows)))
        except reports.NotFoundError:
            found.append((asked, -1))
        except reports.NotSingularError:
            found.append((asked, -2))
    return spark.createDataFrame(found, "asked string, id long")


@query(
    "report_jump",
    f"WITH {ov.REPORTS} SELECT id, iterations FROM reports ORDER BY iterations DESC, id OFFSET (SELECT count(*) // 2 FROM reports) LIMIT 70",
)
def report_jump(spark: SparkSession, sf: str) -> DataFrame:
    """Seventy reports in the middle of an ordering with few values, found by counting passes."""
    r = views.reports(spark, sf).select("id", "iterations")
    return ranks.rows_at(r, ["-iterations", "id"], r.count() // 2, 70, rows=200)


@query("log_jump", f"WITH {ov.LOGS} SELECT id FROM logs ORDER BY ts DESC, id OFFSET (SELECT count(*) * 9 // 10 FROM logs)")
def log_jump(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest tenth of the logs, newest first."""
    logs = views.logs(spark, sf).select("id", "ts")
    return ranks.rows_at(logs, ["-ts", "id"], logs.count() * 9 // 10, rows=300).select("id")


@query("report_offset", f"WITH {ov.REPORTS} SELECT id, iterations FROM reports ORDER BY iterations DESC, id OFFSET 100")
def report_offset(spark: SparkSession, sf: str) -> DataFrame:
    return reports.page(views.reports(spark, sf).select("id", "iterations"), ["-iterations", "id"], None, 100)


@query("report_ids", f"WITH {ov.REPORTS} SELECT id FROM reports WHERE severity = 'critical'")
def report_ids(spark: SparkSession, sf: str) -> DataFrame:
    return reports.ids(views.reports(spark, sf).filter(reports.eq("severity", "critical")))


# --- life cycle -----------------------------------------------------------------------------------


@query("report_current", f"WITH {ov.REPORTS} SELECT {_PLAIN}, epoch_us(create_time) + 120000000 AS updated_us FROM reports")
def report_current(spark: SparkSession, sf: str) -> DataFrame:
    current = lifecycle.current_reports(views.report_events(spark, sf))
    return _plain(current.withColumn("u", F.unix_micros("update_time"))).join(
        current.select("id", F.unix_micros("update_time").alias("updated_us")), "id"
    )


@query(
    "report_upsert",
    f"WITH {ov.REPORTS} SELECT id, CASE WHEN query IS NULL THEN 'no query' ELSE summary END AS summary, "
    "CASE WHEN query IS NULL THEN iterations + 1 ELSE iterations END AS iterations FROM reports",
)
def report_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Updates appended as new versions, then the current view."""
    r = views.reports(spark, sf)
    changes = r.filter("query is null").select("id", F.lit("no query").alias("summary"), (F.col("iterations") + 1).alias("iterations"))
    versions = r.unionByName(lifecycle.updated(r, changes, _as_of()))
    return lifecycle.current_reports(versions).select("id", "summary", "iterations")


@query(
    "report_update_where",
    f"WITH {ov.REPORTS} SELECT id, iterations + 3 AS iterations, array_to_string(list_concat(datasources, ['traces']), ',') AS datasources, "
    "query IS NULL AS cleared FROM (SELECT * REPLACE (NULL AS query) FROM reports WHERE status = 'running')",
)
def report_update_where(spark: SparkSession, sf: str) -> DataFrame:
    values = {**lifecycle.add_iterations(3), **lifecycle.append_datasources(["traces"]), **lifecycle.clear_query()}
    new = lifecycle.update_where(views.reports(spark, sf), reports.eq("status", "running"), values, _as_of())
    return new.select("id", "iterations", F.array_join("datasources", ",").alias("datasources"), F.col("query").isNull().alias("cleared"))


@query("report_delete", f"WITH {ov.REPORTS} SELECT id, status FROM reports WHERE NOT (status = 'completed' AND severity = 'info')")
def report_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Tombstones hide the deleted reports from the current view."""
    r = views.reports(spark, sf)
    gone = lifecycle.deleted_where(r, reports.all_of(reports.eq("status", "completed"), reports.eq("severity", "info")), _as_of())
    versions = r.withColumn("deleted", F.lit(False)).unionByName(gone)
    return lifecycle.current_reports(versions).select("id", "status")


@query(
    "report_table",
    f"WITH {ov.REPORTS} SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, "
    "CASE WHEN status = 'running' THEN 'timed out' ELSE summary END AS summary FROM reports WHERE NOT (severity = 'info' AND status = 'completed')",
)
def report_table(spark: SparkSession, sf: str) -> DataFrame:
    """Create, update and delete against the stored version log, then the current view."""
    stored = lifecycle.ReportTable(spark, new_table_path(spark, "reports"))
    stored.create(views.reports(spark, sf), _as_of(), first=True)
    late = stored.current().filter("status = 'running'").select("id", F.lit("failed").alias("status"), F.lit("timed out").alias("summary"))
    stored.update(late, _as_of())
    stored.delete_where(reports.all_of(reports.eq("severity", "info"), reports.eq("status", "completed")), _as_of())
    return stored.current().select("id", "status", "summary")


@query(
    "report_create_conflicts",
    f"WITH {ov.REPORTS}, n AS (SELECT id + 500 AS id FROM reports) SELECT id, id IN (SELECT id FROM reports) AS conflict FROM n",
)
def report_create_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    r = views.reports(spark, sf)
    fresh, taken = lifecycle.split_new(r, r.select((F.col("id") + 500).alias("id")))
    return fresh.withColumn("conflict", F.lit(False)).unionByName(taken.withColumn("conflict", F.lit(True)))


@query(
    "report_checks",
    f"WITH {ov.REPORTS} SELECT CASE WHEN query IS NULL THEN 'invalid enum value for status field: paused' ELSE 'ok' END AS error, count(*) AS n FROM reports GROUP BY 1",
)
def report_checks(spark: SparkSession, sf: str) -> DataFrame:
    r = views.reports(spark, sf).withColumn("status", F.when(F.col("query").isNull(), "paused").otherwise(F.col("status")))
    full = lifecycle.check_report(lifecycle.with_defaults(r, _as_of()))
    return full.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query(
    "report_get",
    f"WITH {ov.REPORTS}, w AS (SELECT DISTINCT CAST(l_orderkey * 2 AS BIGINT) AS id FROM lineitem) SELECT w.id, CASE WHEN r.id IS NULL THEN 'not_found' ELSE 'found' END AS outcome, "
    "coalesce(r.status, '-') AS status FROM w LEFT JOIN reports r ON r.id = w.id",
)
def report_get(spark: SparkSession, sf: str) -> DataFrame:
    wanted = views.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("id"))
    return lifecycle.get_reports(views.reports(spark, sf), wanted).select("id", "outcome", F.coalesce("status", F.lit("-")).alias("status"))


@query(
    "report_transitions",
    f"""WITH {ov.REPORTS} SELECT id, CASE WHEN id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
      CASE WHEN id % 5 = 0 THEN 'info' ELSE 'warning' END AS severity,
      CASE WHEN id % 5 = 0 THEN 'Analysis failed: timeout' ELSE 'done ' || id END AS summary,
      CASE WHEN id % 5 = 0 THEN 0 ELSE 3 END AS iterations FROM reports WHERE status = 'queued'""",
)
def report_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """queued → running → completed or failed, as versions, then the current view of those reports."""
    queued = views.reports(spark, sf).filter("status = 'queued'")
    running = lifecycle.started(queued, F.timestamp_micros(F.unix_micros("create_time") + 1))
    failed = F.col("id") % 5 == 0
    results = running.select(
        "id", F.when(failed, "timeout").alias("error"), F.lit("warning").alias("severity"),
        F.concat(F.lit("done "), F.col("id").cast("string")).alias("summary"), F.lit("").alias("detail"),
        F.array(F.lit("metrics")).alias("datasources"), F.lit(3).alias("iterations"),
    )
    done = lifecycle.finished(running, results, F.timestamp_micros(F.unix_micros("create_time") + 2))
    versions = queued.unionByName(running).unionByName(done)
    return lifecycle.current_reports(versions).select("id", "status", "severity", "summary", "iterations")


@query(
    "drain_orphans",
    f"WITH {ov.REPORTS} SELECT id, 'failed' AS status, 'Analysis queue drained during shutdown' AS summary FROM reports WHERE status = 'queued'",
)
def drain_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.drain_orphans(views.reports(spark, sf), _as_of()).select("id", "status", "summary")


@query(
    "find_active",
    f"""WITH {ov.REQUESTS}, rep AS (SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'manual' ELSE 'webhook' END AS trigger,
        'check user ' || user_id AS query, ts AS create_time, CASE event_type WHEN 'error' THEN 'running' WHEN 'click' THEN 'queued' ELSE 'completed' END AS status FROM events),
      j AS (SELECT r.id, p.id AS active_id, row_number() OVER (PARTITION BY r.id ORDER BY p.create_time DESC, p.id DESC) AS n
        FROM requests r LEFT JOIN rep p ON p.trigger = r.trigger AND p.query = r.query AND p.status IN ('queued', 'running')
          AND p.create_time <= r.create_time AND p.create_time >= r.create_time - INTERVAL 2 DAY)
      SELECT id, coalesce(active_id, -1) AS active_id FROM j WHERE n = 1""",
)
def find_active(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "running").when(F.col("event_type") == "click", "queued").otherwise("completed")
    rep = views.events(spark, sf).select(
        F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "manual").otherwise("webhook").alias("trigger"),
        F.concat(F.lit("check user "), F.col("user_id").cast("string")).alias("query"), F.col("ts").alias("create_time"), status.alias("status"),
    )
    found = enrich.find_active(views.requests(spark, sf), rep, 2 * DAY)
    return found.select("id", F.coalesce("active.id", F.lit(-1)).alias("active_id"))


_ADMIT = f"""WITH RECURSIVE {ov.REQUESTS},
  chain AS (
    SELECT trigger, query, min(create_time) AS t FROM requests GROUP BY 1, 2
    UNION ALL
    SELECT c.trigger, c.query, min(r.create_time) AS t FROM chain c JOIN requests r
      ON r.trigger = c.trigger AND r.query = c.query AND r.create_time > c.t + INTERVAL 1 DAY GROUP BY c.trigger, c.query, c.t),
  adm AS (SELECT c.trigger, c.query, c.t, min(r.id) AS id FROM chain c JOIN requests r
      ON r.trigger = c.trigger AND r.query = c.query AND r.create_time = c.t GROUP BY 1, 2, 3)
  SELECT r.id, r.id = a.id AS admitted, CASE WHEN r.id = a.id THEN -1 ELSE a.id END AS blocked_by
  FROM requests r ASOF JOIN adm a ON r.trigger = a.trigger AND r.query = a.query AND r.create_time >= a.t"""


@query("admit_requests", _ADMIT)
def admit_requests(spark: SparkSession, sf: str) -> DataFrame:
    out = admission.admit_requests(views.requests(spark, sf), DAY, slots_per_chunk=8)
    return out.select("id", "admitted", F.coalesce("blocked_by", F.lit(-1)).alias("blocked_by"))


@query("stream_admission", _ADMIT)
def stream_admissions(spark: SparkSession, sf: str) -> DataFrame:
    """The same decisions by the stateful stream."""
    requests = views.event_stream(spark, sf).select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "manual").otherwise("webhook").alias("trigger"),
        F.concat(F.lit("check user "), F.col("user_id").cast("string")).alias("query"), F.col("ts").alias("create_time"),
    )
    out = run_available(stream_admission(requests, DAY, ttl_seconds=None), "stream-admission")
    return out.select("id", "admitted", F.coalesce(F.col("blocked_by").cast("bigint"), F.lit(-1)).alias("blocked_by"))


# --- notifications and texts ----------------------------------------------------------------------


@query("notify_filter", f"WITH {ov.REPORTS} SELECT id, severity FROM reports WHERE severity IN ('warning', 'critical')")
def notify_filter(spark: SparkSession, sf: str) -> DataFrame:
    return notify.notify_filter(views.reports(spark, sf), "warning").select("id", "severity")


_EMOJI = "CASE severity WHEN 'critical' THEN ':rotating_light:' WHEN 'warning' THEN ':warning:' WHEN 'info' THEN ':information_source:' ELSE ':question:' END"


@query(
    "slack_payload",
    f"""WITH {ov.REPORTS}, p AS (SELECT *, {_EMOJI} AS emoji, strftime(create_time, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM reports WHERE status = 'completed' AND severity IN ('warning', 'critical')),
      f AS (SELECT *, array_to_string(list_filter([
          '{{"type":"mrkdwn","text":' || to_json('*Trigger*' || chr(10) || trigger) || '}}',
          CASE WHEN len(datasources) > 0 THEN '{{"type":"mrkdwn","text":' || to_json('*Datasources*' || chr(10) || array_to_string(datasources, ', ')) || '}}' END,
          '{{"type":"mrkdwn","text":' || to_json('*Time*' || chr(10) || '<!date^' || (epoch_us(create_time) // 1000000) || '^{{date_short}} {{time_secs}}|' || stamp || '>') || '}}'
        ], lambda x: x IS NOT NULL), ',') AS fields FROM p)
      SELECT id, severity, '{{"text":' || to_json(emoji || ' [' || severity || '] ' || summary) || ',"blocks":[{{"type":"header","text":{{"type":"plain_text","text":'
        || to_json(emoji || ' Alert — ' || severity) || '}}}},{{"type":"section","text":{{"type":"mrkdwn","text":' || to_json('*Summary*' || chr(10) || summary) || '}}}}'
        || CASE WHEN detail <> '' THEN ',{{"type":"section","text":{{"type":"mrkdwn","text":' || to_json('*Detail*' || chr(10) || detail) || '}}}}' ELSE '' END
        || ',{{"type":"section","fields":[' || fields || ']}}]}}' AS payload FROM f""",
)
def slack_payload(spark: SparkSession, sf: str) -> DataFrame:
    return notify.notification_payloads(views.reports(spark, sf), "warning")


@query(
    "notification_json",
    f"""WITH {ov.REPORTS} SELECT id, '{{"id":' || id || ',"trigger":"' || trigger || '","trigger_id":"' || trigger_id || '","severity":"' || severity || '","summary":' || to_json(summary)
      || ',"detail":' || to_json(detail) || ',"datasources":' || to_json(datasources) || ',"iterations":' || iterations || ',"created_at":"' || strftime(create_time, '%Y-%m-%dT%H:%M:%SZ') || '"}}' AS payload FROM reports""",
)
def notification_json(spark: SparkSession, sf: str) -> DataFrame:
    return views.reports(spark, sf).select("id", notify.notification_json().alias("payload"))


@query(
    "compose_query",
    f"""WITH {ov.REPORTS} SELECT id, CASE WHEN query IS NULL THEN 'Check metrics: up' ELSE query END
      || CASE WHEN detail <> '' THEN chr(10) || 'Check logs: ' || detail ELSE '' END AS composed FROM reports""",
)
def compose_query(spark: SparkSession, sf: str) -> DataFrame:
    return views.reports(spark, sf).select("id", analysis.compose_query(F.col("query"), F.lit("up"), F.col("detail")).alias("composed"))


@query(
    "initial_prompt",
    f"""WITH {ov.REPORTS} SELECT id, '## Trigger: ' || trigger || ' (ID: ' || trigger_id || ')' || chr(10) || chr(10) || '## Available Datasources:' || chr(10)
      || CASE WHEN len(datasources) = 0 THEN 'No datasources configured.' ELSE '[' || array_to_string(list_transform(datasources, lambda d: '{{"name":"' || d || '","type":"store"}}'), ',') || ']' END
      || CASE WHEN query IS NULL THEN '' ELSE chr(10) || chr(10) || '## Query:' || chr(10) || query END
      || CASE WHEN detail = '' THEN '' ELSE chr(10) || chr(10) || '## Additional Context:' || chr(10) || detail END AS prompt FROM reports""",
)
def initial_prompt(spark: SparkSession, sf: str) -> DataFrame:
    ds = F.transform("datasources", lambda d: F.struct(d.alias("name"), F.lit("store").alias("type")))
    return views.reports(spark, sf).select(
        "id", analysis.initial_prompt(F.col("trigger"), F.col("trigger_id"), ds, F.col("query"), F.col("detail")).alias("prompt")
    )


@query(
    "schedule_ticks",
    """WITH jobs AS (SELECT 'job ' || s_suppkey AS name, (s_suppkey % 20 + 1) * 30 AS mins, s_suppkey % 9 = 0 AS bad FROM supplier)
      SELECT name, 'scheduled' AS trigger, 'Scheduled inspection: ' || name || chr(10) || 'Check logs: error' AS query,
        epoch_us(unnest(range(TIMESTAMP '2024-01-01' + to_minutes(mins), TIMESTAMP '2024-01-03' + INTERVAL 1 MICROSECOND, to_minutes(mins)))) AS tick_us
      FROM jobs WHERE NOT bad""",
)
def schedule_ticks(spark: SparkSession, sf: str) -> DataFrame:
    minutes = ((F.col("s_suppkey") % 20 + 1) * 30).cast("string")
    jobs = views.table(spark, sf, "supplier").select(
        F.concat(F.lit("job "), F.col("s_suppkey").cast("string")).alias("name"),
        F.when(F.col("s_suppkey") % 9 == 0, "soon").otherwise(F.concat(minutes, F.lit("m"))).alias("interval"),
        F.lit("up").alias("metric_query"), F.lit("error").alias("log_query"),
    )
    ticks = schedule.schedule_ticks(jobs, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-03").cast("timestamp"))
    return ticks.select("name", "trigger", "query", F.unix_micros("create_time").alias("tick_us"))
