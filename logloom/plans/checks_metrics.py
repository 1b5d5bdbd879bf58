"""Registered queries over transcripts, metric samples, log queries and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import analysis, times
from logloom.functions.text import truncate
from logloom.operators import logquery, metrics, transcripts
from logloom.operators.embed import HashEmbedder
from logloom.plans import oracle_views as ov
from logloom.plans import views
from logloom.plans.blocks import blocked_running_sum, parts_of
from logloom.session import new_table_path
from logloom.sources import vector_table
from logloom.streaming.dedup import drop_repeats, stream_template_dedup
from logloom.streaming.ingest import hourly_counts, run_available, stream_ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(fn):  # noqa: ANN001, ANN202
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _ts(text: str):  # noqa: ANN202
    return F.lit(text).cast("timestamp")


# --- transcripts ----------------------------------------------------------------------------------

_TURNS = """t AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first_turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
  x AS (SELECT *, sum(CASE WHEN role = 'assistant' AND turn > first_turn THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS ex,
               sum(CASE WHEN role = 'assistant' AND turn > first_turn THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS n_ex FROM t)"""
_CUT = f"CASE WHEN strlen(text) <= 200 THEN text ELSE {ov.byte_prefix('text', 200)} || '...' END"
_SUMMARY = f"""{_TURNS}, s AS (SELECT conv_id, ex, string_agg(CASE WHEN role = 'assistant' AND text <> '' THEN 'Assistant: ' || {_CUT} END, '; ' ORDER BY turn) AS summary
  FROM x WHERE ex > 0 GROUP BY 1, 2)"""


@query("exchange_groups", f"WITH {_TURNS} SELECT conv_id, turn, role, CAST(ex AS BIGINT) AS exchange_no FROM x WHERE ex > 0")
def exchange_groups(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.group_exchanges(views.transcripts(spark, sf)).select("conv_id", "turn", "role", "exchange_no")


@query("exchange_summaries", f"WITH {_SUMMARY} SELECT conv_id, CAST(ex AS BIGINT) AS exchange_no, summary FROM s")
def exchange_summaries(spark: SparkSession, sf: str) -> DataFrame:
    t = transcripts.with_tool_columns(views.transcripts(spark, sf))
    return transcripts.summarize_exchanges(transcripts.numbered_messages(t))


@query(
    "compact_transcript",
    f"""WITH {_SUMMARY}, k AS (SELECT *, ex > n_ex - 2 AS kept FROM x),
      c AS (SELECT conv_id, n > 3 AND n_ex > 2 AND kept_n + 2 < n AS compacted, first_turn FROM
            (SELECT conv_id, any_value(n) AS n, any_value(n_ex) AS n_ex, any_value(first_turn) AS first_turn, count(*) FILTER (kept) AS kept_n FROM k GROUP BY 1))
      SELECT k.conv_id, k.turn, 0 AS seq, role, text AS content, compacted FROM k JOIN c ON k.conv_id = c.conv_id
        WHERE NOT compacted OR kept OR k.turn = k.first_turn
      UNION ALL
      SELECT c.conv_id, c.first_turn, 1, 'user', '[CONVERSATION HISTORY SUMMARY]' || chr(10) || 'Earlier investigation steps were summarized to save context:' || chr(10)
          || string_agg('- ' || s.summary || chr(10), '' ORDER BY s.ex), true
        FROM c JOIN s ON s.conv_id = c.conv_id JOIN (SELECT DISTINCT conv_id, n_ex FROM x) m ON m.conv_id = c.conv_id
        WHERE compacted AND s.ex <= m.n_ex - 2 GROUP BY c.conv_id, c.first_turn""",
)
def compact_transcript(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.compact(views.transcripts(spark, sf)).select("conv_id", "turn", "seq", "role", "content", "compacted")


_P500 = f"CASE WHEN strlen(text) <= 500 THEN text ELSE {ov.byte_prefix('text', 500)} || '...' END"


@query(
    "parse_analysis",
    f"""SELECT conv_id, turn, 'info' AS severity, {_P500} AS summary, text AS detail FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'assistant') WHERE n = 1""",
)
def parse_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Final answers of the conversations; plain prose becomes the summary."""
    return transcripts.final_answers(views.transcripts(spark, sf))


@query(
    "parse_json_analysis",
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'info' WHEN turn % 4 = 0 THEN 'critical' WHEN turn % 4 = 1 THEN 'info' ELSE 'warning' END AS severity,
      CASE WHEN turn % 4 = 3 THEN '[]' ELSE role END AS summary, CASE WHEN turn % 4 = 3 THEN '[]' ELSE text END AS detail FROM conversations""",
)
def parse_json_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Every message wrapped as a fenced JSON answer with a known, unknown or missing severity, or as an array."""
    severity = F.when(F.col("turn") % 4 == 0, "critical").when(F.col("turn") % 4 == 1, "dreadful").otherwise("warning")
    doc = F.to_json(F.struct(severity.alias("severity"), F.col("role").alias("Summary"), F.col("content").alias("detail")))
    answer = F.concat(F.lit("```json\n"), F.when(F.col("turn") % 4 == 3, "[]").otherwise(doc), F.lit("```"))
    t = views.transcripts(spark, sf).select("conv_id", "turn", analysis.parse_analysis(answer).alias("a"))
    return t.select("conv_id", "turn", "a.severity", "a.summary", "a.detail")


@query(
    "iterations",
    "SELECT conv_id, count(*) FILTER (role = 'assistant') AS iterations, count(*) FILTER (role = 'assistant') >= 3 AS limit_reached FROM conversations GROUP BY 1",
)
def iterations(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.iterations(views.transcripts(spark, sf), 3)


@query(
    "truncate_result",
    f"""SELECT doc_id, line_no, CASE WHEN strlen(body) <= 100 THEN body ELSE p || chr(10) || chr(10) || '[TRUNCATED: original ' || strlen(body) || ' chars, showing first ' || strlen(p) || ']' END AS content
      FROM (SELECT doc_id, line_no, body, {ov.byte_prefix('body', 100)} AS p FROM (WITH {ov.LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, body FROM lines))""",
)
def truncate_result(spark: SparkSession, sf: str) -> DataFrame:
    """Document lines as tool results, cut at 100 bytes."""
    t = views.doc_lines(spark, sf).select("doc_id", "line_no", F.lit("tool").alias("role"), F.col("body").alias("content"))
    return transcripts.truncate_results(t, 100).select("doc_id", "line_no", "content")


@query("truncate_text", f"SELECT conv_id, turn, {_CUT} AS content FROM conversations")
def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    return views.transcripts(spark, sf).select("conv_id", "turn", truncate(F.col("content"), 200).alias("content"))


# fixed values: error texts handed out to events by user
_ERRORS = (
    ("invalid parameters: query", "parameter_validation"), ("dial tcp: connection refused", "connection"),
    ("metrics query failed: bad data", "query"), ("out of memory", "execution"), ("query failed: timeout", "connection"),
)


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    error = F.get(F.array(*[F.lit(e) for e, _ in _ERRORS]), (F.col("user_id") % len(_ERRORS)).cast("int"))
    return views.events(spark, sf).select(F.col("event_id").alias("call_id"), F.col("user_id").alias("conv_id"), F.col("event_type").alias("tool_name"), error.alias("error"))


@query(
    "tool_error_category",
    "SELECT event_type AS tool_name, CASE user_id % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_ERRORS)) + " END AS category, count(*) AS errors FROM events GROUP BY 1, 2",
)
def tool_error_category(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.tool_errors(_calls(spark, sf))


@query("unknown_tools", "SELECT event_id AS call_id, event_type AS tool_name FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_type < 'q')")
def unknown_tools(spark: SparkSession, sf: str) -> DataFrame:
    registry = _calls(spark, sf).filter("tool_name < 'q'")
    return transcripts.unknown_tools(_calls(spark, sf), registry).select("call_id", "tool_name")


@query("datasources_used", "SELECT user_id AS conv_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS datasources FROM events GROUP BY 1")
def datasources_used(spark: SparkSession, sf: str) -> DataFrame:
    t = _calls(spark, sf).withColumn("role", F.lit("tool"))
    return transcripts.datasources_used(t).select("conv_id", F.array_join("datasources", ",").alias("datasources"))


@query(
    "call_error_class",
    """SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'auth' WHEN user_id % 5 IN (1, 2) THEN 'context_overflow' WHEN user_id % 5 = 3 THEN 'invalid_request' ELSE 'other' END AS class,
      user_id % 5 = 4 AS retryable FROM events""",
)
def call_error_class(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("user_id") % 5
    status = F.when(kind == 0, 403).when(kind == 4, 529).otherwise(400)
    code = F.when(kind == 1, "context_length_exceeded").otherwise("")
    body = F.when(kind == 2, '{"message":"Prompt is too long"}').otherwise("{}")
    return views.events(spark, sf).select(
        "event_id", analysis.call_error_class(status, code, body).alias("class"), analysis.is_retryable(status, code, body).alias("retryable")
    )


# --- metrics --------------------------------------------------------------------------------------

_KEYS = ["service", "event_type"]


@query(
    "metric_instant",
    f"WITH {ov.SAMPLES} SELECT service, event_type, epoch_us(ts) AS ts_us, value FROM (SELECT *, row_number() OVER (PARTITION BY service, event_type ORDER BY ts DESC, id DESC) AS n "
    "FROM samples WHERE ts <= TIMESTAMP '2024-01-20 12:00:00') WHERE n = 1",
)
def metric_instant(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.instant(views.samples(spark, sf), _KEYS, _ts("2024-01-20 12:00:00"))
    return rows.select(*_KEYS, F.unix_micros("ts").alias("ts_us"), "value")


@query(
    "metric_rate",
    f"""WITH {ov.SAMPLES}, c AS (SELECT *, sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY service, event_type, date_trunc('day', ts) ORDER BY ts, id) AS total FROM samples),
      s AS (SELECT *, epoch_us(ts) // 21600000000 AS slot, lag(total) OVER (PARTITION BY service, event_type, epoch_us(ts) // 21600000000 ORDER BY ts, id) AS before FROM c)
      SELECT service, event_type, slot * 21600000000 AS start_us, CAST(sum(CASE WHEN before IS NULL THEN 0 WHEN total >= before THEN total - before ELSE total END) AS DOUBLE) AS increase,
        count(*) AS samples FROM s GROUP BY 1, 2, 3""",
)
def metric_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that start again every day."""
    s = views.samples(spark, sf)
    day = times.slot_of(F.col("ts"), 86_400_000_000)
    counters = blocked_running_sum(
        s.withColumn("day", day), [*_KEYS, "day"], times.slot_of(F.col("ts"), 3_600_000_000), [F.col("ts"), F.col("id")],
        F.col("value").cast("decimal(18,2)"), "total",
    ).withColumn("value", F.col("total").cast("double"))
    rows = metrics.counter_rate(counters, _KEYS, 21_600)
    # back to cents: the sums are exact there
    return rows.select(*_KEYS, F.unix_micros("start").alias("start_us"), F.round(F.col("rate") * 21_600, 2).alias("increase"), "samples")


_COUNTERS = f"""{ov.SAMPLES}, c AS (SELECT *, epoch_us(ts) AS us,
  sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY service, event_type, date_trunc('day', ts) ORDER BY ts, id) AS total FROM samples)"""
_STEPS = "st AS (SELECT epoch_us(unnest(range(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-28' + INTERVAL 1 MICROSECOND, INTERVAL 6 HOUR))) AS step_us)"


def _counters(spark: SparkSession, sf: str, parts: int) -> DataFrame:
    """Counters that start again every day."""
    day = times.slot_of(F.col("ts"), 86_400_000_000)
    return blocked_running_sum(
        views.samples(spark, sf).withColumn("day", day), [*_KEYS, "day"], times.slot_of(F.col("ts"), 3_600_000_000),
        [F.col("ts"), F.col("id")], F.col("value").cast("decimal(18,2)"), "total", parts,
    ).withColumn("value", F.col("total").cast("double"))


@query(
    "rate_step",
    f"""WITH {_COUNTERS}, {_STEPS}, s AS (SELECT *, lag(us) OVER o AS b_us, lag(total) OVER o AS b FROM c WINDOW o AS (PARTITION BY service, event_type ORDER BY ts, id))
      SELECT service, event_type, step_us, CAST(sum(CASE WHEN b IS NULL OR b_us <= step_us - 43200000000 THEN 0 WHEN total >= b THEN total - b ELSE total END) AS DOUBLE) AS increase,
        count(*) AS samples FROM st JOIN s ON us <= step_us AND us > step_us - 43200000000 GROUP BY 1, 2, 3""",
)
def rate_step(spark: SparkSession, sf: str) -> DataFrame:
    """The increase over half a day, every six hours."""
    parts = parts_of(views.samples(spark, sf).count())
    rows = metrics.rate_query(_counters(spark, sf, parts), _KEYS, _ts("2024-01-03"), _ts("2024-01-28"), 21_600, 43_200, parts=parts)
    return rows.select(*_KEYS, F.unix_micros("step_ts").alias("step_us"), F.round(F.col("rate") * 43_200, 2).alias("increase"), "samples")


_BOUNDS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0)
_BOUND_ROWS = ", ".join(f"({b})" for b in _BOUNDS)
_HIST = f"""{ov.SAMPLES}, b AS (SELECT * FROM (VALUES {_BOUND_ROWS}, ('Infinity'::DOUBLE)) v(le)),
  h AS (SELECT service, le, count(*) FILTER (value <= le) AS cum, count(*) AS n FROM samples, b GROUP BY 1, 2)"""


@query("latency_histogram", f"WITH {_HIST} SELECT service, CASE WHEN isinf(le) THEN -1.0 ELSE CAST(le AS DOUBLE) END AS le, cum AS value, n AS \"count\" FROM h")
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    h = metrics.cumulative_histogram(views.samples(spark, sf), ["service"], F.col("value"), _BOUNDS)
    return h.select("service", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "value", "count")


@query(
    "histogram_quantile",
    f"""WITH {_HIST}, w AS (SELECT *, CAST(le AS DOUBLE) AS hi, coalesce(CAST(lag(le) OVER o AS DOUBLE), 0) AS lo, coalesce(lag(cum) OVER o, 0) AS below FROM h WINDOW o AS (PARTITION BY service ORDER BY le)),
      f AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY le) AS k FROM w WHERE cum >= 0.9 * n)
      SELECT service, round(CASE WHEN isinf(hi) THEN lo ELSE lo + (hi - lo) * (0.9 * n - below) / (cum - below) END, 6) AS quantile FROM f WHERE k = 1""",
)
def histogram_quantile(spark: SparkSession, sf: str) -> DataFrame:
    h = metrics.cumulative_histogram(views.samples(spark, sf), ["service"], F.col("value"), _BOUNDS)
    return metrics.histogram_quantile(h, ["service"], 0.9).select("service", F.round("quantile", 6).alias("quantile"))


_BUCKETS = f"""{ov.SAMPLES}, bounds AS (SELECT * FROM (VALUES {_BOUND_ROWS}, ('Infinity'::DOUBLE)) v(le)),
  k AS (SELECT service, le, epoch_us(ts) AS us, id, sum((value <= le)::INT) OVER (PARTITION BY service, le ORDER BY ts, id) AS total FROM samples, bounds)"""


@query(
    "quantile_of_rate",
    f"""WITH {_BUCKETS}, {_STEPS}, s AS (SELECT *, lag(us) OVER o AS b_us, lag(total) OVER o AS b FROM k WINDOW o AS (PARTITION BY service, le ORDER BY us, id)),
      h AS (SELECT service, le, step_us, CAST(sum(CASE WHEN b IS NULL OR b_us <= step_us - 43200000000 THEN 0 ELSE total - b END) AS DOUBLE) AS cum
        FROM st JOIN s ON us <= step_us AND us > step_us - 43200000000 GROUP BY 1, 2, 3),
      w AS (SELECT *, CAST(le AS DOUBLE) AS hi, coalesce(CAST(lag(le) OVER o AS DOUBLE), 0) AS lo, coalesce(lag(cum) OVER o, 0) AS below,
        max(cum) OVER (PARTITION BY service, step_us) AS n FROM h WINDOW o AS (PARTITION BY service, step_us ORDER BY le)),
      f AS (SELECT *, row_number() OVER (PARTITION BY service, step_us ORDER BY le) AS r FROM w WHERE cum >= 0.9 * n)
      SELECT service, step_us, round(CASE WHEN n = 0 THEN NULL WHEN isinf(hi) THEN lo ELSE lo + (hi - lo) * coalesce((0.9 * n - below) / nullif(cum - below, 0), 0) END, 6) AS quantile
      FROM f WHERE r = 1""",
)
def quantile_of_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The 0.9 quantile of the values of half a day, every six hours, from bucket counters."""
    le = F.explode(F.array(*(F.lit(float(b)) for b in (*_BOUNDS, float("inf")))))
    samples = views.samples(spark, sf)
    parts = parts_of(samples.count() * (len(_BOUNDS) + 1))
    ones = samples.select("service", "ts", "id", "value", le.alias("le"))
    counters = blocked_running_sum(
        ones, ["service", "le"], times.slot_of(F.col("ts"), 3_600_000_000), [F.col("ts"), F.col("id")],
        F.when(F.col("value") <= F.col("le"), 1).otherwise(0).cast("decimal(18,0)"), "total", parts,
    ).withColumn("value", F.col("total").cast("double"))
    rows = metrics.quantile_of_rate(counters, ["service"], 0.9, _ts("2024-01-03"), _ts("2024-01-28"), 21_600, 43_200, parts=parts)
    return rows.select("service", F.unix_micros("step_ts").alias("step_us"), F.round("quantile", 6).alias("quantile"))


@query(
    "log_rate",
    f"WITH {ov.LOGS} SELECT service, epoch_us(ts) // 300000000 * 300000000 AS start_us, count(*) AS lines, round(count(*) / 300.0::DOUBLE, 6) AS rate FROM logs GROUP BY 1, 2",
)
def log_rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.log_rate(views.logs(spark, sf), ["service"])
    return rows.select("service", F.unix_micros("start").alias("start_us"), "lines", F.round("rate", 6).alias("rate"))


@query(
    "range_step",
    f"""WITH {ov.SAMPLES}, st AS (SELECT unnest(range(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-28' + INTERVAL 1 MICROSECOND, INTERVAL 30 MINUTE)) AS step_ts),
      j AS (SELECT service, event_type, step_ts, value, row_number() OVER (PARTITION BY service, event_type, step_ts ORDER BY ts DESC, id DESC) AS n
        FROM st JOIN samples ON ts <= step_ts AND ts > step_ts - INTERVAL 2 HOUR)
      SELECT service, event_type, epoch_us(step_ts) AS step_us, value FROM j WHERE n = 1""",
)
def range_step(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.range_query(views.samples(spark, sf), _KEYS, _ts("2024-01-03"), _ts("2024-01-28"), 1800, 7200)
    return rows.select(*_KEYS, F.unix_micros("step_ts").alias("step_us"), "value")


@query("outcome_counts", f"WITH {ov.LOGS} SELECT severity AS outcome, count(*) AS \"count\" FROM logs GROUP BY 1")
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.outcome_counts(views.logs(spark, sf), "severity")


# --- log queries ----------------------------------------------------------------------------------


@query(
    "log_search",
    f"WITH {ov.LOGS} SELECT id, body FROM logs WHERE contains(body, 'user 1') AND regexp_matches(body, 'value [0-9]{{2}}\\.') AND NOT contains(body, 'click')",
)
def log_search(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("body")
    hit = logquery.line_contains(b, "user 1") & logquery.line_matches(b, r"value [0-9]{2}\.") & logquery.line_contains(b, "click", True)
    return views.logs(spark, sf).filter(hit).select("id", "body")


@query(
    "log_phrase",
    f"WITH {ov.LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM lines WHERE regexp_matches(body, '(^|[^0-9A-Za-z_])of the([^0-9A-Za-z_]|$)') "
    "AND NOT regexp_matches(body, '(^|[^0-9A-Za-z_])and([^0-9A-Za-z_]|$)')",
)
def log_phrase(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("body")
    return views.doc_lines(spark, sf).filter(logquery.has_phrase(b, "of the") & ~logquery.has_phrase(b, "and")).select("doc_id", "line_no")


@query(
    "log_labels",
    f"WITH {ov.LOGS} SELECT id, '[' || severity || '] ' || service || ' ' || body AS line FROM logs WHERE service = 'svc-3' AND severity = 'notice'",
)
def log_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label selector and line format."""
    labels = F.create_map(F.lit("app"), F.col("service"), F.lit("level"), F.col("severity"))
    rows = views.logs(spark, sf).withColumn("labels", labels).filter(logquery.has_labels(F.col("labels"), {"app": "svc-3", "level": "notice"}))
    return rows.select("id", logquery.format_line("[%s] %s %s", F.col("severity"), F.col("service"), F.col("body")).alias("line"))


@query("log_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def log_json_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.events(spark, sf).select("event_id", logquery.json_field(F.col("props"), "$.k").alias("k"))
    return rows.filter(F.col("k").cast("int") >= 50)


@query(
    "log_window_page",
    f"WITH {ov.LOGS} SELECT id, body FROM logs WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND contains(body, 'error') ORDER BY ts, id LIMIT 50 OFFSET 20",
)
def log_window_page(spark: SparkSession, sf: str) -> DataFrame:
    end = dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc)
    return logquery.query_logs(
        views.logs(spark, sf), logquery.line_contains(F.col("body"), "error"), end=end, since_seconds=10 * 86_400, direction="forward", offset=20
    ).select("id", "body")


# --- times ----------------------------------------------------------------------------------------

_FORM = "event_id % 4"


@query(
    "parse_time",
    f"""SELECT event_id, CASE {_FORM} WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 1 THEN epoch_us(ts) // 1000000 * 1000000 - 5400000000
      WHEN 2 THEN epoch_us(TIMESTAMP '2024-02-01') - user_id * 60000000 ELSE -1 END AS at_us FROM events""",
)
def parse_time(spark: SparkSession, sf: str) -> DataFrame:
    form = F.col("event_id") % 4
    text = (
        F.when(form == 0, F.concat((F.unix_seconds("ts")).cast("string"), F.lit(".75")))
        .when(form == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30")))
        .when(form == 2, F.concat(F.col("user_id").cast("string"), F.lit("m")))
        .otherwise("yesterday")
    )
    at = times.parse_time(text, _ts("2024-02-01"))
    return views.events(spark, sf).select("event_id", F.coalesce(F.unix_micros(at), F.lit(-1)).alias("at_us"))


@query(
    "parse_duration",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id * 3600000000 + 1500000 WHEN 1 THEN user_id * 1000 ELSE 300000000 END AS us FROM events""",
)
def parse_duration(spark: SparkSession, sf: str) -> DataFrame:
    n, form = F.col("user_id").cast("string"), F.col("event_id") % 3
    text = F.when(form == 0, F.concat(n, F.lit("h1.5s"))).when(form == 1, F.concat(n, F.lit("ms"))).otherwise(F.concat(n, F.lit(" parsecs")))
    return views.events(spark, sf).select("event_id", times.parse_duration(text, 300_000_000).alias("us"))


# --- streams --------------------------------------------------------------------------------------


def _log_stream(spark: SparkSession, sf: str) -> DataFrame:
    return views.as_logs(views.event_stream(spark, sf))


def _family_stream(spark: SparkSession, sf: str) -> DataFrame:
    return views.as_family_logs(views.event_stream(spark, sf))


@query(
    "stream_dedup",
    f"WITH RECURSIVE {ov.FAMILIES}, {ov.mined('families', 'ts')} SELECT t.id, t.b AS service, m.created AS body, t.body AS raw_body "
    "FROM mined m JOIN toks t ON m.founder = t.id WHERE m.is_new",
)
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Founding rows of the templates of the log stream."""
    return run_available(stream_template_dedup(_family_stream(spark, sf)), "stream-dedup").select("id", "service", "body", "raw_body")


@query(
    "stream_ingest_stats",
    f"WITH RECURSIVE {ov.FAMILIES}, {ov.mined('families', 'ts')} SELECT sum(is_new::INT)::BIGINT AS ingested, "
    "sum(n_rows - is_new::INT)::BIGINT AS deduplicated, 0::BIGINT AS filtered FROM mined",
)
def stream_ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What became of the rows of the log stream, over all its micro-batches."""
    path = new_table_path(spark, "stream-stats")
    logs = _family_stream(spark, sf).withColumn("severity", F.lit("info"))
    writer = stream_ingest(logs, HashEmbedder(16), f"{path}/table", f"{path}/checkpoint", stats_path=f"{path}/stats")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/stats").agg(*(F.sum(c).alias(c) for c in ("ingested", "deduplicated", "filtered")))


@query(
    "stream_drop_repeats",
    f"WITH {ov.LOGS} SELECT DISTINCT service, array_to_string({ov.masked('body')}, ' ') AS masked FROM logs",
)
def stream_drop_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """One row per masked text and service, as the delay covers the whole table."""
    return run_available(drop_repeats(_log_stream(spark, sf), "60 days"), "stream-repeats").select("service", "masked")


@query(
    "stream_ingest",
    f"WITH {ov.LOGS} SELECT id AS source_id, service, body, 16 AS dim FROM logs WHERE severity = 'error'",
)
def stream_ingestion(spark: SparkSession, sf: str) -> DataFrame:
    """The log stream into a vector table, errors only."""
    path = new_table_path(spark, "stream-ingest")
    writer = stream_ingest(_log_stream(spark, sf), HashEmbedder(16), f"{path}/table", f"{path}/checkpoint", "severity", "error")
    writer.trigger(availableNow=True).start().awaitTermination()
    return vector_table.read_vectors(spark, f"{path}/table").select("source_id", "service", "body", F.size("vector").alias("dim"))


@query(
    "stream_retention",
    f"""WITH {ov.LOGS}, h AS (SELECT service, date_trunc('hour', ts) AS h, count(*) AS "rows" FROM logs GROUP BY 1, 2)
      SELECT service, epoch_us(h) AS hour_us, "rows" FROM h WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM logs) - INTERVAL 72 HOUR""",
)
def stream_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Hours that left the state, 72 hours behind the newest row."""
    out = run_available(hourly_counts(_log_stream(spark, sf)), "stream-retention")
    return out.select("service", F.unix_micros("window.start").alias("hour_us"), "rows")
