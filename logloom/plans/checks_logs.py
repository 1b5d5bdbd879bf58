"""Registered queries over logs, vectors and alerts, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import tokens as tk
from logloom.functions.severity import severity_rank
from logloom.operators import embed as em
from logloom.operators import enrich, ingest_filter, knn, search, templates
from logloom.plans import oracle_views as ov
from logloom.plans import views
from logloom.plans.ingest import ingest
from logloom.session import new_table_path
from logloom.sources import payloads, vector_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-30 00:00:00"
RANGE_DAYS = 20
EMBED_DIM = 32


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(fn):  # noqa: ANN001, ANN202
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _as_of():  # noqa: ANN202
    return F.lit(AS_OF).cast("timestamp")


def _us(name: str = "ts"):  # noqa: ANN202
    return F.unix_micros(name).alias(f"{name}_us")


# --- filters and ingestion ------------------------------------------------------------------------


@query(
    "severity_filter",
    f"WITH {ov.LOGS} SELECT id, service, severity, CASE severity WHEN 'error' THEN 4 WHEN 'warning' THEN 3 END AS rank "
    "FROM logs WHERE severity IN ('error', 'warning')",
)
def severity_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_filter.filter_severity(views.logs(spark, sf), "WARN").select(
        "id", "service", "severity", severity_rank(F.col("severity")).alias("rank")
    )


@query(
    "ingest_stats_severity",
    f"WITH {ov.LOGS} SELECT count(*) FILTER (severity IN ('error', 'warning')) AS ingested, 0::BIGINT AS deduplicated, "
    "count(*) FILTER (severity NOT IN ('error', 'warning')) AS filtered FROM logs",
)
def ingest_stats_severity(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_filter.ingest_stats(ingest_filter.ingest_outcome(views.logs(spark, sf), "severity", "warning"))


@query(
    "mask_template_counts",
    f"WITH {ov.LOGS} SELECT array_to_string({ov.masked('body')}, ' ') AS masked, count(*) AS members FROM logs "
    f"WHERE len({ov.tokens('body')}) > 0 GROUP BY 1",
)
def mask_template_counts(spark: SparkSession, sf: str) -> DataFrame:
    return templates.mask_template_counts(views.logs(spark, sf))


@query(
    "mask_line_counts",
    f"WITH {ov.LINES} SELECT array_to_string({ov.masked('body')}, ' ') AS masked, count(*) AS members FROM lines "
    f"WHERE len({ov.tokens('body')}) > 0 GROUP BY 1",
)
def mask_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return templates.mask_template_counts(views.doc_lines(spark, sf))


@query(
    "parameter_tokens",
    f"WITH {ov.LINES}, t AS (SELECT service, unnest({ov.tokens('body')}) AS token FROM lines) "
    f"SELECT service, count(*) AS tokens, count(*) FILTER ({ov.is_parameter('token')}) AS parameters FROM t GROUP BY 1",
)
def parameter_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = views.doc_lines(spark, sf).select("service", F.explode(tk.tokenize(F.col("body"))).alias("token"))
    return t.groupBy("service").agg(
        F.count("*").alias("tokens"), F.count_if(tk.is_parameter(F.col("token"))).alias("parameters")
    )


def _line_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a document with the next one, masked, without leaving the row."""
    lines = F.split("text", "\n")
    pairs = F.zip_with(
        F.slice(lines, F.lit(1), F.size(lines) - 1), F.slice(lines, F.lit(2), F.size(lines)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    d = views.table(spark, sf, "documents").filter(F.size(lines) > 1)
    return d.select("doc_id", F.posexplode(pairs).alias("line_no", "p")).select(
        "doc_id", "line_no",
        tk.mask_parameters(tk.tokenize(F.col("p.a"))).alias("a"), tk.mask_parameters(tk.tokenize(F.col("p.b"))).alias("b"),
    )


_PAIRS = f"""{ov.LINES}, m AS (SELECT doc_id, line_no, {ov.masked('body')} AS t FROM lines),
  pairs AS (SELECT x.doc_id, x.line_no, x.t AS a, y.t AS b FROM m x JOIN m y ON x.doc_id = y.doc_id AND y.line_no = x.line_no + 1)"""


@query(
    "token_similarity_pairs",
    f"""WITH {_PAIRS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
      CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE round(list_count(list_filter(range(1, least(len(a), len(b)) + 1),
        lambda i: a[i] = b[i] OR a[i] = '<*>' OR b[i] = '<*>'))::DOUBLE / greatest(len(a), len(b)), 6) END AS similarity FROM pairs""",
)
def token_similarity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _line_pairs(spark, sf).select(
        "doc_id", "line_no", F.round(tk.token_similarity(F.col("a"), F.col("b")), 6).alias("similarity")
    )


@query(
    "merge_tokens_pairs",
    f"""WITH {_PAIRS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, array_to_string(list_transform(
      range(1, greatest(len(a), len(b)) + 1), lambda i: CASE WHEN i <= len(a) AND i <= len(b) AND a[i] = b[i] THEN a[i] ELSE '<*>' END), ' ') AS merged
      FROM pairs""",
)
def merge_tokens_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _line_pairs(spark, sf).select(
        "doc_id", "line_no", tk.reconstruct(tk.merge_tokens(F.col("a"), F.col("b"))).alias("merged")
    )


# --- template mining ------------------------------------------------------------------------------


_LINE_ROWS = f"""{ov.LINES}, rows_ AS (
  SELECT doc_id || ':' || line_no AS id, doc_id * 1000000 + line_no AS ord, service, body FROM lines)"""

_ROWS_OUT = """SELECT t.id, {service} len(t.x)::INTEGER AS n_tokens, coalesce(m.template, t.body) AS template,
  CASE WHEN len(t.x) = 0 THEN t.body WHEN m.is_new AND m.founder = t.id THEN m.created END AS created_template,
  len(t.x) = 0 OR (m.is_new AND m.founder = t.id) AS is_new
FROM toks t LEFT JOIN mined m ON t.b IS NOT DISTINCT FROM m.b AND t.x = m.x"""

_CATALOGUE_OUT = """SELECT b AS service, n::INTEGER AS n_tokens, NULL::VARCHAR AS prefix, no::INTEGER AS template_no, template,
  sum(n_rows)::BIGINT AS members, count(*) AS patterns FROM mined GROUP BY ALL"""

_DEDUP_OUT = """SELECT t.id, t.b AS service, coalesce(m.created, t.body) AS body, t.body AS raw_body
FROM toks t LEFT JOIN mined m ON t.b IS NOT DISTINCT FROM m.b AND t.x = m.x WHERE len(t.x) = 0 OR (m.is_new AND m.founder = t.id)"""


def _rows(mined: DataFrame) -> DataFrame:
    return mined.select("id", "service", "n_tokens", "template", "created_template", "is_new")


@query(
    "mine_templates",
    f"WITH RECURSIVE {ov.LOGS}, {ov.mined('logs', 'ts')} {_ROWS_OUT.format(service='t.b AS service,')}",
)
def mine_templates(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(templates.mine_templates(views.logs(spark, sf)))


@query(
    "mine_family_templates",
    f"WITH RECURSIVE {ov.FAMILIES}, {ov.mined('families', 'ts')} {_ROWS_OUT.format(service='t.b AS service,')}",
)
def mine_family_templates(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(templates.mine_templates(views.family_logs(spark, sf)))


@query(
    "mine_global_templates",
    f"WITH RECURSIVE {ov.FAMILIES}, {ov.mined('families', 'ts', by='0')} {_ROWS_OUT.format(service='')}",
)
def mine_global_templates(spark: SparkSession, sf: str) -> DataFrame:
    """One template set over all services."""
    return _rows(templates.mine_templates(views.family_logs(spark, sf), ())).drop("service")


CAPACITY = 3


@query(
    "mine_capacity",
    f"""WITH RECURSIVE {ov.FAMILIES}, {ov.mined_with_capacity('families', 'ts', CAPACITY)}
      SELECT p.id, p.b AS service, c.no::INTEGER AS template_no, c.is_new, CASE WHEN c.is_new THEN array_to_string(p.x, ' ') END AS created_template
      FROM crows p JOIN caps c USING (b, n, k)""",
)
def mine_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every row with at most three templates in a bucket, the least used leaving."""
    out = templates.mine_with_capacity(views.family_logs(spark, sf), CAPACITY)
    return out.where("id is not null").select("id", "service", "template_no", "is_new", "created_template")


@query(
    "capacity_catalogue",
    f"""WITH RECURSIVE {ov.FAMILIES}, {ov.mined_with_capacity('families', 'ts', CAPACITY)}
      SELECT b AS service, n::INTEGER AS n_tokens, no::INTEGER AS template_no, array_to_string(t, ' ') AS template, members FROM left_over""",
)
def capacity_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The templates that are left in the end."""
    out = templates.mine_with_capacity(views.family_logs(spark, sf), CAPACITY)
    return out.where("id is null").select("service", "n_tokens", "template_no", "template", "members")


@query("mine_line_templates", f"WITH RECURSIVE {_LINE_ROWS}, {ov.mined('rows_', 'ord')} {_CATALOGUE_OUT}")
def mine_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    mined = templates.mine_patterns(templates.masked_patterns(views.doc_lines(spark, sf), keep=("ts", "id")))
    return templates.template_catalogue(mined)


@query("family_catalogue", f"WITH RECURSIVE {ov.FAMILIES}, {ov.mined('families', 'ts')} {_CATALOGUE_OUT}")
def family_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return templates.template_catalogue(templates.mine_patterns(templates.masked_patterns(views.family_logs(spark, sf))))


@query("dedup_by_template", f"WITH RECURSIVE {_LINE_ROWS}, {ov.mined('rows_', 'ord')} {_DEDUP_OUT}")
def dedup_by_template(spark: SparkSession, sf: str) -> DataFrame:
    return templates.dedup_by_template(views.doc_lines(spark, sf)).select("id", "service", "body", "raw_body")


@query(
    "template_coverage",
    f"WITH {ov.LINES} SELECT service, CAST(len({ov.tokens('body')}) AS INTEGER) AS n_tokens, count(*) AS members, "
    f"count(DISTINCT array_to_string({ov.masked('body')}, ' ')) AS patterns FROM lines "
    f"WHERE len({ov.tokens('body')}) > 0 GROUP BY 1, 2",
)
def template_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every row and every pattern belongs to exactly one template."""
    mined = templates.mine_patterns(templates.masked_patterns(views.doc_lines(spark, sf), keep=("ts", "id")))
    return templates.template_catalogue(mined).groupBy("service", "n_tokens").agg(
        F.sum("members").alias("members"), F.sum("patterns").alias("patterns")
    )


@query(
    "ingest_template_mode",
    f"WITH RECURSIVE {ov.LOGS}, {ov.mined('logs', 'ts')} SELECT l.id AS source_id, l.service, l.severity, m.created AS body, {EMBED_DIM} AS dim "
    "FROM mined m JOIN logs l ON m.founder = l.id WHERE m.is_new",
)
def ingest_template_mode(spark: SparkSession, sf: str) -> DataFrame:
    records, _ = ingest(views.logs(spark, sf), em.HashEmbedder(EMBED_DIM))
    return records.select("source_id", "service", "severity", "body", F.size("vector").alias("dim"))


@query(
    "ingest_stats_template",
    f"WITH RECURSIVE {ov.FAMILIES}, {ov.mined('families', 'ts')} SELECT sum(is_new::INT)::BIGINT AS ingested, "
    "sum(n_rows - is_new::INT)::BIGINT AS deduplicated, 0::BIGINT AS filtered FROM mined",
)
def ingest_stats_template(spark: SparkSession, sf: str) -> DataFrame:
    logs = views.family_logs(spark, sf).withColumn("severity", F.lit("info"))
    return ingest(logs, em.HashEmbedder(EMBED_DIM))[1]


@query(
    "ingest_severity_mode",
    f"WITH {ov.LOGS} SELECT id AS source_id, service, severity, body, {EMBED_DIM} AS dim FROM logs WHERE severity IN ('error', 'warning')",
)
def ingest_severity_mode(spark: SparkSession, sf: str) -> DataFrame:
    records, _ = ingest(views.logs(spark, sf), em.HashEmbedder(EMBED_DIM), "severity", "warning")
    return records.select("source_id", "service", "severity", "body", F.size("vector").alias("dim"))


# --- vectors --------------------------------------------------------------------------------------


def _all_queries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = views.table(spark, sf, "embeddings")
    return (
        e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")),
        e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")),
    )


_SCORE = {
    "l2": ("CAST(pow(list_distance(a.vector, b.vector), 2) AS FLOAT)", "ASC"),
    "cosine": ("CAST(list_cosine_similarity(a.vector, b.vector) AS FLOAT)", "DESC"),
}


def _knn_sql(metric: str, k: int, queries: str = "e", records: str = "e") -> str:
    score, direction = _SCORE[metric]
    return (
        f"s AS (SELECT a.id AS query_id, b.id, {score} AS score FROM {queries} a, {records} b), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, id) AS rank FROM s) "
        f"SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(CAST(score AS DOUBLE), 6) AS score FROM r WHERE rank <= {k}"
    )


_E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "rank", F.round(F.col("score").cast("double"), 6).alias("score"))


@query("knn_l2", f"WITH {_E}, {_knn_sql('l2', 10)}")
def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(knn.knn(*_all_queries(spark, sf), 10, "l2"))


@query("knn_cosine", f"WITH {_E}, {_knn_sql('cosine', 10)}")
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(knn.knn(*_all_queries(spark, sf), 10, "cosine"))


@query(
    "search_filtered",
    f"WITH {ov.VECTORS}, e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), "
    f"kept AS (SELECT * FROM vectors WHERE service = 'svc-1' AND severity = 'info' "
    f"AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL {RANGE_DAYS + 30} DAY), {_knn_sql('cosine', 5, 'e', 'kept')}",
)
def search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    kept = ingest_filter.metadata_filter(
        views.vectors(spark, sf), _as_of(), (RANGE_DAYS + 30) * 86_400, "svc-1", "info"
    )
    return _hits(knn.knn(_all_queries(spark, sf)[0], kept, 5, "cosine"))


@query("knn_cells_all", f"WITH {_E}, {_knn_sql('l2', 10)}")
def knn_cells_all(spark: SparkSession, sf: str) -> DataFrame:
    """The cell search with every cell probed is exact."""
    queries, vectors = _all_queries(spark, sf)
    return _hits(knn.knn_cells(queries, vectors, knn.train_cells(vectors, 8), 10, "l2", 8))


_SLOTS = (
    "list_transform(list_filter(string_split_regex(lower(body), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: "
    f"{{'i': CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {EMBED_DIM}, "
    "'s': CASE WHEN CAST('0x' || substr(md5(w), 9, 1) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END})"
)
_DENSE = (
    f"list_transform(range(0, {EMBED_DIM}), lambda i: CAST(coalesce(list_sum(list_transform("
    "list_filter(slots, lambda x: x.i = i), lambda x: x.s)), 0) AS DOUBLE))"
)
_NORMED = (
    "list_transform(raw, lambda x: CAST(CAST(CASE WHEN list_dot_product(raw, raw) = 0 THEN 0 "
    "ELSE x / sqrt(list_dot_product(raw, raw)) END AS FLOAT) AS DOUBLE))"
)


def _embed_sql(name: str, source: str) -> str:
    return (
        f"{name}1 AS (SELECT *, {_SLOTS} AS slots FROM {source}), {name}2 AS (SELECT *, {_DENSE} AS raw FROM {name}1), "
        f"{name} AS (SELECT * EXCLUDE (slots, raw), {_NORMED} AS vector FROM {name}2)"
    )


@query(
    "embed_search",
    f"WITH {ov.LOGS}, q0 AS (SELECT DISTINCT event_type AS id, event_type || ' user value' AS body FROM events), "
    f"{_embed_sql('q', 'q0')}, {_embed_sql('v', 'logs')}, {_knn_sql('cosine', 10, 'q', 'v')}",
)
def embed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search by text: one query per event type over all embedded logs."""
    model = em.HashEmbedder(EMBED_DIM)
    asked = views.events(spark, sf).select(
        F.col("event_type").alias("query_id"), F.concat("event_type", F.lit(" user value")).alias("query")
    ).distinct()
    records = em.embed(views.logs(spark, sf), "body", model)
    return _hits(search.search(asked, records, model, 10, metric="cosine"))


@query(
    "search_outcomes",
    f"WITH {ov.LOGS}, q AS (SELECT DISTINCT user_id FROM events) SELECT user_id AS query_id, "
    "CASE WHEN user_id % 7 = 0 THEN 'error_empty_query' WHEN n = 0 THEN 'no_results' ELSE 'success' END AS outcome, "
    "CASE WHEN user_id % 7 = 0 THEN 0 ELSE least(3, n) END::INTEGER AS n_hits FROM q, (SELECT count(*) AS n FROM logs)",
)
def search_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    model = em.HashEmbedder(EMBED_DIM)
    asked = views.events(spark, sf).select(
        F.col("user_id").alias("query_id"),
        F.when(F.col("user_id") % 7 == 0, "").otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("query"),
    ).distinct()
    hits = search.search(asked, em.embed(views.logs(spark, sf), "body", model), model, 3, few=False)  # a query per user
    return search.search_outcomes(asked, hits).select("query_id", "outcome", F.col("n_hits").cast("int").alias("n_hits"))


@query(
    "get_context_range",
    f"WITH {ov.LOGS} SELECT id, epoch_us(ts) AS ts_us, severity, body FROM logs WHERE service = 'svc-2' "
    f"AND ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL {RANGE_DAYS} DAY AND TIMESTAMP '{AS_OF}' ORDER BY ts DESC, id LIMIT 100",
)
def get_context_range(spark: SparkSession, sf: str) -> DataFrame:
    end = dt.datetime.fromisoformat(AS_OF).replace(tzinfo=dt.timezone.utc)
    rows = search.get_context(views.logs(spark, sf), "svc-2", end - dt.timedelta(days=RANGE_DAYS), end, 1000)
    return rows.select("id", _us(), "severity", "body")


@query(
    "get_context_duration",
    f"WITH {ov.VECTORS}, kept AS (SELECT * FROM vectors WHERE service = 'svc-2' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL {RANGE_DAYS + 30} DAY), "
    "s AS (SELECT id, severity, CAST(list_dot_product(vector, vector) AS FLOAT) AS score FROM kept) "
    "SELECT id, severity, round(CAST(score AS DOUBLE), 5) AS score FROM s ORDER BY s.score, id LIMIT 10",
)
def get_context_duration(spark: SparkSession, sf: str) -> DataFrame:
    """The vector-store way: nearest to the empty text, which hashes to the zero vector."""
    end = dt.datetime.fromisoformat(AS_OF)
    rows = search.get_context(
        views.vectors(spark, sf), "svc-2", end - dt.timedelta(days=RANGE_DAYS + 30), end, 10, "duration", _as_of(), em.HashEmbedder(64)
    )
    return rows.select("id", "severity", F.round(F.col("score").cast("double"), 5).alias("score"))


@query(
    "vector_delete",
    f"WITH {ov.VECTORS} SELECT id, service, CAST(len(vector) AS INTEGER) AS dim FROM vectors "
    "WHERE id NOT IN (SELECT id FROM logs WHERE severity = 'debug')",
)
def vector_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = views.logs(spark, sf).filter("severity = 'debug'")
    return vector_table.delete_vectors(views.vectors(spark, sf), gone).select(
        "id", "service", F.size("vector").alias("dim")
    )


@query(
    "vector_upsert",
    f"WITH {ov.LOGS} SELECT id, service, CASE WHEN severity = 'error' THEN 'fixed ' || body ELSE body END AS body FROM logs",
)
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    logs = views.logs(spark, sf)
    fixed = logs.filter("severity = 'error'").withColumn("body", F.concat(F.lit("fixed "), "body"))
    return vector_table.upsert_vectors(logs, fixed).select("id", "service", "body")


@query(
    "vector_table_scan",
    f"WITH {ov.VECTORS} SELECT id, service, epoch_us(ts) // 1000 AS ts_ms, CAST(len(vector) AS INTEGER) AS dim FROM vectors "
    "WHERE service = 'svc-1' AND ts >= TIMESTAMP '2024-01-01 06:00:00'",
)
def vector_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Records written to a table by day and read back for a time span."""
    path = new_table_path(spark, "vector-table")
    vector_table.write_vectors(views.vectors(spark, sf), path)
    rows = vector_table.read_vectors(spark, path, since=F.lit("2024-01-01 06:00:00").cast("timestamp"))
    return ingest_filter.equals_if_given(rows, "service", "svc-1").select(
        "id", "service", F.unix_millis("ts").alias("ts_ms"), F.size("vector").alias("dim")
    )


@query(
    "retention",
    f"WITH {ov.LOGS} SELECT id, service FROM logs WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR",
)
def retention(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_filter.apply_retention(views.logs(spark, sf), _as_of()).select("id", "service")


@query(
    "record_validation",
    f"""WITH {ov.LOGS}, e AS (SELECT vec_id, embedding FROM embeddings),
      r AS (SELECT CASE WHEN l.id % 11 = 0 THEN '' ELSE CAST(l.id AS VARCHAR) END AS id, e.embedding AS vector,
                   CASE WHEN l.id % 13 = 0 THEN '' ELSE l.body END AS body FROM logs l LEFT JOIN e ON e.vec_id = l.id)
      SELECT CASE WHEN id = '' THEN 'record ID is required' WHEN vector IS NULL THEN 'record vector is required'
                  WHEN body = '' THEN 'record body is required' ELSE 'ok' END AS error, count(*) AS n FROM r GROUP BY 1""",
)
def record_validation(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    r = views.logs(spark, sf).join(e, "id", "left").select(
        F.when(F.col("id") % 11 == 0, "").otherwise(F.col("id").cast("string")).alias("id"),
        "vector",
        F.when(F.col("id") % 13 == 0, "").otherwise(F.col("body")).alias("body"),
    )
    return ingest_filter.validate_records(r).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query(
    "column_limits",
    "SELECT doc_id, CASE WHEN strlen(text) > 4096 THEN 'body' ELSE '' END AS too_long FROM documents",
)
def column_limits(spark: SparkSession, sf: str) -> DataFrame:
    r = views.table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("service"),
        F.lit("info").alias("severity"), F.col("text").alias("body"),
    )
    return ingest_filter.check_column_limits(r).select("doc_id", F.array_join("too_long", ",").alias("too_long"))


# --- alerts ---------------------------------------------------------------------------------------


@query("extract_service", f"WITH {ov.ALERTS} SELECT id, service FROM alerts")
def extract_service(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.with_service(views.alerts(spark, sf)).select("id", "service")


_RECENT = f"""{ov.LOGS}, {ov.ALERTS}, hit AS (
  SELECT a.id AS alert_id, l.id, l.ts, l.severity, l.body,
         row_number() OVER (PARTITION BY a.id ORDER BY l.ts DESC, l.id) AS rank
  FROM alerts a JOIN logs l ON l.service = a.service AND l.ts <= a.ts AND l.ts >= a.ts - INTERVAL 6 HOUR)"""


@query("recent_logs", f"WITH {_RECENT} SELECT alert_id, CAST(rank AS INTEGER) AS rank, id, severity FROM hit WHERE rank <= 20")
def recent_logs(spark: SparkSession, sf: str) -> DataFrame:
    a = enrich.with_service(views.alerts(spark, sf), store=True)
    return enrich.recent_logs(a, views.logs(spark, sf), 6 * 3600).select("alert_id", "rank", "id", "severity")


@query(
    "enrich_alerts",
    f"""WITH {_RECENT}, line AS (SELECT alert_id, rank, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '] ' || severity || ': ' || body || chr(10) AS line
        FROM hit WHERE rank <= 20),
      ctx AS (SELECT alert_id, count(*) AS n, string_agg(line, '' ORDER BY rank) AS txt FROM line GROUP BY 1)
      SELECT a.id, a.service, CAST(coalesce(n, 0) AS INTEGER) AS n_logs,
        'Source: grafana' || chr(10) || 'Alert: ' || alert || chr(10) || 'Message: ' || message || chr(10) || 'Data: ' || data
        || CASE WHEN txt IS NULL THEN '' ELSE chr(10) || chr(10) || '=== Recent Log Context ===' || chr(10) || txt END AS context
      FROM alerts a LEFT JOIN ctx ON ctx.alert_id = a.id""",
)
def enrich_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enrich_alerts(views.alerts(spark, sf), views.logs(spark, sf), 6 * 3600).select(
        "id", "service", "n_logs", "context"
    )


# --- payload sources: documents built from the events, read back -----------------------------------


def _text_attr(key: str, value) :  # noqa: ANN001, ANN202
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value"))


@query(
    "otlp_logs",
    "SELECT epoch_us(ts) AS ts_us, 'svc-' || (user_id % 5) AS service, upper(event_type) AS severity, "
    "event_type || ' ' || user_id AS body, CAST(event_id AS VARCHAR) AS event, "
    "CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS even FROM events",
)
def otlp_logs(spark: SparkSession, sf: str) -> DataFrame:
    attrs = F.to_json(
        F.array(
            F.struct(F.lit("event").alias("key"), F.struct(F.col("event_id").cast("string").alias("intValue"), F.lit(None).cast("boolean").alias("boolValue")).alias("value")),
            F.struct(F.lit("even").alias("key"), F.struct(F.lit(None).cast("string").alias("intValue"), (F.col("user_id") % 2 == 0).alias("boolValue")).alias("value")),
        )
    )
    resource = F.to_json(F.array(_text_attr("host.name", F.lit("h1")), _text_attr("service.name", F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")))))
    record = F.concat(
        F.lit('{"timeUnixNano":"'), (F.unix_micros("ts") * 1000).cast("string"), F.lit('","severityText":"'), F.upper("event_type"),
        F.lit('","body":{"stringValue":"'), F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"), F.lit('"},"attributes":'), attrs, F.lit("}"),
    )
    request = F.concat(
        F.lit('{"resourceLogs":[{"resource":{"attributes":'), resource, F.lit('},"scopeLogs":[{"logRecords":['), record, F.lit("]}]}]}")
    )
    rows = payloads.otlp_logs(views.events(spark, sf).select(request.alias("payload")))
    return rows.select(_us(), "service", "severity", "body", F.col("attributes")["event"].alias("event"), F.col("attributes")["even"].alias("even"))


@query(
    "loki_streams",
    "SELECT CAST(epoch_us(ts) * 1000 AS VARCHAR) AS timestamp, event_type AS level, 'user ' || user_id AS message, "
    "'svc-' || (user_id % 5) AS app FROM events UNION ALL "
    "SELECT CAST(epoch_us(ts) * 1000 AS VARCHAR), event_type, 'props ' || json_extract_string(props, '$.k'), 'svc-' || (user_id % 5) FROM events",
)
def loki_streams(spark: SparkSession, sf: str) -> DataFrame:
    ns = (F.unix_micros("ts") * 1000).cast("string")
    values = F.array(
        F.array(ns, F.concat(F.lit("user "), F.col("user_id").cast("string"))), F.array(ns),
        F.array(ns, F.concat(F.lit("props "), F.get_json_object("props", "$.k"))),
    )
    stream = F.create_map(F.lit("app"), F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")), F.lit("level"), F.col("event_type"))
    body = F.to_json(
        F.struct(
            F.lit("success").alias("status"),
            F.struct(F.lit("streams").alias("resultType"), F.array(F.struct(stream.alias("stream"), values.alias("values"))).alias("result")).alias("data"),
        )
    )
    rows = payloads.loki_streams(views.events(spark, sf).select(body.alias("payload")))
    return rows.select("timestamp", "level", "message", F.col("labels")["app"].alias("app"))


@query(
    "victorialogs",
    "SELECT CAST(event_id AS VARCHAR) AS timestamp, event_type AS level, props AS message, "
    "CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n_labels FROM events UNION ALL "
    "SELECT CAST(event_id AS VARCHAR), '', 'second', 1 FROM events WHERE event_id % 2 = 0",
)
def victorialogs(spark: SparkSession, sf: str) -> DataFrame:
    """Odd events arrive as an array, even ones as lines with a broken one between."""
    entry = F.to_json(
        F.struct(F.col("event_id").cast("string").alias("_time"), F.col("event_type").alias("level"), F.col("props").alias("_msg"))
    )
    second = F.to_json(F.struct(F.col("event_id").cast("string").alias("_time"), F.lit("second").alias("_msg")))
    payload = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("["), entry, F.lit("]"))).otherwise(
        F.concat(entry, F.lit("\n\nnot json\n"), second)
    )
    rows = payloads.victorialogs(views.events(spark, sf).select(payload.alias("payload")))
    return rows.select("timestamp", "level", "message", F.size("labels").alias("n_labels"))


@query(
    "prom_result",
    "SELECT event_type AS job, epoch_us(ts) // 1000 AS ms, value FROM events UNION ALL "
    "SELECT event_type, epoch_us(ts) // 1000 + 60000, value FROM events WHERE event_id % 2 = 0",
)
def prom_result(spark: SparkSession, sf: str) -> DataFrame:
    """Even events arrive as a matrix of two points, odd ones as a vector."""
    sec = (F.floor(F.unix_micros("ts") / 1000) / 1000).cast("decimal(18,3)")

    def pair(t):  # noqa: ANN001, ANN202
        return F.concat(F.lit("["), t.cast("string"), F.lit(',"'), F.col("value").cast("string"), F.lit('"]'))

    metric = F.to_json(F.struct(F.col("event_type").alias("job")))
    matrix = F.concat(F.lit('"matrix","result":[{"metric":'), metric, F.lit(',"values":['), pair(sec), F.lit(","), pair(sec + 60), F.lit("]}]"))
    vector = F.concat(F.lit('"vector","result":[{"metric":'), metric, F.lit(',"value":'), pair(sec), F.lit("}]"))
    body = F.concat(F.lit('{"status":"success","data":{"resultType":'), F.when(F.col("event_id") % 2 == 0, matrix).otherwise(vector), F.lit("}}"))
    series = payloads.prom_result(views.events(spark, sf).select(body.alias("payload")))
    return series.select(F.col("labels")["job"].alias("job"), F.explode("points").alias("p")).select(
        "job", F.round(F.col("p.timestamp") * 1000).cast("bigint").alias("ms"), F.col("p.value").alias("value")
    )


@query(
    "alert_payloads",
    "SELECT 'grafana' AS source, event_type AS alert, 'user ' || user_id AS message, "
    "json_extract_string(props, '$.k') AS k FROM events",
)
def alert_payloads(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(
        F.lit('{"source":"grafana","alert":"'), F.col("event_type"), F.lit('","message":"user '), F.col("user_id").cast("string"),
        F.lit('","data":'), F.col("props"), F.lit("}"),
    )
    rows = payloads.alerts(views.events(spark, sf).select(body.alias("payload")))
    return rows.select("source", "alert", "message", F.get_json_object("data", "$.k").alias("k"))


@query(
    "any_value_numbers",
    "SELECT event_id, regexp_replace(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '') AS shown FROM events",
)
def any_value_numbers(spark: SparkSession, sf: str) -> DataFrame:
    v = views.events(spark, sf).select(
        "event_id",
        F.from_json(F.concat(F.lit('{"doubleValue":'), F.col("value").cast("string"), F.lit("}")), "stringValue string, intValue string, doubleValue double, boolValue boolean").alias("v"),
    )
    return v.select("event_id", payloads.any_value_text(F.col("v")).alias("shown"))


_BROKEN = """SELECT event_id AS id, CASE event_id % 5
  WHEN 0 THEN '{"resourceLogs": [' WHEN 1 THEN '{"resourceLogs": "' || event_type || '"}' WHEN 2 THEN NULL
  ELSE '{"resourceLogs": [{"scopeLogs": [{"logRecords": [{"severityText": "' || event_type || '", "body": {"stringValue": "a"}}, {"body": {"intValue": "' || user_id || '"}}]}]}]}'
  END AS payload FROM events"""


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    """OTLP documents with two records each, some of them broken."""
    kind = F.lit('"'), F.col("event_type")
    good = F.concat(
        F.lit('{"resourceLogs": [{"scopeLogs": [{"logRecords": [{"severityText": "'), kind[1],
        F.lit('", "body": {"stringValue": "a"}}, {"body": {"intValue": "'), F.col("user_id").cast("string"), F.lit('"}}]}]}]}'),
    )
    step = F.col("event_id") % 5
    payload = (
        F.when(step == 0, '{"resourceLogs": [').when(step == 1, F.concat(F.lit('{"resourceLogs": "'), kind[1], kind[0], F.lit("}")))
        .when(step > 2, good)
    )
    return views.events(spark, sf).select(F.col("event_id").alias("id"), payload.alias("payload"))


@query(
    "otlp_rejects",
    f"""WITH b AS ({_BROKEN}) SELECT CASE id % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no list at $.resourceLogs' ELSE 'null' END AS reason,
      coalesce(payload, '') AS payload, count(*) AS documents FROM b WHERE id % 5 < 3 GROUP BY ALL""",
)
def otlp_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that give no rows, with the reason."""
    out = payloads.rejects(_broken(spark, sf), "otlp_logs")
    return out.groupBy("reason", F.coalesce("payload", F.lit("")).alias("payload")).agg(F.count("*").alias("documents"))


@query(
    "otlp_records_of_mixed_documents",
    f"""WITH b AS ({_BROKEN}) SELECT severity, body, count(*) AS "rows" FROM (
      SELECT event_type AS severity, 'a' AS body FROM events WHERE event_id % 5 > 2
      UNION ALL SELECT '', user_id::VARCHAR FROM events WHERE event_id % 5 > 2) GROUP BY ALL""",
)
def otlp_records_of_mixed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the documents that can be read, several per document."""
    return payloads.otlp_logs(_broken(spark, sf)).groupBy("severity", "body").agg(F.count("*").alias("rows"))
