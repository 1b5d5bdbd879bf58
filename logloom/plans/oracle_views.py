"""The domain views as SQL, for checking results with another engine."""

from __future__ import annotations

from logloom.functions.text import UNI_SPACE
from logloom.functions.tokens import PARAMETER, SEPARATORS, WILDCARD

LOGS = """logs AS (
  SELECT event_id AS id, ts, 'svc-' || (user_id % 5) AS service,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'notice'
                         WHEN 'click' THEN 'info' WHEN 'view' THEN 'debug' END AS severity,
         event_type || ' user ' || user_id || ' value ' || CAST(value AS VARCHAR) || ' k '
           || json_extract_string(props, '$.k') AS body
  FROM events)"""

LINES = """lines AS (
  SELECT doc_id, source AS service, unnest(string_split(text, chr(10))) AS body,
         unnest(range(0, len(string_split(text, chr(10))))) AS line_no
  FROM documents)"""

VECTORS = f"""{LOGS}, vectors AS (
  SELECT l.*, CAST(e.embedding AS DOUBLE[]) AS vector FROM embeddings e JOIN logs l ON e.vec_id = l.id)"""

REPORTS = """reports AS (
  SELECT o_orderkey AS id, o_orderdate AS create_time,
         CASE o_custkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'webhook' ELSE 'scheduled' END AS trigger,
         't-' || o_orderkey AS trigger_id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' END AS status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'warning' ELSE 'info' END AS severity,
         'Order ' || o_orderkey || ' ' || o_orderpriority AS summary,
         CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Total ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS detail,
         CASE WHEN o_custkey % 10 <> 0 THEN 'check cust ' || o_custkey END AS query,
         CASE o_orderkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['metrics'] ELSE ['metrics', 'logs'] END AS datasources,
         CAST(o_orderkey % 10 AS INTEGER) AS iterations
  FROM orders)"""

ALERTS = """alerts AS (
  SELECT event_id AS id, ts, event_id % 6 AS form, 'svc-' || (user_id % 5) AS svc,
         CASE event_id % 6 WHEN 5 THEN 'payments-' || (user_id % 5) ELSE 'svc-' || (user_id % 5) END AS service,
         'ErrorRateHigh ' || user_id AS alert,
         CASE event_id % 6 WHEN 0 THEN 'service=svc-' || (user_id % 5) || ' error rate > 5%'
                           WHEN 1 THEN 'service: svc-' || (user_id % 5) || ', see runbook'
                           WHEN 2 THEN 'firing app="svc-' || (user_id % 5) || '" now'
                           WHEN 5 THEN 'the payments-' || (user_id % 5) || ' service is down'
                           ELSE 'check dashboards' END AS message,
         CASE event_id % 6 WHEN 3 THEN '{"service":"svc-' || (user_id % 5) || '","value":' || CAST(value AS VARCHAR) || '}'
                           WHEN 4 THEN '{"status":"firing","labels":{"job":"svc-' || (user_id % 5) || '"}}'
                           ELSE '' END AS data
  FROM events WHERE event_type = 'error')"""

REQUESTS = """requests AS (
  SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'manual' ELSE 'webhook' END AS trigger,
         'check user ' || user_id AS query, ts AS create_time
  FROM events)"""

SAMPLES = """samples AS (
  SELECT 'svc-' || (user_id % 5) AS service, event_type, ts, value, event_id AS id FROM events)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(body: str) -> str:
    """Token list of a body expression."""
    head, tail = quoted(f"^[{UNI_SPACE}]+"), quoted(f"[{UNI_SPACE}]+$")
    trimmed = f"regexp_replace(regexp_replace({body}, {head}, ''), {tail}, '')"
    return f"list_filter(string_split_regex({trimmed}, {quoted(SEPARATORS)}), lambda t: t <> '')"


def is_parameter(token: str) -> str:
    return f"regexp_matches({token}, {quoted(PARAMETER.replace(chr(92) + 'z', '$'))})"


def masked(body: str) -> str:
    return (
        f"list_transform({tokens(body)}, lambda t: CASE WHEN {is_parameter('t')} THEN {quoted(WILDCARD)} ELSE t END)"
    )


def byte_prefix(text: str, n: int) -> str:
    """Longest prefix of at most n bytes, counted character by character."""
    return (
        f"left({text}, CAST(list_count(list_filter(range(1, least(length({text}), {n}) + 1), "
        f"lambda i: strlen(left({text}, i)) <= {n})) AS BIGINT))"
    )


FAMILIES = """families AS (
  SELECT event_id AS id, ts, 'svc-' || (user_id % 5) AS service,
         CASE event_id % 4 WHEN 0 THEN 'connection to host' || (user_id % 40) || 'x refused'
                           WHEN 1 THEN event_type || ' job' || (user_id % 30) || 'x took long on node' || (event_id % 7) || 'x'
                           WHEN 2 THEN 'worker' || (event_id % 9) || 'x of pool' || (user_id % 3) || 'x started by ' || event_type || ' at ' || event_id
                           ELSE event_type || ' cache' || (user_id % 4) || 'x warm and ready for shard' || (event_id % 11) || 'x' END AS body
  FROM events)"""


def mined(source: str, order: str, by: str = "service", threshold: float = 0.7) -> str:
    """CTEs `pats`, `steps` and `final` of the greedy template fold over a view with id and body.

    pats: one row per masked pattern of a bucket in the order of its first row, with that row's id; steps: what became of
    each; final: the templates of a bucket in the end. Rows without tokens take no part. To be used after WITH RECURSIVE.
    """
    return f"""toks AS (
  SELECT id, {order} AS o, {by} AS b, body, {masked('body')} AS x FROM {source}
), pats AS (
  SELECT *, row_number() OVER (PARTITION BY b, n ORDER BY first) AS k FROM (
    SELECT b, len(x) AS n, x, count(*) AS n_rows, min(row(o, id)) AS first, arg_min(id, row(o, id)) AS founder
    FROM toks WHERE len(x) > 0 GROUP BY ALL)
), steps AS (
  SELECT DISTINCT b, n, 0::BIGINT AS k, []::VARCHAR[][] AS tpl, NULL::BIGINT AS no, NULL::BOOLEAN AS is_new FROM pats
  UNION ALL
  SELECT b, n, k, CASE WHEN hit THEN list_transform(tpl, lambda t, j: CASE WHEN j = best
           THEN list_transform(t, lambda w, i: CASE WHEN w = x[i] THEN w ELSE '<*>' END) ELSE t END) ELSE list_append(tpl, x) END,
         CASE WHEN hit THEN best - 1 ELSE len(tpl) END, NOT hit
  FROM (
    SELECT *, coalesce(top > 0 AND top::DOUBLE / n >= {threshold}::DOUBLE, false) AS hit, list_position(scores, top) AS best FROM (
      SELECT *, list_max(scores) AS top FROM (
        SELECT s.b, s.n, p.k, s.tpl, p.x, list_transform(s.tpl, lambda t: list_sum(list_transform(t, lambda w, i:
                 CASE WHEN w = '<*>' OR w = p.x[i] THEN 1 ELSE 0 END))) AS scores
        FROM steps s JOIN pats p ON s.b IS NOT DISTINCT FROM p.b AND s.n = p.n AND p.k = s.k + 1)))
), final AS (
  SELECT b, n, tpl FROM (SELECT *, max(k) OVER (PARTITION BY b, n) AS last FROM steps) WHERE k = last
), mined AS (
  SELECT p.*, s.no, s.is_new, array_to_string(f.tpl[s.no + 1], ' ') AS template,
         CASE WHEN s.is_new THEN array_to_string(p.x, ' ') END AS created
  FROM pats p JOIN steps s ON p.b IS NOT DISTINCT FROM s.b AND p.n = s.n AND p.k = s.k
  JOIN final f ON p.b IS NOT DISTINCT FROM f.b AND p.n = f.n
)"""


def mined_with_capacity(source: str, order: str, capacity: int, by: str = "service", threshold: float = 0.7) -> str:
    """CTEs `caps` (a row for every row with tokens) and `left_over` (the templates in the end) of the fold with eviction."""
    return f"""crows AS (
  SELECT *, row_number() OVER (PARTITION BY b, n ORDER BY o, id) AS k FROM (
    SELECT id, {order} AS o, {by} AS b, {masked('body')} AS x, len({masked('body')}) AS n FROM {source}) WHERE n > 0
), caps AS (
  SELECT DISTINCT b, n, 0::BIGINT AS k, []::VARCHAR[][] AS tpl, []::BIGINT[] AS cnt, NULL::BIGINT AS no, NULL::BOOLEAN AS is_new FROM crows
  UNION ALL
  SELECT b, n, k,
         CASE WHEN hit THEN list_transform(tpl, lambda t, j: CASE WHEN j = best
           THEN list_transform(t, lambda w, i: CASE WHEN w = x[i] THEN w ELSE '<*>' END) ELSE t END)
           WHEN len(tpl) < {capacity} THEN list_append(tpl, x)
           ELSE list_append(list_transform(tpl[:-2], lambda t, j: CASE WHEN j = worst THEN tpl[-1] ELSE t END), x) END,
         CASE WHEN hit THEN list_transform(cnt, lambda c, j: CASE WHEN j = best THEN c + 1 ELSE c END)
           WHEN len(tpl) < {capacity} THEN list_append(cnt, 1)
           ELSE list_append(list_transform(cnt[:-2], lambda c, j: CASE WHEN j = worst THEN cnt[-1] ELSE c END), 1) END,
         CASE WHEN hit THEN best - 1 ELSE least(len(tpl), {capacity} - 1) END, NOT hit
  FROM (
    SELECT *, coalesce(top > 0 AND top::DOUBLE / n >= {threshold}::DOUBLE, false) AS hit, list_position(scores, top) AS best,
           list_position(cnt, list_min(cnt)) AS worst FROM (
      SELECT *, list_max(scores) AS top FROM (
        SELECT s.b, s.n, p.k, s.tpl, s.cnt, p.x, list_transform(s.tpl, lambda t: list_sum(list_transform(t, lambda w, i:
                 CASE WHEN w = '<*>' OR w = p.x[i] THEN 1 ELSE 0 END))) AS scores
        FROM caps s JOIN crows p ON s.b IS NOT DISTINCT FROM p.b AND s.n = p.n AND p.k = s.k + 1)))
), left_over AS (
  SELECT b, n, unnest(range(0, len(tpl))) AS no, unnest(tpl) AS t, unnest(cnt) AS members
  FROM (SELECT *, max(k) OVER (PARTITION BY b, n) AS last FROM caps) WHERE k = last
)"""
