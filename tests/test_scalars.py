"""Scalar functions against fixed input and expected pairs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.functions import analysis, services, severity, text, times, tokens
from logloom.operators.templates import with_tokens


def apply(spark, fn, rows, ddl):
    """fn over the columns of rows, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ddl}").repartition(1)
    out = df.select("i", fn(*[F.col(c) for c in df.columns[1:]]).alias("out")).orderBy("i").collect()
    return [r.out for r in out]


def test_severity_rank(spark):
    cases = [("DEBUG", 0), ("info", 1), ("Notice", 2), ("warn", 3), ("WARNING", 3), ("err", 4), ("error", 4), ("crit", 5), ("alert", 6), ("panic", 7), ("odd", 0), (None, 0)]
    assert apply(spark, severity.severity_rank, [(c,) for c, _ in cases], "s string") == [n for _, n in cases]


TOKENS = [
    ("", []),
    ("hello world", ["hello", "world"]),
    ("error: connection failed!", ["error", "connection", "failed"]),
    ("[ERROR] connection refused", ["ERROR", "connection", "refused"]),
    ("hello   world", ["hello", "world"]),
    ("  padded ", ["padded"]),
    (" , ; ", []),
    ("a b", ["a b"]),
    ("x\x0by", ["x\x0by"]),
    (None, []),
]


def test_tokenize(spark):
    assert apply(spark, tokens.tokenize, [(t,) for t, _ in TOKENS], "t string") == [e for _, e in TOKENS]


PARAMETERS = [
    ("12345", True), ("12.34", True), ("abc123", False), ("a1b2c3d4e5f6", True), ("2024-01-15", True),
    ("2024-01-15T10:00", True), ("12:34:56", True), ("true", True), ("FALSE", True), ("True", False),
    ("/path/to/file", True), ("user@example.com", True), ("user@example", False), ("192.168.1.1", True),
    ("192.168.1.1:80", True), ("hello", False), ("12345\n", False),
]


def test_is_parameter(spark):
    assert apply(spark, tokens.is_parameter, [(t,) for t, _ in PARAMETERS], "t string") == [e for _, e in PARAMETERS]


def test_mask_parameters(spark):
    cases = [
        (["connection", "refused"], ["connection", "refused"]),
        (["user", "12345", "logged", "in"], ["user", "<*>", "logged", "in"]),
        (["request", "a1b2c3d4"], ["request", "<*>"]),
        (["enabled", "true"], ["enabled", "<*>"]),
    ]
    assert apply(spark, tokens.mask_parameters, [(c,) for c, _ in cases], "t array<string>") == [e for _, e in cases]


def test_masked_text_equals_the_token_by_token_form(spark):
    bodies = [t for t, _ in TOKENS] + [t for t, _ in PARAMETERS] + [
        "at 12:34:56 from 10.0.0.1:8080, id=deadbeef01 <*> (true) /var/log/x 2024-01-01T00:00:00Z 3.14 .5 a@b.co",
        "trueish 12x x12 12345678 abcdefab abcdefg1 1.2.3.4.5 //  / a/b", "tab\tand\r\nline", "ü 1 é 22  ",
    ]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    t = tokens.tokenize(F.col("body"))
    want = df.select("body", tokens.reconstruct(tokens.mask_parameters(t)).alias("m"), F.size(t).alias("n")).collect()
    got = with_tokens(df).select("body", "masked", "n_tokens").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_similarity_and_merge(spark):
    pairs = [
        (["a", "b", "c"], ["a", "b", "c"], 1.0, "a b c"),
        (["a", "b", "c"], ["a", "b", "d"], 2 / 3, "a b <*>"),
        (["a", "b"], ["a", "b", "c"], 2 / 3, "a b <*>"),
        (["a", "b", "c"], ["a", "b"], 2 / 3, "a b <*>"),
        (["a", "<*>", "c"], ["a", "x", "c"], 1.0, "a <*> c"),
        (["a", "b", "c"], ["a", "x", "c"], 2 / 3, "a <*> c"),
        (["a", "b"], ["a", "<*>"], 1.0, "a <*>"),
        (["a"], ["a", "<*>"], 0.5, "a <*>"),
        ([], ["a"], 0.0, "<*>"),
        ([], [], 0.0, ""),
    ]
    rows = [(a, b) for a, b, _, _ in pairs]
    ddl = "a array<string>, b array<string>"
    assert apply(spark, tokens.token_similarity, rows, ddl) == pytest.approx([s for *_, s, _ in pairs])
    assert apply(spark, lambda a, b: tokens.reconstruct(tokens.merge_tokens(a, b)), rows, ddl) == [m for *_, m in pairs]


SERVICES = [
    ("HighErrorRate", "service=api-server has high error rate", None, "api-server"),
    ("service:db-primary CPU high", "CPU usage is above 90%", None, "db-primary"),
    ('service="payment-gateway"', "", None, "payment-gateway"),
    ("HighLatency", "app=auth-service latency p99 > 500ms", None, "auth-service"),
    ("DiskFull", 'job="node-exporter" disk usage > 90%', None, "node-exporter"),
    ("OOMKilled", "namespace=production pod crashed", None, "production"),
    ("Error", "service_name=order-service error rate high", None, "order-service"),
    ("Alert", "Something happened", '{"service":"notification-svc","severity":"critical"}', "notification-svc"),
    ("Alert", "Something happened", '{"labels":{"service":"billing-api","env":"prod"}}', "billing-api"),
    ("Alert", "Something happened", '{"commonLabels":{"app":"grafana","service":"dashboard-svc"}}', "dashboard-svc"),
    ("HighErrorRate", "The api-gateway service is experiencing high error rates", None, "api-gateway"),
    ("HighLatency", "Latency is above threshold", None, ""),
    ("", "", None, ""),
    ('service="alert-svc"', 'service="msg-svc"', None, "alert-svc"),
    ("", "frontend service degraded", None, "frontend"),
    ("labels.app = 'x'", "", None, "x"),
    (None, None, None, ""),
    ("a", "", '{"service_name":"primary-svc","namespace":"infra"}', "primary-svc"),
    ("a", "", '{"app":"mobile-api","region":"us-east-1"}', "mobile-api"),
    ("a", "", '{"service":5,"job":"backup-cron"}', "backup-cron"),
    ("a", "", '{"service":"one","service":"two"}', "two"),
    ("a", "", '{"service":"x"} trailing', ""),
    ("a", "", '["service"]', ""),
    ("a", "", '{"payload":{"pod":"p-1"}}', "p-1"),
    ("myservice=x", "", None, "my"),
]


def test_extract_service(spark):
    got = apply(spark, services.extract_service, [r[:3] for r in SERVICES], "a string, m string, d string")
    assert got == [r[3] for r in SERVICES]


def test_service_parts(spark):
    texts = [("", None), ('service: "api"', "api"), ("service=null", None), ("hello world", None), ("service = null app=web", None), ("service=null app: web", "web")]
    assert apply(spark, services.service_from_text, [(t,) for t, _ in texts], "t string") == [e for _, e in texts]
    docs = [(None, None), ("{invalid", None), ('{"service": null}', None), ('{"service": ""}', None), ('{"commonLabels": {"app": "web"}}', "web")]
    assert apply(spark, services.service_from_json, [(t,) for t, _ in docs], "t string") == [e for _, e in docs]
    words = [
        ("the redis service is down", "redis"), ("service api-gateway timeout", "api-gateway"), ("no keyword here", None),
        ("service=explicit", None), ("service:explicit", None), ("the service", None), ('service="api"', None), ("a service b", None),
        ("services up", None),
    ]
    got = apply(spark, services.service_heuristic, [(t,) for t, _ in words], "t string")
    assert got[:7] == [e for _, e in words[:7]]
    assert got[7] is None  # both neighbours are shorter than two bytes


def test_times(spark):
    as_of = F.lit("2024-02-01").cast("timestamp")
    cases = [
        ("2024-01-15T10:30:00Z", dt.datetime(2024, 1, 15, 10, 30)), ("1705315800", dt.datetime(2024, 1, 15, 10, 50)),
        ("1705315800.9", dt.datetime(2024, 1, 15, 10, 50)), ("1h", dt.datetime(2024, 1, 31, 23)),
        ("2024-01-15T10:30:00,5+02:00", dt.datetime(2024, 1, 15, 8, 30, 0, 500000)), ("invalid", None), ("2024-01-15", None), ("", None),
    ]
    assert apply(spark, lambda c: times.parse_time(c, as_of), [(t,) for t, _ in cases], "t string") == [e for _, e in cases]
    spans = [("1h30m", 5_400_000_000), ("1.5s", 1_500_000), ("-2m", -120_000_000), ("0", 0), ("+3us", 3), ("2µs", 2), ("1500ns", 1), ("5", None), ("5 m", None), ("", None), ("1d", None)]
    assert apply(spark, times.parse_duration, [(t,) for t, _ in spans], "t string") == [e for _, e in spans]
    assert apply(spark, lambda c: times.parse_duration(c, 7), [("bad",), (None,)], "t string") == [7, 7]


def test_double_text(spark):
    cases = [(1.0, "1"), (1e10, "10000000000"), (1.5e-7, "0.00000015"), (-123456.75, "-123456.75"), (1.2345e20, "123450000000000000000"), (0.0, "0"), (float("inf"), "+Inf"), (1.5e300, "15" + "0" * 299)]
    assert apply(spark, text.double_text, [(c,) for c, _ in cases], "x double") == [e for _, e in cases]


def test_cuts_between_characters(spark):
    s = "éé€😀abc"
    raw = s.encode()
    for n in range(1, len(raw) + 2):
        want = raw[:n].decode(errors="ignore")
        assert apply(spark, lambda c, n=n: text.byte_prefix(c, n), [(s,)], "s string") == [want]
    assert apply(spark, lambda c: text.truncate(c, 3), [("abc",), ("abcd",), ("aéé",), (None,)], "s string") == ["abc", "abc...", "aé...", None]


def test_truncate_tool_result(spark):
    got = apply(spark, lambda c: analysis.truncate_tool_result(c, 100), [("x" * 500,), ("short",)], "s string")
    assert got == ["x" * 100 + "\n\n[TRUNCATED: original 500 chars, showing first 100]", "short"]


def test_parse_analysis(spark):
    long = "p" * 600
    cases = [
        ('```json\n{"severity":"warning","summary":"s","detail":"d"}\n```', ("warning", "s", "d")),
        ('{"severity":"critical","summary":"s"}', ("critical", "s", "")),
        ('{"severity":"strange","summary":"s","detail":null}', ("info", "s", "")),
        ("plain", ("info", "plain", "plain")),
        ("null", ("info", "", "")),
        ("[1]", ("info", "[1]", "[1]")),
        ('{"severity":1}', ("info", '{"severity":1}', '{"severity":1}')),
        ('{"Summary":"fold"} tail', ("info", '{"Summary":"fold"} tail', '{"Summary":"fold"} tail')),
        ('{"Summary":"fold"}', ("info", "fold", "")),
        ("```\n```", ("info", "```\n```", "```\n```")),
        ("``````", ("info", "``````", "``````")),
        (long, ("info", "p" * 500 + "...", long)),
        (None, ("info", "", "")),
        ("", ("info", "", "")),
    ]
    got = apply(spark, analysis.parse_analysis, [(c,) for c, _ in cases], "s string")
    assert [tuple(r) for r in got] == [e for _, e in cases]


def test_tool_errors_and_call_errors(spark):
    cases = [("invalid parameters: timeout", "parameter_validation"), ("dial: no such host", "connection"), ("query failed", "query"), ("boom", "execution")]
    assert apply(spark, analysis.tool_error_category, [(c,) for c, _ in cases], "s string") == [e for _, e in cases]
    msg = apply(spark, analysis.tool_error_text, [("prom", "boom", "{}")], "t string, m string, a string")[0]
    assert msg.startswith("TOOL_ERROR [tool=prom category=execution]: boom\n\nArguments: {}\n\nDo NOT guess")
    calls = [(401, "", "", "auth"), (400, "context_length_exceeded", "", "context_overflow"), (400, "", "Too many tokens", "context_overflow"), (400, "", "", "invalid_request"), (429, "", "", "other")]
    assert apply(spark, analysis.call_error_class, [c[:3] for c in calls], "s int, c string, b string") == [c[3] for c in calls]


def test_texts(spark):
    assert apply(spark, analysis.compose_query, [("", "up", "err"), ("q", "up", ""), ("", "", "e")], "q string, m string, l string") == ["Check metrics: up\nCheck logs: err", "q", "\nCheck logs: e"]
    assert apply(spark, analysis.unknown_tool_text, [('a"b',)], "t string") == ['Error: unknown tool "a\\"b"']
