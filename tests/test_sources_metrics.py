"""Payload sources, metric and log queries."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import logquery, metrics
from logloom.sources import payloads


def docs(spark, *texts):
    return spark.createDataFrame([(t if isinstance(t, str) else json.dumps(t),) for t in texts], "payload string")


def test_otlp(spark):
    def value(**kw):
        return kw

    export = {
        "resourceLogs": [
            {
                "resource": {"attributes": [{"key": "host", "value": value(stringValue="h")}, {"key": "service.name", "value": value(stringValue="api")}]},
                "scopeLogs": [
                    {"logRecords": [
                        {"timeUnixNano": "1700000000123456789", "severityText": "ERROR", "severityNumber": 17, "body": value(stringValue="boom"),
                         "attributes": [{"key": "n", "value": value(intValue="5")}, {"key": "ok", "value": value(boolValue=True)}, {"key": "x", "value": value(doubleValue=1e21)}, {"key": "n", "value": value(intValue="6")}]},
                        {"timeUnixNano": "0"},
                    ]},
                    {"logRecords": []},
                ],
            },
            {"scopeLogs": [{"logRecords": [{"timeUnixNano": "1", "body": value(arrayValue={})}]}]},
        ]
    }
    rows = payloads.otlp_logs(docs(spark, export)).collect()
    assert [(r.service, r.severity, r.body) for r in rows] == [("api", "ERROR", "boom"), ("api", "", ""), ("", "", "")]
    assert rows[0].ts == dt.datetime(2023, 11, 14, 22, 13, 20, 123456)
    assert rows[0].attributes == {"n": "6", "ok": "true", "x": "1" + "0" * 21} and rows[1].attributes == {}


def test_log_stores(spark):
    loki = {"status": "success", "data": {"resultType": "streams", "result": [{"stream": {"app": "x", "level": "error"}, "values": [["1", "a"], ["2"], ["3", "c"]]}, {"stream": {}, "values": [["4", "d"]]}]}}
    rows = payloads.loki_streams(docs(spark, loki)).collect()
    assert [(r.timestamp, r.message, r.level, r.labels.get("app")) for r in rows] == [("1", "a", "error", "x"), ("3", "c", "error", "x"), ("4", "d", "", None)]
    array = '[{"_time":"t","_msg":"m","level":"info","_stream":"{a}"},{"_time":"u","_msg":"n"}]'
    lines = '{"_time":"t","_msg":"m"}\n\nbroken\n{"_time":"u","_msg":"n","_stream":"s"}'
    rows = payloads.victorialogs(docs(spark, array, lines)).collect()
    assert [(r.timestamp, r.message, r.level, r.labels) for r in rows] == [
        ("t", "m", "info", {"_stream": "{a}"}), ("u", "n", "", {}), ("t", "m", "", {"_stream": ""}), ("u", "n", "", {"_stream": "s"}),
    ]


def test_entries_of_the_wrong_type_are_skipped(spark):
    rows = payloads.victorialogs(docs(spark, '[{"_msg":5}]', '{"_msg":5}\n{"_msg":"ok"}', "[]", '[{"_msg":"x"},{"_msg":["y"]}]')).collect()
    assert [r.message for r in rows] == ["ok"]


def test_metric_results(spark):
    vector = {"data": {"resultType": "vector", "result": [{"metric": {"job": "a"}, "value": [1700000000, "1"]}, {"metric": {"job": "b"}, "value": [1700000000.1234, "NaN"]}]}}
    matrix = {"data": {"resultType": "matrix", "result": [{"metric": {}, "values": [[1, "1"], [61, "2.5"], [121, "+Inf"]]}]}}
    scalar = {"data": {"resultType": "scalar", "result": [5, "7"]}}
    rows = payloads.prom_result(docs(spark, vector, matrix, scalar)).collect()
    assert [r.labels for r in rows] == [{"job": "a"}, {"job": "b"}, {}, None]
    assert rows[1].points[0].timestamp == 1700000000.123 and rows[1].points[0].value != rows[1].points[0].value
    assert [(p.timestamp, p.value) for p in rows[2].points] == [(1, 1), (61, 2.5), (121, float("inf"))]
    with pytest.raises(Exception, match="unsupported result type: string"):
        payloads.prom_result(docs(spark, {"data": {"resultType": "string", "result": [1, "x"]}})).collect()


def test_alert_payloads(spark):
    row = payloads.alerts(docs(spark, {"source": "g", "alert": "a", "message": "m", "data": {"service": "x"}})).first()
    assert (row.source, row.alert, row.message, json.loads(row.data)) == ("g", "a", "m", {"service": "x"})
    bare = payloads.alerts(docs(spark, {"alert": "a"})).first()
    assert (bare.source, bare.data) == ("", None)


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"alert":"a"}\n{"alert":"b"}\n')
    assert payloads.read_payloads(spark, str(tmp_path)).count() == 2
    assert payloads.read_payloads(spark, str(tmp_path), whole_file=True).count() == 1
    assert payloads.stream_payloads(spark, str(tmp_path)).isStreaming


def samples(spark, rows):
    data = [(i, k, float(s), v) for i, (k, s, v) in enumerate(rows)]
    return spark.createDataFrame(data, "id int, k string, s double, value double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))


def test_counter_rate_with_reset(spark):
    s = samples(spark, [("a", 0, 10.0), ("a", 10, 15.0), ("a", 20, 3.0), ("a", 59, 4.0), ("a", 60, 9.0), ("a", 70, 10.0)])
    rows = metrics.counter_rate(s, ["k"], 60).orderBy("start").collect()
    assert [(round(r.rate * 60, 6), r.samples) for r in rows] == [(9.0, 4), (1.0, 2)]


def test_range_query_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), rnd.randrange(0, 200_000) + rnd.choice([0, 0.5]), float(i)) for i in range(600)]
    start, end, step, back = 1000, 190_000, 700, 900
    got = metrics.range_query(samples(spark, rows), ["k"], F.timestamp_seconds(F.lit(start)), F.timestamp_seconds(F.lit(end)), step, back)
    got = {(r.k, int(r.step_ts.replace(tzinfo=dt.timezone.utc).timestamp())): r.value for r in got.collect()}
    want = {}
    for k in "ab":
        for t in range(start, end + 1, step):
            live = [(s, i) for i, (kk, s, _) in enumerate(rows) if kk == k and t - back < s <= t]
            if live:
                want[k, t] = rows[max(live)[1]][2]
    assert got == want


def test_instant(spark):
    s = samples(spark, [("a", 1, 1.0), ("a", 5, 2.0), ("a", 9, 3.0), ("b", 1, 4.0)])
    at = F.timestamp_seconds(F.lit(6))
    assert {r.k: r.value for r in metrics.instant(s, ["k"], at).collect()} == {"a": 2.0, "b": 4.0}
    assert {r.k: r.value for r in metrics.instant(s, ["k"], at, 3).collect()} == {"a": 2.0}


def test_histograms(spark):
    inf = float("inf")
    b = spark.createDataFrame([("x", 1.0, 5.0), ("x", 2.0, 9.0), ("x", inf, 10.0), ("y", 1.0, 0.0), ("y", inf, 0.0), ("z", 1.0, 1.0), ("z", inf, 10.0)], "k string, le double, value double")
    q = {r.k: r.quantile for r in metrics.histogram_quantile(b, ["k"], 0.8).collect()}
    assert q == {"x": pytest.approx(1.75), "y": None, "z": 1.0}
    d = spark.createDataFrame([("x", 0.004), ("x", 0.005), ("x", 3.0), ("x", 99.0)], "k string, v double")
    h = {r.le: r.value for r in metrics.cumulative_histogram(d, ["k"], F.col("v")).collect()}
    assert (h[0.005], h[2.5], h[5.0], h[10.0], h[inf]) == (2, 2, 3, 3, 4)


def test_log_queries(spark):
    rows = [(i, dt.datetime(2024, 1, 1, i), f"error {i} in app-{i % 2}", {"app": f"a{i % 2}"}) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, body string, labels map<string,string>")
    b = F.col("body")
    assert df.filter(logquery.has_phrase(b, "app")).count() == 10
    assert df.filter(logquery.has_phrase(b, "ap")).count() == 0
    assert df.filter(logquery.line_matches(b, "error [0-4] ")).count() == 5
    assert df.filter(logquery.has_labels(F.col("labels"), {"app": "a1", "zone": ""})).count() == 5
    page = logquery.query_logs(df, logquery.line_contains(b, "app-1"), start=dt.datetime(2024, 1, 1, 1), end=dt.datetime(2024, 1, 1, 9), limit=2, offset=1)
    assert [r.id for r in page.collect()] == [5, 3]
    since = logquery.query_logs(df, end=dt.datetime(2024, 1, 1, 9), since_seconds=7200, direction="forward")
    assert [r.id for r in since.collect()] == [7, 8]
    with pytest.raises(ValueError, match="unknown direction"):
        logquery.query_logs(df, direction="up")
    j = spark.createDataFrame([('{"a":{"b":5}}',), ("no json",)], "l string").select(logquery.json_field(F.col("l"), "$.a.b").alias("v"))
    assert [r.v for r in j.collect()] == ["5", None]
