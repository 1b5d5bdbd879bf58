"""Report queries, life cycle and notifications."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logloom.operators import lifecycle, notify, reports, schedule

T0 = dt.datetime(2024, 1, 1)
DDL = "id string, trigger string, status string, severity string, summary string, query string, iterations int, create_time timestamp"


def as_of(text="2024-02-01"):
    return F.lit(text).cast("timestamp")


@pytest.fixture
def table(spark):
    rows = [
        ("a", "manual", "queued", "info", "One", "q1", 1, T0),
        ("b", "webhook", "running", "warning", "two", None, 2, T0 + dt.timedelta(hours=1)),
        ("c", "webhook", "completed", "critical", "Three", "q1", 3, T0 + dt.timedelta(hours=2)),
    ]
    return lifecycle.with_defaults(spark.createDataFrame(rows, DDL), as_of())


def found(df):
    return sorted(r.id for r in df.collect())


def test_predicates(table):
    cases = [
        (reports.eq("status", "queued"), "a"), (reports.neq("status", "queued"), "bc"), (reports.is_in("id", ["a", "c"]), "ac"),
        (reports.not_in("id", ["a"]), "bc"), (reports.gt("iterations", 1), "bc"), (reports.gte("iterations", 2), "bc"),
        (reports.lt("iterations", 2), "a"), (reports.lte("iterations", 2), "ab"), (reports.contains("summary", "n"), "a"),
        (reports.has_prefix("summary", "T"), "c"), (reports.has_suffix("summary", "o"), "b"), (reports.equal_fold("summary", "TWO"), "b"),
        (reports.contains_fold("summary", "T"), "bc"), (reports.is_nil("query"), "b"), (reports.not_nil("query"), "ac"),
        (reports.all_of(reports.eq("query", "q1"), reports.gt("iterations", 1)), "c"), (reports.any_of(reports.eq("id", "a"), reports.eq("id", "b")), "ab"),
        (reports.negate(reports.eq("id", "a")), "bc"), (reports.all_of(), "abc"), (reports.any_of(), ""),
    ]
    for predicate, want in cases:
        assert "".join(found(table.filter(predicate))) == want
    with pytest.raises(ValueError, match="unknown report column"):
        reports.eq("password", 1)


def test_order_page_and_single_rows(spark, table):
    assert [r.id for r in reports.list_reports(table, 10).collect()] == ["c", "b", "a"]
    assert [r.id for r in reports.list_reports(table, 2).collect()] == ["c", "b"]
    assert reports.list_reports(table, 0).count() == 3
    assert [r.id for r in reports.page(table, ["-iterations"], 1, 1).collect()] == ["b"]
    assert [r.id for r in reports.page(table, ["iterations"], None, 1).collect()] == ["b", "c"]
    assert reports.first(table, ["-id"]).id == "c" and reports.first_id(table, ["iterations", "id"]) == "a"
    none = table.filter("false")
    for call in (lambda: reports.first(none, ["id"]), lambda: reports.only(none)):
        with pytest.raises(reports.NotFoundError):
            call()
    with pytest.raises(reports.NotSingularError):
        reports.only(table)
    assert reports.only_id(table.filter("id = 'a'")) == "a"
    assert reports.exists(table) and not reports.exists(none)
    assert reports.count_rows(table, "query").first()[0] == 2 and reports.count_rows(table).first()[0] == 3
    wanted = spark.createDataFrame([("a",), ("z",)], "x string")
    assert found(reports.where_in_table(table, "id", wanted)) == ["a"]
    assert found(reports.where_in_table(table, "id", wanted, keep=False)) == ["b", "c"]


def test_checks(spark, table):
    rows = [("x", "manual", "queued", "info"), (None, "manual", "queued", "info"), ("y", None, "queued", "info"), ("z", "manual", "lost", "info"), ("w", "odd", "queued", "info")]
    df = spark.createDataFrame(rows, "id string, trigger string, status string, severity string")
    errors = [r.error for r in lifecycle.check_report(df).collect()]
    assert errors == [None, 'missing required field "id"', 'missing required field "trigger"', "invalid enum value for status field: lost", "invalid enum value for trigger field: odd"]
    first = lifecycle.with_defaults(spark.createDataFrame([("n", "manual")], "id string, trigger string"), as_of()).first()
    assert (first.status, first.severity, first.summary, first.datasources, first.iterations, first.query) == ("queued", "info", "", [], 0, None)


def test_table_life(spark, table, tmp_path):
    t = lifecycle.ReportTable(spark, str(tmp_path / "r"))
    t.create(table, as_of(), first=True)
    with pytest.raises(lifecycle.ConstraintError, match="report a exists"):
        t.create(table.filter("id = 'a'"), as_of())
    with pytest.raises(lifecycle.ConstraintError, match="invalid enum"):
        t.create(table.withColumn("id", F.lit("n")).withColumn("status", F.lit("lost")).limit(1), as_of())
    t.update(spark.createDataFrame([("a", "completed", "done")], "id string, status string, summary string"), as_of("2024-03-01"))
    a = t.current().filter("id = 'a'").first()
    assert (a.status, a.summary, a.iterations, a.update_time) == ("completed", "done", 1, dt.datetime(2024, 3, 1))
    with pytest.raises(LookupError, match="report z not found"):
        t.update(spark.createDataFrame([("z", "x")], "id string, summary string"), as_of())
    assert t.delete_where(reports.eq("severity", "critical"), as_of("2024-03-02")) == 1
    assert found(t.current()) == ["a", "b"]
    got = {r.id: r.outcome for r in lifecycle.get_reports(t.current(), spark.createDataFrame([("a",), ("c",)], "id string")).collect()}
    assert got == {"a": "found", "c": "not_found"}
    with pytest.raises(ValueError, match="unknown report columns"):
        lifecycle.updated(table, spark.createDataFrame([("a", 1)], "id string, owner int"), as_of())


def test_transitions(spark, table):
    running = lifecycle.started(table, as_of())
    assert [(r.id, r.status) for r in running.collect()] == [("a", "running")]
    results = spark.createDataFrame([("a", "no answer", "critical", "s", "d", ["m"], 4)], "id string, error string, severity string, summary string, detail string, datasources array<string>, iterations int")
    failed = lifecycle.finished(running, results, as_of()).first()
    assert (failed.status, failed.severity, failed.summary, failed.iterations, failed.datasources) == ("failed", "info", "Analysis failed: no answer", 0, [])
    done = lifecycle.finished(running, results.withColumn("error", F.lit(None).cast("string")), as_of()).first()
    assert (done.status, done.severity, done.summary, done.detail, done.iterations) == ("completed", "critical", "s", "d", 4)
    drained = lifecycle.drain_orphans(table, as_of()).collect()
    assert [(r.id, r.status, r.summary) for r in drained] == [("a", "failed", "Analysis queue drained during shutdown")]


def test_payloads_are_written(spark, table, tmp_path):
    path = str(tmp_path / "out")
    notify.write_payloads(notify.notification_payloads(table), path)
    assert json.loads(spark.read.text(path).first().value)["text"].endswith("Three")


def test_notifications(table):
    assert found(notify.notify_filter(table, "warning")) == ["b", "c"]
    assert found(notify.notify_filter(table, "")) == ["a", "b", "c"]
    assert found(notify.notify_filter(table, "odd")) == ["a", "b", "c"]
    rows = notify.notification_payloads(table, "warning").collect()
    assert [r.id for r in rows] == ["c"]
    p = json.loads(rows[0].payload)
    assert p["text"] == ":rotating_light: [critical] Three"
    assert [b["type"] for b in p["blocks"]] == ["header", "section", "section"]
    assert p["blocks"][0]["text"] == {"type": "plain_text", "text": ":rotating_light: Alert — critical"}
    assert p["blocks"][2]["fields"][-1]["text"] == "*Time*\n<!date^1704074400^{date_short} {time_secs}|2024-01-01T02:00:00Z>"
    bare = table.select(F.lit("x").alias("severity"), F.lit("").alias("summary"), F.lit("why").alias("detail"), F.lit("").alias("trigger"), F.array().cast("array<string>").alias("datasources"), F.lit(None).cast("timestamp").alias("create_time"))
    p = json.loads(bare.select(notify.slack_payload().alias("p")).first().p)
    assert p["text"].startswith(":question: [x] ") and [b["text"]["text"] for b in p["blocks"][1:]] == ["*Summary*\n", "*Detail*\nwhy"]


def test_schedule(spark):
    jobs = spark.createDataFrame([("j", "90m", "up", ""), ("bad", "soon", "", ""), ("zero", "0", "", ""), ("late", "5h", "", "")], "name string, interval string, metric_query string, log_query string")
    rows = schedule.schedule_ticks(jobs, as_of("2024-01-01"), as_of("2024-01-01 04:30:00")).orderBy("create_time").collect()
    assert [(r.name, r.create_time.hour, r.create_time.minute) for r in rows] == [("j", 1, 30), ("j", 3, 0), ("j", 4, 30)]
    assert rows[0].trigger == "scheduled" and rows[0].query == "Scheduled inspection: j"
