"""Notifications: severity threshold and chat payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.severity import REPORT_RANK, report_rank, severity_emoji
from logloom.functions.text import rfc3339

TITLE = "Alert"


def notify_filter(reports: DataFrame, min_severity: str | None = None) -> DataFrame:
    """Reports at or above a severity; unknown severities rank lowest on both sides."""
    least = REPORT_RANK.get(min_severity or "", 0)
    return reports.filter(report_rank(F.col("severity")) >= least)


def notification_json() -> Column:
    """The report as a JSON object."""
    cols = ("id", "trigger", "trigger_id", "severity", "summary", "detail", "datasources", "iterations")
    return F.to_json(F.struct(*cols, rfc3339(F.col("create_time")).alias("created_at")))


def slack_payload(title: str = TITLE) -> Column:
    """Chat message of a report: header, summary, and detail and field blocks where there is something to say."""
    emoji, severity = severity_emoji(F.col("severity")), F.coalesce("severity", F.lit(""))
    none_fields = F.lit(None).cast("array<struct<type:string,text:string>>")
    none_text = F.lit(None).cast("struct<type:string,text:string>")

    def text(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), body.alias("text"))

    def block(kind: str, body: Column, fields: Column = none_fields) -> Column:
        return F.struct(F.lit(kind).alias("type"), body.alias("text"), fields.alias("fields"))

    def marked(head: str, body: Column) -> Column:
        return text("mrkdwn", F.concat(F.lit(f"*{head}*\n"), body))

    created = F.col("create_time")
    date = F.concat(
        F.lit("<!date^"), F.unix_seconds(created).cast("string"), F.lit("^{date_short} {time_secs}|"), rfc3339(created), F.lit(">")
    )
    fields = F.array_compact(
        F.array(
            F.when(F.coalesce("trigger", F.lit("")) != "", marked("Trigger", F.col("trigger"))),
            F.when(F.size("datasources") > 0, marked("Datasources", F.array_join("datasources", ", "))),
            F.when(created.isNotNull(), marked("Time", date)),
        )
    )
    blocks = F.array_compact(
        F.array(
            block("header", text("plain_text", F.concat(emoji, F.lit(f" {title} — "), severity))),
            block("section", marked("Summary", F.coalesce("summary", F.lit("")))),
            F.when(F.coalesce("detail", F.lit("")) != "", block("section", marked("Detail", F.col("detail")))),
            F.when(F.size(fields) > 0, block("section", none_text, fields)),
        )
    )
    head = F.concat(emoji, F.lit(" ["), severity, F.lit("] "), F.coalesce("summary", F.lit("")))
    return F.to_json(F.struct(head.alias("text"), blocks.alias("blocks")))


def notification_payloads(reports: DataFrame, min_severity: str | None = None, title: str = TITLE) -> DataFrame:
    """One payload row per completed report that passes the threshold, ready for any sink."""
    return notify_filter(reports.filter("status = 'completed'"), min_severity).select(
        "id", "severity", slack_payload(title).alias("payload")
    )


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Hand the payloads to a sink that delivers them: one JSON document per line."""
    payloads.select("payload").write.mode("append").text(path)
