"""Texts around an analysis: prompts, answers, tool results, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.jsonv import json_document, json_object, json_type
from logloom.functions.text import byte_cut, byte_prefix, go_quote, let, truncate

SUMMARY_BYTES = 500
TOOL_RESULT_BYTES = 30_000
LOG_CONTEXT_TITLE = "\n\n=== Recent Log Context ===\n"


def _blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip_code_fence(text: Column) -> Column:
    """Inside of a text that is one fenced block, else the text itself."""
    inner = F.regexp_extract(text, r"^```[^\n]*\n([\s\S]+)```\z", 1)
    return F.when(inner != "", inner).otherwise(text)


ANALYSIS_FIELDS = ("severity", "summary", "detail")


def parse_analysis(text: Column) -> Column:
    """STRUCT(severity, summary, detail) of an answer; an answer that is not a JSON object becomes the summary."""

    def member(members: Column, name: str) -> Column:
        loose = F.map_filter(members, lambda k, _: F.lower(k) == name)
        return F.coalesce(F.try_element_at(members, F.lit(name)), F.get(F.map_values(loose), F.lit(0)))

    def fits(v: Column) -> Column:
        return v.isNull() | json_type(v).isin("STRING", "VOID")

    def from_values(values: Column) -> Column:
        severity, summary, detail = (
            _blank(F.try_variant_get(F.get(values, F.lit(i)), "$", "string")) for i in range(len(ANALYSIS_FIELDS))
        )
        known = F.when(severity.isin("warning", "critical"), severity).otherwise(F.lit("info"))
        return F.when(F.forall(values, fits), _answer(known, summary, detail))

    def from_document(doc: Column) -> Column:
        values = let(json_object(doc), lambda m: F.array(*[member(m, n) for n in ANALYSIS_FIELDS]))
        empty = F.when(json_type(doc) == "VOID", _answer(F.lit("info"), F.lit(""), F.lit("")))
        return F.coalesce(empty, F.when(json_type(doc).startswith("OBJECT"), let(values, from_values)))

    def read(body: Column) -> Column:
        raw = _answer(F.lit("info"), truncate(body, SUMMARY_BYTES), body)
        return F.coalesce(let(json_document(body), from_document), raw)

    return let(strip_code_fence(_blank(text)), read)


def _answer(severity: Column, summary: Column, detail: Column) -> Column:
    return F.struct(severity.alias("severity"), summary.alias("summary"), detail.alias("detail"))


def truncate_tool_result(text: Column, limit: int = TOOL_RESULT_BYTES) -> Column:
    """Cut long tool results between characters and say so."""
    marker = F.format_string(
        "\n\n[TRUNCATED: original %d chars, showing first %d]", F.octet_length(text), byte_cut(text, limit)
    )
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(byte_prefix(text, limit), marker))


# fixed values: fragments that decide the class of a tool error, in this order
TOOL_ERROR_CLASSES = (
    ("parameter_validation", ("invalid parameters", "jsonschema")),
    ("connection", ("connection refused", "no such host", "timeout")),
    ("query", ("metrics query failed", "query failed", "returned status")),
)


def tool_error_category(message: Column) -> Column:
    out = None
    for name, fragments in TOOL_ERROR_CLASSES:
        hit = F.lit(False)
        for f in fragments:
            hit = hit | message.contains(f)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("execution"))


# fixed values: advice that follows a tool error
TOOL_ERROR_ADVICE = (
    "Do NOT guess or assume data based on this error. "
    "If this is a connection error, you may try another datasource. "
    "If this is a parameter validation error, fix the arguments and retry. "
    "If all datasources fail, report the failure honestly without speculation."
)


def tool_error_text(tool: Column, message: Column, arguments: Column) -> Column:
    head = F.concat(F.lit("TOOL_ERROR [tool="), tool, F.lit(" category="), tool_error_category(message))
    return F.concat(
        head, F.lit("]: "), message, F.lit("\n\nArguments: "), arguments, F.lit("\n\n" + TOOL_ERROR_ADVICE)
    )


def unknown_tool_text(tool: Column) -> Column:
    return F.concat(F.lit("Error: unknown tool "), go_quote(tool))


def compose_query(query: Column, metric_query: Column, log_query: Column) -> Column:
    """Text of a manual inspection request."""
    base = F.when(
        (_blank(query) == "") & (_blank(metric_query) != ""), F.concat(F.lit("Check metrics: "), metric_query)
    ).otherwise(_blank(query))
    logs = F.when(_blank(log_query) != "", F.concat(F.lit("\nCheck logs: "), log_query)).otherwise(F.lit(""))
    return F.concat(base, logs)


def alert_context(source: Column, alert: Column, message: Column, data: Column, log_context: Column) -> Column:
    """Text handed to the analysis of an alert, with recent logs when there are any."""
    head = F.concat(
        F.lit("Source: "), _blank(source), F.lit("\nAlert: "), _blank(alert),
        F.lit("\nMessage: "), _blank(message), F.lit("\nData: "), _blank(data),
    )
    logs = F.when(_blank(log_context) != "", F.concat(F.lit(LOG_CONTEXT_TITLE), log_context)).otherwise(F.lit(""))
    return F.concat(head, logs)


def initial_prompt(trigger: Column, trigger_id: Column, datasources: Column, query: Column, context: Column) -> Column:
    """First user message; datasources is an array of structs (name, type)."""
    listed = F.when(F.size(datasources) > 0, F.to_json(datasources)).otherwise(F.lit("No datasources configured."))

    def section(title: str, body: Column) -> Column:
        return F.when(_blank(body) != "", F.concat(F.lit(f"\n\n## {title}:\n"), body)).otherwise(F.lit(""))

    return F.concat(
        F.lit("## Trigger: "), trigger, F.lit(" (ID: "), trigger_id, F.lit(")\n\n## Available Datasources:\n"),
        listed, section("Query", query), section("Additional Context", context),
    )


def call_error_class(status: Column, code: Column, body: Column) -> Column:
    """Class of a failed model call by HTTP status; texts tell an overflow from an invalid request."""
    low = F.lower(_blank(body))
    overflow = (
        _blank(code).contains("context_length_exceeded")
        | low.contains("prompt is too long")
        | low.contains("too many tokens")
    )
    return (
        F.when(status.isin(401, 403), F.lit("auth"))
        .when((status == 400) & overflow, F.lit("context_overflow"))
        .when(status == 400, F.lit("invalid_request"))
        .otherwise(F.lit("other"))
    )


def is_retryable(status: Column, code: Column, body: Column) -> Column:
    return call_error_class(status, code, body) == "other"
