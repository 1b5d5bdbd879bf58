"""Table schemas (DDL text, usable wherever Spark takes a schema)."""

from __future__ import annotations

LOG = "id STRING, ts TIMESTAMP, service STRING, severity STRING, body STRING, attributes MAP<STRING,STRING>"

VECTOR = (
    "id STRING, vector ARRAY<FLOAT>, ts TIMESTAMP, service STRING, severity STRING, body STRING, "
    "attributes MAP<STRING,STRING>"
)

ALERT = "source STRING, alert STRING, message STRING, data STRING"

REPORT = (
    "id STRING, create_time TIMESTAMP, update_time TIMESTAMP, trigger STRING, trigger_id STRING, status STRING, "
    "severity STRING, summary STRING, detail STRING, query STRING, datasources ARRAY<STRING>, iterations INT"
)

TRANSCRIPT = (
    "conv_id STRING, turn INT, role STRING, content STRING, "
    "tool_calls ARRAY<STRUCT<id: STRING, name: STRING, arguments: STRING>>, tool_call_id STRING, tool_name STRING"
)

ANY_VALUE = "STRUCT<stringValue: STRING, intValue: STRING, doubleValue: DOUBLE, boolValue: BOOLEAN>"
_KEY_VALUES = f"ARRAY<STRUCT<key: STRING, value: {ANY_VALUE}>>"

# OTLP/JSON export request, one per row
OTLP = (
    "resourceLogs ARRAY<STRUCT<"
    f"resource: STRUCT<attributes: {_KEY_VALUES}>, "
    "scopeLogs: ARRAY<STRUCT<logRecords: ARRAY<STRUCT<"
    f"timeUnixNano: STRING, severityText: STRING, body: {ANY_VALUE}, attributes: {_KEY_VALUES}"
    ">>>>>>"
)

LOKI = (
    "status STRING, data STRUCT<resultType: STRING, "
    "result: ARRAY<STRUCT<stream: MAP<STRING,STRING>, values: ARRAY<ARRAY<STRING>>>>>"
)

VICTORIA_ENTRY = "STRUCT<_time: STRING, _stream: STRING, level: STRING, _msg: STRING>"

# report columns by kind; the query helpers refuse anything else
REPORT_COLUMNS = (
    "id", "create_time", "update_time", "trigger", "trigger_id", "status",
    "severity", "summary", "detail", "query", "datasources", "iterations",
)
# fixed values: the enumerations of the report table
REPORT_ENUMS = {
    "trigger": ("manual", "webhook", "scheduled"),
    "status": ("queued", "pending", "running", "completed", "failed"),
    "severity": ("info", "warning", "critical"),
}
ACTIVE_STATUS = ("queued", "pending", "running")
