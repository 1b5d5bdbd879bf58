"""Flatten the payloads of log and metric producers into tables.

Every function takes a DataFrame with one JSON document per row and explodes inside the row, so no
shuffle happens; file readers hand the text to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import schemas
from logloom.functions.jsonv import json_document, json_object, json_type
from logloom.functions.text import double_text, let

_LENIENT = {"mode": "PERMISSIVE"}

#: Where each source keeps its list.
LISTS = {"otlp_logs": "$.resourceLogs", "loki_streams": "$.data.result", "prom_result": "$.data.result"}



def any_value_text(value: Column) -> Column:
    """Text of an OTLP value union; other kinds and NULL are empty."""
    return F.coalesce(
        value["stringValue"], value["intValue"], double_text(value["doubleValue"]),
        value["boolValue"].cast("string"), F.lit(""),
    )


def rejects(df: DataFrame, source: str, payload: str = "payload") -> DataFrame:
    """(payload, reason) of the documents that a source cannot read: it gives no row for them.

    reason: `null`, `not JSON`, or `no list at` and the path the source reads. All other documents are read; one with an
    empty list has no rows and is no reject.
    """
    path = LISTS[source]
    doc = json_document(F.col(payload))
    listed = F.coalesce(json_type(F.try_variant_get(doc, path, "variant")).startswith("ARRAY"), F.lit(False))
    reason = (
        F.when(F.col(payload).isNull(), "null")
        .when(doc.isNull(), "not JSON")
        .when(~listed, f"no list at {path}")
    )
    return df.select(payload, reason.alias("reason")).filter("reason IS NOT NULL")


def otlp_logs(df: DataFrame, payload: str = "payload") -> DataFrame:
    """OTLP/JSON export requests to log rows (without id); only service.name survives from the resource."""
    req = F.from_json(payload, schemas.OTLP, _LENIENT)
    service_attr = F.filter("rl.resource.attributes", lambda a: a["key"] == "service.name")
    return (
        df.select(F.explode(req["resourceLogs"]).alias("rl"))
        .select(
            # the last attribute of a repeated key wins
            F.coalesce(any_value_text(F.try_element_at(service_attr, F.lit(-1))["value"]), F.lit("")).alias("service"),
            F.explode("rl.scopeLogs").alias("sl"),
        )
        .select("service", F.explode("sl.logRecords").alias("lr"))
        .select(
            F.timestamp_micros((F.coalesce(F.col("lr.timeUnixNano").try_cast("decimal(20,0)"), F.lit(0)) / 1000).cast("bigint")).alias("ts"),
            "service",
            F.coalesce("lr.severityText", F.lit("")).alias("severity"),
            any_value_text(F.col("lr.body")).alias("body"),
            _attribute_map(F.col("lr.attributes")).alias("attributes"),
        )
    )


def _attribute_map(attrs: Column) -> Column:
    keys = F.array_distinct(F.transform(attrs, lambda a: a["key"]))

    def last_value(k: Column) -> Column:
        return any_value_text(F.try_element_at(F.filter(attrs, lambda a: a["key"] == k), F.lit(-1))["value"])

    return F.coalesce(
        F.map_from_arrays(keys, F.transform(keys, last_value)), F.create_map().cast("map<string,string>")
    )


def loki_streams(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Log-store range responses to rows; value pairs with fewer than two parts are skipped."""
    resp = F.from_json(payload, schemas.LOKI, _LENIENT)
    return (
        df.select(F.explode(resp["data"]["result"]).alias("r"))
        .select(F.col("r.stream").alias("labels"), F.explode("r.values").alias("v"))
        .filter(F.size("v") >= 2)
        .select(
            F.col("v")[0].alias("timestamp"),
            "labels",
            F.col("v")[1].alias("message"),
            F.coalesce(F.try_element_at("labels", F.lit("level")), F.lit("")).alias("level"),
        )
    )


def _is_entry(doc: Column) -> Column:
    """A JSON object whose entry members, as far as it has them, are strings."""
    names = F.array(F.lit("_time"), F.lit("_stream"), F.lit("level"), F.lit("_msg"))

    def fits(members: Column) -> Column:
        kinds = F.transform(names, lambda n: json_type(F.try_element_at(members, n)))
        return members.isNotNull() & F.forall(kinds, lambda k: k.isNull() | k.isin("STRING", "VOID"))

    return F.coalesce(json_type(doc) == "VOID", F.lit(False)) | F.coalesce(let(json_object(doc), fits), F.lit(False))


def victorialogs(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A JSON array of entries, or one entry per line; bad and empty lines are skipped.

    The array form leaves out an empty stream label, the line form keeps it.
    """
    doc = F.col(payload)
    is_array = let(json_document(doc), lambda d: json_type(d).startswith("ARRAY") & F.coalesce(
        F.forall(F.try_variant_get(d, "$", "array<variant>"), _is_entry), F.lit(True)
    ))
    as_array = F.when(is_array, F.from_json(payload, f"array<{schemas.VICTORIA_ENTRY}>", _LENIENT))
    lines = F.filter(F.split(doc, "\n"), lambda s: s != "")
    good = F.filter(lines, lambda s: F.coalesce(let(json_document(s), _is_entry), F.lit(False)))
    as_lines = F.transform(good, lambda s: F.from_json(s, schemas.VICTORIA_ENTRY, _LENIENT))
    rows = df.select(as_array.isNotNull().alias("is_array"), F.explode(F.coalesce(as_array, as_lines)).alias("e"))
    stream = F.coalesce("e._stream", F.lit(""))
    return rows.select(
        F.coalesce("e._time", F.lit("")).alias("timestamp"),
        F.when(F.col("is_array") & (stream == ""), F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.lit("_stream"), stream))
        .alias("labels"),
        F.coalesce("e._msg", F.lit("")).alias("message"),
        F.coalesce("e.level", F.lit("")).alias("level"),
    )


def prom_result(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Metric query responses to series (labels, points); unknown result types raise."""
    doc = json_document(F.col(payload))

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(doc, path, kind)

    def point(pair: Column) -> Column:
        # millisecond times, as the metric store keeps them
        return F.struct(
            (F.round(F.try_variant_get(pair, "$[0]", "double") * 1000) / 1000).alias("timestamp"),
            F.try_variant_get(pair, "$[1]", "string").try_cast("double").alias("value"),
        )

    def series(item: Column, kind: Column) -> Column:
        many = F.transform(F.try_variant_get(item, "$.values", "array<variant>"), point)
        one = F.array(point(F.try_variant_get(item, "$.value", "variant")))
        return F.struct(
            F.try_variant_get(item, "$.metric", "map<string,string>").alias("labels"),
            F.when(kind == "matrix", many).otherwise(one).alias("points"),
        )

    kind = get("$.data.resultType", "string")
    items = F.transform(get("$.data.result", "array<variant>"), lambda x: series(x, kind))
    scalar = F.array(
        F.struct(
            F.lit(None).cast("map<string,string>").alias("labels"),
            F.array(point(get("$.data.result", "variant"))).alias("points"),
        )
    )
    bad = F.raise_error(F.concat(F.lit("unsupported result type: "), F.coalesce(kind, F.lit("none"))))
    rows = (
        F.when(kind.isin("vector", "matrix"), items)
        .when(kind == "scalar", scalar)
        .otherwise(bad.cast("array<struct<labels:map<string,string>,points:array<struct<timestamp:double,value:double>>>>"))
    )
    return df.select(F.explode(rows).alias("s")).select("s.labels", "s.points")


def alerts(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Webhook payloads to alert rows; the data member stays JSON text."""
    doc = json_document(F.col(payload))

    def text(name: str) -> Column:
        return F.coalesce(F.try_variant_get(doc, f"$.{name}", "string"), F.lit(""))

    data = F.to_json(F.try_variant_get(doc, "$.data", "variant"))
    return df.select(
        text("source").alias("source"), text("alert").alias("alert"), text("message").alias("message"),
        data.alias("data"),
    )


def read_payloads(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """JSON documents as text, one per line or one per file, in a column named payload."""
    return spark.read.text(path, wholetext=whole_file).withColumnRenamed("value", "payload")


def stream_payloads(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same as a stream over a growing folder."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).withColumnRenamed("value", "payload")
