"""Domain views over the driver tables (FIXTURES.md, section 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import configure

# fixed values: how the driver's columns map to domain names
EVENT_SEVERITY = {"error": "error", "purchase": "warning", "signup": "notice", "click": "info", "view": "debug"}
ORDER_STATUS = {"F": "completed", "O": "queued", "P": "running"}
PRIORITY_SEVERITY = {"1-URGENT": "critical", "2-HIGH": "warning"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that comes in fewer splits than there are cores.

    Only tiny tables do; one of many files keeps its splits and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def _case(col: str, mapping: dict, other: str | None = None):
    out = None
    for k, v in mapping.items():
        out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
    return out if other is None else out.otherwise(other)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log row per event."""
    return as_logs(spread(events(spark, sf_dir)))


def as_logs(rows: DataFrame) -> DataFrame:
    """Log rows of an event table or stream."""
    return rows.select(
        F.col("event_id").alias("id"),
        "ts",
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"),
        _case("event_type", EVENT_SEVERITY).alias("severity"),
        F.concat(
            "event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" value "),
            F.col("value").cast("string"), F.lit(" k "), F.get_json_object("props", "$.k"),
        ).alias("body"),
    )


def family_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log row per event, in families of bodies that merge partly."""
    return as_family_logs(events(spark, sf_dir))


def as_family_logs(rows: DataFrame) -> DataFrame:
    """Family rows of an event table or stream."""

    def word(name: str, value, rest: str = "x"):
        return F.concat(F.lit(name), value.cast("string"), F.lit(rest))

    user, event = F.col("user_id"), F.col("event_id")
    body = (
        F.when(event % 4 == 0, word("connection to host", user % 40, "x refused"))
        .when(event % 4 == 1, F.concat_ws(" ", "event_type", word("job", user % 30, "x took long on"), word("node", event % 7)))
        .when(event % 4 == 2, F.concat_ws(" ", word("worker", event % 9), F.lit("of"), word("pool", user % 3, "x started by"), "event_type", word("at ", event, "")))
        .otherwise(F.concat_ws(" ", "event_type", word("cache", user % 4, "x warm and ready for"), word("shard", event % 11)))
    )
    return rows.select(event.alias("id"), "ts", F.concat(F.lit("svc-"), (user % 5).cast("string")).alias("service"), body.alias("body"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a log row; the source is the service, (document, line) the order."""
    return (
        spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
        .select("doc_id", F.col("source").alias("service"), F.posexplode(F.split("text", "\n")).alias("line_no", "body"))
        .withColumn("id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line_no").cast("string")))
        .withColumn("ts", F.col("doc_id") * 1_000_000 + F.col("line_no"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as vector records; metadata comes from the log row with the same id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e.join(logs(spark, sf_dir), "id")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error event as an alert; the way it names its service varies."""
    svc = F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))
    form = F.col("event_id") % 6
    said = F.concat(F.lit("the payments-"), (F.col("user_id") % 5).cast("string"), F.lit(" service is down"))
    return spread(events(spark, sf_dir).filter("event_type = 'error'")).select(
        F.col("event_id").alias("id"),
        "ts",
        svc.alias("log_service"),
        F.lit("grafana").alias("source"),
        F.concat(F.lit("ErrorRateHigh "), F.col("user_id").cast("string")).alias("alert"),
        F.when(form == 0, F.concat(F.lit("service="), svc, F.lit(" error rate > 5%")))
        .when(form == 1, F.concat(F.lit("service: "), svc, F.lit(", see runbook")))
        .when(form == 2, F.concat(F.lit('firing app="'), svc, F.lit('" now')))
        .when(form == 5, said)
        .otherwise("check dashboards")
        .alias("message"),
        F.when(form == 3, F.concat(F.lit('{"service":"'), svc, F.lit('","value":'), F.col("value").cast("string"), F.lit("}")))
        .when(form == 4, F.concat(F.lit('{"status":"firing","labels":{"job":"'), svc, F.lit('"}}')))
        .otherwise("")
        .alias("data"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an inspection request for its user."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 2 == 0, "manual").otherwise("webhook").alias("trigger"),
        F.concat(F.lit("check user "), F.col("user_id").cast("string")).alias("query"),
        F.col("ts").alias("create_time"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per order."""
    create = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        create.alias("create_time"),
        create.alias("update_time"),
        F.when(F.col("o_custkey") % 3 == 0, "manual").when(F.col("o_custkey") % 3 == 1, "webhook")
        .otherwise("scheduled").alias("trigger"),
        F.concat(F.lit("t-"), F.col("o_orderkey").cast("string")).alias("trigger_id"),
        _case("o_orderstatus", ORDER_STATUS).alias("status"),
        _case("o_orderpriority", PRIORITY_SEVERITY, "info").alias("severity"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("summary"),
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("Total "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).alias("detail"),
        F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("check cust "), F.col("o_custkey").cast("string"))).alias("query"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>"))
        .when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("metrics")))
        .otherwise(F.array(F.lit("metrics"), F.lit("logs"))).alias("datasources"),
        (F.col("o_orderkey") % 10).cast("int").alias("iterations"),
    )


def report_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of every report: queued, running, and its own status, a minute apart."""
    r = reports(spark, sf_dir)
    step = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("step")
    return r.select(*r.columns, step).select(
        *[c for c in r.columns if c not in ("status", "update_time")],
        F.when(F.col("step") == 0, "queued").when(F.col("step") == 1, "running").otherwise(F.col("status")).alias("status"),
        F.timestamp_micros(F.unix_micros("create_time") + F.col("step") * 60_000_000).alias("update_time"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a metric sample of the series (service, event_type)."""
    return events(spark, sf_dir).select(
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"), "event_type", "ts", "value",
        F.col("event_id").alias("id"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, without tool messages as they have none."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
