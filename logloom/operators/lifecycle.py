"""The life of a report.

The table is an append-only log of report versions and a "current" view over it. Changes are DataFrames of
new versions; appending them is the write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.schemas import REPORT_COLUMNS, REPORT_ENUMS

DRAINED = "Analysis queue drained during shutdown"
QUEUE_FULL = "Analysis queue is full, request rejected"
#: Ids that one task compares.
IDS_AT_ONCE = 500_000


class ConstraintError(ValueError):
    """A write that breaks the table's rules."""


def with_defaults(rows: DataFrame, as_of: Column) -> DataFrame:
    """Fill what a new report may leave out."""
    defaults = {
        "create_time": as_of, "update_time": as_of, "status": F.lit("queued"), "severity": F.lit("info"),
        "summary": F.lit(""), "detail": F.lit(""), "trigger_id": F.lit(""),
        "datasources": F.array().cast("array<string>"), "iterations": F.lit(0), "query": F.lit(None).cast("string"),
    }
    out = []
    for c in REPORT_COLUMNS:
        if c not in rows.columns:
            out.append(defaults.get(c, F.lit(None).cast("string")).alias(c))
        elif c in defaults and c != "query":
            out.append(F.coalesce(F.col(c), defaults[c]).alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out)


def check_report(rows: DataFrame) -> DataFrame:
    """Add `error`: missing id or trigger, or a value outside an enumeration."""
    checks = F.when(F.col("id").isNull(), F.lit('missing required field "id"')).when(
        F.col("trigger").isNull(), F.lit('missing required field "trigger"')
    )
    for name, allowed in REPORT_ENUMS.items():
        bad = F.concat(F.lit(f"invalid enum value for {name} field: "), F.col(name))
        checks = checks.when(~F.col(name).isin(*allowed), bad)
    return rows.withColumn("error", checks)


def split_new(current: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is new, and rows that repeat an id of the table or of their own batch.

    Both are counted first, as small ids would else come together in few tasks: a task takes about IDS_AT_ONCE of them.
    """
    parts = 1 + (rows.count() + current.count()) // IDS_AT_ONCE
    seen = rows.select("id", F.lit(1).alias("new"), F.lit(0).alias("old")).unionByName(
        current.select("id", F.lit(0).alias("new"), F.lit(1).alias("old"))
    )
    counted = seen.repartition(parts, "id").groupBy("id").agg(F.sum("new").alias("new"), F.max("old").alias("old"))
    taken = counted.filter("new > 1 OR (new = 1 AND old = 1)").select("id")
    dealt = rows.repartition(parts, "id")
    return dealt.join(taken, "id", "left_anti"), dealt.join(taken, "id", "left_semi")


def current_reports(versions: DataFrame, order: tuple[str, ...] = ("update_time",)) -> DataFrame:
    """Latest version of every report, deleted ones left out.

    A partial aggregate: a report with any number of versions shrinks to one row per task before the shuffle.
    """
    latest = versions.groupBy("id").agg(F.max_by(F.struct(*versions.columns), F.struct(*order)).alias("v"))
    out = latest.select("v.*")
    if "deleted" not in versions.columns:
        return out
    return out.filter(~F.coalesce("deleted", F.lit(False))).drop("deleted")


def updated(current: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """New versions of the reports named in changes (id and any report columns)."""
    sets = [c for c in changes.columns if c != "id"]
    unknown = set(sets) - set(REPORT_COLUMNS)
    if unknown:
        raise ValueError(f"unknown report columns {sorted(unknown)}")
    renamed = changes.select("id", *[F.col(c).alias(f"_{c}") for c in sets])
    return current.join(renamed, "id").select(
        *[
            as_of.alias(c) if c == "update_time" else F.col(f"_{c}").alias(c) if c in sets else F.col(c)
            for c in current.columns
        ]
    )


def not_found(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Change rows whose report does not exist."""
    return changes.join(current.select("id"), "id", "left_anti")


def update_where(current: DataFrame, predicate: Column, values: dict[str, Column], as_of: Column) -> DataFrame:
    """New versions of all reports that satisfy a predicate."""
    return current.filter(predicate).select(
        *[as_of.alias(c) if c == "update_time" else values.get(c, F.col(c)).alias(c) for c in current.columns]
    )


def add_iterations(n: int) -> dict[str, Column]:
    return {"iterations": F.col("iterations") + n}


def append_datasources(names: list[str]) -> dict[str, Column]:
    more = F.array(*[F.lit(n) for n in names])
    return {"datasources": F.concat(F.coalesce("datasources", F.array().cast("array<string>")), more)}


def clear_query() -> dict[str, Column]:
    return {"query": F.lit(None).cast("string")}


def deleted_where(current: DataFrame, predicate: Column, as_of: Column) -> DataFrame:
    """Tombstone versions; their number is the number of deleted reports."""
    return update_where(current, predicate, {}, as_of).withColumn("deleted", F.lit(True))


def delete_ids(current: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the listed reports."""
    return current.join(ids.select("id").distinct(), "id", "left_anti")


def get_reports(current: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids with their report columns and an outcome, found or not_found."""
    found = current.withColumn("_hit", F.lit(True))
    return ids.select("id").distinct().join(found, "id", "left").withColumn(
        "outcome", F.when(F.col("_hit"), "found").otherwise("not_found")
    ).drop("_hit")


def started(queued: DataFrame, as_of: Column) -> DataFrame:
    """running versions of queued reports."""
    return update_where(queued, F.col("status") == "queued", {"status": F.lit("running")}, as_of)


def finished(reports: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Final versions of running reports.

    results: id, error (NULL when the analysis succeeded), severity, summary, detail, datasources, iterations.
    """
    cols = ("error", "severity", "summary", "detail", "datasources", "iterations")
    r = results.select("id", *[F.col(c).alias(f"_{c}") for c in cols])
    failed = F.col("_error").isNotNull()
    values = {
        "update_time": as_of,
        "status": F.when(failed, "failed").otherwise("completed"),
        "severity": F.when(failed, "info").otherwise(F.col("_severity")),
        "summary": F.when(failed, F.concat(F.lit("Analysis failed: "), F.col("_error"))).otherwise(F.col("_summary")),
        "detail": F.when(failed, F.col("detail")).otherwise(F.col("_detail")),
        "datasources": F.when(failed, F.col("datasources")).otherwise(F.col("_datasources")),
        "iterations": F.when(failed, F.lit(0)).otherwise(F.col("_iterations")),
    }
    return reports.join(r, "id").select(*[values.get(c, F.col(c)).alias(c) for c in reports.columns])


def drain_orphans(current: DataFrame, as_of: Column) -> DataFrame:
    """failed versions of the reports still queued."""
    values = {"status": F.lit("failed"), "summary": F.lit(DRAINED)}
    return update_where(current, F.col("status") == "queued", values, as_of)


class ReportTable:
    """The version log on storage: every change appends, reading gives the current view."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def current(self) -> DataFrame:
        return current_reports(self.versions(), ("update_time", "version"))

    def _append(self, rows: DataFrame, version: int) -> None:
        if "deleted" not in rows.columns:
            rows = rows.withColumn("deleted", F.lit(False))
        keep = [*REPORT_COLUMNS, "deleted"]
        rows.select(*keep, F.lit(version).cast("bigint").alias("version")).write.mode("append").parquet(self.path)

    def _next(self) -> int:
        top = self.versions().agg(F.max("version")).first()[0]
        return 0 if top is None else top + 1

    def create(self, rows: DataFrame, as_of: Column, first: bool = False) -> None:
        """Append new reports; repeated ids and bad values refuse the whole batch."""
        full = check_report(with_defaults(rows, as_of))
        problem = full.filter("error is not null").select("error").first()
        if problem:
            raise ConstraintError(problem[0])
        full = full.drop("error")
        current = full.limit(0) if first else self.current()
        bad = split_new(current, full)[1].select("id").first()
        if bad:
            raise ConstraintError(f"report {bad[0]} exists")
        self._append(full, 0 if first else self._next())

    def update(self, changes: DataFrame, as_of: Column) -> None:
        current = self.current()
        missing = not_found(current, changes).select("id").first()
        if missing:
            raise LookupError(f"report {missing[0]} not found")
        self._append(updated(current, changes, as_of), self._next())

    def delete_where(self, predicate: Column, as_of: Column) -> int:
        version = self._next()
        self._append(deleted_where(self.current(), predicate, as_of), version)
        return self.versions().filter((F.col("version") == version) & F.col("deleted")).count()
