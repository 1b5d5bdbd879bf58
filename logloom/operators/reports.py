"""Querying the report table: predicates, order, paging and aggregates.

Predicates are plain Column expressions over checked column names, so they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.plans.ranks import rows_at
from logloom.schemas import REPORT_COLUMNS

DEFAULT_LIST_LIMIT = 50


class NotFoundError(LookupError):
    """No row where one was expected."""


class NotSingularError(LookupError):
    """More than one row where one was expected."""


def field(name: str) -> Column:
    if name not in REPORT_COLUMNS:
        raise ValueError(f"unknown report column {name!r}")
    return F.col(name)


def eq(name: str, value) -> Column:
    return field(name) == value


def neq(name: str, value) -> Column:
    return field(name) != value


def is_in(name: str, values: list) -> Column:
    return field(name).isin(*values)


def not_in(name: str, values: list) -> Column:
    return ~field(name).isin(*values)


def gt(name: str, value) -> Column:
    return field(name) > value


def gte(name: str, value) -> Column:
    return field(name) >= value


def lt(name: str, value) -> Column:
    return field(name) < value


def lte(name: str, value) -> Column:
    return field(name) <= value


def contains(name: str, part: str) -> Column:
    return field(name).contains(part)


def has_prefix(name: str, part: str) -> Column:
    return field(name).startswith(part)


def has_suffix(name: str, part: str) -> Column:
    return field(name).endswith(part)


def equal_fold(name: str, value: str) -> Column:
    return F.lower(field(name)) == value.lower()


def contains_fold(name: str, part: str) -> Column:
    return F.lower(field(name)).contains(part.lower())


def is_nil(name: str) -> Column:
    return field(name).isNull()


def not_nil(name: str) -> Column:
    return field(name).isNotNull()


def all_of(*parts: Column) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def any_of(*parts: Column) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def negate(part: Column) -> Column:
    return ~part


def where_in_table(df: DataFrame, name: str, values: DataFrame, keep: bool = True) -> DataFrame:
    """Membership in a column of another table, for lists too long to write out."""
    field(name)
    v = values.select(F.col(values.columns[0]).alias(name))
    return df.join(v, name, "left_semi" if keep else "left_anti")


def select_fields(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[field(n) for n in names])


def order_by(df: DataFrame, *names: str) -> DataFrame:
    """Order by columns; a leading '-' means descending."""
    return df.orderBy(*[field(n[1:]).desc() if n.startswith("-") else field(n).asc() for n in names])


#: Offsets from which `page` looks for the place by counts instead of a top-k of all rows before it.
DEEP_OFFSET = 10_000


def page(df: DataFrame, order: list[str], limit: int | None = None, offset: int = 0, deep: int = DEEP_OFFSET) -> DataFrame:
    """Rows offset … offset + limit of an ordering; rows with equal keys are in any order.

    With a limit and a small offset Spark keeps only offset + limit rows per task. Otherwise the place is found by counting
    passes (`plans.ranks`), which run when this is called: no task holds the rows before it, and no id need be unique.
    """
    for name in order:
        field(name.removeprefix("-"))
    if not offset:
        ordered = order_by(df, *order)
        return ordered if limit is None else ordered.limit(limit)
    if limit is not None and offset < deep:
        return order_by(df, *order).offset(offset).limit(limit)
    return rows_at(df, order, offset, limit)


def first(df: DataFrame, order: list[str]):
    row = page(df, order, 1).first()
    if row is None:
        raise NotFoundError("report not found")
    return row


def first_id(df: DataFrame, order: list[str]):
    return first(df.select("id", *[o.lstrip("-") for o in order if o.lstrip("-") != "id"]), order)["id"]


def only(df: DataFrame):
    rows = df.limit(2).collect()
    if not rows:
        raise NotFoundError("report not found")
    if len(rows) > 1:
        raise NotSingularError("report not singular")
    return rows[0]


def only_id(df: DataFrame):
    return only(df.select("id"))["id"]


def ids(df: DataFrame) -> DataFrame:
    return df.select("id")


def exists(df: DataFrame) -> bool:
    return bool(df.select(F.lit(1)).limit(1).count())


def list_reports(df: DataFrame, limit: int = 0) -> DataFrame:
    """Newest first; a limit of 0 or less means 50. Equal times are ordered by id."""
    return order_by(df, "-create_time", "id").limit(limit if limit > 0 else DEFAULT_LIST_LIMIT)


def distinct_fields(df: DataFrame, *names: str) -> DataFrame:
    return select_fields(df, *names).distinct()


def count_rows(df: DataFrame, *distinct_on: str) -> DataFrame:
    """One row with the number of rows, or of distinct value combinations."""
    rows = distinct_fields(df, *distinct_on) if distinct_on else df
    return rows.agg(F.count("*").alias("count"))


def count() -> Column:
    return F.count("*")


def total(name: str) -> Column:
    return F.sum(field(name))


def mean(name: str) -> Column:
    return F.avg(field(name))


def minimum(name: str) -> Column:
    return F.min(field(name))


def maximum(name: str) -> Column:
    return F.max(field(name))


def aggregate(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Named aggregates per key combination, or over all rows when there are no keys."""
    named = [c.alias(n) for n, c in aggregates.items()]
    return df.groupBy(*[field(k) for k in keys]).agg(*named) if keys else df.agg(*named)
