"""Places of an ordering against a sorted list: ties, nulls, single keys, and no sort of what comes before."""

from __future__ import annotations

import random

import pytest

from logloom.operators import reports
from logloom.plans import ranks

KEYS = "a int, b string, id long"


def frame(spark, kind, n=3000):
    draw = random.Random(kind)
    a = {"mixed": lambda: draw.choice([None, *range(9)]), "one": lambda: 7, "two": lambda: draw.choice([1, 1, 1, 1, 2]), "wide": lambda: draw.randint(0, 10**6)}[kind]
    rows = [(a(), draw.choice([None, "x", "y", "z"]), i) for i in range(n)]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, KEYS).repartition(5)


def place(row, order):
    out = []
    for name, down in ranks.parsed(order):
        v = row[("a", "b", "id").index(name)]
        null = (v is None) if down else (v is not None)
        out.append((null, 0 if v is None else (tuple(-ord(c) for c in v) if isinstance(v, str) else -v) if down else v))
    return tuple(out)


@pytest.mark.parametrize("kind", ["mixed", "one", "two", "wide"])
def test_rows_at(spark, kind):
    rows, df = frame(spark, kind)
    for order, unique in ((["-a", "b", "id"], True), (["a", "-b", "-id"], True), (["a"], False), (["-b", "a"], False)):
        want = sorted(rows, key=lambda r: place(r, order))
        for offset, limit in ((0, 5), (1499, 40), (2990, 50), (3000, 5)):
            got = [tuple(r) for r in ranks.rows_at(df, order, offset, limit, rows=100).collect()]
            part = want[offset : offset + limit]
            assert [place(r, order) for r in got] == [place(r, order) for r in part]
            assert got == part if unique else len(set(got)) == len(got)
    got = [tuple(r) for r in ranks.rows_at(df, ["-a", "b", "id"], 1700, rows=100).collect()]
    assert got == sorted(rows, key=lambda r: place(r, ["-a", "b", "id"]))[1700:]
    assert ranks.rows_at(df, ["a"], 2900, rows=100).count() == 100


def test_a_place_far_down_sorts_few_rows(spark):
    df = spark.range(0, 400_000, 1, 6).selectExpr("id", "hash(id) AS a")
    low, high, before, inside = ranks.locate(df, ["a", "id"], 250_000, rows=5_000)
    assert before <= 250_000 < before + inside and inside <= 5_000 and low < high
    assert ranks.rows_at(df, ["a", "id"], 250_000, 3, rows=5_000).collect() == df.orderBy("a", "id").offset(250_000).limit(3).collect()


def test_page_and_empty(spark):
    rows = spark.createDataFrame([(str(i), i % 3) for i in range(50)], "id string, iterations int")
    for limit in (None, 7):
        deep = reports.page(rows, ["-iterations", "id"], limit, 20, deep=1).collect()
        assert deep == rows.orderBy(rows.iterations.desc(), "id").offset(20).limit(limit or 100).collect()
    assert ranks.rows_at(rows.limit(0), ["id"], 3, 5).count() == 0 == ranks.rows_at(rows.limit(0), ["id"], 3).count()
