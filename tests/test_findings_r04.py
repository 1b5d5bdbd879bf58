"""What the fourth round of findings changed."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as entry
from logloom.operators import knn, search
from logloom.operators.embed import HashEmbedder, embed


def _events(spark, folder, users):
    rows = [(n, u, "view", float(n % 50), '{"k": 1}') for n, u in enumerate(users)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    made.selectExpr("event_id", "timestamp_ntz '2024-01-01' as ts", "user_id", "event_type", "value", "props").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_outcomes_of_many_users_do_not_pair_every_user_with_every_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(knn, "_by_blocks", lambda *args: pytest.fail("every query meets every vector"))
    users = [*range(-300, 700), None, *([5] * 200)]
    sf = _events(spark, tmp_path, users)
    got = {r.query_id: (r.outcome, r.n_hits) for r in entry.queries()["search_outcomes"](spark, sf).collect()}
    assert got == {u: ("error_empty_query", 0) if u is None or u % 7 == 0 else ("success", 3) for u in users}


@pytest.mark.parametrize("metric", knn.METRICS)
@pytest.mark.parametrize("few", [256, 3])  # with three the queries have too many different vectors and go in blocks
def test_search_of_repeated_queries(spark, monkeypatch, metric, few):
    monkeypatch.setattr(knn, "FEW_QUERIES", few)
    texts, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    class Counting(HashEmbedder):
        def embed(self, some):
            for text in some:
                (texts if text.startswith("record") else asked).add(1)
            return super().embed(some)

    model, plain = Counting(8), HashEmbedder(8)
    rows = [(n if n % 10 else 4 if n % 20 else None, f"record {n} of {n % 6}") for n in range(90)]
    records = spark.createDataFrame(rows, "id int, body string").repartition(3)
    wanted = [(n, f"record of {n % 6}x") for n in range(400)] + [(1, "of 5"), (1, "of 5"), (None, "of 3"), (7, ""), (8, None)]
    queries = spark.createDataFrame([(i, None if q is None else q.replace("record", "which")) for i, q in wanted], "query_id int, query string").repartition(3)
    hits = search.search(queries, embed(records, "body", model), model, 3, metric=metric, few=False)
    got: dict = {}
    for r in hits.collect():
        assert rows.count((r.id, r.body)) == 1
        got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 5)))

    v = plain.embed([b for _, b in rows]).astype(float)
    met: dict = {}
    for r in queries.collect():
        if r.query:
            x = plain.embed([r.query]).astype(float)[0]
            far = ((v - x) ** 2).sum(axis=1) if metric == "l2" else -(v @ x)
            near = sorted((round(s, 5), i is None, i or 0) for s, (i, _) in zip(far, rows, strict=True))  # a missing id is left out first
            met.setdefault(r.query_id, []).extend(near[:3])
    want = {}
    for q, near in met.items():  # and stands first
        best = enumerate(sorted((s, not none, i) for s, none, i in near)[:3], 1)
        want[q] = [(n, i, abs(s)) for n, (s, some, i) in best for _ in range(sum(j == i for j, _ in rows) if some else 0)]
    assert {q: sorted((n, i) for n, i, _ in h) for q, h in got.items()} == {q: sorted((n, i) for n, i, _ in h) for q, h in want.items() if h}
    for q, h in got.items():
        assert np.allclose(sorted(abs(s) for *_, s in h), sorted(s for *_, s in want[q]), atol=1e-4)
    if few > 3:
        assert texts.value == len(rows) and asked.value < 400  # a record is embedded once


def test_embedder_slots(spark):
    """As the words are hashed one by one, on texts of every kind."""
    import hashlib
    import re

    texts = ["", " \n", "Disk 7 full, disk full", "İstanbul K ß ﬃ é", "a_b.c-D e\x00f", "x " * 50]
    got = HashEmbedder(5).embed(texts)
    for text, vector in zip(texts, got, strict=True):
        raw = np.zeros(5)
        for word in re.split("[^a-z0-9]+", text.lower()):
            if word:
                h = hashlib.md5(word.encode()).hexdigest()
                raw[int(h[:8], 16) % 5] += 1 if int(h[8], 16) % 2 == 0 else -1
        assert vector.dtype == np.float32 and np.array_equal(vector, (raw / (np.linalg.norm(raw) or 1)).astype(np.float32))
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "body string")
    assert [tuple(r.vector) for r in embed(df, "body", HashEmbedder(5)).collect()] == [tuple(map(float, x)) for x in [*got, np.zeros(5)]]
    assert embed(df.limit(0), "body", HashEmbedder(5)).count() == 0
