"""What the third round of findings changed."""

from __future__ import annotations

import datetime as dt

import __spark_entry__ as entry

DAY_ONE = dt.datetime(2024, 1, 1)


def _events(spark, folder, rows):
    """An events table of (event_id, user_id) pairs, a minute apart."""
    made = [(e, DAY_ONE + dt.timedelta(minutes=n), u, "view", float(n % 50), '{"k": 1}') for n, (e, u) in enumerate(rows)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(made, schema).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_search_outcomes_of_more_users_than_travel_with_tasks(spark, tmp_path):
    sf = _events(spark, tmp_path, [(n, n) for n in range(400)])
    got = {r.query_id: (r.outcome, r.n_hits) for r in entry.queries()["search_outcomes"](spark, sf).collect()}
    assert got == {u: ("error_empty_query", 0) if u % 7 == 0 else ("success", 3) for u in range(400)}


def test_near_copies_of_the_pipeline_go_through_simhash(spark, monkeypatch):
    import corpus_pipeline
    from logloom.llm import near_copies, simhash

    asked = []
    found = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *args: asked.append(1) or found(fps, *args))
    words = [f"w{n}" for n in range(400)]
    texts = [" ".join(words), " ".join([*words, "end"]), "other words are here " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]
    assert asked
    keyed = near_copies._keyed(docs, "doc_id", "text")
    node = {r.doc_id: r.node for r in keyed.collect()}
    assert {tuple(sorted(r)) for r in near_copies.simhash_candidates(keyed).collect()} == {tuple(sorted([node[0], node[1]]))}


def test_a_query_travels_once_to_a_block_of_many_cells(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from logloom.operators import knn

    monkeypatch.setattr(knn, "ROWS_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 4)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(vectors)]
    q = spark.createDataFrame(rows, "query_id long, query_vector array<float>")
    v = spark.createDataFrame([(i, x, i % 12) for i, x in rows], "id long, vector array<float>, cell int")
    all_cells = lambda part, m: np.ones((len(m), 12), bool)
    sent, dealt = knn._cells_in_blocks(q, v, [(c, 5) for c in range(12)], 4, all_cells)
    assert sent.count() == 60 and sent.select("block").distinct().count() == 1  # not one row per cell
    monkeypatch.setattr(knn, "BLOCK_NUMBERS", 64)  # sixteen vectors a block
    few = lambda part, m: np.arange(12)[None, :] % 3 != (pa.array(part.column("query_id")).to_numpy() % 3)[:, None]
    sent, dealt = knn._cells_in_blocks(q, v, [(c, 5) for c in range(12)], 4, few)
    assert sent.groupBy("query_id", "block").count().where("count > 1").count() == 0
    got: dict = {}
    _, _, ddl, arrow = knn._prepared(q, v, "l2")
    for r in knn._top(knn._by_blocks(sent, dealt, 3, "l2", ddl, arrow), 3, "l2").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for i, x in rows:
        open_ = [(np.float32(((np.float64(y) - np.float64(x)) ** 2).sum()), j) for j, y in rows if (j % 12) % 3 != i % 3]
        assert [got[i][n] for n in (1, 2, 3)] == [j for _, j in sorted(open_)[:3]]


def test_a_store_reads_its_source_once(spark, tmp_path):
    from logloom.sources import vector_store

    rows = spark.range(40).selectExpr("id", "array(cast(id as float), 1f) as vector", "timestamp_micros(id) as ts", "'b' as body")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    vector_store.create(rows.mapInArrow(count, rows.schema), f"{tmp_path}/s")
    assert seen.value == 40 and vector_store.read(spark, f"{tmp_path}/s").count() == 40


def test_a_catalogue_carries_no_bodies_and_writes_patterns_once(spark, monkeypatch):
    from logloom.operators import templates

    written = []
    kept = templates.materialize
    monkeypatch.setattr(templates, "materialize", lambda df, name: written.append((name, df.columns, df.schema)) or kept(df, name))
    rows = [(1, 1, "s", "disk alpha full now"), (2, 2, "s", "disk beta full now"), (3, 3, "s", ""), (4, 4, None, None), (5, 5, None, ""), (6, 6, None, "a b")]
    logs = spark.createDataFrame(rows, "id int, ts int, service string, body string")
    mined = templates.mine_patterns(templates.masked_patterns(logs, keep=("ts", "id")))
    assert [name for name, _, _ in written] == ["folded"]
    assert written[0][2]["first"].dataType.names == ["ts", "id"]
    got = {(r.service, r.n_tokens, r.template, r.members, r.patterns) for r in templates.template_catalogue(mined).collect()}
    assert got == {("s", 4, "disk <*> full now", 2, 2), (None, 2, "a b", 1, 1)}
    lone = {(r.first.id, r.is_new, r.prefix, r.template, r.n_rows) for r in mined.where("n_tokens = 0").collect()}
    assert lone == {(i, True, None, None, 1) for i in (3, 4, 5)}


def test_new_ids_are_told_apart_in_tasks_of_a_bounded_number(spark, monkeypatch):
    from logloom.operators import lifecycle

    monkeypatch.setattr(lifecycle, "IDS_AT_ONCE", 10, raising=False)
    rows = spark.range(100).union(spark.createDataFrame([(7,), (None,)], "id long"))
    fresh, taken = lifecycle.split_new(spark.range(50, 150), rows)
    assert fresh.rdd.getNumPartitions() >= 20
    assert sorted(r.id for r in taken.collect()) == sorted([7, 7, *range(50, 100)])
    assert sorted(fresh.collect(), key=str) == sorted([(i,) for i in [None, *range(7), *range(8, 50)]], key=lambda r: f"Row(id={r[0]})")


def test_blocks_are_dealt_to_tasks_of_a_bounded_number_of_rows(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    from logloom.operators import metrics
    from logloom.plans import blocks

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    keys = [0.0, -0.0, float("nan"), float("inf"), None, 2.5]
    rows = spark.createDataFrame([(k, "a" if n % 2 else None, n) for n in range(300) for k in [keys[n % 6]]], "k double, s string, n long")
    block = F.floor(F.col("n") / 40)
    for form in (
        lambda **parts: blocks.blocked_running_sum(rows, ["k", "s"], block, [F.col("n")], F.col("n"), "x", **parts),
        lambda **parts: blocks.blocked_previous(rows, ["k", "s"], block, ["n"], F.col("n"), "x", **parts),
    ):
        dealt = form(parts=7)
        assert dealt.columns == ["k", "s", "n", "x"] and dealt.rdd.getNumPartitions() == 7  # as dealt, and not dealt again
        assert {r.n: r.x for r in dealt.collect()} == {r.n: r.x for r in form().collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    asked = []
    rates = metrics.rate_query
    monkeypatch.setattr(metrics, "rate_query", lambda *args, **more: asked.append([args, more]) or rates(*args, **more))
    monkeypatch.setattr(blocks, "ROWS_AT_ONCE", 100)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    entry.queries()["quantile_of_rate"](spark, sf)
    assert asked[0][0][-1] == 1 + 7 * n // 100
    entry.queries()["rate_step"](spark, sf)
    assert asked[1][1]["parts"] == 1 + n // 100


def test_component_rounds_are_one_job_each_without_broadcasts(spark, monkeypatch):
    from logloom.llm import components as module

    plans = []
    kept = module.stored

    def stored(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(module, "stored", stored)
    edges = spark.createDataFrame([(n, n + 1) for n in range(40)] + [(100, 101), (7, None), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in module.components(edges).collect()}
    assert got == {n: 0 for n in range(41)} | {100: 100, 101: 100}
    assert len(plans) > 2 and not any("Broadcast" in plan for plan in plans)
    assert module.components(edges.where("a < 0")).count() == 0


def test_rounds_of_near_copies_end_when_few_pairs_are_left(spark):
    from logloom.llm import near_copies

    schema = "node long, n int, at int, shingle long, class long"
    few = [(i, 9, 0, s, i) for s in range(5) for i in range(4)]  # four members, six pairs a list
    many = [(i, 9, 0, 1, i % 30) for i in range(60)]  # 59 others, one of the own class
    one = [(i, 9, 0, 1, 7) for i in range(60)]
    assert [near_copies._few_pairs(spark.createDataFrame(rows, schema)) for rows in (few, many, one, [])] == [True, False, True, True]


def test_a_stored_table_leaves_no_shuffle_files(spark, tmp_path):
    import time
    from pathlib import Path

    from pyspark.sql import functions as F

    from logloom.llm.common import drop, materialize, stored
    from logloom.session import FREE_SHUFFLES

    folders = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {p for d in folders for p in d.glob("*/shuffle_*")}

    before, setting = shuffles(), spark.conf.get(FREE_SHUFFLES, None)
    counts = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.count("*").alias("n"))
    both = counts.join(counts.toDF("l", "m").hint("merge"), F.col("k") == F.col("l"))
    assert materialize(both, "counts").count() == 5000
    table, path = stored(both.select("k", "n").distinct(), "counts")
    end = time.time() + 5
    while (left := sum(p.stat().st_size for p in shuffles() - before if p.exists())) > 10_000 and time.time() < end:
        time.sleep(0.1)
    assert left <= 10_000, left  # the count makes small ones
    assert {r.n for r in table.collect()} == {4}
    drop(spark, path)
    assert spark.conf.get(FREE_SHUFFLES, None) == setting


def test_rows_that_stay_are_dealt_out_once(spark, tmp_path):
    from logloom.llm import simhash

    rows = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d"), (3, "e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, None), (None, None), (3, 3)], "doc_id long, component_id long").write.parquet(f"{tmp_path}/marks")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for a broadcast
    try:
        got = simhash.stay_of_each(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/marks"))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.columns == ["doc_id", "text"]
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the documents and the ids that stay
    kept = sorted((r.doc_id or 0, r.text) for r in got.collect())
    assert [i for i, _ in kept] == [0, 1, 3] and set(kept) < {(0, "d"), (1, "a"), (1, "b"), (3, "e")}


def test_string_kernel_gathers_only_triples_of_its_landmarks():
    from itertools import combinations

    import numpy as np

    from logloom.llm import toxicity

    def triples(piece):
        letters = [int(x) for x in toxicity._LETTER[list(piece)] if x >= 0]
        found = {}
        for a, b, c in combinations(range(len(letters)), 3):
            if c - a < toxicity.STRETCH:
                key = letters[a], letters[b], letters[c]
                found[key] = found.get(key, 0) + toxicity.DECAY ** (c - a + 1)
        return found

    def like(word, landmark):
        own = triples(landmark)
        starts = range(0, max(1, len(word) - toxicity.SPAN // 2), toxicity.SPAN // 2) if len(word) > toxicity.SPAN else [0]
        best = max(sum(w * own.get(t, 0) for t, w in triples(word[s : s + toxicity.SPAN]).items()) for s in starts)
        return min(1, best / sum(w * w for w in own.values())) ** toxicity.POWER

    landmarks = [toxicity.canonical(w) for w in (b"idiot", b"stupid", b"the")]
    words = [b"idiots", b"i.d1i-o7t", b"", b"x", b"stup\xc3\xa9id", b"unrelated" * 9 + b"idiot" + b"stupid" * 5, b"12345", b"The", b"a\x01b\0c" * 6]
    words = [toxicity.canonical(w) for w in words]
    kernel = toxicity.Kernel(landmarks)
    assert np.allclose(kernel.rows(words), [[like(w, m) for m in landmarks] for w in words], atol=1e-5)
    assert kernel.shares.shape == (3, 1 + len(set().union(*map(triples, landmarks))))


def test_words_are_cut_and_coded_without_a_python_object_for_each_token():
    import numpy as np
    import pyarrow as pa

    from logloom.llm import hmm

    texts = [b"  The cat\x0b\x0csat \r\n", b"", b"\t ", b"\xff\xfeA\x00B \xc3\x89t\xc3\xa9 the", b"\xe2\x80\x83x y\x1cz\x85 the", b"end"] * 3
    want = [[*t.lower().split(), hmm.END] for t in texts]
    column = pa.array([b"before", *texts, b"after"]).slice(1, len(texts))
    distinct, ids, lengths = hmm.coded(column)
    words = distinct.to_pylist()
    assert lengths.tolist() == [len(w) for w in want] and [words[k] for k in ids] == [w for ws in want for w in ws]
    assert words[-1] == hmm.END and len(set(words)) == len(words)
    assert [t for part in hmm._slices(column, 20) for t in part.to_pylist()] == texts
    classes = hmm.Classes([b"the", hmm.END])
    runs = list(hmm._segments(column, classes))
    assert [first for first, _ in runs] == [1] * len(texts)
    assert all(np.array_equal(got, classes.of(w)) for (_, got), w in zip(runs, want, strict=True))
