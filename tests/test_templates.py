"""Template mining against an independent row-by-row replay."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.operators import templates
from logloom.operators.embed import HashEmbedder, embed_in_batches
from logloom.operators.ingest_filter import check_mode
from logloom.plans.ingest import ingest

_PARAM = re.compile(r"^(\d+|\d+\.\d+|true|false)$")


def replay(rows, threshold):
    """Greedy clustering row by row, per (service, token count)."""
    known, out = {}, {}
    for ts, i, service, body in sorted(rows):
        toks = body.split()
        if not toks:
            out[i] = (True, body)
            continue
        group = known.setdefault((service, len(toks)), [])
        best, score = None, 0.0
        for t in group:
            s = sum(a == b or b == "<*>" for a, b in zip(toks, t)) / len(toks)
            if s > score and s >= threshold:
                best, score = t, s
        if best is None:
            t = ["<*>" if _PARAM.match(x) else x for x in toks]
            group.append(t)
            out[i] = (True, " ".join(t))
        else:
            best[:] = [b if a == b or b == "<*>" else "<*>" for a, b in zip(toks, best)]
            out[i] = (False, None)
    return out, {(k, " ".join(t)) for k, g in known.items() for t in g}


def random_logs(seed, n=400):
    rnd = random.Random(seed)
    words = ["get", "put", "up", "down", "node", "disk", "7", "12", "3.5", "true"]
    return [
        (rnd.randrange(200), i, rnd.choice(["hot", "hot", "b", None]), " ".join(rnd.choice(words) for _ in range(rnd.randrange(7))))
        for i in range(n)
    ]


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.7), (2, 0.5), (3, 0.34)])
def test_equals_row_by_row_replay(spark, seed, threshold):
    rows = random_logs(seed)
    df = spark.createDataFrame(rows, "ts int, id int, service string, body string")
    want, final = replay([(t, i, s or "", b) for t, i, s, b in rows], threshold)
    got = templates.mine_templates(df, threshold=threshold).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.is_new, r.created_template) for r in got} == want
    mined = templates.mine_patterns(templates.masked_patterns(df), threshold=threshold)
    catalogue = templates.template_catalogue(mined).collect()
    assert {(((r.service or ""), r.n_tokens), r.template) for r in catalogue} == final
    assert sum(r.members for r in catalogue) == sum(bool(b.split()) for *_, b in rows)
    kept = templates.dedup_by_template(df, threshold=threshold).collect()
    assert {r.id: r.body for r in kept} == {i: t for i, (new, t) in want.items() if new}


def test_fixed_sequence(spark):
    bodies = [
        "connection refused to database", "connection refused to redis", "timeout waiting for response",
        "user 12345 logged in from 192.168.1.1", "user 99999 logged in from 10.0.0.1",
    ]
    df = spark.createDataFrame([(i, i, "s", b) for i, b in enumerate(bodies)], "ts int, id int, service string, body string")
    rows = templates.mine_templates(df).orderBy("id").collect()
    assert [r.is_new for r in rows] == [True, False, True, True, False]
    assert [r.template for r in rows] == ["connection refused to <*>"] * 2 + ["timeout waiting for response"] + ["user <*> logged in from <*>"] * 2


def family_catalogue(spark, extra):
    """Templates of 60 similar bodies, alone or among unrelated rows of the same service and length."""
    rows = [(i, i, "s", f"w{chr(97 + i % 26)}{chr(97 + i // 26)} said hello to the world") for i in range(60)]
    rows += [(i, i, "s", " ".join(f"{c}{i:x}q" for c in "uvwxyz")) for i in range(1000, 1000 + extra)]
    df = spark.createDataFrame(rows, "ts int, id int, service string, body string")
    mined = templates.mine_patterns(templates.masked_patterns(df))
    return {(r.template, r.members) for r in templates.template_catalogue(mined).collect() if "hello" in r.template}


def test_unrelated_rows_change_no_template(spark):
    want = {("<*> said hello to the world", 60)}
    assert family_catalogue(spark, 0) == want
    assert family_catalogue(spark, 30_000) == want


def test_depth_holds_for_every_bucket(spark):
    rows = [(i, i, "s", f"same start of {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)]
    rows += [(i, i, None, f"{'xyz'[i % 3]} start of {chr(97 + i % 26)}") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "ts int, id int, service string, body string")
    mined = templates.mine_patterns(templates.masked_patterns(df, ()), (), depth=1, threshold=0.5)
    got = {(r.prefix, r.template, r.members) for r in templates.template_catalogue(mined, ()).collect()}
    assert got == {("same", "same start of <*>", 60)} | {(c, f"{c} start of <*>", 20) for c in "xyz"}


def test_index_finds_what_a_full_comparison_finds():
    rnd = random.Random(5)
    for threshold in (0.3, 0.5, 0.7):
        known, plain = templates.TemplateSet(5, threshold, capacity=40), []
        for _ in range(600):
            tokens = [rnd.choice(["a", "b", "c", "d", "<*>"]) + (rnd.choice(["", "x", "y"]) if rnd.random() < 0.5 else "") for _ in range(5)]
            tokens = ["<*>" if t.startswith("<*>") else t for t in tokens]
            score, best = max(((sum(b == "<*>" or a == b and a != "<*>" for a, b in zip(tokens, t[0])) / 5, -k) for k, t in enumerate(plain)), default=(0, 0))
            i, is_new = known.add(tokens)
            if score > 0 and score >= threshold:
                assert (i, is_new) == (-best, False)
                t = plain[-best]
                t[0], t[1] = [b if a == b or b == "<*>" else "<*>" for a, b in zip(tokens, t[0])], t[1] + 1
            else:
                if len(plain) == 40:
                    worst = min(range(40), key=lambda k: plain[k][1])
                    plain[worst] = plain[-1]
                    plain.pop()
                plain.append([tokens, 1])
                assert (i, is_new) == (len(plain) - 1, True)
        assert [known.text(i) for i in range(known.size)] == [" ".join(t) for t, _ in plain]


def test_capacity_evicts_the_least_used():
    known = templates.TemplateSet(2, 0.9, capacity=2)
    known.add(["a", "b"])
    known.add(["a", "b"])
    known.add(["c", "d"])
    assert known.add(["e", "f"]) == (1, True)  # the used-once template left, the last slot is free again
    assert sorted(known.text(i) for i in range(known.size)) == ["a b", "e f"]


def test_eviction_reads_no_other_template():
    """10,000 templates in use, 3,000 evictions: each looks at a few entries of the heap only, and takes the first of the least used."""
    known = templates.TemplateSet(3, 1.0, capacity=10_000)
    for i in range(10_000):
        known.add([f"a{i}", f"b{i % 50}", "c"], 1 + i % 7)
    seen = []

    class Counting(list):
        def __getitem__(self, k):
            seen.append(k)
            return list.__getitem__(self, k)

    known.uses = Counting(known.uses)
    plain = {i: int(known.counts[i]) for i in range(10_000)}
    for i in range(3_000):
        worst = min(plain, key=lambda k: (plain[k], k)) if i % 100 == 0 else None
        before = known.text(worst) if worst is not None else None
        assert known.add([f"n{i}", "x", "c"], 5) == (9_999, True)
        if before is not None:
            assert all(known.text(k) != before for k in (worst, 9_999))
        plain = {k: int(known.counts[k]) for k in range(10_000)} if i % 100 == 99 else plain
    assert len(seen) < 40 * 3_000
    assert all(len(set(p.numbers[: p.n].tolist())) == p.n for p in known.at.values() if isinstance(p, templates.Posting))


def test_capacity_of_the_batch_job_is_that_of_a_loop(spark):
    draw = random.Random(9)
    rows = [(i, i, "s" if i % 3 else None, " ".join(draw.choice("abcdefgh") + draw.choice("xyz") for _ in range(draw.choice([3, 4])))) for i in range(600)]
    df = spark.createDataFrame(rows, "ts int, id int, service string, body string")
    got = templates.mine_with_capacity(df, 5, threshold=0.6).collect()
    sets, want = {}, {}
    for _, i, service, text in rows:
        key = service, len(text.split())
        known = sets.setdefault(key, templates.TemplateSet(key[1], 0.6, 5))
        want[i] = known.add(text.split())
    assert {r["id"]: (r["template_no"], r["is_new"]) for r in got if r["id"] is not None} == want
    left = {(r["service"], r["n_tokens"], r["template_no"], r["template"], r["members"]) for r in got if r["id"] is None}
    assert left == {(s, n, k, x.text(k), int(x.counts[k])) for (s, n), x in sets.items() for k in range(x.size)}


def test_ingest_modes(spark):
    rows = [(i, i, "s", sev, f"connection refused to db-{i}") for i, sev in enumerate(["INFO", "WARNING", "ERROR", "DEBUG"])]
    df = spark.createDataFrame(rows, "ts int, id int, service string, severity string, body string").withColumn("ts", F.timestamp_seconds("ts"))
    model = HashEmbedder(8)
    records, stats = ingest(df, model)
    assert tuple(stats.first()) == (1, 3, 0)
    assert [r.body for r in records.collect()] == ["connection refused to db-0"]
    records, stats = ingest(df, model, "severity", "warning")
    assert tuple(stats.first()) == (2, 0, 2) and records.count() == 2
    assert tuple(ingest(df, model, "all")[1].first()) == (4, 0, 0)
    empty = df.limit(0)
    assert tuple(ingest(empty, model)[1].first()) == (0, 0, 0)
    assert tuple(ingest(empty, model, "all")[1].first()) == (0, 0, 0)
    with pytest.raises(ValueError, match="unknown filter mode"):
        check_mode("")


def test_embedder_count_is_checked():
    class Short:
        dim = 2

        def embed(self, texts):
            return [[0.0, 0.0]] * (len(texts) - 1)

    with pytest.raises(ValueError, match="embedding count mismatch: got 1, want 2"):
        embed_in_batches(Short(), ["a", "b"])
