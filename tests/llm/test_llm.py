from __future__ import annotations

import hashlib
import json
import random
import zipfile
import zlib
from collections import Counter
from io import BytesIO

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
import corpus_pipeline
from logloom.llm import decontamination, hmm, language, line_dedup, mixing, near_copies, neighbours, quality, queries, simhash, toxicity, warc
from logloom.llm.common import bucket_of_id, table
from logloom.llm.components import components

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{k % 997}" for k in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "a"), (1, "one two three four five six seven eight nine ten eleven", "a"),
        (2, "one two three four five six seven eight nine ten eleven", "b"), (3, None, None), (4, "", "a"), (5, " \t\n ", None),
        (None, "a null id", "c"), (6, long, "a"), (7, long + " tail", "é"), (8, "Größe æøå 漢字 \x0b x", "z"), (9, None, "b"), (10, "one", None),
    ]
    df = docs_of(spark, rows)
    for name in ("score", "fingerprint", "component_id", "doc", "of", "first", "line", "target", "taken", "position", "n_hit", "begins", "label", "order"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


@pytest.fixture(scope="module")
def duck(sf):
    import glob
    import os

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    """Rows as texts, in order, with the columns in the order of their names."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "null" if v is None else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, sf, name):
    got, want = queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLES[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_registered():
    known = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(known)


# ---- 1 ---------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: list of (id, fingerprint); the class of each row by comparing all pairs."""
    root = {k: k for k in range(len(fps))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            best[find(k)] = min(best.get(find(k), i), i)
    return [best.get(find(k)) for k in range(len(fps))]


def test_simhash_is_brute_force(spark, sf):
    got = queries.QUERIES["op1_simhash_near_dedup"](spark, sf).orderBy("doc_id").collect()
    texts = dict(table(spark, sf, "documents").select("doc_id", "text").collect())
    fps = [(r["doc_id"], brute_fingerprint(texts[r["doc_id"]])) for r in got]
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for _, f in fps]
    assert [r["component_id"] for r in got] == brute_components(fps)


def test_links_over_short_and_long_lists(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(300):  # a cloud in which lists are long, and loners
        x = centre
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    values |= {rng.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {}
    for v, c in zip(signed, brute_components(list(enumerate(values))), strict=True):
        want.setdefault(c, set()).add(v)
    want = {frozenset(g) for g in want.values() if len(g) > 1}
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for longest in (2, 1000):
        got = {}
        for r in components(simhash.links(df, longest_list=longest)).collect():
            got.setdefault(r["root"], set()).add(r["node"])
        assert {frozenset(g) for g in got.values()} == want


def test_simhash_of_odd_rows(spark, odd):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    by_id = {i: c for (i, _), c in got.items()}
    assert by_id[1] == by_id[2] == 1 and by_id[3] == by_id[4] == by_id[5] == by_id[9] == 3
    assert by_id[6] == by_id[7] == 6
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 2").count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = dict(components(edges).collect())
    assert {got[k] for k in range(41)} == {0} and got[101] == 100


def test_near_copies_are_all_pairs_of_jaccard(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(60):  # copies with one to seven words changed, strangers, and strangers that hold one common passage
        words = list(base)
        for _ in range(rng.randint(1, 7)):
            words[rng.randrange(200)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    passage = [f"p{k}" for k in range(40)]
    rows += [(100 + i, " ".join([f"v{rng.randrange(5000)}" for _ in range(30)] + passage)) for i in range(40)]
    rows += [(200, ""), (201, " \t"), (202, "a b"), (203, "A  b"), (204, None), (None, rows[0][1])]
    docs = docs_of(spark, [(i, t, "s") for i, t in rows])

    def sets(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    found = [sets(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(found[a] & found[b]) * 5 >= len(found[a] | found[b]) * 4 and root[a] != root[b]:
                root = [root[b] if r == root[a] else r for r in root]
    want = [min(i for (i, _), r in zip(rows, root, strict=True) if i is not None and r == mine) for mine in root]
    for longest in (4, 1000):
        got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, long_list=longest).collect()}
        assert [got[i] for i, _ in rows] == want
    # one changed word of 200 is a near copy, though more than two bits of the fingerprint differ
    two = docs_of(spark, [(1, " ".join(base), "s"), (2, " ".join(["x", *base[:99], "y", *base[100:]]), "s")])
    assert simhash.first_of_each(two).count() == 2
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, two, "").collect()] == [1]
    assert near_copies.near_copies(empty(spark)).count() == 0


# ---- 2 ---------------------------------------------------------------------------------------------------------------


def test_language_of_pages(spark, sf):
    got = queries.QUERIES["op2_language_id"](spark, sf).collect()
    assert len(got) == table(spark, sf, "pages").count()
    assert np.mean([r["lang"] == r["declared"] for r in got if r["declared"]]) > 0.95


def test_evidence_beats_a_wrong_declaration_and_fills_a_missing_text(spark):
    docs = docs_of(spark, [(k, "the and of with this", "s") for k in range(20)]).union(
        spark.createDataFrame([(100 + k, "der die und mit nicht", "de", "s", 1) for k in range(20)], DOCS)
    )
    german, english = "der die und nicht mit " * 20, "the and of this with " * 20
    pages = [(k, f"https://de.host.example/{k}", f'<html lang="de"><p>{german}</p>') for k in range(20)]
    pages += [(50 + k, f"https://en.other.test/{k}", f"<HTML LANG=en-GB><p>{english}</p>") for k in range(20)]
    pages += [(200, "https://en.other.test/x", f'<html lang="de"><script>{english}</script><p>{german}</p>'), (201, "https://de.host.example/y", None), (202, None, ""), (None, "no url", "<p>")]
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert got[3]["lang"] == "de" and got[55]["lang"] == "en" and got[55]["declared"] == "en"
    assert got[200]["lang"] == "de" and got[201]["lang"] == "de" and got[201]["text_lang"] is None
    assert 0 < got[202]["confidence"] <= 1 and None in got
    assert language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), empty(spark)).where("lang is null").count() == len(pages)


def test_language_by_brute_force(spark):
    """The fused probabilities of a small table, recomputed with plain numbers."""
    words = {"en": ["the", "and", "of"], "de": ["der", "und", "mit"]}
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words[x], k=5)), x, "s", 1) for k, x in enumerate(["en", "de"] * 10)], DOCS)
    pages = []
    for k in range(30):
        x = rng.choice(["en", "de"])
        pages.append((k, f"http://{rng.choice('ab')}.{rng.choice(['x.org', 'y.net'])}/", f'<html lang="{rng.choice([x, x, "fr"])}"> {" ".join(rng.choices(words[x], k=rng.randint(0, 3)))}'))
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    langs, log = language.likelihoods(docs)
    rows = []
    for i, url, body in pages:
        f = language.features(language.visible(body.encode()))
        text = log[:, f].sum(1) if len(f) else np.zeros(2)
        host = url.split("/")[2]
        rows.append((i, text, int(np.argmax(text)), text.max() > text.min(), body.split('"')[1], host.split(".")[-1], ".".join(host.split(".")[-2:]), host))
    total = Counter(r[2] for r in rows if r[3])
    n = sum(total.values())
    for i, text, k, told, *keys in rows:
        own = [int(told and k == x) for x in range(2)]

        def votes(col, value):
            c = Counter(r[2] for r in rows if r[3] and r[col] == value)
            return np.array([c[x] for x in range(2)], float)

        p = np.array([(total[x] + 1) / (n + 2) for x in range(2)])
        for col, value in ((6, keys[2]), (7, keys[3])):
            c = votes(col, value) - own
            p = (c + p * language.STRENGTH) / (c.sum() + language.STRENGTH)
        s = text * language.TEXT_WEIGHT + np.log(p)
        for col, value in ((4, keys[0]), (5, keys[1])):
            several = len({r[col] for r in rows if r[3]})
            s += np.log((votes(col, value) + 0.5) / (np.array([total[0], total[1]]) + 0.5 * several))
        q = np.exp(s - s.max())
        assert got[i]["lang"] == langs[int(np.argmax(s))] and got[i]["confidence"] == pytest.approx(1 / q.sum(), abs=1e-9)


# ---- 3 ---------------------------------------------------------------------------------------------------------------


def brute_hits(words, items, window):
    hit, found = set(), set()
    for i, w in items:
        n = min(window, len(w))
        for a in range(len(w) - n + 1) if w else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[a : a + n]:
                    hit.update(range(p, p + n))
                    found.add(i)
    return hit, found


def test_contamination_by_brute_force(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choices("abcd", k=rng.randint(0, 12)))) for k in range(8)] + [(50, None)]
    rows = [(k, " ".join(rng.choices("abcdX", k=rng.randint(0, 60))), "s") for k in range(40)]
    bench = spark.createDataFrame(items, ITEMS)
    split = [(i, decontamination.words_of((t or "").encode())) for i, t in items]
    for block in (10_000, 10):  # one block, and several whose hits meet
        got = decontamination.contamination(docs_of(spark, rows), bench, window=4, block_words=block, shard_words=50).collect()
        assert len(got) == len(rows)
        for r in got:
            hit, found = brute_hits(decontamination.words_of(rows[r["doc_id"]][1].encode()), split, 4)
            assert (r["n_hit"], set(r["items"])) == (len(hit), found)


def test_longest_matches(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], ITEMS)
    docs = docs_of(spark, [(7, "x y Alpha, beta; gamma delta q", "s"), (8, "nothing here", "s")])
    got = decontamination.longest_matches(docs, bench, min_words=3).collect()
    assert {(r["item_word"], r["doc_id"], r["doc_word"], r["words"]) for r in got} == {(0, 7, 2, 4), (1, 7, 3, 3)}


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "four five six"), (2, None), (None, "W3 w4 w5"), (4, "")], ITEMS)
    got = {r["doc_id"]: r for r in decontamination.contamination(odd, bench).collect()}
    assert got[1]["n_hit"] == 3 and got[3]["n_words"] == 0 and got[6]["items"] == [None] and got[None]["n_hit"] == 0
    kept = decontamination.clean(odd, bench)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, None, 8, 9, 10}
    assert decontamination.contamination(odd, empty(spark, ITEMS)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(empty(spark), bench).count() == 0


# ---- 4 and 7 ---------------------------------------------------------------------------------------------------------


def auc(y, x):
    rank = pd.Series(x).rank()
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality", "quality", 0.95), ("op7_toxicity", "toxic", 0.8)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out].merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    assert auc(held[label], held.score) > least
    assert (got.predicted == (got.score >= (0.3 if label == "quality" else 0.5))).all()


@pytest.mark.parametrize(("score", "label"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_scores_of_odd_rows(spark, odd, score, label):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (6, 1, 0), (7, None, None), (8, 0, 1), (None, 1, 1), (99, 1, 1)], LABELS)
    for given in (labels, empty(spark, LABELS)):
        got = score(odd, given).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert score(empty(spark), labels).count() == 0


def test_word_vectors_are_sums_over_neighbours():
    texts = [b"a b c a", b"x, y"]
    where, sign = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIMS), np.int64)
    for t in texts:
        ids = quality.tokens(t)
        for i in range(len(ids)):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    want[ids[i], where[ids[j]]] += sign[ids[j]]
    assert (quality._context_sums(iter(texts)) == want).all()


def test_string_kernel_tolerates_gaps():
    kernel = toxicity.Kernel([toxicity.canonical(b"idiot")])
    same, dotted, inserted, other = kernel.rows([toxicity.canonical(w) for w in (b"Idiot!", b"i.d.i.o.t", b"idxiot", b"reading")])[:, 0]
    assert same == pytest.approx(1, abs=1e-5) and dotted == pytest.approx(1, abs=1e-5) and inserted > 0.15 > 3 * other


# ---- 5 ---------------------------------------------------------------------------------------------------------------


def brute_nearest(rows, query, k=10):
    x = {i: np.array(v, float) for i, v in rows}
    return sorted((float(np.sqrt(((x[i] - x[query]) ** 2).sum())), i) for i in x if i != query)[:k]


def test_nearest_recall(spark, sf):
    got = queries.QUERIES["op5_nn_descent"](spark, sf).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, near in found.items():
        want = brute_nearest(rows, q)
        hits += len({v for _, v, _ in near} & {i for _, i in want})
        exact = {i: d for d, i in brute_nearest(rows, q, len(rows))}
        assert all(s == pytest.approx(exact[v], abs=1e-12) for _, v, s in near)
        assert [r for r, _, _ in sorted(near)] == list(range(1, 11))
    assert hits >= 0.9 * 10 * len(found) and set(found) == {i for i, _ in rows if i % 100 == 0}


def test_nearest_with_descent_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(600)]
    rows += [(1000 + k, rows[100][1]) for k in range(50)]  # copies of one vector
    bad = [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [1.0, None] * 4), (2400, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([*rows, *rows[:5], *bad], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, k=10, rounds=2, cell=64)
    out = {}
    for r in got.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    assert set(out) == {i for i, _ in rows if i % 100 == 0}
    hits = 0
    for q, near in out.items():
        want = brute_nearest(rows, q)
        hits += len({v for _, v in near.values()} & {i for _, i in want})
    assert hits >= 9 * len(out)
    assert [v for _, v in sorted(out[100].items())][0][1] == 1000
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.nearest(none, F.col("vec_id") % 100 == 0).count() == 0


# ---- 6 ---------------------------------------------------------------------------------------------------------------


def test_archives_are_plain_zip_and_are_read_by_ranges():
    records = [warc.record(k, f"http://x/{k}", b"page %d" % k, None if k else None) for k in range(3)]
    data, index, at = b"".join(records), [], 0
    for k, r in enumerate(records):
        index.append(json.dumps({"page_id": k, "offset": at, "length": len(r)}))
        at += len(r)
    for zip64 in (False, True):
        for comment in (b"", b"\n", b"a comment with PK\5\6 inside and more than twenty-two bytes"):
            whole = warc.archive([(warc.RECORDS, data), (warc.INDEX, "\n".join(index).encode())], comment, zip64)
            if b"PK" not in comment:  # which the standard library does not read
                assert zipfile.ZipFile(BytesIO(whole)).read("pages.warc.gz") == data
            asked = []

            def read(offset, n, whole=whole, asked=asked):
                asked.append(n)
                return whole[offset : offset + n]

            got = list(warc.records_of(read, len(whole)))
            assert [r["payload"] for r in got] == [b"page 0", b"page 1", b"page 2"] and len(data) not in asked
    for broken in (b"", b"no archive"):
        with pytest.raises(ValueError):
            warc.directory(lambda offset, n, b=broken: b[offset : offset + n], len(broken))


@pytest.mark.parametrize("reader", ["ranges", "spark"])
def test_warc_round_trip(spark, tmp_path, reader):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u4", ""), (5, "u\r\n5", "größe" * 5000), (1, "u1", "same"), (6, "u6", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1)).withColumn("sha", F.lit(2))
    path = f"file://{tmp_path}/a"
    warc.write_archives(pages.repartition(2), path, archive_bytes=300)
    got = warc.read_archives(spark, path, reader).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == sorted(
        [(1, "response", None, 4), (1, "response", None, 4), (2, "revisit", 1, 4), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, 35000), (6, "response", None, 5)]
    )
    assert {r["payload"].decode() for r in got if r["page_id"] == 5} == {"größe" * 5000}
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(none, f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b", reader).count() == 0


def test_short_payloads_are_no_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = warc.first_copies(pages, min_bytes=3).collect()
    assert {r["page_id"]: r["refers_to"] for r in got} == {1: None, 2: None, 3: None, 4: 3}


# ---- 8 ---------------------------------------------------------------------------------------------------------------


def test_lines_that_recur_are_dropped(spark):
    rows = [
        (1, "user 17 logged in from site alpha\nonly here and nowhere else\nshort line", "s"),
        (2, "user 99 logged in from site alpha\nsomething else is in this\nshort line", "s"),
        (3, "user 99 logged in from site beta\nuser 99 logged in from site beta", "s"),
        (4, None, "s"), (5, "", "s"), (None, "something else is in this", "s"), (2, "another text of the same one", "s"),
    ]
    got = line_dedup.drop_recurring_lines(docs_of(spark, rows))
    texts = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert texts == {
        (1, rows[0][1]), (2, "short line"), (3, ""), (4, None), (5, ""), (None, "something else is in this"), (2, "another text of the same one"),
    }
    whole = line_dedup.drop_recurring_lines(docs_of(spark, rows), keep_whole_above=0.5)
    assert {r["doc_id"]: (r["text"], r["__n_recurring"]) for r in whole.collect()}[3] == (rows[2][1], 2)
    assert line_dedup.drop_recurring_lines(empty(spark)).count() == 0


def test_only_copies_are_left_whole(spark):
    passage = " ".join(f"p{'abcdefgh'[k % 8]}{'xyz' [k % 3]}{'klmnopq'[k % 7]}" for k in range(80))
    other = "\n".join(" ".join(f"{a}{b}{'uvw'[k % 3]}" for k, b in enumerate("qwertyuiopas")) for a in "abcdefghij")
    near = other.replace("aqu", "changed", 1)
    own = ["\n".join(f"{x}{a} is here" for a in "abcdefghijk") for x in ("one", "two")]  # lines of three words
    rows = [
        (1, passage + "\n" + own[0], "s"), (2, own[1] + "\n" + passage, "s"),  # no copies, mostly the passage
        (3, other, "s"), (4, other, "s"), (5, near, "s"), (6, None, "s"), (7, "", "s"),
    ]
    got = corpus_pipeline.line_dedup_stage(spark, docs_of(spark, rows), "")
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    want = {i: t for i, t, _ in rows} | {2: own[1]}
    assert texts == want


def test_short_lines_recur_in_the_pipeline(spark):
    texts = ["one page with its own words\nAll rights reserved.\n\nx", "another text with other words here\nAll rights reserved.\n\nx y", "All rights reserved!\n\nvery different from the others it is"]
    got = corpus_pipeline.line_dedup_stage(spark, docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), "")
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == [texts[0], "another text with other words here\n\nx y", texts[2]]


def test_line_dedup_of_odd_rows(spark, odd):
    got = line_dedup.drop_recurring_lines(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() == odd.count()
    assert {r["text"] for r in got.where("doc_id = 2").collect()} == {""}


# ---- 9 ---------------------------------------------------------------------------------------------------------------


def test_forward_recursion_sums_all_paths():
    rng = np.random.default_rng(0)
    k, n = 3, 5

    def random_rows(shape):
        x = rng.random(shape) + 0.1
        return x / x.sum(-1, keepdims=True)

    chain = hmm.Chain(random_rows(k), random_rows((k, k)), random_rows((k, n)))
    texts = [rng.integers(0, n, size) for size in (6, 4, 1)]
    ids, lengths = hmm._padded(texts)
    got = chain.log10(ids, lengths)
    into = np.zeros(k + k * k + k * n)
    chain.expected(ids, lengths, np.array([1, 1, 1]), into)
    want = np.zeros_like(into)
    for text, g in zip(texts, got, strict=True):
        total, parts = 0.0, np.zeros_like(into)
        for path in np.ndindex(*(k,) * len(text)):
            p = chain.start[path[0]] * chain.emit[path[0], text[0]]
            for t in range(1, len(text)):
                p *= chain.move[path[t - 1], path[t]] * chain.emit[path[t], text[t]]
            total += p
            parts[path[0]] += p
            for t in range(1, len(text)):
                parts[k + path[t - 1] * k + path[t]] += p
            for s, c in zip(path, text, strict=True):
                parts[k + k * k + s * n + c] += p
        assert g == pytest.approx(np.log10(total))
        want += parts / total
    assert into == pytest.approx(want)


def test_hmm_scores(spark, sf):
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_hmm_scoring"](spark, sf).collect()}
    texts = dict(table(spark, sf, "documents").select("doc_id", "text").collect())
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        words = [*(t or "").encode().lower().split(), None]
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base) and r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_hmm_of_odd_rows(spark, odd):
    got = hmm.score_texts(odd, rounds=1, batch_bytes=10_000).collect()
    assert len(got) == odd.count() and {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hmm.score_texts(empty(spark)).count() == 0


# ---- 10 --------------------------------------------------------------------------------------------------------------


def test_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights 1, 2, 3, 1: a is 1, b is 2, c and the null source stop at three times their size
    assert got["a"] == 30 and got["c"] == 30 and got[None] == 300 and got["b"] == pytest.approx(1120 - 360)


def test_mix_of_odd_rows(spark, odd):
    got = mixing.mix(odd, rows_per_slice=2)
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r["position"] <= 1 and 0 <= r["taken"] <= 3 * r["size"] for r in rows)
    per = {}
    for r in rows:
        per.setdefault((r["source"], r["target"]), []).append(r)
    for (_, target), group in per.items():
        assert abs(sum(r["taken"] for r in group) - target) <= max(r["size"] for r in group)
    again = mixing.mix(odd.repartition(5), rows_per_slice=1)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert mixing.mix(empty(spark)).count() == 0
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)


def test_every_copy_has_its_position(spark):
    # weights 1, 2, 3: the small source c is taken three times
    docs = docs_of(spark, [(i, "w " * 50, "a") for i in range(40)] + [(100 + i, "w " * 50, "c") for i in range(8)] + [(200 + i, "w " * 50, "b") for i in range(40)])
    rows = mixing.take(docs).collect()
    marks = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    count = Counter(r["doc_id"] for r in rows)
    assert count == {i: r["copies"] for i, r in marks.items() if r["copies"]} and all(count[100 + i] == 3 for i in range(8))
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    at = sorted(r["position"] for r in rows if r["source"] == "c")
    # schedule of the third source: 1.5 to 0.5 over time 0..1, whose integral is 1.5 t - t * t / 2
    assert [1.5 * t - t * t / 2 for t in at] == pytest.approx([k / 24 for k in range(24)])
    assert all(min(m["positions"]) == m["position"] for m in marks.values() if m["copies"])


def test_inverse_of_the_integral(spark):
    schedule = ((0.0, 1.0), (0.25, 3.0), (1.0, 0.0))
    df = spark.range(101).select((F.col("id") / 100).alias("u"))
    got = df.select("u", mixing.inverse_integral(schedule, F.col("u")).alias("t")).collect()
    grid = np.linspace(0, 1, 200_001)
    w = np.interp(grid, [0, 0.25, 1], [1, 3, 0])
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    for r in got:
        assert r["t"] == pytest.approx(np.interp(r["u"], area / area[-1], grid), abs=2e-3)


# ---- the pipeline ----------------------------------------------------------------------------------------------------


def brute_shingles(text):
    """Distinct five-word shingles; a shorter text is one."""
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute_line_stage(rows, share=0.5):
    """Line de-duplication of (doc_id, text), by plain Python: short lines recur whole, only shown copies stay whole."""
    import re

    def tokens(line):
        return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub(r"[^\x20\x09-\x0d]*[0-9@][^\x20\x09-\x0d]*", "<*>", line)) if w]

    def templates(t):
        n = len(t)
        if n < 5:
            return [(n, -1, tuple(t))] if n else []
        width = -(-max(n - 2, 0) // 4)
        return [(n, k, tuple(t[: 2 + width * k]), tuple(t[2 + width * (k + 1) :])) for k in range(4)]

    seen, text_of = {}, dict(rows)
    for i, text in rows:
        for line in (text or "").split("\n"):
            for x in templates(tokens(line)):
                seen[x] = min(seen.get(x, i), i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        lost, by_first = [], Counter()
        for k, line in enumerate(lines):
            t = tokens(line)
            first = min((seen[x] for x in templates(t)), default=i)
            if first < i:
                lost.append(k)
                by_first[first] += len(t)
        words = len([w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w])
        copy = False
        if sum(by_first.values()) > share * words:
            origin = text_of[max(by_first, key=lambda d: (by_first[d], -d))]
            copy = origin == text or alike(brute_shingles(origin), brute_shingles(text))
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in lost) if lost and not copy else text))
    return out


def brute_near_stage(rows):
    """The texts with the smallest id of their class over all pairs of similarity 0.8 or more."""
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if alike(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                root[y] = x
    return [r for k, r in enumerate(rows) if find(k) == k]


def test_pipeline_stages_by_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    scored = {r["doc_id"]: r["predicted"] for r in quality.score_quality(docs, table(spark, sf, "labels")).collect()}
    one = stage[names[0]](spark, docs, sf).cache()
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {i for i, p in scored.items() if p}

    rows = sorted((r["doc_id"], r["text"]) for r in one.collect())
    two = stage[names[1]](spark, one, sf).cache()
    want = brute_line_stage(rows)
    assert two.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in two.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())

    three = stage[names[2]](spark, two, sf).cache()
    kept = brute_near_stage(want)
    assert len(kept) < len(want)
    assert three.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in three.collect()) == kept

    items = [(r["item_id"], decontamination.words_of(r["text"].encode())) for r in table(spark, sf, "benchmark").collect()]
    grams = {tuple(w[a : a + min(10, len(w))]) for _, w in items if w for a in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(g) for g in grams}

    def dirty(text):
        w = decontamination.words_of(text.encode())
        return any(tuple(w[a : a + n]) in grams for n in sizes for a in range(len(w) - n + 1))

    four = stage[names[3]](spark, three, sf).cache()
    clean = [i for i, t in kept if not dirty(t)]
    assert four.columns == docs.columns and sorted(r["doc_id"] for r in four.collect()) == clean

    five = stage[names[4]](spark, four, sf).collect()
    marks = {r["doc_id"]: r for r in mixing.mix(four).collect()}
    assert {r["doc_id"]: (r["copies"], r["taken"]) for r in five} == {i: (r["copies"], r["taken"]) for i, r in marks.items() if r["taken"]}
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, whole)) == sorted(map(str, five))


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    folder = f"file://{tmp_path}"
    odd.select(DOCS.names).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (6, 1, 0)], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "größe æøå 漢字")], ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert 8 not in got and 2 not in got and got <= {1, 6, 7, 10, None}


def test_ids_without_labels_are_held_out(spark):
    got = spark.createDataFrame([(None,), (5,)], "doc_id long").select("doc_id", (bucket_of_id(5) == 0).alias("h")).collect()
    assert dict(got)[None] is True and dict(got)[5] == (zlib.crc32(b"5") % 5 == 0)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
