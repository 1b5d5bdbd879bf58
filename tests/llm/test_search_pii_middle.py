"""Ranked search, personal data and fill-in-middle: brute force, bounds that never lose, round trips, and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import fill_in_middle as fim
from logloom.llm import lexical, pii, queries
from logloom.llm.common import bucket_of_id, table

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{k % 997}" for k in range(30_000))
    rows = [
        (1, "one two three four"), (1, "one two three four"), (2, "one two three four"), (3, None), (4, ""), (5, " \t\n "),
        (None, "a null id one"), (6, long), (7, long + " tail"), (8, "Größe æøå 漢字 \x0b x <P> y"), (9, "x" * 300_000), (10, "+1 (212) 555-0147 é a@b.co"),
    ]
    df = docs_of(spark, rows)
    for name in ("n", "units", "chars", "bytes", "frames", "score", "rank", "query", "length", "terms", "bucket", "base", "spans", "words", "labels", "__id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# ---- 11 ---------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute_search(docs, items, k=50):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, Counter(w)) for i, w in ((i, split(t)) for i, t in docs) if w]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        terms = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(split(text))}
        scores = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in terms.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_rows,block_words", [(20_000, 500_000), (7, 500_000), (20_000, 12)])
def test_search_by_brute_force(spark, bucket_rows, block_words):
    draw = random.Random(3)
    docs = [(k, " ".join(f"t{int(draw.paretovariate(0.7)) % 60}" for _ in range(draw.randint(0, 60)))) for k in range(300)]
    docs += [(k, docs[17][1]) for k in range(1000, 1080)]  # more equal scores than answers
    items = [(q, " ".join(f"t{draw.randint(0, 60)}" for _ in range(draw.randint(0, 9)))) for q in range(12)] + [(3, docs[17][1]), (99, None)]
    got = lexical.search(docs_of(spark, docs), docs_of(spark, items, ITEMS), bucket_rows=bucket_rows, block_words=block_words).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items)


def test_search_prunes(spark):
    """Most vectors are neither scored nor, once thresholds are known, read as candidates."""
    draw = np.random.default_rng(0)
    block = lexical.Block([(0, b"rare one two three")])
    block.weights[:] = [900, 40, 30, 20]
    rows = [(draw.integers(1, 10**6, 3), np.array([1, 2, 3])) for _ in range(5000)] + [(draw.integers(9 * 10**5, 10**6, 4), np.arange(4)) for _ in range(60)]
    order = sorted(range(len(rows)), key=lambda k: -float((block.weights[rows[k][1]] * rows[k][0].astype(float) ** 2).sum()))
    offsets = np.cumsum([0, *(len(rows[k][1]) for k in order)])
    terms, impacts = (np.concatenate([rows[k][x] for k in order]) for x in (1, 0))
    length = np.sqrt(np.add.reduceat(block.weights[terms] * impacts.astype(float) ** 2, offsets[:-1]))
    task = lexical.Searcher(block, 50, [0])
    task.read(lexical.Bucket(list(range(len(rows))), length, offsets, terms, impacts))
    first = task.scored
    task.read(lexical.Bucket(list(range(len(rows))), length, offsets, terms, impacts))
    assert first == len(rows) and task.scored - first < 100
    best = sorted((-int((block.weights[rows[k][1]] * rows[k][0]).sum()), j) for j, k in enumerate(order))[:25]
    assert [-s for _, _, s in list(task.answers())[:50:2]] == [s for s, _ in best]


def test_search_odd_rows(spark, odd):
    items = docs_of(spark, [(1, "one two"), (1, "one two"), (None, "w1 tail"), (2, None), (3, ""), (4, "absent")], ITEMS).withColumn("rank", F.lit("clash"))
    got = lexical.search(odd, items).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == brute_search(rows, [tuple(r)[:2] for r in items.collect()])
    assert lexical.search(docs_of(spark, []), items).count() == 0
    assert lexical.search(odd, docs_of(spark, [], ITEMS)).columns == ["item_id", "rank", "doc_id", "score"]
    texts = docs_of(spark, [("a", "one"), ("b", "one two")], T.StructType([T.StructField("key", T.StringType()), T.StructField("body", T.StringType())]))
    assert [r["doc_id"] for r in lexical.search(texts, items.limit(1), id_col="key", text_col="body").collect()] == ["b", "a"]


# ---- 12 ---------------------------------------------------------------------------------------------------------------


def brute_spans(text):
    digits = lambda m: "".join(c for c in m[0] if c in "0123456789")
    find = lambda p: re.finditer(p, text)
    return {
        "email": [m.span() for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")],
        "ip": [m.span() for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in find(r"[0-9]([\x20-]?[0-9])+") if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= len(digits(m)) <= 15],
    }


def test_patterns_by_brute_force(spark, sf):
    draw = random.Random(1)
    for alphabet in ("a1.@-+ ( )1223.é", "0123456789 -", "a@b.c", "12.+", "+1 (2)-3"):
        for _ in range(3000):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 45)))
            assert pii.base_spans(text) == brute_spans(text), text
    for r in table(spark, sf, "documents").select("text").collect():
        assert pii.base_spans(r["text"] or "") == brute_spans(r["text"] or "")
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 100_000, "+" * 100_000, "a@" * 100_000):
        pii.base_spans(text)  # in linear time


def small_field(rng, k=len(pii.LABELS)):
    n, size = 4, 5
    return rng.normal(size=(n, size, k)), np.array([5, 1, 3, 4]), rng.normal(size=(k, k)), rng.normal(size=k)


def path_sums(unary, length, follow, first):
    for u, n in zip(unary, length, strict=True):
        paths = list(itertools.product(range(u.shape[1]), repeat=int(n)))
        yield paths, np.array([first[p[0]] + sum(u[t, p[t]] for t in range(n)) + sum(follow[p[t - 1], p[t]] for t in range(1, n)) for p in paths])


def test_field_by_all_paths():
    unary, length, follow, first = small_field(np.random.default_rng(4), 3)
    node, edge, whole = pii._expected(unary, length, follow, first)
    best = pii.viterbi(unary, length, follow, first)
    want = np.zeros((3, 3))
    for k, (paths, sums) in enumerate(path_sums(unary, length, follow, first)):
        assert tuple(best[k, : length[k]]) == paths[int(sums.argmax())]
        total = np.log(np.exp(sums).sum())
        assert whole[k] == pytest.approx(total)
        for p, s in zip(paths, sums, strict=True):
            for a, b in zip(p, p[1:], strict=False):
                want[a, b] += math.exp(s - total)
        for t in range(length[k]):
            for y in range(3):
                assert node[k, t, y] == pytest.approx(sum(math.exp(s - total) for p, s in zip(paths, sums, strict=True) if p[t] == y))
    assert np.allclose(edge, want)


@pytest.fixture(scope="module")
def field(spark, sf):
    rows = pii.training_table(table(spark, sf, "documents")).collect()
    assert len(rows) <= 2 * pii.SAMPLE
    return pii.train([([bytes(w) for w in r["words"]], list(r["labels"])) for r in rows])


def test_field_adds_what_patterns_miss(field):
    def added(text):
        ((_, base, more),) = pii.spans_of([(0, text.encode())], field)
        assert base == brute_spans(text)
        return sorted((k, text[a:b]) for k, spans in more.items() for a, b in spans)

    assert added("é write to bob.smith at mail dot corp dot com now") == [("email", "bob.smith at mail dot corp dot com")]
    assert added("call me on (743) 555-3824 then") == [("phone", "(743) 555-3824")]
    assert added("the server 10[.]2[.]3[.]4 is down") == [("ip", "10[.]2[.]3[.]4")]
    assert ("card", "4465758382889437") in added("and 4465758382889437 4465758382889437 once more")
    for clean in ("at the dot of noon at 5", "key 24be64439e3e49cf46b2d7c90f3602a3", "version 4.1.2 of 2024", "order 12345678 is late", "no numbers here"):
        assert added(clean) == []


def test_field_on_held_out_windows(spark, sf, field):
    """Labels of spans in windows of documents beyond the sample, as they are and rewritten."""
    rows = table(spark, "/root/testdata/sf0.1", "documents").where((bucket_of_id(5) == 0) & F.col("text").rlike("[0-9@]")).select("text").collect()
    draw = random.Random(5)
    whole = [x for r in rows for w in pii.labelled_windows((r["text"] or "").encode()) if any(w[1]) for x in pii.rewritten(*w, draw)]
    assert len(whole) > 100
    right = total = claimed = 0
    for (words, gold), got in zip(whole, field.label([w for w, _ in whole]), strict=True):
        assert len(words) == len(got)
        right += sum(int(a == b > 0) for a, b in zip(got, gold, strict=True))
        total += sum(map(bool, gold))
        claimed += int((got > 0).sum())
    assert right / total > 0.9 and right / claimed > 0.9


def test_pii_odd_rows(spark, odd, field):
    got = pii.find_pii(odd, field=field).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[3][0]["spans"] == "" == by[4][0]["base"] and len(by[1]) == 2 and None in by
    assert by[10][0]["base"] == "email:20:26,phone:0:17" and by[10][0]["n_phone"] == 1
    assert pii.find_pii(docs_of(spark, [])).count() == 0
    masked = pii.mask(odd.where("doc_id = 10"), pii.find_pii(odd, field=field)).first()
    assert masked["text"] == "<phone> é <email>"


def test_pii_query(spark, sf):
    got = queries.QUERIES["op12_pii"](spark, sf)
    assert {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"} <= set(got.columns)
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    for r in got.collect():
        base = brute_spans(texts[r["doc_id"]])
        listed = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k]]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        assert set(listed) <= set(r["spans"].split(",")) | {""}


# ---- 13 ---------------------------------------------------------------------------------------------------------------


def brute_middle(doc_id, text, rate=90, first=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < first else "psm"
    return doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame_bytes", [4, 7, 1000, fim.FRAME_BYTES])
def test_middle_by_brute_force(spark, odd, frame_bytes):
    """Frames cut letters, runs and seams anywhere; texts hold halves of marks."""
    draw = random.Random(frame_bytes)
    rows = [(k, "".join(draw.choice(["a", "Bc", " ", "é", "漢", "<", "P", ">", "<S", "M>", "\n", "1"]) for _ in range(draw.randint(0, 60)))) for k in range(400)]
    df = docs_of(spark, rows)
    if frame_bytes >= 1000:
        rows += [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
        df = df.union(odd.select("doc_id", "text"))
    got = fim.fill_in_middle(fim.pack(df, frame_bytes=frame_bytes), outputs=True).collect()
    seen = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=str)
    assert seen == sorted((brute_middle(*r) for r in rows), key=str)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert all(r["output_sha256"] == digest(r["output"]) for r in got)
    assert Counter(r["restored_sha256"] for r in got) == Counter(digest(t or "") for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_cuts_open_their_frames_only(spark):
    text = " ".join(f"word{k}" for k in range(50_000)).encode()
    row = fim.pack(docs_of(spark, [(1, text.decode())]), frame_bytes=10_000).first()
    frames = [f.asDict() for f in row["frames"]]
    assert len(frames) > 40
    units = re.findall(rb"[A-Za-z]+|[^A-Za-z]", text)
    for unit in (0, 1, 777, len(units) // 2, len(units) - 1, len(units)):
        reader = fim.Reader(row["units"], row["chars"], row["bytes"], frames)
        assert reader.place(unit) == (len(b"".join(units[:unit])), len(b"".join(units[:unit]).decode()))
        assert reader.opened <= 1
    got = fim.units_between(fim.pack(docs_of(spark, [(1, text.decode())]), frame_bytes=10_000), 60_000, 60_010).first()
    assert got["text"] == b"".join(units[60_000:60_010]).decode()


def test_middle_empty_table(spark):
    assert fim.fill_in_middle(fim.pack(docs_of(spark, []))).count() == 0
