"""Language of web pages by Bayesian fusion of four kinds of evidence.

For a page with text t, declared language m, address suffix s and host h,

    P(lang | all)  ~  P(t | lang)^w  P(m | lang)  P(s | lang)  P(lang | h)

Text: words and endings of words of the visible text, hashed to a fixed number of buckets, with likelihoods counted over all
documents whose language is given. Words of a text depend on each other, which single likelihoods do not know, so the text
weighs w = TEXT_WEIGHT. Markup and suffix: how often pages of a language declare or have them. Host: shares of languages on
the host, smoothed by those of its domain, which are smoothed by those of all pages. These tables are counted by grouped
aggregation over all pages, with the language their text alone gives; a page's own vote is taken out of its host and domain.

The tables of the likelihoods have a fixed size per language. Hosts are joined to pages, so their number and size are free.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.text import let
from logloom.llm.common import id_and_bytes, map_rows, materialize, table, to_arrow

BUCKETS, BLOCK = 1 << 16, 1 << 12
TEXT_WEIGHT, ALPHA, STRENGTH = 0.25, 0.5, 4.0
#: Languages at most, the most frequent ones; a text of none of them is given the likeliest of these.
MOST_LANGUAGES = 256

_HIDDEN = re.compile(rb"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(rb"<[^>]*>")
_EDGE = b".,;:!?\"'()[]|*#$%&"


def visible(page: bytes) -> bytes:
    """Text of a page without markup, scripts, styles and comments, entities resolved."""
    text = _TAG.sub(b" ", _HIDDEN.sub(b" ", page))
    return html.unescape(text.decode("utf-8", "replace")).encode() if b"&" in text else text


def features(text: bytes) -> np.ndarray:
    """Buckets of the words and of their last three bytes."""
    words = [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]
    both = [*words, *(b"\0" + w[-3:] for w in words)]
    return np.fromiter(map(zlib.crc32, both), np.int64, len(both)) % BUCKETS


def declared_language(page: Column) -> Column:
    """Primary subtag, in lower case, of the lang attribute of the html element; null without one."""
    tag = F.regexp_extract(page, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,8})", 1)
    return F.nullif(F.lower(tag), F.lit(""))


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user and port; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def likelihoods(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order of their code, and the log likelihood of every bucket in each."""
    named = docs.where(F.col(lang_col).isNotNull())
    top = named.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    langs = sorted(r["lang"] for r in top)
    place = {x: k for k, x in enumerate(langs)}
    schema = T.StructType([T.StructField("lang", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    arrow = to_arrow(schema)

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, np.ndarray] = {}
        for lang, text in rows:
            if (k := place.get(lang)) is not None:
                total = held.setdefault(k, np.zeros(BUCKETS, np.int64))
                f = features(text)
                np.add.at(total, f, 1)
        for k, total in held.items():
            for b, part in enumerate(total.reshape(-1, BLOCK)):
                yield k, b, part.tolist()

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for batch in parts:
            for row in batch.column("sums"):
                total += row.values.to_numpy()
        yield pa.RecordBatch.from_pydict({"lang": [key[0].as_py()], "block": [key[1].as_py()], "sums": [total]}, arrow)

    source = id_and_bytes(named.withColumn("__lang", F.col(lang_col)), "__lang", text_col)
    counts = np.zeros((len(langs), BUCKETS // BLOCK, BLOCK))
    for r in map_rows(source, schema, count, size=256).groupBy("lang", "block").applyInArrow(add, schema).collect():
        counts[r["lang"], r["block"]] = r["sums"]
    counts = counts.reshape(len(langs), BUCKETS)
    return langs, np.log((counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * BUCKETS))


def _largest(scores: Column) -> Column:
    """Index of the largest element, the first of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, suffix, host) of every row.

    lang: the likeliest language; confidence: its probability; text_lang: that of the text alone. A null or empty page has no
    text and is decided by the other evidence; so is a page without words. Equal probabilities go to the language
    with the lesser code. A page without declaration, or without a host, counts as one that declares, or has, nothing.
    Without documents of a given language nothing can be told, and lang and confidence are null.
    """
    langs, table_ = likelihoods(docs)
    n = len(langs)
    kind = pages.schema[id_col].dataType
    host = host_of(F.col(url_col))
    base = pages.select(
        F.col(id_col).alias("page_id"), host.alias("host"), F.coalesce(declared_language(F.col(html_col)), F.lit("")).alias("declared"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"),
    )
    if not n:
        return base.select("page_id", *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"))), "declared", F.substring_index("host", ".", -1).alias("suffix"), "host")
    sent = pages.sparkSession.sparkContext.broadcast(table_)
    schema = T.StructType([T.StructField("page_id", kind), T.StructField("host", T.StringType()), T.StructField("declared", T.StringType()), T.StructField("text", T.ArrayType(T.DoubleType()))])

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        for page, at, declared, body in rows:
            f = features(visible(body))
            yield page, at, declared, sent.value[:, f].sum(1).tolist() if len(f) else [0.0] * n

    seen = map_rows(base, schema, read).withColumns(
        {"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2), "k": _largest(F.col("text"))}
    )
    seen = materialize(seen.withColumn("told", F.array_max("text") > F.array_min("text")), "pages")
    votes = seen.where("told")  # pages without words do not vote

    def counted(key: str) -> DataFrame:
        """(key, n_key): votes by language, as an array."""
        by_lang = F.array(*(F.count(F.when(F.col("k") == k, 1)) for k in range(n)))
        return votes.groupBy(F.col(key).alias(f"{key}_")).agg(by_lang.alias(f"n_{key}"))

    whole = {r["k"]: r["c"] for r in votes.groupBy("k").agg(F.count("*").alias("c")).collect()}  # one number per language
    per_lang = [float(whole.get(k, 0)) for k in range(n)]
    total = sum(per_lang)
    share = F.array(*(F.lit((c + 1) / (total + n)) for c in per_lang))
    lang_votes = F.array(*map(F.lit, per_lang))
    kinds = [max(1, votes.select(c).distinct().count()) for c in ("declared", "suffix")]

    joined = seen
    for key in ("declared", "suffix", "domain", "host"):
        joined = joined.join(counted(key), F.col(key) == F.col(f"{key}_"), "left").drop(f"{key}_")
    none = F.array(*(F.lit(0).cast("long") for _ in range(n)))
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(F.col("told") & (F.col("k") == k), 1).otherwise(0))

    def less_own(col: str) -> Column:
        return F.zip_with(F.coalesce(F.col(col), none), own, lambda a, b: F.greatest(a - b, F.lit(0)))

    def smoothed(counts: Column, prior: Column) -> Column:
        return let(counts, lambda c: F.zip_with(c, prior, lambda a, p: (a + p * STRENGTH) / (F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y) + STRENGTH)))

    def evidence(col: str, several: int) -> Column:
        """log P(value | language), smoothed over the values that occur."""
        return F.zip_with(F.coalesce(F.col(col), none), lang_votes, lambda a, b: F.ln((a + ALPHA) / (b + ALPHA * several)))

    prior = let(smoothed(less_own("n_domain"), share), lambda p: smoothed(less_own("n_host"), p))
    parts = [F.transform("text", lambda x: x * TEXT_WEIGHT), evidence("n_declared", kinds[0]), evidence("n_suffix", kinds[1]), F.transform(prior, lambda p: F.ln(p))]
    score = parts[0]
    for p in parts[1:]:
        score = F.zip_with(score, p, lambda a, b: a + b)
    names = F.array(*map(F.lit, langs))
    scored = joined.withColumn("score", score)
    weights = let(F.array_max("score"), lambda m: F.transform("score", lambda x: F.exp(x - m)))
    return scored.select(
        "page_id", F.get(names, _largest(F.col("score"))).alias("lang"),
        (F.lit(1.0) / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)).alias("confidence"),
        F.when(F.col("told"), F.get(names, F.col("k"))).alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), "suffix", "host",
    )


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every page."""
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
