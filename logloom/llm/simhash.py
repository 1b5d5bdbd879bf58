"""SimHash near-duplicates over a positional byte index with count filtering.

Charikar, "Similarity Estimation Techniques from Rounding Algorithms", STOC 2002; count filtering as in Li, Lu, Lu,
"Efficient Merging and Filtering Algorithms for Approximate String Searches", ICDE 2008.

A 64-bit fingerprint is eight bytes at eight positions. Two fingerprints with at most `max_bits` differing bits share at
least 8 - max_bits positional bytes, which is the guaranteed minimum of the count filter. A list of one byte holds 1/256
of all fingerprints, so lists of single bytes would tally a quadratic number of pairs. The posting lists are therefore
those of several positions at once: the positions are cut into max_bits + 2 units, of which at least two are untouched,
and a list is keyed by a pair of units with all their bytes. Pairs that meet in a list have their shared positional bytes
counted, keep the minimum, and are verified on the bits.

Lists of more than `longest_list` fingerprints are not paired. Their fingerprints are linked through midpoints instead:
two fingerprints are within two bits exactly if some value is within one bit of both, and at most 65 fingerprints are
within one bit of a value, so the groups are bounded by arithmetic. That route loses nothing: it yields for every such
pair a path of links, hence the same components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import id_and_bytes, map_rows, materialize
from logloom.llm.components import components

#: Bits of the 256 byte values, lowest first.
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
PIECE = 1 << 18


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a text: a bit is 1 if set in over half the hashes.

    A-Z become lower case and words are separated by white space of ASCII. A text of fewer words is one shingle, a text
    without words has fingerprint 0. Repeated shingles count as often as they occur.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - words_per_shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    tally = np.zeros(2048, np.int64)
    for at in range(0, n, PIECE):  # bounds the memory of very long texts
        part = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + PIECE], ends[at : at + PIECE], strict=True)]
        octets = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        tally += np.bincount((octets + np.arange(0, 2048, 256)).ravel(), minlength=2048)
    bits = tally.reshape(8, 256) @ BYTE_BITS
    return int(np.packbits((bits * 2 > n).ravel(), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        return ((i, fingerprint(text, words_per_shingle)) for i, text in texts)

    return map_rows(id_and_bytes(docs, id_col, text_col), schema, rows)


def shared_bytes(a: Column, b: Column) -> Column:
    """Number of the eight positions at which two fingerprints have the same byte."""
    x = a.bitwiseXOR(b)
    same = [F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(8)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total


def _units(max_bits: int) -> list[int]:
    """Masks of the byte positions of max_bits + 2 units."""
    edges = [round(8 * i / (max_bits + 2)) for i in range(max_bits + 3)]
    return [sum(255 << (8 * p) for p in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, max_bits: int = 2, longest_list: int = 64) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints with at most `max_bits` differing bits.

    `fps` has one column of distinct signed 64-bit values. Pairs from short posting lists are exactly such pairs; the
    fingerprints of long lists are linked to the smallest one around each midpoint. `max_bits` is 1 or 2.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    fp = F.col("fp")
    keys = [
        F.struct(F.lit(k).alias("unit"), fp.bitwiseAND(F.lit(_signed(p | q))).alias("value"))
        for k, (p, q) in enumerate(combinations(_units(max_bits), 2))
    ]
    index = fps.toDF("fp").where("fp is not null").select("fp", F.explode(F.array(*keys)).alias("list")).select("fp", "list.*")
    sizes = index.groupBy("unit", "value").agg(F.count("*").alias("n")).where("n > 1")
    listed = materialize(index.join(sizes, ["unit", "value"]), "postings")

    short = listed.where(F.col("n") <= longest_list).select("unit", "value", "fp")
    a, b = short.withColumnRenamed("fp", "a"), short.withColumnRenamed("fp", "b")
    near = (
        (F.col("a") < F.col("b"))
        & (shared_bytes(F.col("a"), F.col("b")) >= 8 - max_bits)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    )
    met = a.join(b, (a["unit"] == b["unit"]) & (a["value"] == b["value"]) & near).select("a", "b")

    steps = [F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(64))]
    around = (
        listed.where(F.col("n") > longest_list)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.array(*(fp.bitwiseXOR(s) for s in steps))).alias("middle"))
        .groupBy("middle")
        .agg(F.collect_list("fp").alias("near"))  # at most 65 values are within one bit of the middle
        .where(F.size("near") > 1)
    )
    if max_bits == 1:  # two ends around a midpoint may be two bits apart; only those at the midpoint itself are within one
        around = around.where(F.array_contains("near", F.col("middle"))).withColumn("first", F.col("middle"))
    else:
        around = around.withColumn("first", F.array_min("near"))
    star = around.select(F.col("first").alias("a"), F.explode("near").alias("b")).where("a <> b")
    return met.union(star).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, max_bits: int = 2, longest_list: int = 64
) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id reachable over links of at most `max_bits` differing bits.

    Texts without words have fingerprint 0 and are linked like any other. Rows of equal fingerprint are one node, whatever
    their number; null ids take part but name a component only if it has no other id.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    return classes_of(fps, links(fps.select("fp").distinct(), max_bits, longest_list))


def classes_of(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of (doc_id, fp), which is stored: the smallest id of the component over the edges."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(edges).withColumnsRenamed({"node": "fp"})
    # one row per component that has a link, then one row per linked fingerprint
    named = nodes.join(roots, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(named, "root").select("fp", "component_id")
    classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # written, so that both sides of the last join are shuffled and a fingerprint of very many copies can be split
    return fps.join(materialize(classes, "classes"), "fp").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, one for each class of near-duplicates: that with the smallest id.

    A document of which several rows exist under one id stays once.
    """
    return stay_of_each(docs, near_duplicates(docs, id_col, **options), id_col)


def stay_of_each(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id names the class of one of its rows in `marks`, one row per id.

    The key is a struct, in which a null id is a value like any other: rows are dealt out by it once, for both steps.
    """
    stay = marks.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.struct(F.col("doc_id").alias("id")).alias("__stay")).distinct()
    one = docs.withColumn("__key", F.struct(F.col(id_col).alias("id"))).dropDuplicates(["__key"])
    return one.join(stay.hint("merge"), F.col("__key") == F.col("__stay")).drop("__key", "__stay")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    from logloom.llm.common import table

    marks = near_duplicates(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
