"""Near copies by SimHash and the exact Jaccard similarity of word shingles: every pair at 4/5 or more is a link.

The texts get SimHash fingerprints of the same shingles, and those with at most two differing bits are compared first, a group of equal
fingerprints and a link between two groups by their first texts; the exact similarity decides. As SimHash misses most pairs near the
threshold, prefix filtering then finds the others:

Prefix filtering as in Chaudhuri, Ganti, Kaushik, "A Primitive Operator for Similarity Joins in Data Cleaning", ICDE 2006, with
the position bound of Xiao et al., "Efficient Similarity Joins for Near Duplicate Detection", WWW 2008. In one order of all shingles,
two sets of similarity 4/5 share a shingle among the first n - ceil(4n/5) + 1 of each, so only these are put into posting
lists. The order is that of the hashes, with shingles of long lists last; any order is exact, this one keeps common passages
out of the lists.

A large group of near copies is in one list many times over. Neighbours in a list are therefore compared first, and what that
links is one class; then, in rounds, every class but the largest of a list with some members of the list, others and twice as many
each time, so a group grows together without all its pairs; then members of classes that are still different and meet in a list are compared, all
of them that the place of the shingle and the sizes allow. No pair is lost: a link that is not compared lies inside a class. Shingles and texts are told apart
by 64-bit hashes.

Rounds end as soon as all pairs of different classes that meet in a list are no more than a fixed number for each member, so they are
only run where lists are long. Joins are merges, as a broadcast, of which the driver holds the table and a thread, gains nothing here.

Texts are compared in blocks: a block is a stretch of a list, or a share of the partners of a text, so its number of texts is
bounded, and a text travels once to each block that has a pair of it, as text, which is a quarter of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import simhash
from logloom.llm.common import drop, map_rows, materialize, stored
from logloom.llm.components import components
from logloom.llm.simhash import classes_of, stay_of_each

#: Shingles in more lists than this are ordered last, the longest first if there are more than MOST_COMMON, which bounds the broadcast.
LONG_LIST = 32
MOST_COMMON = 1 << 18
#: Texts of a stretch of a list, and partners of a text, that meet in one block.
BLOCK = 256
#: Rounds of comparing members of other classes, and pairs of a class in the first of them.
ROUNDS, MEETINGS = 6, 4
#: No further round if the members of lists would meet others of another class no more often than this, on average.
FEW_PAIRS = 8
#: Shingles that a task counts at once for the list lengths.
COUNT_AT_ONCE = 1 << 21


def shingles(text: bytes, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; words as in SimHash. A shorter text, also one without words, is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    joined, n = b" ".join(words), max(1, len(words) - words_per_shingle + 1)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    if n == 1:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))


def _prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of a text, sorted, that go into lists; those in `common` come last in the order."""
    n = len(found)
    if len(common):
        last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~last], found[last]])
    return found[: n - (4 * n + 4) // 5 + 1]


def _prefixes(texts: DataFrame, words_per_shingle: int, common: np.ndarray) -> DataFrame:
    """(node, n, shingles) of the distinct texts of (node, text): the number of shingles and those that go into lists."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        for node, text in texts:
            found = shingles(text, words_per_shingle)
            yield node, len(found), _prefix(found, common).view(np.int64)

    return map_rows(texts.select("node", F.col("text").cast("binary")), schema, rows, size=512).dropDuplicates(["node"])


def _long_lists(texts: DataFrame, words_per_shingle: int, long_list: int) -> np.ndarray:
    """The shingles of most texts, sorted.

    Any order gives the same links, so a count may miss some: a task counts stretches and leaves out what it saw once in one.
    """
    schema = T.StructType([T.StructField("shingle", T.LongType()), T.StructField("n", T.LongType())])

    def counted(held: list[np.ndarray]) -> Iterator[tuple]:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        often = n > 1
        yield from zip(values[often].view(np.int64).tolist(), n[often].tolist(), strict=True)

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        held, size = [], 0
        for (text,) in texts:
            held.append(shingles(text, words_per_shingle))
            size += len(held[-1])
            if size > COUNT_AT_ONCE:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    sizes = map_rows(texts.select(F.col("text").cast("binary")), schema, rows).groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > long_list)
    top = sizes.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).select("shingle").collect()
    return np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))


def _possible(n: Column, m: Column, at: Column, at_m: Column) -> Column:
    """Whether sets of n and m shingles, of which the first common ones stand at these places, can have similarity 4/5."""
    return 9 * F.least(n - at, m - at_m) >= 4 * (n + m)


def verified(pairs: DataFrame, texts: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """The pairs (a, b) whose texts, of (node, text), have similarity 4/5 or more.

    Pairs are compared in their blocks (x, y), if they have these columns, else with others of the same a.
    """
    if "x" not in pairs.columns:
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        pairs = pairs.join(parts.hint("merge"), "a").select("a", "b", F.col("a").alias("x"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("y"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.col("x").alias("of_x"), F.col("y").alias("of_y")).distinct()
    held = texts.select("node", F.col("text").cast("binary").alias("text")).dropDuplicates(["node"]).join(needed.hint("merge"), "node")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(asked: pa.Table, known: pa.Table) -> pa.Table:
        a, b = (asked.column(c).to_numpy() for c in "ab")
        used = dict.fromkeys([*a.tolist(), *b.tolist()])
        for node, text in zip(known.column("node").to_pylist(), known.column("text"), strict=True):
            if node in used:
                used[node] = shingles(text.as_py(), words_per_shingle)
        good = np.zeros(len(a), bool)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            u, v = used[i], used[j]
            if u is not None and v is not None and 9 * min(len(u), len(v)) >= 4 * (len(u) + len(v)):
                good[k] = 9 * len(np.intersect1d(u, v, assume_unique=True)) >= 4 * (len(u) + len(v))
        return pa.Table.from_arrays([pa.array(a[good]), pa.array(b[good])], schema=out)

    return pairs.groupBy("x", "y").cogroup(held.groupBy("of_x", "of_y")).applyInArrow(compare, "a long, b long")


def simhash_candidates(texts: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """Pairs (a, b) of texts of (node, text) whose fingerprints differ in at most two bits: of a group of equal fingerprints its
    first text with each other one, of two groups their first texts."""
    marks = materialize(simhash.fingerprints(texts, "node", "text", words_per_shingle).withColumnRenamed("doc_id", "node").distinct(), "fingerprints")
    groups = marks.groupBy("fp").agg(F.min("node").alias("first"))
    same = marks.join(groups.hint("merge"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = [groups.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab"]
    near = simhash.links(groups.select("fp")).join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b")
    return same.union(near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))).distinct()


def links(texts: DataFrame, words_per_shingle: int = 5, long_list: int = LONG_LIST) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the texts of (node, text) with similarity 4/5 or more."""
    spark = texts.sparkSession
    seeds, seeds_path = stored(simhash_candidates(texts, words_per_shingle), "seeds")
    linked = materialize(verified(seeds, texts, words_per_shingle), "links")
    common = _long_lists(texts, words_per_shingle, long_list)
    order = Window.partitionBy("shingle").orderBy("n", "node")
    postings = _prefixes(texts, words_per_shingle, common).select("node", "n", F.posexplode("shingles").alias("at", "shingle"))
    listed, listed_path = stored(
        postings.withColumn("before", F.lag(F.struct("node", "n", "at")).over(order)).withColumn("after", F.lead("node").over(order))
        .withColumn("place", F.row_number().over(order))
        .where("before is not null or after is not null").drop("after"),
        "postings",
    )
    near = listed.where("before is not null").where(_possible(F.col("n"), F.col("before.n"), F.col("at"), F.col("before.at")))
    block = F.min(F.struct(F.col("shingle").alias("x"), F.floor(F.col("place") / BLOCK).alias("y"))).alias("block")
    pairs = near.groupBy(F.least("node", "before.node").alias("a"), F.greatest("node", "before.node").alias("b")).agg(block)
    pairs, pairs_path = stored(pairs.select("a", "b", "block.*").join(seeds.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    linked = linked.union(materialize(verified(pairs, texts, words_per_shingle), "links"))

    roots = components(linked)
    named = listed.drop("before", "place").join(roots.hint("merge"), "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    rows, compared, more = _grown(named, pairs.select("a", "b").union(seeds), texts, words_per_shingle)
    for part in more:
        linked = linked.union(part)
    rest, rest_path = stored(_across_classes(rows).join(compared.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    for path in (listed_path, pairs_path, seeds_path):
        drop(spark, path)
    if not rest.isEmpty():
        linked = linked.union(materialize(verified(rest, texts, words_per_shingle), "links"))
    drop(spark, rest_path)
    return linked


def _grown(named: DataFrame, compared: DataFrame, texts: DataFrame, words_per_shingle: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The members of lists of several classes, with the classes after some rounds, all compared pairs, and the new links."""
    found: list[DataFrame] = []
    rows, path = named, None
    for k in range(ROUNDS + 1):
        several = rows.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("shingle")
        before = path
        rows, path = stored(rows.join(several.hint("merge"), "shingle", "left_semi"), "mixed")
        if before:
            drop(rows.sparkSession, before)
        if k == ROUNDS or _few_pairs(rows):
            break
        meetings = MEETINGS << k
        order = Window.partitionBy("shingle").orderBy(F.xxhash64("node", F.lit(k)), "node")
        met = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= meetings)
        met = met.select("shingle", F.struct("node", "n", "at", "class").alias("other"))
        sizes = rows.groupBy("shingle", "class").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("shingle").agg(F.max_by("class", F.struct("size", "class")).alias("largest"))
        small = rows.join(largest.hint("merge"), "shingle").where("class <> largest").drop("largest")
        near = small.join(met.hint("merge"), "shingle").where((F.col("other.class") != F.col("class")) & _possible(F.col("n"), F.col("other.n"), F.col("at"), F.col("other.at")))
        near = near.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b"), "class").distinct()
        few = Window.partitionBy("class").orderBy(F.xxhash64("a", "b", F.lit(k)), "a", "b")
        near = near.join(compared.hint("merge"), ["a", "b"], "left_anti").withColumn("k", F.row_number().over(few))
        near = near.where(F.col("k") <= meetings).select("a", "b").distinct()
        near = materialize(near, "pairs")
        if near.isEmpty():
            break
        compared = compared.union(near)
        new = materialize(verified(near, texts, words_per_shingle), "links")
        if new.isEmpty():
            continue
        found.append(new)
        of = rows.select("node", "class").distinct()
        ends = [of.select(F.col("node").alias(x), F.col("class").alias(f"class_{x}")) for x in "ab"]
        roots = components(new.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").select("class_a", "class_b"))
        rows = rows.join(roots.hint("merge"), F.col("class") == roots["node"], "left").select(rows["node"], "n", "at", "shingle", F.coalesce("root", "class").alias("class"))
    return rows, compared, found


def _few_pairs(rows: DataFrame) -> bool:
    """Whether all pairs of members of different classes that share a list are at most FEW_PAIRS for each member."""
    sizes = rows.groupBy("shingle", "class").agg(F.count("*").cast("double").alias("n"))
    lists = sizes.groupBy("shingle").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    members, pairs = lists.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2)).first()
    return (pairs or 0) <= FEW_PAIRS * (members or 0)


def _across_classes(named: DataFrame) -> DataFrame:
    """Pairs (a, b) of (node, n, at, shingle, class) that are in one list and different classes, and whose sizes and places allow a link.

    Kinds of members (size and place) are paired first: where none can have a link with another, as in lists of many texts that
    share a passage and little else, no member is paired.
    """
    rows = named
    kinds = rows.groupBy("shingle", "n", "at").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    other = kinds.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("n", "at", "low", "high")])
    differ = (F.col("low") < F.col("high")) | (F.col("low_b") < F.col("high_b")) | (F.col("low") != F.col("low_b"))
    first = F.struct("n", "at") <= F.struct(F.col("n_b").alias("n"), F.col("at_b").alias("at"))
    able = kinds.join(other.hint("merge"), "shingle").where(first & differ & _possible(F.col("n"), F.col("n_b"), F.col("at"), F.col("at_b")))
    able = able.select("shingle", "n", "at", "n_b", "at_b")
    classes = rows.select("shingle", "n", "at", "class").distinct()
    classes_b = classes.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("n", "at", "class")])
    met = able.join(classes.hint("merge"), ["shingle", "n", "at"]).join(classes_b.hint("merge"), ["shingle", "n_b", "at_b"]).where("class <> class_b")
    rows_b = rows.select("shingle", F.col("node").alias("other"), *[F.col(c).alias(f"{c}_b") for c in ("n", "at", "class")])
    both = met.join(rows.hint("merge"), ["shingle", "n", "at", "class"]).join(rows_b.hint("merge"), ["shingle", "n_b", "at_b", "class_b"])
    return both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, long_list: int = LONG_LIST) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id reachable over pairs of similarity 4/5 or more; fp is the text's hash.

    Ids and rows are treated as in SimHash: equal texts are one node, texts without words are equal.
    """
    keyed = _keyed(docs, id_col, text_col)
    marks = materialize(keyed.select("doc_id", F.col("node").alias("fp")), "texts")
    return classes_of(marks, links(keyed.select("node", "text"), words_per_shingle, long_list))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, one for each class of near copies: that with the smallest id."""
    return stay_of_each(docs, near_copies(docs, id_col, **options), id_col)
