"""Line de-duplication over a log-template tree, in DataFrame functions only.

He et al., "Drain: An Online Log Parsing Approach with Fixed Depth Tree", ICWS 2017. A line descends a tree of fixed depth:
first by its number of tokens, then by its leading tokens. Tokens that hold a digit or @ are variable fields and are masked
on the way. Inside a leaf the remaining tokens are cut into `fields` fields of equal width; a template is a leaf with one
field left open, so it covers all lines of the leaf that differ within that field only, and a line has as many templates as
fields. A template recurs if lines of two or more documents have it.

The original assigns lines to templates one after another, which makes results depend on the order and puts a leaf into one
task; templates that are computed from the line alone need one aggregation over all lines instead, with partial sums
before the shuffle, and a template that holds a third of all lines is one row of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import let
from logloom.llm.common import materialize, table


def tokens_of(line: Column) -> Column:
    """Tokens between white space of ASCII, variable fields masked."""
    masked = F.when(
        line.rlike("[0-9@]"), F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*", "<*>")
    ).otherwise(line)  # the test is cheap, the replacement is not
    spaced = F.when(masked.rlike(r"[\x09-\x0D]"), F.translate(masked, "\t\x0b\x0c\r", "    ")).otherwise(masked)
    return F.array_remove(F.split(spaced, " "), "")


def templates_of(tokens: Column, depth: int, fields: int) -> Column:
    """The templates of a token array: an array of structs of the number of tokens and two hashes, 128 bits in all.

    Every token is hashed once, in its field; a template combines the hashes of the fields that it does not leave open.
    """

    def combined(n: Column, hashes: Column) -> Column:
        out = []
        for k in range(fields):
            parts = [n, F.lit(k), *(F.get(hashes, F.lit(j)) for j in range(fields + 1) if j != k + 1)]
            out.append(F.struct(n.alias("n"), F.xxhash64(*parts).alias("t1"), F.xxhash64(F.lit("second"), *parts).alias("t2")))
        return F.array(*out)

    n = F.size(tokens)
    width = F.ceil(F.greatest(n - depth, F.lit(0)) / fields).cast("int")
    pieces = [F.xxhash64(F.slice(tokens, 1, depth))]
    pieces += [F.xxhash64(F.slice(tokens, F.lit(depth + 1) + width * k, width)) for k in range(fields)]
    return let(F.array(*pieces), lambda hashes: combined(n, hashes))


def closed_template_of(tokens: Column) -> Column:
    """The template of a token array without an open field."""
    parts = [F.size(tokens), F.lit(-1), tokens]
    return F.struct(F.size(tokens).alias("n"), F.xxhash64(*parts).alias("t1"), F.xxhash64(F.lit("second"), *parts).alias("t2"))


def drop_recurring_lines(
    docs: DataFrame,
    depth: int = 2,
    fields: int = 4,
    min_tokens: int = 5,
    keep_whole_above: float = 1.0,
    only_copies: bool = False,
    short_lines: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`docs` with the same columns and rows, recurring lines removed from the text, and three columns more.

    A line is dropped if one of its templates occurs in a document with a smaller id: the document with the smallest id keeps
    its lines, and lines that recur inside one document only stay. Lines of fewer than `min_tokens` tokens are always
    kept; with `short_lines` they are dropped like others, but have one template only, without an open field, and lines without
    tokens are kept. A document that would lose more than the share `keep_whole_above` of its words is left whole; at 1 there is no
    such document. With less it leaves copies of whole documents, which are no boilerplate, to the near-duplicate stage. With
    `only_copies` such a document is left whole only if it is a copy: its text and that of the document in which most words of
    its recurring lines were first seen are equal, or near copies of each other.

    __n_lines: lines of the text; __n_dropped: lines dropped; __n_recurring: lines that recur in an earlier document.
    A null text stays null and has no lines, an empty text has one empty line. Null ids count as one document before all
    others. Rows with one id and one text get the same result, rows with one id and different texts are parts of one document.
    """
    lines = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(text_col).alias("of"),
        F.posexplode(F.split(text_col, "\n")).alias("line", "body"),
    )

    def found_by(tokens: Column) -> Column:
        long = F.when(F.size(tokens) >= min_tokens, templates_of(tokens, depth, fields))
        return long.when(F.size(tokens) > 0, F.array(closed_template_of(tokens))) if short_lines else long

    # let: the tokens are computed once, not once for each of their uses
    found_in = let(tokens_of(F.col("body")), found_by)
    # written: the templates are read twice and cost more to find than to read
    held = materialize(lines.select("doc", "of", "line", found_in.alias("templates")).where(F.col("templates").isNotNull()), "templates")
    index = held.select("doc", "of", "line", F.explode("templates").alias("t")).select("doc", "of", "line", "t.n", "t.t1", "t.t2")
    recurring = index.groupBy("t1", "t2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    found = index.join(recurring, ["t1", "t2"]).where("doc > first").groupBy("doc", "of", "line")
    keys = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.xxhash64(text_col)]
    by_row = [F.col("doc").alias("__doc"), F.col("of").alias("__of")]
    if only_copies:
        # per document in which the lines were first seen, then of all of them the one with most words
        per = found.agg(F.first("n").alias("n"), F.min("first").alias("first")).groupBy("doc", "of", "first")
        per = per.agg(F.collect_list("line").alias("lines"), F.sum("n").alias("n"))
        lost = per.groupBy(*by_row).agg(
            F.flatten(F.collect_list("lines")).alias("__lost"), F.sum("n").alias("__lost_words"),
            F.max_by("first", F.struct("n", -F.col("first"))).alias("__first"),
        )
        lost = _with_copies(docs.select(keys[0].alias("doc"), keys[1].alias("of"), F.col(text_col).alias("text")), materialize(lost, "lost"), keep_whole_above)
    else:
        lost = found.agg(F.first("n").alias("n")).groupBy(*by_row).agg(F.collect_list("line").alias("__lost"), F.sum("n").alias("__lost_words"))

    joined = docs.join(lost, (keys[0] == F.col("__doc")) & (keys[1] == F.col("__of")), "left")
    dropping = F.col("__lost").isNotNull()
    if only_copies:
        dropping = dropping & ~F.col("__copy")
    elif keep_whole_above < 1:
        dropping = dropping & (F.col("__lost_words") <= F.lit(keep_whole_above) * _words(F.col(text_col)))
    kept = _without(F.col(text_col), F.col("__lost"))
    return joined.withColumn("__drop", dropping).select(
        *[F.when(F.col("__drop"), kept).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.greatest(F.size(F.split(text_col, "\n")), F.lit(0)).alias("__n_lines"),
        F.when(F.col("__drop"), F.size("__lost")).otherwise(0).alias("__n_dropped"),
        F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")).alias("__n_recurring"),
    )


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda t: t != ""))


def _alike(pairs: DataFrame, texts: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """The pairs (a, b) whose texts, of (node, text), have five-word shingles of Jaccard similarity 4/5 or more."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda t: t != "")

    def shingled(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (words_per_shingle - 1)))
        return F.array_distinct(F.transform(starts, lambda k: F.xxhash64(F.slice(w, k, words_per_shingle))))

    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = texts.join(needed, "node", "left_semi").dropDuplicates(["node"]).select("node", let(words, shingled).alias("shingles"))
    held = materialize(held, "shingles")
    a, b = (held.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(a, "a").join(b, "b").where(9 * both >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def _with_copies(texts: DataFrame, lost: DataFrame, share: float) -> DataFrame:
    """`lost` with __copy: whether the text loses over `share` of its words and is a near copy of one of the document __first."""
    own = (F.col("doc") == F.col("__doc")) & (F.col("of") == F.col("__of"))
    heavy = texts.join(lost.drop("__lost"), own).where(F.col("__lost_words") > F.lit(share) * _words(F.col("text")))
    heavy = heavy.select("__doc", "__of", "__first").distinct()
    firsts = texts.select(F.col("doc").alias("__first"), F.col("of").alias("origin")).distinct()
    pairs = materialize(heavy.join(firsts, "__first").select("__doc", "__of", "origin"), "pairs")
    unequal = pairs.where("__of <> origin").select(F.least("__of", "origin").alias("a"), F.greatest("__of", "origin").alias("b")).distinct()
    near = _alike(unequal, texts.select(F.col("of").alias("node"), "text")).withColumn("near", F.lit(True))
    ends = (F.least("__of", "origin") == F.col("a")) & (F.greatest("__of", "origin") == F.col("b"))
    copies = pairs.join(near, ends, "left").where("__of = origin or near").select("__doc", "__of", F.lit(True).alias("__copy")).distinct()
    return lost.join(copies, ["__doc", "__of"], "left").withColumn("__copy", F.coalesce("__copy", F.lit(False)))


def _without(text: Column, lost: Column) -> Column:
    """The text without the lines numbered in `lost`."""

    def chosen(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")

    # the outer transform binds the split lines once
    return F.get(F.transform(F.array(F.split(text, "\n")), chosen), F.lit(0))


def op8_line_templates(spark, sf_dir: str) -> DataFrame:
    """What the line de-duplication leaves of every document, every recurring line dropped."""
    out = drop_recurring_lines(table(spark, sf_dir, "documents"), short_lines=True)
    return out.select(
        "doc_id",
        F.col("__n_lines").cast("long").alias("n_lines"),
        F.col("__n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


SQL = r"""
WITH l AS (
  SELECT coalesce(doc_id, -9223372036854775808) AS doc, hash(text) AS of, unnest(string_split(text, chr(10))) AS body,
         unnest(range(len(string_split(text, chr(10))))) AS line
  FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT doc, of, line,
         list_filter(regexp_split_to_array(regexp_replace(body, '[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'),
                     lambda x: x <> '') AS tokens
  FROM l
), w AS (
  SELECT *, len(tokens) AS n, ceil(greatest(len(tokens) - 2, 0) / 4.0)::BIGINT AS width FROM t WHERE len(tokens) >= 5
), i AS (
  SELECT doc, of, line, n, k, array_to_string(tokens[1:least(n, 2 + width * k)], chr(9)) AS a,
         array_to_string(tokens[3 + width * (k + 1):], chr(9)) AS b
  FROM w, range(4) r(k)
  UNION ALL
  SELECT doc, of, line, len(tokens), -1, array_to_string(tokens, chr(9)), '' FROM t WHERE len(tokens) BETWEEN 1 AND 4
), r AS (
  SELECT n, k, a, b, min(doc) AS first FROM i GROUP BY ALL HAVING min(doc) < max(doc)
), f AS (
  SELECT DISTINCT doc, of, line FROM i JOIN r USING (n, k, a, b) WHERE doc > first
), lost AS (
  SELECT doc, of, list(line) AS lines FROM f GROUP BY ALL
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(lost.lines), 0)::BIGINT AS n_dropped,
       sha256(coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, j: lost.lines IS NULL OR NOT list_contains(lost.lines, j - 1)), chr(10)), '')) AS text_sha256
FROM documents d LEFT JOIN lost ON coalesce(d.doc_id, -9223372036854775808) = lost.doc AND hash(d.text) = lost.of
"""
