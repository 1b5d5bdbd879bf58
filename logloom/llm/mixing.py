"""Mixing sources to target weights along a time-varying curriculum.

How much: every source gets its share of all words by weight, at most `most_times` its own size; what is above is shared
again by weight. A document is taken as often as its source's target holds whole passes, and once more if it lies in the
part of the source, in an order fixed by the ids, that the rest of the target covers.

When: a source has a schedule of weights over training time 0..1, piecewise linear. Its integral is the share of the
source's words that is due by a time; a document's cumulative words in its source, as a share of what the source gives,
are put through the inverse of the integral, which is the document's position. Positions of all sources interleave, and a
range sort by position is the training order.

No source is one task's job: words are summed in slices of the id order inside a source, and only the sums of the slices
meet in a window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import WORD, materialize, table

Schedule = tuple[tuple[float, float], ...]

#: Weight over time of the first, second and third source of a cycle: late, steady, early.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = 3, share: float = 1.0) -> DataFrame:
    """(source, kind, source_size, target) per source from (source, source_size).

    Sources weigh `weights` in turn by code point, null last; `kind` is the index of the weight. Targets are the sources'
    shares of `share` of all words by weight, none above `most_times` its source's size.
    """
    spread = materialize(
        sizes.select("source", F.col("source_size").cast("long").alias("source_size"))
        .repartitionByRange(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id()),
        "sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    in_part = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    kind = ((F.col("ahead") + F.col("in_part") - 1) % len(weights)).cast("int")
    ranked = materialize(
        spread.withColumn("in_part", in_part)
        .join(parts, "part")
        .select("source", "source_size", kind.alias("kind"), F.element_at(F.array(*map(F.lit, weights)), kind + 1).alias("weight")),
        "ranked_sources",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    full, level = F.lit(False), None
    while True:  # each round fills at least one source more, in practice a few rounds
        row = ranked.agg(
            F.sum(F.when(full, F.col("source_size") * most_times).otherwise(0)).alias("filled"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row or not row["open"]:
            break
        now = (total * share - row["filled"]) / row["open"]
        if now == level:
            break
        level = now
        full = F.col("weight") * F.lit(level) > F.col("source_size") * most_times
    capped = F.col("source_size") * F.lit(float(most_times))
    target = capped if level is None else F.least(capped, F.col("weight") * F.lit(level))
    return ranked.select("source", "kind", "source_size", target.alias("target"))


def inverse_integral(schedule: Schedule, share: Column) -> Column:
    """Time by which `share` (0..1) of the integral of a piecewise linear schedule is due."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, done, pieces = sum(areas), 0.0, []
    for (a, b), area in zip(zip(schedule, schedule[1:], strict=False), areas, strict=True):
        slope = (b[1] - a[1]) / (b[0] - a[0])
        due = share * F.lit(whole) - F.lit(done)
        at = F.lit(a[0]) + due * 2 / (F.lit(a[1]) + F.sqrt(F.greatest(F.lit(0.0), F.lit(a[1] * a[1]) + due * (2 * slope))))
        done += area
        pieces.append((done, at))
    out = pieces[-1][1]
    for upto, at in reversed(pieces[:-1]):
        out = F.when(share * F.lit(whole) < F.lit(upto), at).otherwise(out)
    return out


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most_times: int = 3,
    share: float = 1.0,
    curriculum: tuple[Schedule, ...] = CURRICULUM,
    id_col: str = "doc_id",
    rows_per_slice: int = 2000,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, position, positions) of every row, sorted by position.

    size: words of the text (null: 0); taken: copies times size, at most most_times * size; position: training time 0..1 of
    the first copy, the time at the end of its source's schedule if no copy is taken; positions: those of all copies, one in each
    pass over the source. Words taken from a source differ from
    its target by half a document at most. Rows of one id are ordered by size; equal rows are interchangeable. The order
    inside a source is that of md5(id), so reruns agree and the table's order does not matter.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("order"),
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = materialize(targets(sizes, weights, most_times, share), "targets")
    largest = sizes.agg(F.max("n")).first()[0] or 1
    digits = max(1, min(8, math.ceil(math.log(max(2, largest / rows_per_slice), 16))))  # of the order, so any slice is small

    sliced = rows.withColumn("slice", F.substring("order", 1, digits))
    by_source = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        sliced.groupBy("source", "slice")
        .agg(F.sum("size").alias("words"))
        .select("source", "slice", F.coalesce(F.sum("words").over(by_source), F.lit(0)).alias("ahead"))
        .join(goal.select(F.col("source").alias("of"), "kind", "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumnsRenamed({"source": "of", "slice": "part"})
    )
    in_slice = Window.partitionBy("source", "slice").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.col("ahead") + F.coalesce(F.sum("size").over(in_slice), F.lit(0))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = (
        sliced.join(ahead, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("part")))
        .withColumn("begun", begun)
        .withColumn("passes", passes)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    )
    copies = F.col("passes") + F.when((F.col("passes") < most_times) & (F.col("begun") * 2 + F.col("size") <= F.col("rest") * 2), 1).otherwise(0)
    due = F.when(F.col("target") > 0, F.least(F.lit(1.0), F.col("begun") / F.col("target"))).otherwise(F.lit(1.0))

    def time_of(due: Column) -> Column:
        at = F.lit(None).cast("double")
        for k in range(len(weights)):
            at = F.when(F.col("kind") == k, inverse_integral(curriculum[k % len(curriculum)], due)).otherwise(at)
        return at

    numbers = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    dues = F.transform(numbers, lambda p: F.least(F.lit(1.0), (p * F.col("source_size") + F.col("begun")) / F.col("target")))
    out = (
        placed.withColumn("copies", copies)
        .withColumn("due", due)
        .select(
            "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"),
            (F.col("copies") * F.col("size")).cast("long").alias("taken"), time_of(F.col("due")).alias("position"),
            F.transform(dues, time_of).alias("positions"),
        )
    )
    # documents that are not taken share one position; the id divides them
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "size")


def take(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, as often as the mix takes them, with copies, taken (of all copies) and position of each, sorted by position.

    Columns of `docs` of these three names give way. Rows without words are never taken. Rows of one id are one document.
    """
    new = ("copies", "taken", "position")
    marks = mix(docs, id_col=id_col, **options).where("taken > 0").groupBy(F.col("doc_id").alias("__id"))
    marks = marks.agg(F.max("copies").alias("copies"), F.max("taken").alias("taken"), F.max_by("positions", F.struct("copies", "taken", -F.col("position"))).alias("positions"))
    marks = marks.select("__id", "copies", "taken", F.explode("positions").alias("position"))
    out = docs.drop(*new).join(marks, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    return out.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Words taken of every document, and the places in the curriculum of its first, second and third copy."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("*", *[F.get("positions", F.lit(k - 1)).alias(f"position_{k}") for k in (2, 3)]).drop("source", "positions")


def _time_sql(due: str) -> str:
    """The inverse of the schedules' integrals in SQL."""
    return f"""CASE kind
         WHEN 0 THEN 0.0::DOUBLE + {due} * 2 / (0.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + {due} * 2.0::DOUBLE)))
         WHEN 1 THEN 0.0::DOUBLE + {due} * 2 / (1.0::DOUBLE + sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE + {due} * 0.0::DOUBLE)))
         ELSE CASE WHEN {due} < 0.625::DOUBLE
           THEN 0.0::DOUBLE + {due} * 2 / (1.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE + {due} * -2.0::DOUBLE)))
           ELSE 0.5::DOUBLE + ({due} - 0.625::DOUBLE) * 2 / (1.0::DOUBLE + sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE + ({due} - 0.625::DOUBLE) * -2.0::DOUBLE)))
         END END"""


SQL = rf"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents
), z AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 AS kind
  FROM s GROUP BY source
), w AS (
  SELECT *, kind + 1 AS weight, 3 * source_size AS cap, 3.0::DOUBLE * source_size / (kind + 1) AS brim FROM z
), o AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY brim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below,
         (sum(weight) OVER (ORDER BY brim, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open
  FROM w
), l AS (
  SELECT max((total - below) / open) AS level FROM o WHERE brim >= (total - below) / open
), g AS (
  SELECT source, kind, source_size, coalesce(least(3.0::DOUBLE * source_size, weight * level), 3.0::DOUBLE * source_size) AS target FROM w, l
), b AS (
  SELECT s.*, kind, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS begun,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, passes + CASE WHEN passes < 3 AND begun * 2 + size <= (target - passes * source_size) * 2 THEN 1 ELSE 0 END AS copies,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, begun / target) ELSE 1.0::DOUBLE END AS due,
         least(1.0::DOUBLE, (1 * source_size + begun) / target) AS due_2, least(1.0::DOUBLE, (2 * source_size + begun) / target) AS due_3
  FROM b
)
SELECT doc_id, size, source_size, target, copies::INT AS copies, (copies * size)::BIGINT AS taken,
       {_time_sql('due')} AS position, CASE WHEN copies >= 2 THEN {_time_sql('due_2')} END AS position_2,
       CASE WHEN copies >= 3 THEN {_time_sql('due_3')} END AS position_3
FROM c
"""
