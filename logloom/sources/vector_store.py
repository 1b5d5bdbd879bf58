"""The vector table on storage: cells inside days, changes beside the base, resolved at read.

    snapshots/N                  one row: what of the changes is folded in, probes, schema, the generation of every day
    centroids                    (cell, centroid), trained once; later vectors go to these cells
    base/gen=G/day=D/cell=C      records, written by day and cell in files of a bounded number of rows
    changes/N-rows               upserts and tombstones of one call, N is its place in the order of all calls
    changes/N-expire-MICROS      a retention limit: records older than it, written before it, are gone
    claims/N, calls/TOKEN        who took a place in the order, and which calls were made

A read joins the base against the newest change of every id, nothing is rewritten for it. `compact` folds the changes in and
rewrites the days they touch only; days that a limit passed whole are dropped without being read. A call with a token
that was made before changes nothing, so a batch repeated after a failure is safe. A change is visible once its folder is
complete; a snapshot likewise. Files that no snapshot needs stay until `vacuum`.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.ingest_filter import COLUMN_LIMITS, check_column_limits, validate_records
from logloom.operators.knn import knn, train_cells
from logloom.session import new_table_path

#: Cells at most, vectors that train a cell, rows of a file, and queries that the probes are measured with.
MOST_CELLS, TRAIN_ROWS, FILE_ROWS, MEASURE_QUERIES = 4096, 256, 200_000, 100
#: Share of the true neighbours that the probed cells of the measured queries must hold.
TARGET = 0.95
META = ("day", "cell", "dist")
_SNAPSHOT = "folded long, n_probe int, schema string, days array<struct<day: date, gen: int>>"


@dataclass(frozen=True)
class Snapshot:
    """What a read starts from."""

    number: int
    folded: int
    n_probe: int
    schema: T.StructType
    days: dict[dt.date, int] = field(default_factory=dict)


# --- files of the store -----------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, where = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def _create(spark: SparkSession, path: str, text: str = "") -> bool:
    """Make a file that must be new; whether it was."""
    fs, where = _fs(spark, path)
    try:
        out = fs.create(where, False)
    except Exception:  # the file system says in its own words that the file is there
        if fs.exists(where):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    source = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The newest complete snapshot."""
    for name in reversed(_names(spark, f"{path}/snapshots")):
        if _exists(spark, f"{path}/snapshots/{name}/_SUCCESS"):
            row = spark.read.schema(_SNAPSHOT).parquet(f"{path}/snapshots/{name}").first()
            schema = T.StructType.fromJson(json.loads(row["schema"]))
            return Snapshot(int(name), row["folded"], row["n_probe"], schema, {d["day"]: d["gen"] for d in row["days"]})
    raise FileNotFoundError(f"no vector store in {path}")


def _write_snapshot(spark: SparkSession, path: str, snap: Snapshot) -> Snapshot:
    row = (snap.folded, snap.n_probe, snap.schema.json(), sorted(snap.days.items()))
    spark.createDataFrame([row], _SNAPSHOT).coalesce(1).write.parquet(f"{path}/snapshots/{snap.number:012d}")  # must be new
    return snap


def centroids(spark: SparkSession, path: str) -> np.ndarray:
    """The centre of every cell, in order; at most MOST_CELLS."""
    rows = spark.read.schema("cell int, centroid array<double>").parquet(f"{path}/centroids").collect()
    return np.array([r["centroid"] for r in sorted(rows)], np.float64)


# --- rows -------------------------------------------------------------------------------------------------------------


def cells_for(rows: int) -> int:
    """Cells of a table: half the root of its rows."""
    return max(1, min(MOST_CELLS, round(math.sqrt(rows) / 2)))


def checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete records within the column limits, and the others with the reason in `error`."""
    as_text = rows.withColumn("__id", F.col("id")).withColumn("id", F.col("id").cast("string"))
    marked = validate_records(as_text).withColumn("id", F.col("__id")).drop("__id")
    for c in [c for c in COLUMN_LIMITS if c not in rows.columns]:
        marked = marked.withColumn(c, F.lit(None).cast("string"))
    marked = check_column_limits(marked)
    limit = F.when(F.size("too_long") > 0, F.concat(F.lit("too long: "), F.array_join("too_long", ", ")))
    empty = F.when(F.exists("vector", lambda x: x.isNull() | F.isnan(x)), "record vector has no number")
    no_time = F.when(F.col("ts").isNull(), "record time is required")
    marked = marked.withColumn("error", F.coalesce("error", no_time, empty, limit)).select(*rows.columns, "error")
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add the day, the nearest cell and the distance to its centre; times are cut to milliseconds, as the table keeps them."""
    norm = (centres * centres).sum(axis=1)

    @F.pandas_udf("cell int, dist double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        cell, dist = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        for at in range(0, len(vectors), 1024):
            m = np.stack(vectors.iloc[at : at + 1024].to_numpy()).astype(np.float64)
            near = np.argmin(norm - 2 * (m @ centres.T), axis=1) if len(centres) > 1 else np.zeros(len(m), int)
            cell[at : at + 1024] = near
            dist[at : at + 1024] = np.sqrt(((m - centres[near]) ** 2).sum(axis=1))
        return pd.DataFrame({"cell": cell, "dist": dist})

    out = rows.withColumn("ts", F.timestamp_millis(F.unix_millis("ts"))).withColumn("__at", place("vector"))
    return out.select(*rows.columns, F.to_date("ts").alias("day"), F.col("__at.cell").alias("cell"), F.col("__at.dist").alias("dist"))


def _last_of_each(rows: DataFrame) -> DataFrame:
    """One row for an id: the latest, of equal times that with the greatest hash; repeats go before the shuffle."""
    order = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc(F.xxhash64(*[c for c in rows.columns if not isinstance(rows.schema[c].dataType, T.MapType)])))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def _written(rows: DataFrame) -> tuple[DataFrame, str]:
    """The rows, computed once for several reads, and the table of the shared folder that holds them."""
    where = new_table_path(rows.sparkSession, "records")
    rows.write.parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where), where


def _write_base(rows: DataFrame, path: str, gen: int) -> None:
    """Write records by day and cell; a cell of a day is cut into files of about FILE_ROWS rows."""
    files = rows.groupBy("day", "cell").agg(F.ceil(F.count("*") / FILE_ROWS).alias("__files"))
    dealt = rows.join(F.broadcast(files), ["day", "cell"]).repartition("day", "cell", F.pmod(F.xxhash64("id"), F.col("__files"))).drop("__files")
    dealt.sortWithinPartitions("day", "cell", "ts").write.mode("overwrite").partitionBy("day", "cell").parquet(f"{path}/base/gen={gen}")


def create(rows: DataFrame, path: str, n_cells: int | None = None, seed: int = 7) -> DataFrame:
    """Train the cells on `rows`, write the first snapshot, and return the rejected rows with `error`.

    rows: id, vector, ts, body and any other columns. The number of cells follows the number of rows unless it is given.
    """
    spark = rows.sparkSession
    good, rejects = checked(rows)
    good, kept = _written(_last_of_each(good))
    n = good.count()
    k = n_cells or cells_for(n)
    share = min(1.0, k * TRAIN_ROWS / max(1, n))
    sample = good.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).select("vector")
    centres = train_cells(sample, k, seed) if k > 1 and n > 1 else np.zeros((1, 1))  # a single cell has its centre at zero
    spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centroid array<double>"
    ).coalesce(1).write.parquet(f"{path}/centroids")
    _write_base(_placed(good, centres), path, 0)
    _delete(spark, kept)
    days = {r["day"]: 0 for r in _all_days(spark, path, rows.schema, 0)}
    snap = _write_snapshot(spark, path, Snapshot(0, 0, len(centres), rows.schema, days))
    if n:
        _write_snapshot(spark, path, Snapshot(1, 0, measured_probes(spark, path), snap.schema, days))
    return rejects


def _full(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())])


def _all_days(spark: SparkSession, path: str, schema: T.StructType, gen: int) -> list:
    names = [n for n in _names(spark, f"{path}/base/gen={gen}") if n.startswith("day=")]
    return [{"day": dt.date.fromisoformat(n[4:])} for n in names]


# --- changes ----------------------------------------------------------------------------------------------------------


def _claim(spark: SparkSession, path: str, token: str | None, folded: int) -> int | None:
    """The place of a call in the order of all calls; None if the call was made and is complete."""
    if token is not None and _exists(spark, f"{path}/calls/{token}"):
        n = int(_text(spark, f"{path}/calls/{token}"))
        done = n <= folded or any(c.number == n for c in _changes(spark, path, folded))
        return None if done else n  # a call that failed goes on in its place
    taken = _names(spark, f"{path}/claims")
    n = max([folded, *(int(x) for x in taken)]) + 1
    while not _create(spark, f"{path}/claims/{n:012d}"):
        n += 1
    if token is not None and not _create(spark, f"{path}/calls/{token}", str(n)):
        _fs(spark, path)[0].mkdirs(_fs(spark, f"{path}/changes/{n:012d}-none")[1])
        return _claim(spark, path, token, folded)
    return n


@dataclass(frozen=True)
class Change:
    number: int
    kind: str
    path: str
    limit: int | None = None


def _changes(spark: SparkSession, path: str, after: int) -> list[Change]:
    """The complete changes behind a place, in order."""
    out = []
    for name in _names(spark, f"{path}/changes"):
        number, kind, *more = name.split("-", 2)
        where = f"{path}/changes/{name}"
        if int(number) > after and (kind != "rows" or _exists(spark, f"{where}/_SUCCESS")):
            out.append(Change(int(number), kind, where, int(more[0]) if more else None))
    return out


def _write_change(rows: DataFrame, path: str, n: int, op: str) -> None:
    rows.withColumn("op", F.lit(op)).withColumn("seq", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{path}/changes/{n:012d}-rows")


def upsert(rows: DataFrame, path: str, token: str | None = None) -> DataFrame:
    """Put records in, in place of those with the same id; returns the rejected rows with `error`.

    Of several rows of one id the latest counts. Columns are those of the store, by name.
    """
    spark = rows.sparkSession
    snap = snapshot(spark, path)
    good, rejects = checked(rows.select(*snap.schema.names))
    n = _claim(spark, path, token, snap.folded)
    if n is not None:
        _write_change(_placed(_last_of_each(good), centroids(spark, path)), path, n, "upsert")
    return rejects


def delete(ids: DataFrame, path: str, token: str | None = None) -> None:
    """Take out the records with the listed ids (a column `id`)."""
    spark = ids.sparkSession
    snap = snapshot(spark, path)
    n = _claim(spark, path, token, snap.folded)
    if n is not None:
        gone = ids.select("id").where("id is not null").distinct()
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in _full(snap.schema) if f.name != "id"]
        _write_change(gone.select("id", *rest).select(*_full(snap.schema).names), path, n, "delete")


def expire(spark: SparkSession, path: str, before: dt.datetime, token: str | None = None) -> None:
    """Take out the records of times before a limit; records that come later stay, whatever their time. Reads no data."""
    snap = snapshot(spark, path)
    n = _claim(spark, path, token, snap.folded)
    if n is not None:
        us = (before.replace(tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
        fs, where = _fs(spark, f"{path}/changes/{n:012d}-expire-{us}")
        fs.mkdirs(where)


# --- reads ------------------------------------------------------------------------------------------------------------


def _base(spark: SparkSession, path: str, snap: Snapshot) -> DataFrame:
    schema = T.StructType([*_full(snap.schema).fields, T.StructField("gen", T.IntegerType())])
    paths = [f"{path}/base/gen={g}/day={d.isoformat()}" for d, g in sorted(snap.days.items())]
    if not paths:
        return spark.createDataFrame([], _full(snap.schema))
    return spark.read.schema(schema).option("basePath", f"{path}/base").parquet(*paths).select(*_full(snap.schema).names)


def _winners(spark: SparkSession, snap: Snapshot, changes: list[Change]) -> tuple[DataFrame, DataFrame]:
    """(id, seq) of the newest change of every id, and all rows of changes."""
    schema = T.StructType([*_full(snap.schema).fields, T.StructField("op", T.StringType()), T.StructField("seq", T.LongType())])
    rows = spark.read.schema(schema).parquet(*[c.path for c in changes])
    return rows.groupBy("id").agg(F.max("seq").alias("seq")), rows


def _in_time(ts: Column, seq: Column | int, limits: list[tuple[int, int]]) -> Column:
    """Whether no limit set after `seq` is past the time."""
    keep = F.lit(True)
    for number, us in limits:
        late = ts >= F.timestamp_micros(F.lit(us))
        keep = keep & (late if isinstance(seq, int) else ((seq > F.lit(number)) | late))
    return keep


def read(
    spark: SparkSession, path: str, since: Column | None = None, until: Column | None = None, cells: list[int] | None = None,
    meta: bool = False, upto: int | None = None, snap: Snapshot | None = None,
) -> DataFrame:
    """The records now, of a time span and of some cells; days and cells prune the folders that are read.

    meta: with day, cell and dist. upto: only the changes up to a place.
    """
    snap = snap or snapshot(spark, path)
    changes = [c for c in _changes(spark, path, snap.folded) if upto is None or c.number <= upto]

    def wanted(df: DataFrame) -> DataFrame:
        if since is not None:
            df = df.where((F.col("day") >= F.to_date(since)) & (F.col("ts") >= since))
        if until is not None:
            df = df.where((F.col("day") <= F.to_date(until)) & (F.col("ts") <= until))
        return df if cells is None else df.where(F.col("cell").isin([int(c) for c in cells]))

    limits = [(c.number, c.limit) for c in changes if c.kind == "expire"]
    out = wanted(_base(spark, path, snap))
    if limits:
        oldest = F.timestamp_micros(F.lit(max(us for _, us in limits)))
        out = out.where((F.col("day") >= F.to_date(oldest)) & _in_time(F.col("ts"), 0, limits))
    written = [c for c in changes if c.kind == "rows"]
    if written:
        newest, rows = _winners(spark, snap, written)
        out = out.join(newest.select("id"), "id", "left_anti").select(*_full(snap.schema).names)
        new = wanted(rows.where("op = 'upsert'")).join(newest, ["id", "seq"]).where(_in_time(F.col("ts"), F.col("seq"), limits))
        out = out.unionByName(new.select(*_full(snap.schema).names))
    return out if meta else out.drop(*META)


def compact(spark: SparkSession, path: str) -> Snapshot:
    """Fold the complete changes into the base and rewrite the days they touch, no other."""
    snap = snapshot(spark, path)
    changes = _changes(spark, path, snap.folded)
    done, upto = {c.number for c in changes}, snap.folded
    while upto + 1 in done:  # a call that is still being written, and what follows it, waits
        upto += 1
    changes = [c for c in changes if c.number <= upto]
    if not changes:
        return snap
    limits = [c.limit for c in changes if c.kind == "expire"]
    passed = {d for d in snap.days if limits and _micros(d + dt.timedelta(days=1)) <= max(limits)}
    live = Snapshot(snap.number, snap.folded, snap.n_probe, snap.schema, {d: g for d, g in snap.days.items() if d not in passed})
    touched: set[dt.date] = set()
    written = [c for c in changes if c.kind == "rows"]
    base = _base(spark, path, live)
    if written:
        newest, rows = _winners(spark, snap, written)
        hit = base.select("id", "day").join(newest.select("id"), "id", "left_semi").select("day")
        touched |= {r["day"] for r in hit.union(rows.where("op = 'upsert'").select("day")).distinct().collect()}  # days are few
    if limits:
        edge = base.where((F.col("day") == F.to_date(F.timestamp_micros(F.lit(max(limits))))) & ~_in_time(F.col("ts"), 0, [(0, max(limits))]))
        touched |= {r["day"] for r in edge.select("day").distinct().collect()}
    gen = max([-1, *(int(n[4:]) for n in _names(spark, f"{path}/base") if n.startswith("gen="))]) + 1
    days = {d: g for d, g in live.days.items() if d not in touched}
    if touched:
        part = Snapshot(snap.number, snap.folded, snap.n_probe, snap.schema, {d: g for d, g in live.days.items() if d in touched})
        rows = read(spark, path, meta=True, upto=upto, snap=part).where(F.col("day").isin(sorted(touched)))
        rows, kept = _written(rows)
        _write_base(rows, path, gen)
        _delete(spark, kept)
        days |= {r["day"]: gen for r in _all_days(spark, path, snap.schema, gen)}
    return _write_snapshot(spark, path, Snapshot(snap.number + 1, upto, snap.n_probe, snap.schema, days))


def _micros(day: dt.date) -> int:
    return (day - dt.date(1970, 1, 1)).days * 86_400_000_000


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete what the newest snapshot does not need; reads that began before it must be over. Returns what went."""
    snap = snapshot(spark, path)
    gone = [f"{path}/snapshots/{n}" for n in _names(spark, f"{path}/snapshots") if int(n) < snap.number]
    gone += [f"{path}/changes/{n}" for n in _names(spark, f"{path}/changes") if int(n[:12]) <= snap.folded]
    for g in [n for n in _names(spark, f"{path}/base") if n.startswith("gen=")]:
        days = [n for n in _names(spark, f"{path}/base/{g}") if n.startswith("day=")]
        kept = [n for n in days if snap.days.get(dt.date.fromisoformat(n[4:])) == int(g[4:])]
        gone += [f"{path}/base/{g}/{n}" for n in days if n not in kept] if kept else [f"{path}/base/{g}"]
    for p in gone:
        _delete(spark, p)
    return gone


# --- probes -----------------------------------------------------------------------------------------------------------


def probe_order(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cells of every vector, nearest first."""
    if len(centres) == 1:
        return np.zeros((len(vectors), 1), np.int64)
    return np.argsort((centres * centres).sum(axis=1) - 2 * (vectors @ centres.T), axis=1, kind="stable")


def measured_probes(spark: SparkSession, path: str, k: int = 10, target: float = TARGET, queries: int = MEASURE_QUERIES) -> int:
    """Cells that must be probed so that `target` of the true k neighbours of some stored vectors lie in them.

    The vectors are those with the smallest id hashes, at most `queries`; their neighbours are found exactly, by one scan.
    """
    rows = read(spark, path, meta=True)
    asked = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(min(queries, 250)).collect()
    if not asked:
        return 1
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query_vector", rows.schema["vector"].dataType)])
    q = spark.createDataFrame([(n, r["vector"]) for n, r in enumerate(asked)], schema)
    near = knn(q, rows.select("id", "vector"), k + 1, "l2", few=True).join(rows.select("id", "cell"), "id").collect()  # bounded
    centres = centroids(spark, path)
    order = probe_order(np.array([r["vector"] for r in asked], np.float64), centres)
    place = np.argsort(order, axis=1)
    ranks = sorted(int(place[r["query_id"], r["cell"]]) for r in near if r["id"] != asked[r["query_id"]]["id"])
    return 1 + ranks[max(0, math.ceil(target * len(ranks)) - 1)] if ranks else 1


def remeasure(spark: SparkSession, path: str, **options) -> Snapshot:
    """Measure the probes again, after many changes, and keep the new number."""
    snap = snapshot(spark, path)
    n = measured_probes(spark, path, **options)
    return _write_snapshot(spark, path, Snapshot(snap.number + 1, snap.folded, n, snap.schema, snap.days))
