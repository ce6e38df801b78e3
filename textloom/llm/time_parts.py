"""A table laid out in files by time, on a calendar that splits where rows are many.

Years, their months, days and hours are nodes. Years from the first to the last moment stand
beside each other; a node of more than ``most`` rows is split into all its months, days or
hours. Siblings of ``most`` rows or fewer, empty ones too, are joined in time order into runs
that stay within ``most``. Leaves are the runs that have rows, hours above ``most`` and all
rows without a moment. A leaf's rows, in order, fill parts of ``most`` rows, each one file.

Ranks take two levels. Rows are dealt by key range, leaf first, into sorted buckets, so a
leaf, however large, is subdivided by its key; a row's number inside its bucket is its place
there. Counts by leaf and bucket are prefix-summed (in blocks, ``running_sums``), and offset
plus number gives rank and part. No window spans a leaf. Rows are told apart by a number of
their own at last, so rows that are equal in all columns are dealt out too.

A second layout reads its leaves' counts and fingerprints first: leaves whose rows recur are
left alone, the rows of all others are ranked anew, and of these the files whose part and rows
recur stay as well. New files are written before old ones go.

What stays small: with ``most`` over a ``share``-th of the rows at most ``share`` nodes a level
exceed it, two neighbouring runs of one parent hold more than ``most`` together, and so there
are some 10 times ``share`` leaves and files at any number of rows. Their starts are all that
goes to the driver and into tasks' closures; hours are counted in a table.

Defined results: an empty table gives no file and no row. Rows without a moment form the leaf
``null``, repeated rows all stay. Rows that are equal in moment and ``order`` columns go by the
remaining columns; nulls come first, and a null id is written as nothing between its commas.
Columns may have any names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import running_sums
from .common import cut, discard, shared_folder, stored, table

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Rows of a bucket, about.
BUCKET = 500_000


def local_micros(ts: Column) -> Column:
    """Microseconds from 1970-01-01 00:00 to a timestamp's own date and time, whatever the zone of the session."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return days * DAY + F.hour(ts).cast("long") * HOUR + F.minute(ts).cast("long") * (HOUR // 60) + seconds


def whole_days(micros: Column) -> Column:
    return ((micros - F.pmod(micros, F.lit(DAY))) / DAY).cast("long")


def hour_node(micros: Column) -> Column:
    """Year, month, day and hour as one number, two digits for each but the year."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), whole_days(micros).cast("int"))
    hour = ((F.pmod(micros, F.lit(DAY)) - F.pmod(micros, F.lit(HOUR))) / HOUR).cast("long")
    return F.year(date).cast("long") * 1_000_000 + F.month(date) * 10_000 + F.dayofmonth(date) * 100 + hour


def members_of(level: int, parent: int, first: int, last: int) -> range:
    """All siblings under a parent; years have none, and reach from the first to the last with rows."""
    if level == 0:
        return range(first, last + 1)
    if level == 1:
        return range(1, 13)
    if level == 3:
        return range(24)
    month = month_of(parent // 100, parent % 100)
    return range(1, int(((month + 1).astype("M8[D]") - month.astype("M8[D]")).astype(np.int64)) + 1)


def month_of(year: int, month: int) -> np.datetime64:
    return np.datetime64(12 * (year - 1970) + month - 1, "M")


def runs_of(level: int, parent: int, rows: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(first, last, rows) in time order; a member above ``most`` stands alone."""
    out: list[tuple[int, int, int]] = []
    for member in members_of(level, parent, min(rows), max(rows)):
        n = rows.get(member, 0)
        if out and n <= most and out[-1][2] <= most and out[-1][2] + n <= most:
            out[-1] = (out[-1][0], member, out[-1][2] + n)
        else:
            out.append((member, member, n))
    return out


@dataclass(frozen=True)
class Leaf:
    name: str
    start: int  # the first microsecond; of no meaning for the leaf without moments
    rows: int


def leaf_of(level: int, parent: int, first: int, last: int, rows: int) -> Leaf:
    digits = [] if level == 0 else [f"{parent // 100 ** (level - 1):04d}", *(f"{parent // 100**k % 100:02d}" for k in range(level - 2, -1, -1))]
    width = 4 if level == 0 else 2
    year, month, day = (*(parent // 100**k % 100 if k < level - 1 else parent // 100**k for k in range(level - 1, -1, -1)), first, 1, 1)[:3]
    start = int((month_of(year, month).astype("M8[D]") + day - 1).astype("M8[us]").astype(np.int64)) + (first * HOUR if level == 3 else 0)
    return Leaf("/".join([*digits, f"{first:0{width}d}-{last:0{width}d}"]), start, rows)


def leaves_of(hours: DataFrame, most: int) -> list[Leaf]:
    """The leaves of (node, n), by time; the one without moments first. Siblings meet by parent: 31 at most, or all years."""
    nodes = hours.where("node IS NOT NULL AND n > 0").select("node", "n")
    out = []
    nulls = hours.where("node IS NULL AND n > 0").agg(F.sum("n")).first()[0]
    if nulls:
        out.append(Leaf("null", 0, nulls))
    split: DataFrame | None = None
    for level in range(4):
        at = F.floor(F.col("node") / 100 ** (3 - level)).cast("long")
        counts = nodes.groupBy(at.alias("node")).agg(F.sum("n").alias("n"))
        parent, member = (F.lit(0), F.col("node")) if level == 0 else (F.floor(F.col("node") / 100), F.pmod("node", F.lit(100)))
        counts = counts.select(parent.cast("long").alias("parent"), member.cast("int").alias("member"), "n")
        if split is not None:
            counts = counts.join(split, "parent", "left_semi")
        families = counts.groupBy("parent").agg(F.collect_list(F.struct("member", "n")).alias("members"))

        def fold(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for parent, members in zip(b.column("parent").to_pylist(), b.column("members").to_pylist(), strict=True):
                    rows += [(parent, *r) for r in runs_of(level, parent, {m["member"]: m["n"] for m in members}, most)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["parent", "first", "last", "n"])

        runs = cut(families.mapInArrow(fold, "parent long, first int, last int, n long"))
        last = level == 3
        out += [leaf_of(level, r.parent, r.first, r.last, r.n) for r in runs.where(F.lit(last) | (F.col("n") <= most)).where("n > 0").collect()]
        split = runs.where(F.col("n") > most).select((F.col("parent") * 100 + F.col("first")).cast("long").alias("parent"))
        if last or not split.limit(1).count():
            break
    return sorted(out, key=lambda leaf: (leaf.name != "null", leaf.start))


def position(values: Column, starts: list[int]) -> Column:
    """Which of the rising ``starts`` is the last that a value reaches, from 0; -1 before all."""
    bounds = np.array(starts, dtype=np.int64)

    @F.pandas_udf("int")
    def find(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, v.to_numpy(np.int64), side="right").astype(np.int32) - 1)

    return find(values)


def leaf_index(moment: Column, leaves: list[Leaf]) -> Column:
    timed = [leaf.start for leaf in leaves if leaf.name != "null"]
    skip = len(leaves) - len(timed)
    return F.when(moment.isNull(), F.lit(0)).otherwise(position(F.coalesce(moment, F.lit(0)), timed) + skip)


def marks(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row, to be added up."""
    cells = [F.col(f"`{c}`") for c in columns]
    return [F.xxhash64(*cells).cast("decimal(20,0)").alias("_mark0"), F.xxhash64(F.lit("again"), *cells).cast("decimal(20,0)").alias("_mark1")]


def id_digests(rows: DataFrame, tasks: int) -> DataFrame:
    """(file, ids_sha256) of (file, place, id), each file's ids hashed one after the other as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        done: list[tuple[int, str]] = []
        for b in batches:
            files = b.column("file").to_numpy()
            ids = ["" if x is None else str(x) for x in b.column("id").to_pylist()]
            ends = [*(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            begin = 0
            for end in ends if len(files) else []:
                more = bool(files[begin] == at)
                if not more:
                    if at is not None:
                        done.append((at, total.hexdigest()))
                    at, total = int(files[begin]), hashlib.sha256()
                total.update(("," * more + ",".join(ids[begin:end])).encode())
                begin = end
        if at is not None:
            done.append((at, total.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.string())], names=["file", "ids_sha256"])

    return rows.select("file", "place", "id").repartition(tasks, "file").sortWithinPartitions("file", "place").mapInArrow(run, "file int, ids_sha256 string")


FILES = "leaf string, part long, n_rows long, mark0 decimal(30,0), mark1 decimal(30,0), n_new long, ids_sha256 string, path string, rewritten boolean"


def lay_out(
    rows: DataFrame, moment: Column, folder: str, most: int, *, order: list[str], id_col: str, new: Column | None = None, before: DataFrame | None = None
) -> DataFrame:
    """Writes ``rows`` to ``folder`` and returns a row for each file there (``FILES``, stored).

    ``moment`` is in microseconds. With ``before``, what an earlier call returned for the same
    folder and ``most``, files that recur stay and the others of that call go.
    """
    spark = rows.sparkSession
    columns = rows.columns
    wide = rows.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)), moment.alias("_moment"), (F.lit(False) if new is None else new).alias("_new"))
    cells = [f"c{i}" for i in range(len(columns))]
    keys = ["_moment", *(cells[columns.index(c)] for c in order), *(cells[i] for i, c in enumerate(columns) if c not in order)]

    marked = wide.select(hour_node(F.col("_moment")).alias("node"), *marks(cells))
    hours = cut(marked.groupBy("node").agg(F.count("*").alias("n"), F.sum("_mark0").alias("mark0"), F.sum("_mark1").alias("mark1")))
    leaves = leaves_of(hours, most)
    if before is None:
        before = spark.createDataFrame([], FILES)
    changed = changed_leaves(hours, leaves, before)
    names = spark.createDataFrame([(i, leaf.name) for i, leaf in enumerate(leaves)], "leaf_at int, leaf string")
    untouched = before.join(names.where(~F.col("leaf_at").isin(changed)) if changed else names, "leaf", "left_semi")
    kept = untouched.withColumns({"rewritten": F.lit(False), "n_new": F.lit(0).cast("long")}).select(*before.columns)

    made = None
    if changed:
        count = sum(leaves[i].rows for i in changed)
        chosen = np.isin(np.arange(len(leaves)), changed)
        ranked = wide.withColumn("_leaf", leaf_index(F.col("_moment"), leaves))
        if not chosen.all():
            ranked = ranked.where(is_chosen(F.col("_leaf"), chosen))
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // BUCKET))
        ranked = ranked.withColumn("_own", F.monotonically_increasing_id()).repartitionByRange(buckets, "_leaf", *keys, "_own")
        ranked = ranked.sortWithinPartitions("_leaf", *keys, "_own").withColumn("place", F.monotonically_increasing_id()).drop("_own", "_moment")
        ranked, ranked_path = stored(ranked)
        made = written(ranked, ranked_path, leaves, folder, most, columns, cells[columns.index(id_col)], before)
        made = made.join(names, "leaf_at").select(*before.columns)
    files, _ = stored(made.unionByName(kept) if made is not None else kept)
    for row in before.join(files.select("path"), "path", "left_anti").select("path").collect():
        discard(spark, row.path.rpartition("/")[0])
    return files


def is_chosen(leaf: Column, chosen: np.ndarray) -> Column:
    @F.pandas_udf("boolean")
    def find(v: pd.Series) -> pd.Series:
        return pd.Series(chosen[v.to_numpy()])

    return find(leaf)


def changed_leaves(hours: DataFrame, leaves: list[Leaf], before: DataFrame) -> list[int]:
    """The leaves, by index, that no earlier leaf of the same name and rows recurs in."""
    start = F.when(F.col("node").isNotNull(), node_start(F.col("node")))
    now = hours.select(leaf_index(start, leaves).alias("leaf_at"), "n", "mark0", "mark1").groupBy("leaf_at").agg(*(F.sum(c).alias(c) for c in ("n", "mark0", "mark1")))
    then = before.groupBy("leaf").agg(F.sum("n_rows"), F.sum("mark0"), F.sum("mark1")).collect()
    known = {(r[0], r[1], int(r[2]), int(r[3])) for r in then}
    return sorted(r.leaf_at for r in now.collect() if (leaves[r.leaf_at].name, r.n, int(r.mark0), int(r.mark1)) not in known)


def node_start(node: Column) -> Column:
    """The first microsecond of an hour's node."""
    day = F.floor(node / 100)
    date = F.make_date(F.floor(node / 1_000_000).cast("int"), F.pmod(F.floor(node / 10_000), F.lit(100)).cast("int"), F.pmod(day, F.lit(100)).cast("int"))
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * DAY + F.pmod(node, F.lit(100)) * HOUR


def written(ranked: DataFrame, ranked_path: str, leaves: list[Leaf], folder: str, most: int, columns: list[str], id_cell: str, before: DataFrame) -> DataFrame:
    """The files of the ``ranked`` rows: those that recur in ``before`` as they are, the others written."""
    spark = ranked.sparkSession
    counts = ranked.groupBy(F.col("_leaf").alias("leaf_at"), F.shiftright("place", 33).alias("bucket")).agg(F.count("*").alias("n"), F.min("place").alias("lo"))
    sums = running_sums(cut(counts), ["leaf_at"], "bucket", {"upto": F.col("n")})
    # Parts (from 0) whose first row lies in the bucket, and its place there.
    parts = F.expr(f"sequence((upto - n + {most - 1}) div {most}, (upto - 1) div {most})")
    begun = sums.where(F.expr(f"(upto - n + {most - 1}) div {most} <= (upto - 1) div {most}")).select("leaf_at", "lo", (F.col("upto") - F.col("n")).alias("offset"), F.explode(parts).alias("q"))
    begun = begun.select("leaf_at", (F.col("q") + 1).alias("part"), (F.col("lo") + F.col("q") * most - F.col("offset")).alias("start"))
    found = sorted(begun.collect(), key=lambda r: r.start)
    files = spark.createDataFrame([(i, r.leaf_at, r.part, leaves[r.leaf_at].name) for i, r in enumerate(found)], "file int, leaf_at int, part long, leaf string")

    cells = [f"c{i}" for i in range(len(columns))]
    placed = ranked.withColumn("file", position(F.col("place"), [r.start for r in found]))
    sums = placed.select("file", "_new", *marks(cells)).groupBy("file")
    sums = cut(sums.agg(F.count("*").alias("n_rows"), F.sum("_mark0").alias("mark0"), F.sum("_mark1").alias("mark1"), F.count_if("_new").alias("n_new")))
    now = sums.join(files, "file")
    old = before.select("leaf", "part", "n_rows", "mark0", "mark1", F.col("ids_sha256").alias("old_ids"), F.col("path").alias("old_path"))
    now = cut(now.join(old, ["leaf", "part", "n_rows", "mark0", "mark1"], "left"))
    writes = np.zeros(len(found), dtype=bool)
    writes[[r.file for r in now.where("old_path IS NULL").select("file").collect()]] = True

    generation, name = f"layout={uuid.uuid4().hex[:12]}", "layout_file"
    while name in map(str.lower, columns):
        name += "_"
    made = None
    if writes.any():
        tasks = int(writes.sum())
        goes = placed if writes.all() else placed.where(is_chosen(F.col("file"), writes))
        # The writer keeps the order of rows that come sorted by its partition column.
        out = goes.withColumnRenamed("file", name).repartition(tasks, name).sortWithinPartitions(name, "place")
        out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), name).write.partitionBy(name).parquet(f"{folder}/{generation}")
        where = spark.read.parquet(f"{folder}/{generation}").select(F.col(name).cast("int").alias("file"), F.col("_metadata.file_path").alias("path"))
        where = where.groupBy("file").agg(F.min("path").alias("path"))
        made = cut(id_digests(goes.select("file", "place", F.col(id_cell).alias("id")), tasks).join(where, "file"))
    else:
        made = spark.createDataFrame([], "file int, ids_sha256 string, path string")
    discard(spark, ranked_path)
    fresh = F.col("old_path").isNull()
    now = now.join(made, "file", "left")
    return now.select(
        "leaf_at", "part", "n_rows", "mark0", "mark1", "n_new", F.coalesce("old_ids", "ids_sha256").alias("ids_sha256"), F.coalesce("old_path", "path").alias("path"), fresh.alias("rewritten")
    )


def shop_moment(ts: Column, click_id: Column) -> Column:
    """The query's moment: some clicks are moved back by years, some to their week's start."""
    k = F.coalesce(F.pmod(F.crc32(click_id.cast("string")), F.lit(128)), F.lit(64))
    micros = local_micros(ts)
    days = whole_days(micros)
    return (
        F.when(k < 16, micros - (k + 6) * (k + 6) * (k + 6) * DAY)
        .when(k > 111, (days - F.pmod(days + 3, F.lit(7))) * DAY)
        .otherwise(micros)
    )


def clicks_laid_out(clicks: DataFrame, folder: str, share: int = 800) -> DataFrame:
    """The early clicks laid out in ``folder``, then all of them; the files that are there at last."""
    early = F.coalesce(local_micros(F.col("arrived_at")) < int(np.datetime64("2024-04-01", "us").astype(np.int64)), F.lit(False))
    most = 1 + clicks.count() // share
    moment = shop_moment(F.col("ts"), F.col("click_id"))
    options = {"order": ["arrived_at", "click_id"], "id_col": "click_id"}
    start = lay_out(clicks.where(early), moment, folder, most, **options)
    return lay_out(clicks, moment, folder, most, new=~early, before=start, **options)


def op13_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: ``clicks`` in files of an 800th of the table, first those before April, then all."""
    clicks = table(spark, sf_dir, "clicks")
    files = clicks_laid_out(clicks, shared_folder(spark))
    return files.select("leaf", F.lit(",".join(clicks.columns)).alias("columns"), "ids_sha256", "path", "part", "n_rows", "n_new", "rewritten")
