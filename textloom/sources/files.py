"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import unpack_signed

LABEL = "struct<from:int,to:int,class:string,auxiliary:int,confidence:double>"
SHARD_SCHEMA = (
    "split string, origin string, stratum string, sourceName string, revision string, license string, path string, language string, "
    f"family string, constructs array<string>, source string, sourceLabelsVersion int, taxonomyVersion int, sourceLabels array<{LABEL}>"
)
FAILURE_SCHEMA = f"language string, family string, source string, source_file string, created_at string, source_sha256 string, source_labels array<{LABEL}>"


def read_shard(spark: SparkSession, path: str, schema: str = SHARD_SCHEMA) -> DataFrame:
    """JSON lines, gzip or plain. Lines end at LF alone; blank lines are skipped; bad lines fail."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def write_shard(rows: DataFrame, path: str, by: str = "split") -> None:
    rows.write.mode("overwrite").partitionBy(by).option("compression", "gzip").json(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Fails where something lies already."""
    rows.write.mode("errorifexists").parquet(path)


def load_within(rows: DataFrame, order: str, size: str, budget: int, *, families: list[str] | None = None, without: DataFrame | None = None, keys: tuple[str, ...] = ("origin", "sourceName", "path")) -> DataFrame:
    """Rows up to a budget of units; adds ``take``, the last row's share of it.

    Filters come before the running sum, which is taken in blocks of ``order``.
    """
    from ..operators.corpus import running_sums

    if families is not None:
        rows = rows.where(F.col("family").isin(families))
    if without is not None:
        rows = rows.join(without.select(*keys).distinct(), list(keys), "left_anti")
    summed = running_sums(rows.withColumn("_all", F.lit(1)), ["_all"], order, {"_upto": F.col(size)}).drop("_all")
    before = F.col("_upto") - F.col(size)
    return summed.where(before < budget).withColumn("take", F.least(F.col(size), budget - before)).drop("_upto")


#: Directories that hold no sources of their own.
EXCLUDED = (".git", "node_modules", "vendor", "third_party", "dist", "build", "target", "__pycache__")


def malformed_lines(spark: SparkSession, path: str, schema: str = SHARD_SCHEMA) -> DataFrame:
    """(file, line, text) of lines that are not blank and no JSON object of the schema; lines count from 1 in each file."""
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("text")
    )
    # Numbers within a block of a file come first, so that no window holds more than its blocks.
    blocks = rows.groupBy("file", "_block").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = blocks.select(F.col("file").alias("_f"), F.col("_block").alias("_b"), "_low", before.alias("_before"))
    bad = rows.where((F.trim("text") != "") & F.from_json("text", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull())
    j = bad.join(first, (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return j.select("file", (F.col("_before") + F.col("_at") - F.col("_low") + 1).alias("line"), "text")


def stream_shard(spark: SparkSession, path: str, schema: str = SHARD_SCHEMA, max_files: int = 16) -> DataFrame:
    """A folder of JSON-line shards as a stream; the sink's pace sets how many files a batch takes."""
    return spark.readStream.schema(schema).option("lineSep", "\n").option("maxFilesPerTrigger", max_files).json(path)


def scan_folder(spark: SparkSession, root: str, max_bytes: int, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, length, content, status, text) of the files below ``root`` that are not empty, by path.

    Files under a directory of an excluded name are left out. ``status`` tells why a file is
    unusable; its text is then null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where("length > 0")
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    inner = F.element_at(F.split("path", base + "/", 2), -1)
    files = files.where(~F.arrays_overlap(F.slice(F.reverse(F.split(inner, "/")), F.lit(2), F.lit(1000)), F.lit(list(excluded))))
    status = F.when(F.col("length") > max_bytes, "too large").when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8").otherwise("ok")
    return files.select("path", "length", "content", status.alias("status")).withColumn(
        "text", F.when(F.col("status") == "ok", F.col("content").cast("string"))
    ).orderBy("path")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with scheme and every folder, relative ones from the working folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toString()


def listed_files(spark: SparkSession, paths: list[str], max_files: int, max_bytes: int) -> DataFrame:
    """(path, status, text) of listed files: records, or why they are skipped or malformed.

    Beyond ``max_files`` they are skipped. A file that does not exist is an error.
    """
    # Empty files are no rows of the reader, so what it does not return is empty.
    # Paths are compared as the file system writes them, whole; a path that is listed twice gives two records.
    wanted = spark.createDataFrame([(k, p, qualified(spark, p)) for k, p in enumerate(paths)], "place int, wanted string, whole string")
    files = spark.read.format("binaryFile").load(sorted(set(paths[:max_files]))) if paths[:max_files] else spark.createDataFrame([], "path string, length long, content binary")
    j = wanted.hint("merge").join(files.withColumnRenamed("path", "at"), F.col("whole") == F.col("at"), "left")
    status = (
        F.when(F.col("place") >= max_files, "skipped: too many files").when(F.coalesce("length", F.lit(0)) == 0, "skipped: empty").when(F.col("length") > max_bytes, "skipped: too large")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "malformed: not UTF-8").otherwise("record")
    )
    return j.select(F.col("wanted").alias("path"), status.alias("status"), F.when(status == "record", F.col("content").cast("string")).alias("text"))


def landed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of fetched (path, content) files against (path, sha256): ok, missing, changed or unlisted."""
    have = files.select(F.col("path").alias("_p"), F.sha2("content", 256).alias("_sha"))
    j = manifest.select("path", "sha256").join(have, F.col("path") == F.col("_p"), "full")
    status = F.when(F.col("_p").isNull(), "missing").when(F.col("path").isNull(), "unlisted").when(F.col("sha256") == F.col("_sha"), "ok").otherwise("changed")
    return j.select(F.coalesce("path", "_p").alias("path"), status.alias("status"))


def provenance_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of either side that the other lacks, by all of their columns: adds ``side``; none if both agree."""
    columns = [*keys, *(c for c in left.columns if c not in keys)]
    a, b = left.select(*columns).distinct(), right.select(*columns).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def write_summary(rows: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    replace(rows.coalesce(1), path, "json")


def replace(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Write beside ``path`` first and move there when whole, so a reader never meets half a table."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    rows.write.format(form).save(new)
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, hadoop.Path(old))
    if not fs.rename(hadoop.Path(new), target):
        raise RuntimeError(f"could not move the new table to {path}")
    fs.delete(hadoop.Path(old), True)


CSR = "block long, first long, last long, offsets binary, values binary"


def write_csr(records: DataFrame, path: str, key: str, values: str, block: int = 4096) -> None:
    """Rows of whole-number arrays as blocks of one flat array and the offsets of its rows, in key order.

    ``key`` numbers the rows from 0 without gaps.
    """
    rows = records.select(F.col(key).cast("long").alias("k"), F.col(values).cast("array<int>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[int]]] = []

        def out(part: list[tuple[int, list[int]]]) -> pa.RecordBatch:
            offsets = np.cumsum([0, *(len(v) for _, v in part)]).astype("<i8")
            flat = np.array([x for _, v in part for x in v], dtype="<i4")
            cols = [pa.array([part[0][0] // block]), pa.array([part[0][0]]), pa.array([part[-1][0]]), pa.array([offsets.tobytes()]), pa.array([flat.tobytes()])]
            return pa.RecordBatch.from_arrays(cols, names=["block", "first", "last", "offsets", "values"])

        for b in batches:
            for k, v in zip(b.column("k").to_pylist(), b.column("v").to_pylist(), strict=True):
                if held and (k // block != held[0][0] // block):
                    yield out(held)
                    held = []
                held.append((k, v or []))
        if held:
            yield out(held)

    dealt = rows.withColumn("b", F.floor(F.col("k") / block)).repartition("b").sortWithinPartitions("k").drop("b")
    dealt.mapInArrow(run, CSR).write.mode("overwrite").parquet(path)


def read_csr(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """(key, values) of the rows ``first`` .. ``last`` - 1; the scan leaves blocks before and behind out by their bounds."""
    blocks = spark.read.schema(CSR).parquet(path).where((F.col("first") < (last if last is not None else 2**62)) & (F.col("last") >= first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                at, flat = np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["values"], "<i4")
                keys = np.arange(row["first"], row["first"] + len(at) - 1)
                keep = np.flatnonzero((keys >= first) & (keys < (last if last is not None else 2**62)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[keep]), pa.array([flat[at[k] : at[k + 1]].tolist() for k in keep.tolist()], pa.list_(pa.int32()))], names=["key", "values"]
                )

    return blocks.mapInArrow(run, "key long, values array<int>")


def load_checkpoint(spark: SparkSession, folder: str) -> dict[str, np.ndarray]:
    """Named tensors of a folder with one ``model.json`` and exactly one data file.

    The manifest lists {name, shape, offset, length} (bytes) and, for codes of 4 to 6 bits, bits
    and scale; without bits the data are float32.
    """
    files = {r.path.rsplit("/", 1)[1]: r for r in spark.read.format("binaryFile").load(folder).select("path", "content").collect()}  # one model
    data = [n for n in files if n != "model.json"]
    if "model.json" not in files or len(data) != 1:
        raise ValueError(f"{folder} must hold model.json and one data file, not {sorted(files)}")
    raw, out = bytes(files[data[0]].content), {}
    for t in json.loads(bytes(files["model.json"].content)):
        part, n = raw[t["offset"] : t["offset"] + t["length"]], int(np.prod(t["shape"]))
        values = unpack_signed(part, t["bits"], n) * t["scale"] if "bits" in t else np.frombuffer(part, "<f4")
        if len(values) != n:
            raise ValueError(f"tensor {t['name']} has {len(values)} of {n} values")
        out[t["name"]] = values.reshape(t["shape"]).astype(np.float32)
    return out


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def failures_or_none(spark: SparkSession, path: str) -> DataFrame:
    """The failure bank, or an empty one where there is no file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], FAILURE_SCHEMA)
    return spark.read.schema(FAILURE_SCHEMA).json(path)


def configuration_digest(*columns: Column) -> Column:
    """Digest of a canonical JSON form of the columns."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def safe_file_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), F.lit("-"), F.substring(F.sha2(name, 256), 1, 12))
