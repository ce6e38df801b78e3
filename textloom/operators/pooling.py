"""Pooling and running means over ordered rows and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pooled(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, channel, mean, most) of a group's vectors; partial sums first, so groups may be of any size."""
    flat = rows.select(key, F.posexplode(vector).alias("channel", "x"))
    return flat.groupBy(key, "channel").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.max(F.col("x").cast("double")).alias("most"))


def running_means(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds ``prefix_mean`` (up to and with the row) and ``suffix_mean`` (from the row on) within a key."""
    up = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("prefix_mean", F.avg(value).over(up)).withColumn("suffix_mean", F.avg(value).over(down))


def tape_ranges(rows: DataFrame, key: str, tape: str) -> DataFrame:
    """(key, from, to, kind): runs of equal kinds on a tape (an array of one kind per unit). Row-local."""
    units = F.size(tape)
    shifted = F.concat(F.array(F.lit(None)), F.slice(tape, F.lit(1), F.greatest(units - 1, F.lit(0))))
    changed = F.zip_with(tape, shifted, lambda a, b: ~a.eqNullSafe(b))
    starts = F.array_compact(F.transform(changed, lambda c, k: F.when(c, k)))
    cut = rows.where(units > 0).select(key, tape, starts.alias("_starts"))
    cut = cut.select(key, tape, "_starts", F.posexplode("_starts").alias("_k", "from"))
    return cut.select(key, "from", F.coalesce(F.get("_starts", F.col("_k") + 1), units).alias("to"), F.get(F.col(tape), F.col("from")).alias("kind"))


def digest_of_rows(rows: DataFrame, by: str, order: str, value: str, width: int = 1024) -> DataFrame:
    """(by, digest): SHA-256 over the values in order, as digests of blocks of ``width`` order values, then of those."""
    joined = lambda a: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(a)), lambda r: r["v"]), "\n"), 256)
    blocks = rows.groupBy(by, F.floor(F.col(order) / width).alias("_block")).agg(joined(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("_d"))
    return blocks.groupBy(by).agg(joined(F.struct(F.col("_block").alias("o"), F.col("_d").alias("v"))).alias("digest"))
