"""Names that stand for others, and what a start reaches: chains and closures by joins, in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import kept


def resolved(names: DataFrame, key: str, alias: str) -> DataFrame:
    """(key, root, steps, cyclic): each name's chain of aliases followed to its end.

    A name whose alias is null or itself is its own root; one that no row has as its key ends
    the chain as well. Names on or before a cycle have no root and say so. A round doubles the
    steps of all chains; one in which no further chain ends leaves only cycles. Of a key's
    repeated rows the least alias counts; rows without a key are left out.
    """
    each = names.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.min(F.when(F.col(alias) != F.col(key), F.col(alias))).alias("at"))
    each = kept(each)
    rows = each.select("node", F.coalesce("at", "node").alias("at"), F.col("at").isNotNull().cast("long").alias("steps"), F.col("at").isNull().alias("done"))
    rows, ended = kept(rows), -1
    while (now := rows.where("done").count()) > ended and rows.where("NOT done").limit(1).count():
        ended = now
        ahead = rows.select(F.col("node").alias("n2"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"))
        moved = rows.where("NOT done").join(ahead, F.col("at") == F.col("n2"), "left").select(
            "node", F.coalesce("at2", "at").alias("at"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.coalesce("done2", F.lit(True)).alias("done")
        )
        rows = kept(rows.where("done").union(moved))
    open_ = ~F.col("done")
    return rows.select(F.col("node").alias(key), F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("steps")).alias("steps"), open_.alias("cyclic"))


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, depth) of all that ``starts`` (node) reach over ``edges`` (node, next), each with its least number of steps.

    Each round follows the edges of what was found in the last one only, so cycles end by themselves.
    """
    edges = kept(edges.where("node IS NOT NULL AND next IS NOT NULL").distinct())
    last = kept(starts.where("node IS NOT NULL").select("node").distinct().withColumn("depth", F.lit(0)))
    found = last
    while last.limit(1).count():
        ahead = last.join(edges, "node").select(F.col("next").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        last = kept(ahead.join(found.select("node"), "node", "left_anti"))
        found = found.union(last)
    return found


def missing(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Ends of edges that are not known names."""
    return edges.select(F.col("next").alias("node")).where("node IS NOT NULL").distinct().join(known.select("node"), "node", "left_anti")
