"""Error windows: where a model fails most, chosen in turns over families."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parts import map_parts
from ..sources.folders import kept
from .corpus import running_sums
from .folds import ranked

WINDOW_SCHEMA = "record_id long, family string, source string, from int, to int, errors int, density double, score double"


def overlap_share(a: int, b: int, c: int, d: int) -> float:
    """How much of the shorter of [a, b) and [c, d) lies in the other."""
    return max(0, min(b, d) - max(a, c)) / min(b - a, d - c)


def error_windows(parts: DataFrame, window: int = 128, stride: int | None = None, context: int | None = None) -> DataFrame:
    """Windows anchored on failures of (record_id, family, source, i, n_parts, supervised, target, predicted, chance).

    Failures are few, so windows come from them; each window is then joined with the
    record's parts by the multiples of the stride that it covers.
    """
    stride, context = stride or window // 2, context or window // 4
    bad = parts.where(F.col("supervised") & (F.col("predicted") != F.col("target")))
    start = F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), F.col("n_parts") - window), F.floor(F.col("i") / stride) * stride - context))
    wins = bad.select("record_id", "family", "source", start.cast("int").alias("from"), F.least(F.col("n_parts"), start + window).cast("int").alias("to")).distinct()
    spread = wins.select("*", F.explode(F.sequence(F.floor(F.col("from") / stride), F.floor((F.col("to") - 1) / stride))).alias("slot"))
    inner = parts.where("supervised").select(F.col("record_id").alias("r"), "i", F.floor(F.col("i") / stride).alias("s"), (F.col("predicted") != F.col("target")).alias("bad"), "chance")
    met = spread.join(inner, (F.col("record_id") == F.col("r")) & (F.col("slot") == F.col("s")) & (F.col("i") >= F.col("from")) & (F.col("i") < F.col("to")))
    loss = F.when(F.col("bad"), -F.log(F.greatest(F.lit(1e-6), F.col("chance")))).otherwise(0.0)
    return met.groupBy("record_id", "family", "source", "from", "to").agg(
        F.count_if("bad").cast("int").alias("errors"), (F.count_if("bad") / F.count("*")).alias("density"), F.sum(loss).alias("score")
    )


def document_error_windows(
    docs: DataFrame, judge: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]], columns: set[str], window: int = 128, stride: int | None = None, context: int | None = None,
) -> DataFrame:
    """``error_windows`` where documents lie: (record_id, from, to, errors, density, score) of (doc_id, text).

    ``judge`` gives for all parts, from part columns: supervised, wrong, chance. Row-local: a
    window's sums are taken between its ends in the document's own parts.
    """
    stride, context = stride or window // 2, context or window // 4

    def run(b: pa.RecordBatch, sizes: np.ndarray, parts: dict) -> pa.RecordBatch:
        doc, begins = np.repeat(np.arange(b.num_rows), sizes), np.cumsum(sizes) - sizes
        supervised, wrong, chance = judge(parts)
        bad = supervised & wrong
        at = np.flatnonzero(bad)
        n = sizes[doc[at]]
        start = np.maximum(0, np.minimum(np.maximum(0, n - window), parts["i"][at] // stride * stride - context))
        low = np.unique(begins[doc[at]] + start)
        of = doc[low]
        high = np.minimum(begins[of] + sizes[of], low + window)
        # Sums between the ends of each window; windows may overlap.
        ends = np.stack([low, high], axis=1).ravel()
        within = lambda x: np.add.reduceat(np.append(x, x.dtype.type(0)), ends)[::2] if len(low) else np.zeros(0, x.dtype)
        errors, total = within(bad.astype(np.int64)), within(supervised.astype(np.int64))
        loss = within(np.where(bad, -np.log(np.maximum(1e-6, chance)), 0.0))
        keep = total > 0
        cols = [pa.array((x - begins[of])[keep], pa.int32()) for x in (low, high)]
        cols += [pa.array(errors[keep], pa.int32()), pa.array((errors / np.maximum(total, 1))[keep]), pa.array(loss[keep])]
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of[keep])), *cols], names=["record_id", "from", "to", "errors", "density", "score"])

    return map_parts(docs.select("doc_id", "text"), columns | {"i"}, run, "record_id long, `from` int, `to` int, errors int, density double, score double")


def uncovered(windows: DataFrame, best: list[str], share: float = 0.5) -> DataFrame:
    """The windows that no better window kept of their record covers by over ``share`` of the shorter one.

    Windows that cover each other so much conflict. Of those undecided, a window is kept if it
    is better than all it conflicts with, and what conflicts with a kept one goes, until none
    is undecided: the same windows that a list taken from the best to the worst would keep.
    A record may have any number of windows: conflicts meet by the stretches of a window's
    length that both touch. ``best`` are columns to compare by, the higher the better.
    """
    rows = kept(windows.withColumn("_id", F.monotonically_increasing_id()))
    length = rows.agg(F.max(F.col("to") - F.col("from"))).first()[0]
    if not length:
        return windows
    rank = F.struct(*best, F.col("_id"))
    slots = rows.select("_id", "record_id", "from", "to", rank.alias("rank"), F.explode(F.sequence(F.floor(F.col("from") / length), F.floor((F.col("to") - 1) / length))).alias("slot"))
    one = slots.select(*(F.col(c).alias(f"{c}1") for c in slots.columns))
    met = one.join(slots, (F.col("record_id1") == F.col("record_id")) & (F.col("slot1") == F.col("slot")) & (F.col("rank1") < F.col("rank")))
    both = F.least("to1", "to") - F.greatest("from1", "from")
    over = both > share * F.least(F.col("to1") - F.col("from1"), F.col("to") - F.col("from"))
    conflicts = kept(met.where(over).select(F.col("_id1").alias("worse"), F.col("_id").alias("better")).distinct())
    left, gone, lost = conflicts, None, None
    while left.limit(1).count():
        # Kept now: better ones that are the worse one of no conflict left.
        firm = left.select(F.col("better").alias("x")).distinct().join(left.select(F.col("worse").alias("x")), "x", "left_anti")
        lost = kept(left.join(firm, F.col("better") == F.col("x")).select(F.col("worse").alias("y")).distinct())
        gone = lost if gone is None else gone.union(lost)
        left = left.join(lost, F.col("worse") == F.col("y"), "left_anti").join(lost, F.col("better") == F.col("y"), "left_anti")
        left = kept(left)
    rows = rows if gone is None else rows.join(gone, F.col("_id") == F.col("y"), "left_anti")
    return rows.select(*windows.columns)


def choose_windows(windows: DataFrame, families: list[str], max_parts: int = 250_000, per_source: int = 12) -> DataFrame:
    """The best windows of each family in turns; at most ``per_source`` of a source, none half covered by an earlier one.

    Overlap concerns one record at a time, so covered windows go first, then each source keeps
    its best: the same as one list for all, in which a source that is full takes no more. What
    is left goes in turns over families up to ``max_parts`` parts, by running sums.
    """
    names = [c.split()[0] for c in WINDOW_SCHEMA.split(", ")]
    best = [F.desc("score"), F.desc("errors"), F.desc("density"), F.asc("record_id"), F.asc("from")]
    windows = windows.where(F.col("family").isin(families)).select(*names)
    worse = windows.withColumn("_start", -F.col("from"))
    rest = uncovered(worse, ["score", "errors", "density", "_start"]).drop("_start")
    rest = rest.withColumn("_place", F.row_number().over(Window.partitionBy("source").orderBy(*best))).where(F.col("_place") <= per_source)
    turns = ranked(rest, ["family"], best, "turn")
    order = (F.col("turn") * len(families) + F.array_position(F.lit(families), F.col("family"))).cast("long")
    turns = turns.withColumn("_order", order).withColumn("_all", F.lit(1))
    summed = running_sums(turns, ["_all"], "_order", {"_upto": F.col("to") - F.col("from")})
    return summed.where(F.col("_upto") <= max_parts).select(*names, "turn")
