"""Folds over ordered records whose next step depends on what was taken before, without one task for a group.

``greedy_batches`` fills batches one after the other. What a block of records does to an open
batch depends only on where its first cut falls, so each block is summarised once for every
record at which that may be; summaries of neighbouring blocks are composed, level by level,
until one is left, and the open batch is then carried down again. Every level reads what the
level below wrote, so the work is in proportion to the records, in tasks of ``width`` records
or ``fan`` summaries.

``ranked`` numbers the rows of groups of any size. ``least_loaded`` deals records to bins a size
at a time. ``taken_while_they_fit`` chooses records in order, skipping what no longer fits. What does not
fit once never fits again, so each round looks only at the next few records that do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import kept
from .corpus import running_sums


@dataclass(frozen=True)
class Cuts:
    """What a stretch of records does to the open batch it is entered with.

    ``upto[k]`` is the size of the records up to a place k at which the first cut may fall,
    ``fill[k]`` and ``count[k]`` what is then open at the end, and how many batches were closed.
    Places lie within the first batch's worth of records; ``total`` is the size of all, ``has``
    says whether there are any.
    """

    upto: np.ndarray
    fill: np.ndarray
    count: np.ndarray
    total: int

    def entered(self, fill: np.ndarray, limit: int, after: bool) -> tuple[np.ndarray, np.ndarray]:
        """(open at the end, batches closed) for each amount that is open at the start."""
        # Before: the first record with which the batch would pass the limit begins the next one.
        # After: the first record with which it reaches the limit ends it.
        at = np.searchsorted(self.upto, limit - fill, side="left" if after else "right")
        cut = at < len(self.upto)
        safe = np.minimum(at, len(self.upto) - 1)
        return np.where(cut, self.fill[safe], fill + self.total), np.where(cut, self.count[safe], 0)


def block_cuts(sizes: np.ndarray, limit: int, after: bool) -> Cuts:
    """The summary of successive records."""
    upto = np.cumsum(sizes)
    n = len(sizes)
    # The cut that follows one at k: batches start at k (before) or behind it (after).
    start = upto if after else upto - sizes
    follows = np.searchsorted(upto, start + limit, side="left" if after else "right")
    if not after:
        follows = np.maximum(follows, np.arange(1, n + 1))  # a batch has one record at least
    fill, count = upto[-1] - start, np.ones(n, dtype=np.int64)
    for k in range(n - 1, -1, -1):
        if follows[k] < n:
            fill[k], count[k] = fill[follows[k]], count[follows[k]] + 1
    return within(Cuts(upto, fill, count, int(upto[-1])), limit)


def within(c: Cuts, limit: int) -> Cuts:
    """Without places that no open batch can reach: those behind the first one beyond the limit."""
    last = int(np.searchsorted(c.upto, limit, side="right")) + 1
    return Cuts(c.upto[:last], c.fill[:last], c.count[:last], c.total)


def composed(parts: list[Cuts], limit: int, after: bool) -> Cuts:
    """The summary of neighbouring stretches, from the last to the first."""
    whole = parts[-1]
    for c in reversed(parts[:-1]):
        fill, more = whole.entered(c.fill, limit, after)
        whole = Cuts(
            np.concatenate([c.upto, c.total + whole.upto]), np.concatenate([fill, whole.fill]),
            np.concatenate([c.count + more, whole.count]), c.total + whole.total,
        )
        whole = within(whole, limit)
    return whole


def batch_numbers(sizes: np.ndarray, fill: int, number: int, limit: int, after: bool, fresh: bool) -> np.ndarray:
    """The batch of each record of a block that is entered with ``fill`` open in batch ``number``.

    ``fresh``: no record is in the open batch yet, so the first one joins it whatever its size.
    """
    upto = np.cumsum(sizes)
    out = np.empty(len(sizes), dtype=np.int64)
    at, base = 0, -fill
    while at < len(sizes):
        if after:
            end = int(np.searchsorted(upto, base + limit, side="left")) + 1
        else:
            end = max(int(np.searchsorted(upto, base + limit, side="right")), at + fresh)
        end = min(end, len(sizes))
        out[at:end] = number
        if end < len(sizes):
            base, fresh = upto[end - 1] if end else 0, True
        number, at = number + 1, end
    return out


LISTS = "upto array<long>, fill array<long>, count array<long>, total long"
GROUP = "g long, block long, "


def greedy_batches(
    records: DataFrame, by: list[str], order: str, size: str, limit: int, *, after: bool = False, width: int = 4096, fan: int = 64
) -> DataFrame:
    """Adds ``batch``, from 0: successive records of each group in batches within ``limit``.

    A record that would pass the limit begins the next batch, so a batch holds more only where
    it is one record alone. With ``after``, the record that reaches the limit ends its batch
    instead. ``order`` is a whole number, different within a group; sizes are whole, one and
    more; records whose order or size is null are left out. A group may be of any size.
    """
    groups = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in by)) if by else F.lit(0).cast("long")
    known = records.where(F.col(order).isNotNull() & F.col(size).isNotNull())
    ranked = running_sums(known.withColumn("_g", groups), ["_g"], order, {"_rank": F.lit(1).cast("long")})
    ranked = ranked.withColumn("_block", F.floor((F.col("_rank") - 1) / width))
    slim = ranked.select(F.col("_g").alias("g"), F.col("_block").alias("block"), F.col("_rank").alias("rank"), F.col(size).cast("long").alias("size"))
    slim = slim.groupBy("g", "block").agg(F.array_sort(F.collect_list(F.struct("rank", "size"))).alias("rows"))
    slim = kept(slim.select("g", "block", F.col("rows.size").alias("sizes")))

    def summary(frames):
        for pdf in frames:
            cuts = [block_cuts(np.asarray(s, dtype=np.int64), limit, after) for s in pdf["sizes"]]
            yield _frame(pdf["g"], pdf["block"], cuts)

    levels = [kept(slim.mapInPandas(summary, GROUP + LISTS))]
    while levels[-1].where("block > 0").limit(1).count():
        levels.append(kept(levels[-1].groupBy("g", F.floor(F.col("block") / fan).alias("above")).applyInPandas(_joined(limit, after), GROUP + LISTS)))
    # Downwards: what is open, and in which batch, as each stretch is entered.
    entry = levels[-1].select("g", "block", F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("number"), F.lit(True).alias("fresh"))
    for below in reversed(levels[:-1]):
        joined = below.withColumn("above", F.floor(F.col("block") / fan)).join(entry.withColumnRenamed("block", "above"), ["g", "above"])
        entry = joined.groupBy("g", "above").applyInPandas(_carried(limit, after), GROUP + "open long, number long, fresh boolean")

    def numbered(frames):
        for pdf in frames:
            out = [batch_numbers(np.asarray(s, dtype=np.int64), o, n, limit, after, f) for s, o, n, f in zip(pdf["sizes"], pdf["open"], pdf["number"], pdf["fresh"])]
            yield pd.DataFrame({"g": pdf["g"], "block": pdf["block"], "batches": out})

    batches = slim.join(entry, ["g", "block"]).mapInPandas(numbered, GROUP + "batches array<long>")
    batches = batches.select(F.col("g").alias("_bg"), F.col("block").alias("_bb"), "batches")
    out = ranked.join(batches, (F.col("_g") == F.col("_bg")) & (F.col("_block") == F.col("_bb")))
    return out.select(*records.columns, F.element_at("batches", (F.col("_rank") - F.col("_block") * width).cast("int")).alias("batch"))


def _frame(g, block, cuts: list[Cuts]) -> pd.DataFrame:
    lists = {c: [getattr(x, c) for x in cuts] for c in ("upto", "fill", "count", "total")}
    return pd.DataFrame({"g": list(g), "block": list(block)} | lists)


def _cuts(row) -> Cuts:
    return Cuts(np.asarray(row.upto), np.asarray(row.fill), np.asarray(row.count_), int(row.total))


def _rows(pdf: pd.DataFrame):
    return pdf.rename(columns={"count": "count_"}).sort_values("block").itertuples()


def _joined(limit: int, after: bool):
    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame([key[0]], [key[1]], [composed([_cuts(r) for r in _rows(pdf)], limit, after)])

    return join


def _carried(limit: int, after: bool):
    def carry(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, now = [], None
        for r in _rows(pdf):
            now = now or (int(r.open), int(r.number), bool(r.fresh))
            out.append((key[0], r.block, *now))
            cuts = _cuts(r)
            fill, closed = cuts.entered(np.array([now[0]]), limit, after)
            # Before the very first record no batch is open that a record above the limit could close.
            none = now[2] and not after and cuts.upto[0] > limit
            now = int(fill[0]), now[1] + int(closed[0]) - int(none), False
        return pd.DataFrame(out, columns=["g", "block", "open", "number", "fresh"])

    return carry


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """Adds each row's number in its group, from 1, in ``order`` (columns, falling ones too), by ranges instead of windows.

    Rows are dealt by key range into sorted buckets; the place in the bucket plus what the
    buckets before it hold of the group is the number. Rows that are equal in all columns of
    ``order`` go in any order, so let it end in a key. A group may hold all rows.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order, "_own"]
    rows = df.withColumn("_own", F.monotonically_increasing_id()).repartitionByRange(buckets, *keys).sortWithinPartitions(*keys)
    placed = kept(rows.drop("_own").withColumn("_place", F.monotonically_increasing_id())).withColumn("_bucket", F.shiftright("_place", 33))
    counts = placed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"), F.min("_place").alias("_lo"))
    sums = running_sums(counts.withColumn("_all", F.lit(1)), ["_all", *by], "_bucket", {"_upto": F.col("_n")})
    sums = sums.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), F.col("_bucket").alias("_b"), (F.col("_upto") - F.col("_n") - F.col("_lo") + 1).alias("_shift"))
    match = placed["_bucket"] == sums["_b"]
    for i, c in enumerate(by):
        match = match & placed[c].eqNullSafe(sums[f"_g{i}"])
    return placed.join(sums, match).select(*df.columns, (F.col("_place") + F.col("_shift")).alias(name))


def drawn(key: Column, weight: Column, seed: int) -> Column:
    """The logarithm of a random number for the key over its weight: the higher, the earlier in a weighted order."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 12)
    return F.log((F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 48)) / F.greatest(F.lit(1.0), weight.cast("double"))


def weighted_turns(records: DataFrame, key: str, family: str, weight: Column, seed: int) -> DataFrame:
    """Adds ``turn`` and ``place``: families in turns, each in a random order in which heavier records tend to come first.

    Families follow each other by their least key. Order and draws are functions of key and seed.
    """
    rows = records.withColumn("_draw", drawn(F.col(key), weight, seed))
    first = records.groupBy(F.col(family).alias("_family")).agg(F.min(key).alias("_first"))
    turns = ranked(rows, [family], [F.desc("_draw"), F.asc(key)], "turn").drop("_draw")
    turns = turns.join(first, F.col(family).eqNullSafe(F.col("_family")))
    return ranked(turns, [], [F.asc("turn"), F.asc("_first"), F.asc(key)], "place").drop("_family", "_first")


def loads_taken(loads: np.ndarray, size: int, items: int) -> np.ndarray:
    """How many of ``items`` equal sizes each bin takes when each goes to the least loaded bin (the first of several)."""
    taken = np.zeros(len(loads), dtype=np.int64)
    if not size:
        taken[int(np.argmin(loads))] = items
        return taken
    # Bin b offers loads[b], loads[b] + size, ...; the least offers are taken, by value and bin.
    level = _level(loads, size, np.array([items]))[0]
    taken = _offers(loads, size, np.array([level - 1]))[0]
    at_level = np.flatnonzero((loads <= level) & ((level - loads) % size == 0))
    taken[at_level[: items - taken.sum()]] += 1
    return taken


def _offers(loads: np.ndarray, size: int, level: np.ndarray) -> np.ndarray:
    """(levels, bins): how many offers of each bin are at a level or below."""
    return np.maximum(0, (level[:, None] - loads) // size + 1)


def _level(loads: np.ndarray, size: int, items: np.ndarray) -> np.ndarray:
    """The least level with so many offers at or below it."""
    low = np.full(len(items), loads.min() - 1)
    high = loads.max() + size * items
    while (low + 1 < high).any():
        mid = (low + high) // 2
        enough = _offers(loads, size, mid).sum(axis=1) >= items
        low, high = np.where(enough, low, mid), np.where(enough, mid, high)
    return high


def bins_taken(loads: np.ndarray, size: int, places: np.ndarray) -> np.ndarray:
    """The bin of the items at these places (from 0) among equal sizes."""
    if not size:
        return np.full(len(places), int(np.argmin(loads)))
    level = _level(loads, size, places + 1)
    nth = places - _offers(loads, size, level - 1).sum(axis=1)
    offering = (loads <= level[:, None]) & ((level[:, None] - loads) % size == 0)
    return np.argmax(np.cumsum(offering, axis=1) > nth[:, None], axis=1)


def least_loaded(records: DataFrame, key: str, size: str, count: int) -> DataFrame:
    """(key, size, bin): records by falling size, then key, each to the bin that holds least, the first of several.

    Records of one size are one step, whatever their number: the loads before each size come
    from the sizes and their counts alone (as many rows as there are sizes), and a record's
    bin from the loads before its size and its rank in it. Records without a size are left out.
    """
    known = records.where(F.col(size).isNotNull()).select(key, F.col(size).cast("long").alias("_size"))
    sizes = known.groupBy("_size").agg(F.count("*").alias("n"))

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        loads, out = np.zeros(count, dtype=np.int64), []
        for n, items in sorted(zip(pdf["_size"], pdf["n"]), reverse=True):
            out.append(loads)
            loads = loads + n * loads_taken(loads, int(n), int(items))
        return pd.DataFrame({"_of": sorted(pdf["_size"], reverse=True), "loads": out})

    steps = sizes.groupBy(F.lit(0).alias("_all")).applyInPandas(before, "_of long, loads array<long>")
    rows = ranked(known, ["_size"], [F.asc(key)]).join(steps, F.col("_size") == F.col("_of"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            bins = np.zeros(len(pdf), dtype=np.int32)
            for n, at in pdf.groupby("_size").indices.items():
                bins[at] = bins_taken(np.asarray(pdf["loads"].iloc[at[0]]), int(n), pdf["rank"].to_numpy()[at] - 1)
            yield pd.DataFrame({key: pdf[key], size: pdf["_size"], "bin": bins})

    kind = records.schema[key].dataType.simpleString()
    return rows.mapInPandas(place, f"`{key}` {kind}, `{size}` long, bin int")


def taken_while_they_fit(records: DataFrame, turn: str, place: list[str], size: str, most_records: int, most_size: int, falling: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``place`` (from 0) to the records taken in order of ``turn`` and ``place``, and drops the others.

    A record is taken while fewer than ``most_records`` are and the sizes taken stay within
    ``most_size``; one that would pass it is skipped. A turn of which none is taken is the last.
    Each round brings at most ``most_records`` records that still fit to the driver, the first
    of which is always taken. Columns of ``falling`` go from high to low; none may be null.
    """
    spark = records.sparkSession
    keys = [turn, *place]
    behind, left, taken, last = None, most_size, [], None
    while len(taken) < most_records and left > 0:
        rows = records.where(F.col(size) <= left)
        if behind is not None:
            rows = rows.where(behind)
        rows = rows.select(*keys, F.col(size).alias("_size")).orderBy(*(F.desc(k) if k in falling else F.asc(k) for k in keys)).limit(most_records).collect()
        if not rows:
            break
        ended = False
        for r in rows:
            # No record of the turns between fitted, or it would have come before.
            if r[turn] > (0 if last is None else last) + 1:
                ended = True
                break
            if r["_size"] <= left and left > 0:
                taken.append(tuple(r[k] for k in keys))
                left, last = left - r["_size"], r[turn]
                if len(taken) == most_records:
                    break
        if ended:
            break
        end = rows[-1]
        behind = F.lit(False)
        for k in reversed(keys):
            further = F.col(k) < F.lit(end[k]) if k in falling else F.col(k) > F.lit(end[k])
            behind = further | ((F.col(k) == F.lit(end[k])) & behind)
    schema = records.select(*keys).schema.add("_place", "integer")
    chosen = spark.createDataFrame([(*t, i) for i, t in enumerate(taken)], schema)
    return records.join(chosen, keys).withColumnRenamed("_place", "place")
