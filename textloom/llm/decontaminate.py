"""Benchmark decontamination by spaced-seed hashing.

A mask is a string of 1s and 0s over successive words; the words at its 1s are hashed, so
a match of training and benchmark hashes survives substitutions at its 0s. Every hit
fixes an item and an alignment. Along it, a stretch is an overlap if it covers
``min_words`` words (or the whole item, if that is shorter) and ``min_share`` of them are
equal. The stretch with the best balance of equal words against two for each unequal one
is reported if it is one, else the longest that is.

At the default lengths and shares every overlap has a seed: wherever 2 of 13, 3 of 15, 4 of
20 or 5 of 25 words are substituted, one of ``MASKS`` meets only equal words, and longer
overlaps have such a part. Items of fewer than ``min_words`` words have masks of their own
length, of which any allowed number of substitutions leaves one intact; items of fewer than
``least_item`` words say too little and are not searched for.

Benchmarks are scanned in blocks of about ``max_block`` words, and documents are read once
per block, so what goes to the executors has a fixed bound at any benchmark size; one
block holds all but very large ones. Within a block the join is a lookup in sorted hash
tables. Words are lower-cased runs of letters and digits: punctuation doesn't count.

Null or empty texts and items give no rows. Repeated documents give repeated rows; equal
items are reported each on its own; an empty benchmark gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_folder, stored, texts

WORDS = re.compile(r"\w+")
MASKS = ("110110111", "1101011011", "1110010111", "111011", "1001000111")
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, n_equal long, item_words long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
BITS = 20
SLICE = 1_000_000


def short_masks(n: int, min_share: float) -> list[str]:
    """Masks over all ``n`` words: two blocks more than words may differ, less any as many blocks as may."""
    spare = n - math.ceil(min_share * n - 1e-9)
    blocks = min(n, spare + 2)
    of = [k * blocks // n for k in range(n)]
    return ["".join("0" if b in gone else "1" for b in of) for gone in combinations(range(blocks), spare)]


class SeedIndex:
    """The hash tables of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, list[str]]], masks=MASKS, least_item: int = 1, min_words: int = 13, min_share: float = 0.8):
        self.vocab: dict[str, int] = {}
        self.min_words, self.min_share = min_words, min_share
        longest = max(min_words, *map(len, masks))
        rng = np.random.default_rng(11)
        self.factors = rng.integers(0, 2**63, longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.names: list[int] = []
        self.items: list[np.ndarray] = []
        seeds: dict[str, list[tuple[np.ndarray, int]]] = {m: [] for m in masks}
        for name, words in items:
            if len(words) < least_item:
                continue
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.uint64)
            for m in masks if len(words) >= longest else short_masks(len(words), min_share):
                seeds.setdefault(m, []).append((self.hashes(ids, m), len(self.items)))
            self.names.append(name)
            self.items.append(ids)
        self.tables = {}
        for m, found in seeds.items():
            if found:
                h = np.concatenate([x for x, _ in found])
                who = np.concatenate([np.full(len(x), k) for x, k in found])
                at = np.concatenate([np.arange(len(x)) for x, _ in found])
                order = np.argsort(h, kind="stable")
                maybe = np.zeros(1 << BITS, dtype=bool)
                maybe[h >> np.uint64(64 - BITS)] = True
                self.tables[m] = (h[order], who[order], at[order], maybe)

    def hashes(self, ids: np.ndarray, mask: str) -> np.ndarray:
        n = max(0, len(ids) - len(mask) + 1)
        h = np.zeros(n, dtype=np.uint64)
        for o, used in enumerate(mask):
            if used == "1":
                h += ids[o : o + n] * self.factors[o]
        return h * np.uint64(0x9E3779B97F4A7C15)

    def words(self, text: str) -> np.ndarray:
        found = WORDS.findall(text.lower())
        return np.fromiter(map(self.vocab.get, found, repeat(0)), np.uint64, len(found))

    def search(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, words, equal words) of the best overlap of each pair."""
        if not docs or not self.tables:
            return []
        gap = np.zeros(16, dtype=np.uint64)
        joined = np.concatenate([x for d in docs for x in (d, gap)])
        starts = np.cumsum([0] + [len(d) + 16 for d in docs])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        for mask, (hs, who, at, maybe) in self.tables.items():
            h = self.hashes(joined, mask)
            place = np.flatnonzero(maybe[h >> np.uint64(64 - BITS)])
            lo, hi = np.searchsorted(hs, h[place], "left"), np.searchsorted(hs, h[place], "right")
            sure = hi > lo
            place, lo, n = place[sure], lo[sure], (hi - lo)[sure]
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // SLICE)) + 1):
                first, many = lo[part], n[part]
                entry = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
                pos = np.repeat(place[part], many)
                doc = np.searchsorted(starts, pos, "right") - 1
                rows = np.unique(np.stack([doc, who[entry], pos - starts[doc] - at[entry]], axis=1), axis=0)
                if len(seen) > SLICE:
                    seen.clear()
                for hit in map(tuple, rows.tolist()):
                    if hit not in seen:
                        seen.add(hit)
                        pair, got = hit[:2], self.overlap(docs[hit[0]], self.items[hit[1]], hit[2])
                        # The longest by equal words; of equal ones the first in the document.
                        if got and (old := best.get(pair, (0, 0, 0))) and (got[2], -got[0]) > (old[2], -old[0] if old[2] else 0):
                            best[pair] = got
        return [(*pair, *got) for pair, got in sorted(best.items())]

    def overlap(self, doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        if b <= a:
            return None
        same = doc[a + shift : b + shift] == item[a:b]
        least = min(self.min_words, len(item))
        if len(same) < least or same.sum() < self.min_share * least - 1e-9:
            return None
        sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
        gain = sums - np.minimum.accumulate(sums)
        end = int(np.argmax(gain))
        start = int(np.argmin(sums[: end + 1]))
        n, equal = end - start, int(same[start:end].sum())
        if n < least or equal < self.min_share * n - 1e-9:
            # The longest stretch with the share: from each start, the last end with no lower balance.
            sums = np.concatenate([[0], np.cumsum(same - self.min_share)])
            ahead = np.maximum.accumulate(sums[::-1])
            ends = len(sums) - 1 - np.searchsorted(ahead, sums - 1e-9)
            start = int(np.argmax(ends - np.arange(len(sums))))
            n = int(ends[start]) - start
            if n < least:
                return None
            equal = int(same[start : start + n].sum())
        return a + start + shift, n, equal


def seed_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", max_block: int = 1_000_000, **options) -> Iterator[SeedIndex]:
    """One index per block of about ``max_block`` benchmark words."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    items, size = [], 0
    for r in rows.toLocalIterator():
        words = WORDS.findall(r.t.lower())
        items.append((r.i, words))
        size += len(words)
        if size >= max_block:
            yield SeedIndex(items, **options)
            items, size = [], 0
    if items:
        yield SeedIndex(items, **options)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and item that overlap. Row-local: no shuffle."""
    spark = docs.sparkSession
    source = texts(docs, id_col, text_col)

    def scan(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                found = index.search([index.words(t.as_py()) for t in b.column("text")])
                rows = [(ids[d], index.names[i], s, n, e, len(index.items[i])) for d, i, s, n, e in found]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=NAMES)

        return source.mapInArrow(run, SCHEMA)

    blocks = seed_indexes(benchmark, **options)
    index, following = next(blocks, None), next(blocks, None)
    if index is None:
        return spark.createDataFrame([], SCHEMA)
    if following is None:
        return scan(spark.sparkContext.broadcast(index))
    path = shared_folder(spark)
    for index in chain((index, following), blocks):
        shared = spark.sparkContext.broadcast(index)
        scan(shared).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(SCHEMA).parquet(path)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Query: all ``documents`` against all ``benchmark`` items."""
    return find_overlaps(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without an overlap, with all their columns.

    Items of under five words, which clean documents hold too, are no ground to drop one.
    """

    def without(kept: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                values = b.column(b.schema.get_field_index("text"))
                bad = {x[0] for x in index.search([index.words(t.as_py() or "") for t in values])}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))

        return kept.mapInArrow(run, docs.schema)

    path, last = None, None
    for index in seed_indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_item=5):
        if last is not None:  # one block at a time: what the last one left is written first
            docs, new = stored(docs)
            last.destroy()
            if path:
                discard(spark, path)
            path = new
        last = spark.sparkContext.broadcast(index)
        docs = without(docs, last)
    return docs
