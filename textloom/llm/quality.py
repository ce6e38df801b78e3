"""Quality selection by importance resampling over hashed n-grams.

Two generative models over the same hash buckets of words and word pairs, one of target
texts and one of all texts, give every document a log importance weight: the sum over
its n-grams of log p_target - log p_raw. Documents are then drawn without replacement by
Gumbel top-k: the k largest of weight + Gumbel noise. k is the number of documents whose
weight reaches that of all but a thousandth of the target sample, less two scales of the
noise (which pulls a key down further once in 1,600 draws), so the choice follows the
data at any size. One half of the sample trains the target model, the other sets k.

The target sample is bounded (``max_target`` expected rows of the labelled ones, by hash
of the id). The models are dense tables of ``buckets`` numbers. The noise is a hash of
the document's id, hence equal when a task runs again. The k-th largest key is found by
narrowing histograms, never by gathering keys.

Words are runs of letters and digits or runs of other signs; a pair of equal words is
one n-gram whatever the word. A null or empty text has weight 0. Repeated rows have equal
keys and are chosen together; a null id draws its noise as one id. Without target rows every
weight is 0 and all are chosen. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts

WORDS = re.compile(r"\w+|[^\w\s]+")
SPACE = re.compile(r"\s")
BLOCK = 1 << 20


def features(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the words and word pairs of a text, block by block."""
    text, at, last = text.lower(), 0, None
    while at < len(text):
        end = len(text)
        if end - at > 2 * BLOCK and (m := SPACE.search(text, at + BLOCK)):
            end = m.start()
        words = WORDS.findall(text, at, end)
        at = end
        h = np.fromiter(map(zlib.crc32, map(str.encode, words)), np.uint64, len(words))
        run = h if last is None else np.concatenate([last, h])
        pairs = run[:-1] * np.uint64(0x9E3779B1) + run[1:]
        pairs ^= pairs >> np.uint64(29)
        pairs[run[:-1] == run[1:]] = 1
        last = h[-1:] if len(h) else last
        yield (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def gumbel(doc, seed: int) -> float:
    u = (xxhash.xxh64_intdigest(str(doc).encode(), seed) + 0.5) / 2.0**64
    return -math.log(-math.log(min(u, 1 - 2.0**-53)))


class QualityModel:
    def __init__(self, ratios: np.ndarray, seed: int, noise: float):
        self.ratios, self.seed, self.noise = ratios, seed, noise

    def weight(self, text: str | None) -> float:
        return float(sum(self.ratios[f].sum() for f in features(text or "", len(self.ratios))))

    def key(self, doc, weight: float) -> float:
        return weight + self.noise * gumbel(doc, self.seed)

    def keys(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, log_weight, sample_key). Row-local."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = [self.weight(t.as_py()) for t in b.column("text")]
                k = [self.key(i.as_py(), x) for i, x in zip(b.column("doc_id"), w, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(w, pa.float64()), pa.array(k, pa.float64())],
                    names=["doc_id", "log_weight", "sample_key"],
                )

        return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, log_weight double, sample_key double")


def fit(
    docs: DataFrame,
    target_ids: list[int],
    *,
    buckets: int = 1 << 14,
    seed: int = 7,
    noise: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> QualityModel:
    """Count n-grams over all documents and over those with a target id."""
    wanted = frozenset(target_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                hit = doc.as_py() in wanted
                for f in features(text.as_py(), buckets):
                    n = np.bincount(f, minlength=buckets)
                    raw += n
                    if hit:
                        target += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])

    counts = (
        texts(docs, id_col, text_col)
        .mapInArrow(run, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()  # one row per bucket
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]] = counts["raw"]
    target[counts["bucket"]] = counts["target"]
    if not target.sum():
        return QualityModel(np.zeros(buckets), seed, noise)
    ratios = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    return QualityModel(ratios, seed, noise)


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value; minus infinity if there are fewer than k rows."""
    values = keys.select(F.col(column).alias("x"))
    n, low, high = values.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if k <= 0:
        return math.inf
    if n < k:
        return -math.inf
    above = 0  # values over ``high`` of the current range
    while low < high:
        here = values.where(F.col("x").between(low, high))
        width = (high - low) / bins
        if width <= 0 or low + width <= low:
            break
        place = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1))
        hist = here.groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for row in sorted(hist.collect(), key=lambda r: -r.p):  # at most ``bins`` rows
            if above + row.n >= k:
                low, high = row.lo, row.hi
                break
            above += row.n
    return high


def select(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_target: int = 20_000,
    lost_share: float = 0.001,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> tuple[QualityModel, DataFrame, float]:
    """(model, keys of all documents, least chosen key); labels: (doc_id, quality 0/1)."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"))
    n = good.count()
    part = min(1.0, max_target / max(n, 1))
    sample = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    ids = sorted(r.id for r in sample.distinct().collect())  # about max_target rows
    # One half trains the model; the other, unseen by it, sets the weight to reach.
    model = fit(docs, ids[::2], id_col=id_col, text_col=text_col, **options)
    keys = cut(model.keys(docs, id_col, text_col))
    known = docs.sparkSession.createDataFrame([(i,) for i in ids[1::2] or ids], "doc_id long")
    least = keys.join(F.broadcast(known), "doc_id").agg(F.percentile_approx("log_weight", lost_share, 10_000)).first()[0]
    reach = -math.inf if least is None else least - 2 * model.noise
    k = keys.where(F.col("log_weight") >= reach).count()
    return model, keys, kth_largest(keys, "sample_key", k)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Query: weight, key and choice of all ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    _, keys, least = select(docs, labels)
    return keys.select("doc_id", "log_weight", "sample_key", (F.col("sample_key") >= least).alias("selected"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents chosen, with all their columns.

    The second look at each text recomputes its key in place, so no text is shuffled.
    """
    model, _, least = select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, values = b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("text"))
            chosen = [model.key(i.as_py(), model.weight(t.as_py())) >= least for i, t in zip(ids, values, strict=True)]
            yield b.filter(pa.array(chosen, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
