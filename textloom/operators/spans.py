"""Runs over a document's parts: span merge, run lengths, local profiles.

``merge_spans``, ``merge_spans_lite`` and ``run_lengths`` take labels from a table. Where the
labels follow from the parts themselves (a classifier of part columns), ``document_spans``,
``document_tiles`` and ``document_runs`` give the same rows where the documents lie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parts import NEWLINE, SPACE, in_order, map_parts

#: Class code and level of each part, from part columns; by documents also from the number of parts of each.
Classifier = Callable[[dict], tuple[np.ndarray, np.ndarray]] | Callable[[dict, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _changes(cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a run begins: at a change of class, and wherever ``first`` says so."""
    return np.flatnonzero(np.append(True, cls[1:] != cls[:-1])[: len(cls)] | first)


def _firsts(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(int(sizes.sum()), dtype=bool)
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return out


def _spans(doc: pa.Array, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    kinds = {"class": pa.int32(), "level": pa.int32(), "block": pa.int32(), "length": pa.int32()}
    arrays = [doc, *(pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns])


def document_spans(docs: DataFrame, classify: Classifier, columns: set[str], *, by_document: bool = False) -> DataFrame:
    """(doc_id, class, start, stop, level) of (doc_id, text): neighbours of one class, with their least level. Row-local."""

    def run(b: pa.RecordBatch, sizes: np.ndarray, parts: dict) -> pa.RecordBatch:
        doc = np.repeat(np.arange(b.num_rows), sizes)
        cls, level = classify(parts, sizes) if by_document else classify(parts)
        at = _changes(cls, _firsts(sizes))
        end = np.append(at[1:], len(cls)) - 1 if len(at) else at
        least = np.minimum.reduceat(level, at) if len(at) else level
        return _spans(b.column("doc_id").take(pa.array(doc[at])), {"class": cls[at], "start": parts["start"][at], "stop": parts["stop"][end], "level": least})

    return map_parts(docs.select("doc_id", "text"), {"start", "stop", *columns}, run, "doc_id long, class int, start long, stop long, level int")


def tiles(ids: pa.Array, sizes: np.ndarray, parts: dict, cls: np.ndarray) -> pa.RecordBatch:
    """The rows of ``document_tiles`` of documents whose parts have these classes."""
    doc = np.repeat(np.arange(len(ids)), sizes)
    solid = np.flatnonzero((parts["kind"] != SPACE) & (parts["kind"] != NEWLINE))
    first = np.append(True, doc[solid][1:] != doc[solid][:-1])[: len(solid)]
    at = solid[_changes(cls[solid], first)]
    bare = np.setdiff1d(np.flatnonzero(sizes), doc[solid])
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(np.append(at, begins[bare]), kind="stable")
    at, kind = np.append(at, begins[bare])[order], np.append(cls[at], np.zeros(len(bare), cls.dtype))[order]
    leads = np.append(True, doc[at][1:] != doc[at][:-1])[: len(at)]
    start = np.where(leads, 0, parts["start"][at])
    ends = parts["stop"][(begins + sizes - 1)[doc[at]]] if len(at) else start
    stop = np.where(np.append(leads[1:], True)[: len(at)], ends, np.append(start[1:], 0)[: len(at)])
    return _spans(ids.take(pa.array(doc[at])), {"class": kind, "start": start, "stop": stop})


def document_tiles(docs: DataFrame, classify: Classifier, columns: set[str]) -> DataFrame:
    """(doc_id, class, start, stop) of (doc_id, text): spans that tile it, white space with the span before it or else the first one. Row-local.

    White space alone is one span of class 0.
    """

    def run(b: pa.RecordBatch, sizes: np.ndarray, parts: dict) -> pa.RecordBatch:
        return tiles(b.column("doc_id"), sizes, parts, classify(parts)[0])

    return map_parts(docs.select("doc_id", "text"), {"start", "stop", "kind", *columns}, run, "doc_id long, class int, start long, stop long")


def document_runs(docs: DataFrame, classify: Classifier, columns: set[str], block: int = 1024) -> DataFrame:
    """(doc_id, block, class, length) of (doc_id, text): runs of one class in blocks of parts. Row-local."""

    def run(b: pa.RecordBatch, sizes: np.ndarray, parts: dict) -> pa.RecordBatch:
        doc = np.repeat(np.arange(b.num_rows), sizes)
        cls, _ = classify(parts)
        at = _changes(cls, parts["i"] % block == 0)
        length = np.diff(np.append(at, len(cls)))
        return _spans(b.column("doc_id").take(pa.array(doc[at])), {"block": parts["i"][at] // block, "class": cls[at], "length": length})

    return map_parts(docs.select("doc_id", "text"), {"i", *columns}, run, "doc_id long, block int, class int, length int")


def merge_spans(labelled: DataFrame) -> DataFrame:
    """Gaps and islands over (doc_id, i, start, stop, class, level).

    Neighbours of one class whose offsets meet become a span; its confidence is the least
    level plus one, in sixteenths.
    """
    w = in_order()
    fresh = (F.lag("class").over(w).eqNullSafe(F.col("class")) & F.lag("stop").over(w).eqNullSafe(F.col("start"))).cast("int")
    runs = labelled.withColumn("fresh", 1 - fresh).withColumn("run", F.sum("fresh").over(w))
    return runs.groupBy("doc_id", "run").agg(
        F.first("class").alias("class"), F.min("start").alias("start"), F.max("stop").alias("stop"),
        ((F.min("level") + 1) / 16.0).alias("confidence"),
    )


def merge_spans_lite(labelled: DataFrame) -> DataFrame:
    """Spans that tile the text: white space joins the span before it, or the first one.

    A document of white space alone is one plain span.
    """
    blank = F.col("kind").isin(SPACE, NEWLINE)
    w = in_order()
    ends = labelled.groupBy("doc_id").agg(F.max("stop").alias("end"), F.max((~blank).cast("int")).alias("solid"))
    starts = (
        labelled.where(~blank)
        .withColumn("before", F.lag("class").over(w))
        .where(F.col("before").isNull() | (F.col("before") != F.col("class")))
    )
    spans = starts.select(
        "doc_id", "class",
        F.when(F.col("before").isNull(), 0).otherwise(F.col("start")).alias("start"),
        F.lead("start").over(w).alias("next"),
    ).join(ends.select("doc_id", "end"), "doc_id")
    spans = spans.select("doc_id", "class", F.col("start").cast("long").alias("start"), F.coalesce("next", "end").alias("stop"))
    plain = ends.where("solid = 0").select("doc_id", F.lit("plain").alias("class"), F.lit(0).cast("long").alias("start"), F.col("end").alias("stop"))
    return spans.unionByName(plain)


def run_lengths(labelled: DataFrame, block: int = 1024) -> DataFrame:
    """Run-length encoding of ``class`` in blocks of parts: (doc_id, block, run, class, length)."""
    rows = labelled.withColumn("block", F.floor(F.col("i") / block))
    w = Window.partitionBy("doc_id", "block").orderBy("i")
    fresh = 1 - F.lag("class").over(w).eqNullSafe(F.col("class")).cast("int")
    runs = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    return runs.groupBy("doc_id", "block", "run").agg(F.first("class").alias("class"), F.count("*").alias("length"))


def expand_runs(runs: DataFrame) -> DataFrame:
    """The inverse of run_lengths: one row per element, ``offset`` within its run."""
    return runs.select("doc_id", "block", "run", "class", F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))).alias("offset"))
