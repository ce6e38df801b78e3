"""Streams with keyed state: spans over chunks in any order, bursts settled by timers, requests in fused batches.

All run on ``transformWithState``, which keeps its state in RocksDB and recovers it from the
checkpoint (``rocksdb_state`` sets the provider); executors may be lost at any time.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.parts import map_parts
from ..operators.folds import greedy_batches

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Within, streams that start keep their state in RocksDB."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


# Spans


CHUNK = "doc_id long, chunk int, last boolean, classes array<int>, stops array<long>, levels array<int>"
SPAN = "doc_id long, class int, start long, stop long, level int"


def chunks(docs: DataFrame, classify: Callable[[dict], tuple[np.ndarray, np.ndarray]], columns: set[str], size: int = 4096) -> DataFrame:
    """(``CHUNK``) of the documents' parts, ``size`` parts each; the last chunk of a document says so.

    ``classify`` gives class and level of each part from part columns. Neighbours of one class
    go as one entry with their least level, so that a chunk is short before it is shuffled or
    waits in the state. A document without parts has no chunk, and neither has one without an
    id. Row-local.
    """

    def run(b: pa.RecordBatch, sizes: np.ndarray, parts: dict) -> pa.RecordBatch:
        cls, level = classify(parts)
        doc, i, n = np.repeat(np.arange(b.num_rows), sizes), parts["i"], len(parts["i"])
        begins = i % size == 0
        first, at = np.flatnonzero(begins), np.flatnonzero(np.append(True, cls[1:] != cls[:-1])[:n] | begins)
        ends = np.append(at[1:], n)[: len(at)] - 1
        offsets = pa.array(np.append(np.searchsorted(at, first), len(at)), pa.int32())
        last = i[first] // size == (sizes[doc[first]] - 1) // size
        least = np.minimum.reduceat(level, at) if n else level
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((cls[at], pa.int32()), (parts["stop"][ends], pa.int64()), (least, pa.int32()))]
        ids = b.column("doc_id").take(pa.array(doc[first]))
        return pa.RecordBatch.from_arrays([ids, pa.array(i[first] // size, pa.int32()), pa.array(last), *lists], names=["doc_id", "chunk", "last", "classes", "stops", "levels"])

    return map_parts(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), {"i", "stop", *columns}, run, CHUNK)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in one value of the state."""
    out = io.BytesIO()
    for x in arrays:
        np.save(out, x, allow_pickle=False)
    return out.getvalue()


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    source = io.BytesIO(data)
    return [np.load(source, allow_pickle=False) for _ in range(n)]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of start[0] .. start[0] + size[0] - 1, start[1] ..., one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class SpanCarry(StatefulProcessor):
    """Chunks of a bucket of documents: each one's open span is its state, with the number of the next chunk; chunks that come early wait.

    A chunk whose number is behind the next one is a repeat and changes nothing, and so does
    any chunk of a document whose last one is done. All documents of a bucket are taken at once.
    """

    def init(self, handle) -> None:
        self.docs = handle.getValueState("docs", "done binary, open binary")
        self.waiting = handle.getValueState("waiting", "chunks binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        docs = self.docs.get() if self.docs.exists() else None
        # Documents that are done; those begun: id, next chunk, start, class, stop and level of the open span.
        done = unpacked(docs[0], 1)[0] if docs else np.zeros(0, np.int64)
        begun = unpacked(docs[1], 1)[0] if docs else np.zeros((6, 0), np.int64)
        waited = self.waiting.exists()
        parts = [unpacked(self.waiting.get()[0], 7)] if waited else []
        for pdf in rows:
            lists = [np.concatenate([np.zeros(0, np.int64), *pdf[c]]).astype(np.int64) for c in ("classes", "stops", "levels")]
            sizes = np.fromiter(map(len, pdf["classes"]), np.int64, len(pdf))
            parts.append([pdf["doc_id"].to_numpy(np.int64), pdf["chunk"].to_numpy(np.int64), pdf["last"].to_numpy(np.int64), sizes, *lists])
        doc, chunk, last, size, cls, stop, level = (np.concatenate([p[i] for p in parts]) for i in range(7))
        at = np.cumsum(size) - size
        # Each chunk once, in order, without those behind.
        order = np.lexsort((chunk, doc))
        again = np.append(False, (np.diff(doc[order]) == 0) & (np.diff(chunk[order]) == 0))[: len(order)]
        order = order[~again & ~np.isin(doc[order], done)]
        ids, own = np.unique(doc[order], return_inverse=True)
        where = np.searchsorted(begun[0], ids)
        known = np.isin(ids, begun[0])
        state = np.tile(np.array([[0], [0], [0], [-1], [0], [0]], np.int64), len(ids))
        state[0] = ids
        state[:, known] = begun[:, where[known]]
        ahead = chunk[order] >= state[1][own]
        order, own = order[ahead], own[ahead]
        # Those that follow the next one without a gap, up to the last one.
        first = np.searchsorted(own, np.arange(len(ids)))
        ready = chunk[order] == state[1][own] + np.arange(len(order)) - first[own]
        ends = np.cumsum(last[order] * ready)
        ready &= ends - last[order] * ready == np.append(0, ends)[first][own]
        over = np.bincount(own, last[order] * ready, len(ids)) > 0
        took, of = order[ready], own[ready]
        early = order[~ready & ~over[own]]
        state[1] += np.bincount(of, minlength=len(ids))
        # The open span stands before the document's own parts.
        opened = np.flatnonzero(state[3] >= 0)
        run = ranges(at[took], size[took])
        run_doc = np.repeat(of, size[took])
        cls_all, stop_all, level_all = (np.append(state[i][opened], x[run]) for i, x in ((3, cls), (4, stop), (5, level)))
        by = np.argsort(np.append(opened, run_doc), kind="stable")
        run_doc, cls_all, stop_all, level_all = (x[by] for x in (np.append(opened, run_doc), cls_all, stop_all, level_all))
        out = None
        if len(run_doc):
            fresh = np.flatnonzero(np.append(True, (np.diff(run_doc) != 0) | (np.diff(cls_all) != 0)))
            span_doc, span_cls, span_level = run_doc[fresh], cls_all[fresh], np.minimum.reduceat(level_all, fresh)
            span_stop = stop_all[np.append(fresh[1:], len(run_doc)) - 1]
            begins = np.append(True, np.diff(span_doc) != 0)
            span_start = np.where(begins, state[2][span_doc], np.append(0, span_stop[:-1]))
            ending = np.append(begins[1:], True)
            still = np.flatnonzero(ending & ~over[span_doc])
            state[2:, span_doc[still]] = span_start[still], span_cls[still], span_stop[still], span_level[still]
            closed = ~ending | over[span_doc]
            out = pd.DataFrame({"doc_id": ids[span_doc], "class": span_cls, "start": span_start, "stop": span_stop, "level": span_level})[closed]
        keep = ~np.isin(begun[0], ids)
        begun = np.concatenate([begun[:, keep], state[:, ~over]], axis=1)
        begun = begun[:, np.argsort(begun[0])]
        self.docs.update((packed(np.union1d(done, ids[over])), packed(begun)))
        if len(early):
            run = ranges(at[early], size[early])
            self.waiting.update((packed(doc[early], chunk[early], last[early], size[early], cls[run], stop[run], level[run]),))
        elif waited:
            self.waiting.clear()
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


def streamed_spans(stream: DataFrame, buckets: int = 1024) -> DataFrame:
    """The spans (``SPAN``) of a stream of ``CHUNK`` rows, each as soon as what closes it has come.

    Chunks may come in any order and more than once; a document's spans end with its last
    chunk. Start within the context of ``rocksdb_state``, in append mode. Documents share the
    state of a bucket; their number must stay as it is while a checkpoint is in use.
    """
    rows = stream.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(SpanCarry(), SPAN, "Append", "None")


# Bursts


class Quiet(StatefulProcessor):
    """Events of a bucket of keys wait until the watermark says that none can come any more within the gap behind them.

    One timer is set, for the first gap that ends; all that the watermark has passed then is settled.
    """

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "timer long, events binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [pdf[["key", "micros", "place"]].to_numpy(np.int64) for pdf in rows]
        return self.settled(np.concatenate(came), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.settled(np.zeros((0, 3), np.int64), timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def settled(self, came: np.ndarray, timerValues, expired: int | None = None) -> Iterator[pd.DataFrame]:
        was, data = self.pending.get() if self.pending.exists() else (None, None)
        events = np.concatenate([unpacked(data, 1)[0], came]) if data else came
        events = events[np.lexsort(events.T[::-1])]
        events = events[np.append(True, (np.diff(events, axis=0) != 0).any(axis=1))[: len(events)]]
        key, micros, _ = events.T
        quiet = np.append((np.diff(key) != 0) | (np.diff(micros) > self.gap), True)[: len(events)]
        now = timerValues.getCurrentWatermarkInMs() * 1000
        over = micros + self.gap <= now
        # What another follows may go, but not before all have come that it may follow itself.
        left = ~over & (quiet | (micros > now))
        # An event that may still be followed is settled at its gap's end; others are never given out.
        ends = micros[left] + self.gap
        timer = int(-(-ends.min() // 1000)) if len(ends) else None
        if was is not None and was not in (timer, expired):
            self.handle.deleteTimer(was)
        if timer is not None and (timer != was or was == expired):
            self.handle.registerTimer(timer)
        if left.any():
            self.pending.update((timer, packed(events[left])))
        elif data:
            self.pending.clear()
        done = events[over & quiet]
        if len(done):
            yield pd.DataFrame({"key": done[:, 0], "micros": done[:, 1], "place": done[:, 2]})

    def close(self) -> None:
        pass


QUIET = "key long, micros long, place long"


def quiet_events(stream: DataFrame, key: str, ts: str, place: str, gap_seconds: float, lateness: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """The events that no other one of their key follows within the gap, as a stream (``QUIET``).

    ``place`` orders events of one moment. An event is given out once the watermark, ``lateness``
    behind the latest event, has passed the end of its gap; later ones than that are dropped.
    Events that another follows within the gap leave the state once the watermark is past them.
    Keys share the state of a bucket; their number must stay as it is while a checkpoint is in use.
    """
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(place).cast("long").alias("place"))
    rows = rows.where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", lateness).withColumn("micros", F.unix_micros("at"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(Quiet(int(gap_seconds * 1_000_000)), QUIET, "Append", "EventTime")


# Requests


def fused_batches(requests: DataFrame, order: str, parts: str, most: int = 16_384) -> DataFrame:
    """Adds ``fused``: requests in order go together until their parts reach ``most``; that request is the last of them."""
    return greedy_batches(requests, [], order, parts, most, after=True).withColumnRenamed("batch", "fused")


def latest_wins(requests: DataFrame, key: str, order: str) -> DataFrame:
    """Of a key's requests the last one; those in between are dropped."""
    rest = [c for c in requests.columns if c != key]
    return requests.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*").select(*requests.columns)


def run_requests(
    stream: DataFrame, *, order: str, parts: str, work: Callable[[DataFrame], DataFrame], broken: Column, path: str, checkpoint: str,
    key: str | None = None, most: int = 16_384,
) -> StreamingQuery:
    """Runs a stream of requests in fused batches and writes ``path/done`` and ``path/rejected``.

    What waits when a micro-batch begins is taken at once, with ``key`` only each key's latest,
    and fused. A fused batch with a ``broken`` request is rejected whole, the others of the
    micro-batch and all later ones run. ``work`` takes the requests of the good batches, with
    ``fused``, and gives their results. Each micro-batch has a folder of its own, so one that is
    repeated after a failure replaces what it wrote.
    """

    def run(batch: DataFrame, number: int) -> None:
        asked = latest_wins(batch, key, order) if key else batch
        fused = fused_batches(asked, order, parts, most)
        bad = fused.groupBy("fused").agg(F.max(F.coalesce(broken, F.lit(False))).alias("bad"))
        marked = fused.join(bad, "fused")
        good = marked.where("NOT bad").drop("bad")
        work(good).write.mode("overwrite").parquet(f"{path}/done/batch={number}")
        marked.where("bad").select(order, "fused").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
