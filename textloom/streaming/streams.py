"""Stream forms: micro-batches, latest request per key, spans that carry over chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState


def text_stream(spark: SparkSession, path: str, schema: str, max_files: int = 16) -> DataFrame:
    """A Parquet folder as a stream of micro-batches of at most ``max_files`` files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def latest_per_key(events: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The latest row of each key; works on batches and, in update mode, on streams."""
    best = F.max_by(F.struct(*keep), F.struct(*order)).alias("x")
    return events.groupBy(key).agg(best).select(key, "x.*")


def write_latest(events: DataFrame, key: str, order: list[str], keep: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch writes its latest rows to a folder of its own; repeated batches overwrite it."""

    def sink(batch: DataFrame, number: int) -> None:
        latest_per_key(batch, key, order, keep).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SPANS = "doc_id long, class string, start long, stop long, level int"


def stream_spans(chunks: DataFrame) -> DataFrame:
    """Spans of (doc_id, i, start, stop, class, level, last) rows that arrive in chunks.

    The open span of each document is its state; it is closed by a change of class, a gap,
    or the document's last part. Levels are the least of a span's parts.
    """

    def merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pdf.sort_values("i")[["class", "start", "stop", "level", "last"]] for pdf in frames]
        if state.exists:
            cls, start, stop, level = state.get
            parts.insert(0, pd.DataFrame([(cls, start, stop, level, False)], columns=["class", "start", "stop", "level", "last"]))
        rows = pd.concat(parts, ignore_index=True)
        fresh = (rows["class"] != rows["class"].shift()) | (rows["start"] != rows["stop"].shift()) | rows["last"].shift(fill_value=False)
        spans = rows.groupby(fresh.cumsum(), sort=True).agg(
            **{"class": ("class", "first"), "start": ("start", "min"), "stop": ("stop", "max"), "level": ("level", "min"), "last": ("last", "any")}
        )
        still_open = not bool(spans["last"].iloc[-1])
        if still_open:
            tail = spans.iloc[-1]
            state.update((tail["class"], int(tail["start"]), int(tail["stop"]), int(tail["level"])))
            spans = spans.iloc[:-1]
        elif state.exists:
            state.remove()
        yield spans.drop(columns="last").assign(doc_id=key[0])[["doc_id", "class", "start", "stop", "level"]]

    ordered = chunks.select("doc_id", "i", "start", "stop", "class", "level", "last")
    return ordered.groupBy("doc_id").applyInPandasWithState(merge, SPANS, "class string, start long, stop long, level int", "append", "NoTimeout")


def debounced(events: DataFrame, key: str, ts: str, gap_seconds: float, *order: str) -> DataFrame:
    """The events that no other one of their key follows within the gap: what is left of a burst of edits."""
    from pyspark.sql import Window

    after = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, *order))
    quiet = after.isNull() | (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) > int(gap_seconds * 1_000_000))
    return events.withColumn("_quiet", quiet).where("_quiet").drop("_quiet")


def job_batches(requests: DataFrame, order: str, most: int = 64) -> DataFrame:
    """Adds ``batch``: at most ``most`` successive requests, in blocks, so no task numbers all of them."""
    from ..operators.corpus import running_sums

    return running_sums(requests.withColumn("_all", F.lit(1)), ["_all"], order, {"_place": F.lit(1)}).withColumn("batch", F.floor((F.col("_place") - 1) / most)).drop("_all", "_place")
