"""Helpers shared by the training-data operators.

Documents are any DataFrame with an id and a text column. Operators read only the
columns they need under fixed internal names, so further columns, whatever they are
called, never clash. A null text counts as the empty text; a null id stays null.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id BIGINT, text STRING) with null texts as empty ones."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def _local(sc) -> bool:
    return sc.master.split("[")[0] == "local"


def _base(sc) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode."""
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not _local(sc):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "textloom-checkpoints")
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder of the session."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_base(sc))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new path under the folder that all executors share."""
    return f"{_base(spark.sparkContext)}/textloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back; and where it lies."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so once their plans are collected.

    The first collection frees the driver's handles, the second one what only they held.
    """
    gc.collect()
    system = spark._jvm.System
    system.gc()
    system.runFinalization()
    time.sleep(0.2)
    system.gc()


def small_batches(spark: SparkSession, n_bytes: int = 1 << 20, n_rows: int = 1024) -> None:
    """From now on the session's Arrow batches hold about ``n_bytes``, and Parquet texts are read ``n_rows`` at a time.

    By default a batch may be all texts of a task, once in the reader's vectors, once in Arrow
    buffers outside the heap and once in Python, and processes keep what they once took.
    Stages return frames that run later, so the setting stays.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(n_rows))


@contextmanager
def batches_of(spark: SparkSession, n_bytes: int = 8 << 20) -> Iterator[None]:
    """Within, Arrow batches hold about ``n_bytes`` at most, however large their rows are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(n_bytes))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)
