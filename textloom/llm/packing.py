"""Sum-of-squares online packing of tokenized documents into fixed windows.

A document's ids (with one end id) are cut into full windows while they exceed one; the
rest goes to the fill level whose choice makes the sum of squared counts of partially
filled windows smallest. ``counts[h]`` is the number of open windows filled to ``h``.
Each task packs its own rows. When a task has over ``max_open`` windows open, the fullest
one is filled up from the emptiest ones, which are cut for it, and the rest stay as they
are. When it has read its last row, the open ones are cut and joined into full windows;
what is left at the very end becomes windows of powers of two, so no window is padded. A
task keeps at most ``max_open`` windows and one batch of texts in memory.

Null and empty texts hold the end id alone. Repeated rows are packed each on its own. A
sequence id is the task's number and a count within the task, so a task that runs again
after a lost executor gives the same rows. A null id stays null in the pieces; an empty
table has none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import texts
from .token_ids import worker_token_ids

END_ID = 1
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Packer:
    """Pieces are (doc_id, start, ids as bytes, doc_tokens); rows come out when a window closes."""

    def __init__(self, window: int, max_open: int, first_sequence: int):
        self.window, self.max_open, self.sequence = window, max_open, first_sequence
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def add(self, doc, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        full = total // w
        for k in range(full):
            self._close([(doc, k * w, ids[4 * k * w : 4 * (k + 1) * w], total)])
        if r := total - full * w:
            self._place(r, (doc, full * w, ids[4 * full * w :], total))

    def _place(self, r: int, piece: tuple) -> None:
        counts, w = self.counts, self.window
        change = 2 * (counts[r:] - counts[: w - r + 1] + 1)
        change[counts[: w - r + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * counts[r] + 1 if r < w else 0
        if counts[w - r] and r < w:
            change[w - r] = 1 - 2 * counts[w - r]
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        pieces = self.open[level].pop() if level else []
        if level:
            counts[level] -= 1
        pieces.append(piece)
        if level + r == w:
            self._close(pieces)
            return
        counts[level + r] += 1
        self.open.setdefault(level + r, []).append(pieces)
        if counts.sum() > self.max_open:
            self._fill_up()

    def _fill_up(self) -> None:
        """Close the fullest window with ids from the ends of the emptiest ones."""

        def take(level: int) -> list:
            self.counts[level] -= 1
            return self.open[level].pop()

        levels = np.flatnonzero(self.counts)
        pieces, need = take(int(levels[-1])), self.window - int(levels[-1])
        while need:
            low = int(np.flatnonzero(self.counts)[0])
            donor = take(low)
            while need and donor:
                doc, start, ids, total = donor.pop()
                n = len(ids) // 4
                keep = max(0, n - need)
                pieces.append((doc, start + keep, ids[4 * keep :], total))
                need, low = need - (n - keep), low - (n - keep)
                if keep:
                    donor.append((doc, start, ids[: 4 * keep], total))
            if donor:
                self.counts[low] += 1
                self.open.setdefault(low, []).append(donor)
        self._close(pieces)

    def join_open(self) -> None:
        """Cut and join the open windows, fullest first, into full ones."""
        pending = [p for h in sorted(self.open, reverse=True) for ps in self.open[h] for p in ps]
        self.open.clear()
        self.counts[:] = 0
        left, room, window = sum(len(p[2]) // 4 for p in pending), 0, []
        for doc, start, ids, total in pending:
            while ids:
                if not window:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                n = min(room, len(ids) // 4)
                window.append((doc, start, ids[: 4 * n], total))
                start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                if not room:
                    self._close(window)
                    window = []

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=NAMES)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    window: int = 2048,
    max_open: int = 1024,
    vocabulary: str | None = None,
    max_units: int | None = None,
) -> DataFrame:
    """One row per piece. Row-local: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_token_ids(vocabulary, max_units)
        end = np.array([END_ID], dtype="<u4").tobytes()
        packer = Packer(window, max_open, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                packer.add(doc.as_py(), encode(text.as_py()) + end)
            yield packer.take()
        packer.join_open()
        yield packer.take()

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Query: all ``documents``, in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): the pieces of every document that is left.

    Workers keep their tables between stages, so these are smaller than the query's.
    """
    return pack(docs, max_units=60_000)
