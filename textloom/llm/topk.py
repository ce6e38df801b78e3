"""Exact top-k inner products by block-at-a-time pruning.

Terms are vector components. Rows are sorted by id and packed into chunks; a chunk is cut
into document-range blocks with the largest and smallest value of every term. For a block
of queries, the summed term maxima (minima for negative query values) bound every score
in a block; blocks are scored through their forward index in the order of these bounds
until a bound falls below the k-th best score so far. A bound equal to it is still
scored, as a smaller id may win the tie, so results are exact.

Every query block meets every chunk once, in a grid: chunks are dealt into slots and query
blocks into groups of about ``group`` blocks; a cell of the grid holds a copy of both, and
keeps k results per query across its chunks. A task works on one cell at a time, so what
it holds does not grow with the queries or the rows. Vectors that are null
or hold null or non-finite components take no part, nor do rows without an id; a shorter
vector is as if padded by zeros. A repeated row is a candidate (or query) of its own, but
never a candidate of a query with its own id. Too few candidates give shorter lists; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACKED = "chunk long, dim int, ids binary, matrix binary"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v ARRAY<BIGINT>): floor(scale * x) of every component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    raw = raw.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", bad))
    return raw.select("vec_id", F.transform("e", lambda x: F.floor(x * float(scale))).alias("v"))


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Rows of (vec_id, v), in chunks of ``size`` successive rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq = TaskContext.get().partitionId() << 32, 0
        ids: list[np.ndarray] = []
        vecs: list = []

        def out(n: int) -> pa.RecordBatch:
            nonlocal ids, vecs, seq
            held = np.concatenate(ids)
            dim = max(map(len, vecs[:n]), default=0)
            matrix = np.zeros((n, dim), dtype=np.int64)
            for k, v in enumerate(vecs[:n]):
                matrix[k, : len(v)] = v
            seq += 1
            got = pa.RecordBatch.from_arrays(
                [pa.array([first + seq]), pa.array([dim], pa.int32()), pa.array([held[:n].tobytes()]), pa.array([matrix.tobytes()])],
                names=["chunk", "dim", "ids", "matrix"],
            )
            ids, vecs = [held[n:]], vecs[n:]
            return got

        for batch in batches:
            ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
            v = batch.column("v")
            flat, at = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            vecs += [flat[a:b] for a, b in zip(at[:-1], at[1:])]
            while len(vecs) >= size:
                yield out(size)
        if vecs:
            yield out(len(vecs))

    return rows.mapInArrow(run, PACKED)


class TopK:
    """The best k (score, id) of each query of a block so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, block: int):
        self.ids, self.k, self.block = ids, k, block
        self.queries = queries
        self.found = np.zeros((0, 3), dtype=np.int64)  # query number, score, id
        self.kth = np.full(len(ids), np.iinfo(np.int64).min)

    def _keep(self, number, score, doc) -> None:
        rows = np.concatenate([self.found, np.stack([number, score, doc], axis=1)])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        start = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - start
        self.found = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.kth[last[:, 0]] = last[:, 1]

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        dim = max(self.queries.shape[1], matrix.shape[1])
        q = np.pad(self.queries, ((0, 0), (0, dim - self.queries.shape[1])))
        d = np.pad(matrix, ((0, 0), (0, dim - matrix.shape[1])))
        size = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(d.astype(np.float64)).max(initial=0)) * max(dim, 1)
        if size >= 2.0**53:  # not exact as doubles: whole-number arithmetic, no bounds
            full = q.astype(object) @ d.astype(object).T
            full = np.clip(full, -(2**63), 2**63 - 1).astype(np.int64)
            for b in range(0, len(ids), self.block):
                self._score(np.arange(len(q)), full[:, b : b + self.block], ids[b : b + self.block])
            return
        q, d = q.astype(np.float64), d.astype(np.float64)
        starts = np.arange(0, len(d), self.block)
        most, least = np.maximum.reduceat(d, starts), np.minimum.reduceat(d, starts)
        bounds = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        everyone = np.arange(len(q))
        for place in range(len(starts)):
            block = order[:, place]
            live = bounds[everyone, block] >= self.kth
            if not live.any():
                break
            for b in np.unique(block[live]).tolist():
                who = np.flatnonzero(live & (block == b))
                part = slice(starts[b], starts[b] + self.block)
                self._score(who, (q[who] @ d[part].T).astype(np.int64), ids[part])

    def _score(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.kth[who][:, None]) & (self.ids[who][:, None] != ids[None, :])
        r, c = np.nonzero(good)
        if len(r):
            self._keep(who[r], scores[r, c], ids[c])


def _matrix(data: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64).reshape(n, dim)


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    chunk: int = 8192,
    block: int = 256,
    query_block: int = 1024,
    group: int = 8,
    slots: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for (vec_id, v) rows against (vec_id, v) queries."""
    docs = _pack(rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id"), chunk)
    if slots is None:
        slots = max(16, min(1024, rows.count() // (4 * chunk)))
    n = queries.count()
    groups = max(1, -(-n // (group * query_block)))
    asked = _pack(queries.repartitionByRange(max(1, -(-n // (4 * query_block))), "vec_id").sortWithinPartitions("vec_id"), query_block)
    asked = asked.select(
        F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
        F.col("chunk").alias("q_chunk"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"),
    )
    placed = docs.withColumn("slot", F.pmod(F.xxhash64("chunk"), F.lit(slots)).cast("int"))
    placed = placed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cells = placed.join(asked.hint("shuffle_merge"), ["slot", "group"])  # sorted by cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, TopK] = {}
        cell = None

        def results() -> Iterator[pa.RecordBatch]:
            for chunk_id, s in states.items():
                number, score, doc = s.found.T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(number), chunk_id)), pa.array(number), pa.array(s.ids[number]), pa.array(doc), pa.array(score)],
                    names=["q_chunk", "number", "query_id", "vec_id", "score"],
                )
            states.clear()

        for batch in batches:
            for x in batch.to_pylist():
                if (x["slot"], x["group"]) != cell:
                    yield from results()
                    cell = x["slot"], x["group"]
                if x["q_chunk"] not in states:
                    ids = np.frombuffer(x["q_ids"], dtype=np.int64)
                    states[x["q_chunk"]] = TopK(ids, _matrix(x["q_matrix"], x["q_dim"], len(ids)), k, block)
                ids = np.frombuffer(x["ids"], dtype=np.int64)
                states[x["q_chunk"]].add(ids, _matrix(x["matrix"], x["dim"], len(ids)))
        yield from results()

    found = cells.mapInArrow(run, "q_chunk long, number long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("q_chunk", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Query: every ``embeddings`` row whose id is divisible by 100 against all other rows."""
    rows = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
