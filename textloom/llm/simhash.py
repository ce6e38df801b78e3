"""SimHash near-duplicates through an inverted index of positional fingerprint bytes.

Fingerprints within ``d`` bits share at least ``8 - d`` of their eight positional bytes
(each differing bit spoils one byte at most). The index is read as count filtering with
skipped lists does: the lists of one position are left out, so a pair that reaches the
minimum shares ``7 - d`` bytes at least in the other seven. Lists of single bytes would
hold a 256th of all fingerprints and pair them all; they are intersected first, for each
set of ``7 - d`` of the seven positions. For every pair that meets there, the shared
positional bytes are tallied over all eight; pairs that reach the minimum are verified bit
by bit.

Equal fingerprints count as one entry, so copies never multiply. A list of two is a pair;
a longer one yields a spanning forest of its links, never all its pairs. A list longer
than ``max_list`` is dealt again by combinations of the half bytes that are still free,
after which a list holds at most 2^16 different fingerprints, whatever the input.

Texts: A-Z lower-cased, words are runs without ASCII white space. Null and empty texts
have the fingerprint zero and link like any other. Shingles keep repeats. Repeated rows
share a fingerprint and therefore a component. A null id counts for no component's least
id; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts
from .components import connected_components

SEED = 42
BLOCK = 1 << 20
WHITE = re.compile(rb"[\x20\t\n\x0b\x0c\r]")

#: Byte value -> its eight bits, one in each byte of a 64-bit word.
LANES = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], dtype=np.uint64)


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, in lists of bounded size."""
    at = 0
    while len(data) - at > BLOCK:
        m = WHITE.search(data, at + BLOCK)
        if m is None:
            break
        yield data[at : m.start()].split()
        at = m.end()
    yield data[at:].split()


def shingle_hashes(data: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of k words joined by spaces (of all words, if fewer)."""
    kept: list[bytes] = []
    any_full = False
    for words in word_blocks(data):
        words = kept + words
        if len(words) >= k:
            any_full = True
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            joined = b" ".join(words)
            starts = np.concatenate([[0], ends[: len(words) - k]]).tolist()
            parts = map(joined.__getitem__, map(slice, starts, (ends[k - 1 :] - 1).tolist()))
            yield np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(starts))
        kept = words[max(0, len(words) - k + 1) :]
    if kept and not any_full:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], dtype=np.uint64)


def remix(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th further hash of hashed values (a finaliser of multiply-xorshift form)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * i) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the values have each of the 64 bits set (lowest first)."""
    out = np.zeros(64, dtype=np.int64)
    rows = h.view(np.uint8).reshape(-1, 8)
    for i in range(0, len(rows), 255):
        out += LANES[rows[i : i + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return out


def fingerprint(text: str, k: int, words: int = 1, distinct: bool = False) -> list[int]:
    """``words`` 64-bit fingerprint words; a bit is 1 if set in over half the hashes.

    ``distinct`` counts equal shingles of a block of text (1 MB) once.
    """
    counts, n = np.zeros((words, 64), dtype=np.int64), 0
    with np.errstate(over="ignore"):
        for h in shingle_hashes(text.encode("utf-8").lower(), k):
            h = np.unique(h) if distinct else h
            n += len(h)
            for i in range(words):
                counts[i] += bit_counts(remix(h, i) if i else h)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def fingerprints(docs: DataFrame, k: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """(doc_id, f0, f1, ...) per document. Row-local."""
    names = [f"f{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprint(t.as_py(), k, words, distinct) for t in batch.column("text")]
            cols = list(zip(*rows, strict=True)) if rows else [()] * words
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *names]
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(parts: tuple[int, ...], bits: int) -> int:
    return sum(((1 << bits) - 1) << bits * p for p in parts)


def _long_array(values: list[int]) -> str:
    return "array(" + ",".join(f"{_signed(v)}L" if _signed(v) != -(1 << 63) else "bigint('-9223372036854775808')" for v in values) + ")"


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The tally of positional bytes that are zero in each XOR of two fingerprints."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links within ``distance`` bits that connect all that such links connect."""
    values = np.unique(values)
    bits = values.view(np.uint64)  # a signed count would be that of the magnitude
    parent = list(range(len(values)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(values) - 1):
        apart = bits[i + 1 :] ^ bits[i]
        met = np.flatnonzero(shared_bytes(apart) >= 8 - distance)
        near = met[np.bitwise_count(apart[met]) <= distance]
        for j in (near + i + 1).tolist():
            a, b = top(i), top(j)
            if a != b:
                parent[b] = a
                out.append((int(values[i]), int(values[j])))
    return out


def link_fingerprints(fps: DataFrame, distance: int = 4, max_list: int = 4096) -> DataFrame:
    """Links (a, b) that connect all different values of ``fps`` (fp BIGINT) within ``distance`` bits (6 at most)."""
    masks = [_mask(c, 8) for c in combinations(range(7), 7 - distance)]
    posted = fps.select("fp", F.expr(f"posexplode(transform({_long_array(masks)}, m -> fp & m))").alias("c", "key"))
    lists = posted.groupBy("c", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    lists = cut(lists)
    apart = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum(((F.shiftrightunsigned(apart, 8 * k).bitwiseAND(F.lit(255))) == 0).cast("int") for k in range(8))
    pairs = lists.where("n = 2").where((tally >= 8 - distance) & (F.bit_count(apart) <= distance)).select("a", "b")

    # Half bytes outside the shared bytes: all but ``distance`` of them are shared at least.
    free = [[p for p in range(16) if not m >> 4 * p & 15] for m in masks]
    finer = [[_mask(c, 4) for c in combinations(f, len(f) - distance)] for f in free]
    finer_sql = "array(" + ",".join(_long_array(x) for x in finer) + ")"
    long_lists = lists.where("n > 2").select("c", "key", "n")
    members = posted.join(long_lists, ["c", "key"])
    short = members.where(F.col("n") <= max_list).select("c", "key", F.lit(-1).alias("c2"), F.lit(0).cast("long").alias("key2"), "fp")
    dealt = members.where(F.col("n") > max_list).select(
        "c", "key", F.expr(f"posexplode(transform(element_at({finer_sql}, c + 1), m -> fp & m))").alias("c2", "key2"), "fp"
    )
    grouped = short.unionByName(dealt).groupBy("c", "key", "c2", "key2").agg(F.collect_set("fp").alias("fps"))

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [e for x in batch.column("fps") for e in forest(np.array(x.values, dtype=np.int64), distance)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    return pairs.unionByName(grouped.select("fps").mapInArrow(connect, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, k: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", max_list: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document; the least id that links reach."""
    found = cut(fingerprints(docs, k, 1, id_col, text_col).withColumnRenamed("f0", "fp"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # postings multiply what few rows each hold
    fps = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")).repartition(parts, "fp"))
    comps = connected_components(link_fingerprints(fps.select("fp"), distance, max_list))
    linked = comps.join(fps, F.col("node") == F.col("fp")).select("fp", "comp", "least")
    reach = linked.groupBy("comp").agg(F.min("least").alias("reached"))
    linked = linked.join(reach, "comp").select(F.col("fp").alias("linked_fp"), "reached")
    ids = fps.join(linked, F.col("fp") == F.col("linked_fp"), "left").select(
        F.bitwise_not("fp").alias("key"), F.coalesce("reached", "least").alias("component_id")
    )
    # Joined on the complement, so that both sides are exchanged and a hot value can be split.
    left = found.select("doc_id", "fp", F.bitwise_not("fp").alias("key"))
    return left.join(ids, "key").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Query: all ``documents``, four-word shingles, at most four differing bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
