"""Near-duplicates at a Jaccard similarity of word shingles, exact up to hash collisions.

A text is the set of XXH64 hashes of its k-word shingles. Candidates have a guaranteed
bound: with all shingles in one fixed order, two sets of similarity s or more share one
among the first ``n - ceil(s * n) + 1`` of each (prefix filter), so only these are posted.
The order is rare first, by counts in a sample of texts of fixed size; any order is right,
and this one keeps the lists of common passages short. Met pairs are verified on the sets.

Equal sets are one node. Links are only made as far as components need them:

1. Each list's nodes are compared with its first node, and components are labelled.
2. In lists that still hold several components, all nodes are compared that may link two
   of them: as different pairs, each verified once, or list by list where these are many. Lists longer than ``max_list`` are dealt into blocks of about half that, and
   every two blocks of a list are compared, so that no task holds more than about
   ``max_list`` nodes of a list and every pair of a list meets.

Before sets are fetched, pairs are ruled out by parity bits of each set, in number by its
size: the bits that differ are at most as many as the shingles that do, at any number of
bits to which both are folded, so this rules out no link.

Of each group the least doc_id stays. Null and empty texts are equal to each other. Rows
without an id are always kept. Repeated rows of an id stay or go together; where an id has
different texts, each goes by its own text's group, so that no group goes as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, discard, release, stored, texts
from .components import connected_components
from .simhash import SEED, shingle_hashes

SAMPLE = 5_000
COMMON = 65_536
SLOTS = 1 << 25


def shingle_set(text: str, k: int) -> np.ndarray:
    """The different shingle hashes in rising order."""
    found = list(shingle_hashes(text.encode("utf-8").lower(), k))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def node_of(shingles: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def parity_bits(shingles: np.ndarray) -> bytes:
    """How often each value of the hashes' lowest bits occurs, modulo two; of 9 bits at least, of 17 at most."""
    width = 1 << min(17, max(9, (len(shingles) * 7 // 5).bit_length()))
    counts = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(bits: list[bytes]) -> np.ndarray:
    """Parity bits as rows of 64-bit words, all of the least width among them."""
    least = min(map(len, bits)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.uint64).reshape(-1, least)) for x in bits])


def text_hash(text: Column) -> Column:
    """Of a text or null, which counts as the empty text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def slot_of(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SLOTS))


def may_differ(n: np.ndarray, similarity: float) -> np.ndarray:
    """Each set's share of the shingles in which two sets may differ at ``similarity``."""
    return n * (1 - similarity) / (1 + similarity) + 1e-9


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def linked_forest(prints: np.ndarray, most, linked: Callable[[int, int], bool] | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of 64-bit words.

    Rows link that differ in ``most`` bits at most (given for each row, in the sum of both),
    and of which ``linked`` holds too; rows of one ``known`` group link in any case. The
    first row links to all that it can, then each linked row to what is left, and so on.
    """
    out, left = [], np.arange(len(prints))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop(0)
            d = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1, dtype=np.int64)
            near = d <= (most if np.isscalar(most) else most[left] + most[at])
            sure = known[left] == known[at] if known is not None else np.zeros(len(left), dtype=bool)
            if linked:
                for i in np.flatnonzero(near & ~sure):
                    near[i] = linked(int(at), int(left[i]))
            near |= sure
            out += [(int(at), int(x)) for x in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return out


def dealt(members: DataFrame, max_list: int) -> DataFrame:
    """``members`` (key, n, node, ...) with (i, j): groups of which every pair of a list shares one.

    A list of more than ``max_list`` nodes has blocks of about half that; (i, j) holds two of them.
    """
    blocks = F.when(F.col("n") <= max_list, 1).otherwise(F.ceil(2 * F.col("n") / max_list)).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A block alone is part of each of its groups, so (i, i) is needed only where it is the only one.
    placed = placed.withColumn("other", F.explode(F.expr("filter(sequence(0, blocks - 1), o -> o <> own OR blocks = 1)")))
    return placed.select(*members.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles most frequent in a sample of about ``SAMPLE`` texts, and their counts there."""
    rate = SAMPLE / max(1, docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found = np.concatenate([shingle_set(t.as_py(), k) for t in b.column("text").slice(at, 256)])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    few = docs if rate >= 1 else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)
    rows = few.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r.h for r in rows], dtype=np.int64).view(np.uint64), np.array([r.n for r in rows], dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def rarest(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The shingles of which one at least is shared with each set of ``similarity``."""
    n = len(shingles)
    if not n:
        return shingles
    names, counts = common
    often = np.zeros(n, dtype=np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
        often = np.where(names[at] == shingles, counts[at], 0)
    return shingles[np.argsort(often, kind="stable")][: n - math.ceil(similarity * n - 1e-9) + 1]


def near_groups(
    docs: DataFrame,
    k: int = 5,
    similarity: float = 0.8,
    *,
    max_list: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    by_text: bool = False,
) -> DataFrame:
    """(doc_id, group_id) of every document with an id; group_id is the least id of the group.

    ``by_text`` adds each row's ``text_hash``, which tells the texts of an id apart.
    """
    with batches_of(docs.sparkSession, 1 << 20):
        groups = _near_groups(docs, k, similarity, max_list, id_col, text_col)
    return groups if by_text else groups.drop("text_hash")


def _near_groups(docs: DataFrame, k: int, similarity: float, max_list: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    source = texts(docs, id_col, text_col).where("doc_id IS NOT NULL")
    common = source.sparkSession.sparkContext.broadcast(common_shingles(source, k))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), k) for t in b.column("text")]
            keys = [rarest(x, common.value, similarity).view(np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("text_hash"), pa.array([node_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([parity_bits(x) for x in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "node", "size", "bits", "keys"],
            )

    # Tables with the keys and their lists are the largest; each goes once the next one is written.
    hashed = source.withColumn("text_hash", text_hash(F.col("text")))
    found, found_path = stored(hashed.mapInArrow(digest, "doc_id long, text_hash long, node long, size long, bits binary, keys array<long>"))
    nodes, nodes_path = stored(found.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("size", "bits", "keys"))))
    found = cut(found.select("doc_id", "text_hash", "node"))
    discard(spark, found_path)
    small = cut(nodes.select(F.col("node").alias("member"), "least", "size", "bits"))
    posts = nodes.select(F.explode("keys").alias("key"), "node")
    lists = posts.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1")
    members, members_path = stored(posts.join(lists, "key"))
    discard(spark, nodes_path)
    release(spark)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """``wanted`` (member, ...) with the shingles of each row's node, read off the texts again."""
        wanted = wanted.join(small.select("member", F.col("least").alias("wanted_id")), "member")
        wanted = cut(wanted.withColumn("slot", slot_of("wanted_id")))
        # A bitmap of fixed size keeps most other texts out of the shuffle.
        at = wanted.select(F.shiftright("slot", 15).alias("k"), F.expr("slot & 32767").alias("p"))
        bits = np.zeros(SLOTS // 8, dtype=np.uint8)
        for row in at.groupBy("k").agg(F.bitmap_construct_agg("p").alias("part")).collect():
            bits[row.k * 4096 : row.k * 4096 + 4096] = np.frombuffer(bytes(row.part), dtype=np.uint8)
        shared = source.sparkSession.sparkContext.broadcast(bits)

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                slot = b.column("slot").to_numpy()
                yield b.select(["doc_id", "text"]).filter(pa.array((shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, node, data = None, 0, b""
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part, out = b.slice(at, 256), []
                    for t in part.column("text").to_pylist():
                        if t != last:
                            x = shingle_set(t, k)
                            last, node, data = t, node_of(x), x.tobytes()
                        out.append((node, data))
                    part = part.drop_columns(["text"]).append_column("shingles", pa.array([x[1] for x in out], pa.binary()))
                    # An id may have other texts too.
                    yield part.filter(pa.array(np.array([x[0] for x in out]) == part.column("member").to_numpy()))

        columns = [c for c in wanted.columns if c not in ("wanted_id", "slot")]
        rows = source.withColumn("slot", slot_of("doc_id")).mapInArrow(some, "doc_id long, text string")
        rows = rows.join(wanted, F.col("doc_id") == F.col("wanted_id")).select("text", *columns)
        return rows.mapInArrow(run, ", ".join(f"{c} long" for c in columns) + ", shingles binary")

    def with_both(pairs: DataFrame) -> DataFrame:
        for end in "ab":
            side = small.select(F.col("member").alias(f"{end}_"), *(F.col(c).alias(f"{end}_{c}") for c in ("size", "bits")))
            pairs = pairs.join(side, F.col(end) == F.col(f"{end}_"))
        return pairs.drop("a_", "b_")

    def may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("a_size").to_numpy(), b.column("b_size").to_numpy()
            good = abs(x - y) <= may_differ(x + y, similarity) + 1e-9
            for i in np.flatnonzero(good):
                p, q = folded([b.column("a_bits")[i].as_py(), b.column("b_bits")[i].as_py()])
                good[i] = np.bitwise_count(p ^ q).sum(dtype=np.int64) <= may_differ(x[i] + y[i], similarity) + 1e-9
            yield b.select(["a", "b"]).filter(pa.array(good))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar. Partners of one node meet it in groups of about 64."""
        degree = pairs.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count("*") / 64).alias("groups"))
        placed = cut(pairs.join(degree, F.col("a") == F.col("of")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("group")))
        ends = placed.select("a", "group", F.col("b").alias("member")).union(placed.select("a", "group", F.col("a").alias("member")).distinct())
        # A group's node comes first and its partners pass by, so that one set is held at a time.
        rows = sets_of(ends).select("a", "group", (F.col("member") != F.col("a")).alias("partner"), "member", "shingles")
        rows = rows.repartition("a", "group").sortWithinPartitions("a", "group", "partner", "member")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, first, before, good = None, np.zeros(0, np.uint64), None, False
            for b in batches:
                out: list[tuple[int, int]] = []
                a, group, partner, member = (b.column(c).to_pylist() for c in ("a", "group", "partner", "member"))
                for k, x in enumerate(b.column("shingles")):
                    if not partner[k]:
                        # Rows of a node that recur are alike, as are those of a partner.
                        if (a[k], group[k]) != at:
                            at, first, before = (a[k], group[k]), np.frombuffer(x.as_py(), np.uint64), None
                    elif (a[k], group[k]) == at and member[k] != before:
                        before, good = member[k], similar(first, np.frombuffer(x.as_py(), np.uint64), similarity)
                        out += [(a[k], member[k])] * good
                yield pa.RecordBatch.from_arrays([pa.array([p[e] for p in out], pa.int64()) for e in (0, 1)], names=["a", "b"])

        return cut(rows.mapInArrow(run, "a long, b long"))

    stars = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    stars = cut(with_both(stars).mapInArrow(may_link, "a long, b long"))
    release(spark)
    links = verified(stars)
    release(spark)
    comps = connected_components(links)

    # What the first nodes have not settled: lists of three and more with several components.
    open_lists = members.where("n > 2").join(comps.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    open_lists = cut(open_lists.select("key", "n", "node", F.coalesce("comp", "node").alias("comp")))
    several = open_lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    groups = dealt(open_lists.join(several, "key"), max_list).join(small, F.col("node") == F.col("member"))
    groups = groups.groupBy("key", "i", "j").agg(F.array_sort(F.collect_list(F.struct("node", "comp", "size", "bits"))).alias("rows"))

    def still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each group what may be linked across components: pairs, or its nodes where pairs are over four a node."""
        for b in batches:
            few, many = [], []
            for value in b.column("rows"):
                node, comp, n, bits = (value.values.field(c) for c in ("node", "comp", "size", "bits"))
                bits = bits.to_pylist()
                # By rising width, so that two sets are compared at the lesser width of both.
                order = np.argsort(np.array(list(map(len, bits))), kind="stable")
                node, comp, n, bits = node.to_numpy()[order], comp.to_numpy()[order], n.to_numpy()[order], [bits[k] for k in order]
                most, width, first = may_differ(n, similarity), 0, 0
                keep, pairs = np.zeros(len(node), dtype=bool), []
                for at in range(len(node) - 1):
                    if len(bits[at]) != width:
                        width, first, rows = len(bits[at]), at, folded(bits[at:])
                    other = np.flatnonzero((comp[at + 1 :] != comp[at]) & (abs(n[at + 1 :] - n[at]) <= most[at + 1 :] + most[at])) + at + 1
                    d = np.bitwise_count(rows[other - first] ^ rows[at - first]).sum(axis=1, dtype=np.int64)
                    other = other[d <= most[other] + most[at]]
                    keep[other] = True
                    keep[at] |= len(other) > 0
                    if len(pairs) <= 4 * len(node):
                        pairs += [(int(node[at]), int(x)) for x in node[other]]
                sparse = len(pairs) <= 4 * len(node)
                few.append([{"a": min(p), "b": max(p)} for p in pairs] if sparse else [])
                many.append([] if sparse else [{"node": int(x), "comp": int(c)} for x, c in zip(node[keep], comp[keep], strict=True)])
            pair, row = pa.struct([("a", pa.int64()), ("b", pa.int64())]), pa.struct([("node", pa.int64()), ("comp", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(few, pa.list_(pair)), pa.array(many, pa.list_(row))], names=["pairs", "rows"])

    left = cut(groups.select("rows").mapInArrow(still_open, "pairs array<struct<a:long,b:long>>, rows array<struct<node:long,comp:long>>"))
    discard(spark, members_path)
    release(spark)
    pairs = cut(left.select(F.explode("pairs").alias("p")).select("p.a", "p.b").distinct())
    more = verified(pairs) if pairs.limit(1).count() else None
    dense = left.where(F.size("rows") > 0).select("rows").distinct()
    dense = cut(dense.select(F.monotonically_increasing_id().alias("list"), "rows"))
    release(spark)

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int]] = []
            for value in b.column("rows"):
                node, comp = value.values.field("node").to_numpy(), value.values.field("comp").to_numpy()
                own = [np.frombuffer(x.as_py(), np.uint64) for x in value.values.field("shingles")]
                bits = folded([parity_bits(x) for x in own])
                most = may_differ(np.array(list(map(len, own))), similarity)
                pairs = linked_forest(bits, most, lambda x, y, own=own: similar(own[x], own[y], similarity), comp)
                out += [(int(node[x]), int(node[y])) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([p[e] for p in out], pa.int64()) for e in (0, 1)], names=["a", "b"])

    if dense.limit(1).count():
        rest = dense.select("list", F.explode("rows").alias("row")).select("list", F.col("row.node").alias("member"), "row.comp")
        rest = sets_of(rest).groupBy("list").agg(F.collect_set(F.struct(F.col("member").alias("node"), "comp", "shingles")).alias("rows"))
        dense_links = rest.select("rows").mapInArrow(connect, "a long, b long")
        more = dense_links if more is None else more.union(dense_links)
    if more is not None:
        comps = connected_components(links.union(more))

    comps = comps.withColumnRenamed("node", "member")
    nodes = small.select(F.col("member").alias("node"), "least")
    linked = nodes.join(comps, F.col("node") == F.col("member"))
    reach = linked.groupBy("comp").agg(F.min("least").alias("reached"))
    linked = linked.join(reach, "comp").select(F.col("node").alias("member"), "reached")
    ids = nodes.join(linked, F.col("node") == F.col("member"), "left").select(
        F.bitwise_not("node").alias("key"), F.coalesce("reached", "least").alias("group_id")
    )
    # Joined on the complement, so that both sides are exchanged and a hot value can be split.
    return found.select("doc_id", "text_hash", F.bitwise_not("node").alias("key")).join(ids, "key").select("doc_id", "text_hash", "group_id")


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group, with all its columns."""
    groups = near_groups(docs, by_text=True).where("doc_id <> group_id")
    gone = groups.select(F.col("doc_id").alias("doc_id_that_goes"), F.col("text_hash").alias("text_that_goes")).distinct()
    # An id may have other texts that stay.
    same = (docs["doc_id"].cast("long") == gone["doc_id_that_goes"]) & (text_hash(docs["text"]) == gone["text_that_goes"])
    return docs.join(gone, same, "left_anti")
