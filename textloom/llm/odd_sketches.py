"""Near-duplicates by MinHash bands and odd sketches, each link confirmed on whole shingle sets.

A text is the set of XXH64 hashes of its k-word shingles; equal sets are one node. From a
node's MinHash samples come two things:

* Bands: ``rows`` samples hash to a key, ``bands`` times. A pair of similarity s shares a
  key with probability ``1 - (1 - s ** rows) ** bands``: at 0.85 all but one pair in 10^10.
* The odd sketch: sample i and its value fall on one of 512 bits, and a bit says whether an
  odd number fell there. In the XOR of two sketches equal samples cancel, so its population
  count p tells how many differ, most precisely for similar pairs: the similarity is about
  ``1 + bits / (4 samples) * ln(1 - 2 p / bits)``. Pairs with more differing bits than a pair
  of the asked similarity has with probability 10^-9 (exact distribution, ``most_apart``)
  are no candidates; neither are pairs whose sizes alone rule the similarity out, or of which
  more parity bits of all their shingles differ than shingles may (which is never so for a
  pair that is similar, and tells best for small sets).

Candidates are confirmed by intersecting the sets, which are read off the texts once more for
the nodes that share a key. Links are made as far as components need them, in three rounds:
each node with the most similar of its keys' first nodes; in keys with several components left
a spanning forest by estimated similarity; then every candidate pair across components. So copies are
never expanded into pairs, and no link is lost that bands and sketches let through. Keys with
equal members are looked at once. A key of more than ``max_list`` nodes is dealt into blocks,
every two of which are compared; a key of over 20 times as many is first split by the pairs of
keys its nodes share (a pair at 0.85 shares a second key but in 10^-10 of cases).

Defined results: null and empty texts and those of white space only have no shingles, size
zero and no links; texts under k words are one shingle. A row without an id takes part in
nothing: its component and ``kept`` are null. Repeated rows each give a row and share the
component, and texts under one id are rows of their own. An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, discard, release, stored, table, texts
from .components import connected_components
from .simhash import remix
from .simhash_groups import dealt, may_differ, node_of, shingle_set, similar

BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
WORDS = 8
BITS = 64 * WORDS
#: Words of the parity bits of all shingles, behind those of the samples.
WHOLE = 16
#: Bits of the map that tells which texts are read again; fixed, so a full map only reads more.
SLOTS = 1 << 25
#: Partners that meet one node in a group.
PARTNERS = 256
CHUNK = 1024
#: Lists of so many times ``max_list`` nodes are split by second keys: by then blocks would copy a node as often.
SPLIT = BANDS // 2

_RANDOM = np.random.default_rng(12)
_FACTORS = _RANDOM.integers(0, 1 << 64, SAMPLES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 64, SAMPLES, dtype=np.uint64)


def min_samples(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over the (hashed) shingles."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), CHUNK):
        values = shingles[at : at + CHUNK, None] * _FACTORS
        values += _SHIFTS
        np.minimum(least, values.min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = remix(keys ^ samples.reshape(BANDS, ROWS)[:, j], j + 1)
    return keys.view(np.int64)


def parities(at: np.ndarray, words: int) -> np.ndarray:
    """Whether an odd number fell on each bit, as words of 64."""
    odd = np.bincount(at.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """``WORDS`` words of 64 parity bits of the samples and their numbers."""
    return parities(remix(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 7) >> np.uint64(55), WORDS)


def sketch_of(shingles: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """The odd sketch of the samples, then that of all shingles in ``WHOLE`` words."""
    return np.append(odd_sketch(samples), parities(shingles & np.uint64(64 * WHOLE - 1), WHOLE))


def estimate(apart: int | np.ndarray) -> float | np.ndarray:
    """The similarity of which that many differing bits tell."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(apart) / BITS, 1e-9))


def most_apart(similarity: float, miss: float = 1e-9) -> int:
    """Bits that differ in more with probability ``miss`` at most, at ``similarity`` or above."""
    odd = np.zeros(BITS + 1)
    odd[0] = 1.0
    total, share = np.zeros(BITS + 1), np.arange(BITS + 1) / BITS
    for differing in range(SAMPLES + 1):
        log = math.lgamma(SAMPLES + 1) - math.lgamma(differing + 1) - math.lgamma(SAMPLES - differing + 1)
        log += differing * math.log(1 - similarity) + (SAMPLES - differing) * math.log(similarity)
        total += math.exp(log) * odd
        for _ in range(2):  # both samples fall on a bit each, whose parity turns
            up, down = odd * (1 - share), odd * share
            odd = np.zeros(BITS + 1)
            odd[1:] += up[:-1]
            odd[:-1] += down[1:]
    tail = 1 - np.cumsum(total)
    return int(np.flatnonzero(tail <= miss)[0])


def differing(a: str, b: str, words: range):
    """How many bits of these words of the sketches (columns of 64-bit words) differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in words), F.lit(0))


def listed(posts: DataFrame) -> DataFrame:
    """(key, n, lo, hi) of the keys with several nodes; of keys with equal nodes one. ``posts`` is (key, node)."""
    lists = posts.repartition("key").groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("mark")
    )
    return lists.where("n > 1").groupBy("n", "lo", "hi", "mark").agg(F.min("key").alias("key")).select("key", "n", "lo", "hi")


def members_of(posts: DataFrame, lists: DataFrame) -> DataFrame:
    return posts.join(lists.select(F.col("key").alias("of"), "n", "lo"), F.col("key") == F.col("of")).select("key", "n", "lo", "node")


def forest_by_estimate(comps: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, similarity: float, most: int) -> list[tuple[int, int]]:
    """Pairs of rows that connect components, the most similar by estimate first; one a merger."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    found = [c for at in range(len(comps) - 1) for c in candidates(at, comps, sizes, sketches, similarity, most)]
    out = []
    for _, x, y in sorted(found):
        a, b = top(int(comps[x])), top(int(comps[y]))
        if a != b:
            parent[b] = a
            out.append((x, y))
    return out


def candidates(at: int, comps: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, similarity: float, most: int) -> list[tuple[int, int, int]]:
    """(differing bits, at, other) for rows behind ``at`` in other components that may be similar; sketches are unsigned words."""
    rest = slice(at + 1, None)
    good = (comps[rest] != comps[at]) & (np.minimum(sizes[rest], sizes[at]) >= similarity * np.maximum(sizes[rest], sizes[at]) - 1e-9)
    other = np.flatnonzero(good) + at + 1
    bits = np.bitwise_count(sketches[other] ^ sketches[at])
    apart, whole = (x.sum(axis=1, dtype=np.int64) for x in (bits[:, :WORDS], bits[:, WORDS:]))
    kept = (apart <= most) & (whole <= may_differ(sizes[other] + sizes[at], similarity))
    return [(int(d), at, int(x)) for d, x in zip(apart[kept], other[kept], strict=True)]


def near_duplicates(
    docs: DataFrame, k: int = 3, similarity: float = 0.85, *, id_col: str = "doc_id", text_col: str = "text", max_list: int = 1024
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ``similarity`` is a Jaccard one, of 0.8 and more."""
    with batches_of(docs.sparkSession):
        return _near_duplicates(docs, k, similarity, id_col, text_col, max_list)


def _near_duplicates(docs: DataFrame, k: int, similarity: float, id_col: str, text_col: str, max_list: int) -> DataFrame:
    spark = docs.sparkSession
    source = texts(docs, id_col, text_col)
    most = most_apart(similarity)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, sketches, bands = [], [], [], []
            for t in b.column("text"):
                x = shingle_set(t.as_py(), k)
                samples = min_samples(x) if len(x) else None
                nodes.append(node_of(x) if len(x) else None)
                sizes.append(len(x))
                sketches.append(sketch_of(x, samples) if len(x) else None)
                bands.append(band_keys(samples) if len(x) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, longs), pa.array(bands, longs)],
                names=["doc_id", "node", "size", "sketch", "bands"],
            )

    found, found_path = stored(source.mapInArrow(digest, "doc_id long, node long, size long, sketch array<long>, bands array<long>"))
    with_id = found.where("doc_id IS NOT NULL AND node IS NOT NULL")
    nodes, nodes_path = stored(with_id.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("size", "sketch", "bands"))))
    found = cut(found.select("doc_id", "node", "size"))
    discard(spark, found_path)
    small = cut(nodes.select("node", "least", "size", "sketch"))
    posts = nodes.select(F.explode("bands").alias("key"), "node")
    lists = cut(listed(posts))
    release(spark)
    members, members_path = stored(members_of(posts, lists.where("n > 2")))
    release(spark)

    def with_both(pairs: DataFrame) -> DataFrame:
        """The different pairs (a, b) that may be similar, with ``apart``."""
        for end in "ab":
            side = small.select(F.col("node").alias(f"{end}_"), F.col("size").alias(f"{end}_size"), F.col("sketch").alias(f"{end}_sketch"))
            pairs = pairs.join(side, F.col(end) == F.col(f"{end}_"))
        fits = F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - 1e-9
        sure = differing("a_sketch", "b_sketch", range(WORDS, WORDS + WHOLE)) <= may_differ(F.col("a_size") + F.col("b_size"), similarity)
        return pairs.where(fits & sure).select("a", "b", differing("a_sketch", "b_sketch", range(WORDS)).alias("apart")).where(F.col("apart") <= most)

    stars = members.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    stars = stars.union(lists.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))).distinct()
    stars = cut(with_both(stars))
    release(spark)

    # The sets of all nodes that may have a partner, read off the texts once more.
    wanted = members.select("node").union(stars.select(F.col("a").alias("node"))).union(stars.select("b")).distinct()
    wanted = cut(wanted.join(small.select(F.col("node").alias("n"), "least"), F.col("node") == F.col("n")).select("node", "least"))
    sets, sets_path = stored(_sets(source, wanted, k))
    release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar. The partners of a node meet it in groups, one after the other."""
        degree = pairs.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count("*") / PARTNERS).alias("groups"))
        placed = cut(pairs.join(degree, F.col("a") == F.col("of")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("group")))
        ends = placed.select("a", "group", F.lit(1).alias("turn"), F.col("b").alias("member"))
        ends = ends.union(placed.select("a", "group").distinct().select("a", "group", F.lit(0), "a"))
        rows = ends.join(sets, F.col("member") == F.col("node")).select("a", "group", "turn", "member", "shingles")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, first = None, np.zeros(0, dtype=np.uint64)
            for b in batches:
                out: list[tuple[int, int]] = []
                for a, group, turn, member, data in zip(*(b.column(c).to_pylist() for c in ("a", "group", "turn", "member")), b.column("shingles"), strict=True):
                    own = np.frombuffer(data.as_buffer(), np.uint64)
                    if not turn:
                        at, first = (a, group), own.copy()
                    elif at == (a, group) and similar(first, own, similarity):
                        out.append((a, member))
                yield pa.RecordBatch.from_arrays([pa.array([p[e] for p in out], pa.int64()) for e in (0, 1)], names=["a", "b"])

        rows = rows.repartition("a", "group").sortWithinPartitions("a", "group", "turn")
        out = cut(rows.mapInArrow(run, "a long, b long").distinct())
        release(spark)
        return out

    def labelled(rows: DataFrame, comps: DataFrame, column: str = "node") -> DataFrame:
        """Adds the component of each node, itself where it has no links."""
        there = comps.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
        joined = rows.join(there, F.col(column) == F.col("_node"), "left")
        return joined.select(*rows.columns, F.coalesce("_comp", column).alias(f"{column}_comp"))

    def open_lists(members: DataFrame, comps: DataFrame) -> DataFrame:
        """(key, i, j, node): the lists that still have several components, in groups of which each pair of nodes shares one."""
        left = cut(labelled(members, comps))
        several = left.groupBy("key").agg(F.min("node_comp").alias("x"), F.max("node_comp").alias("y")).where("x <> y").select(F.col("key").alias("open_key"))
        left = left.join(several, F.col("key") == F.col("open_key")).select("key", "n", "node")
        long = cut(left.where(F.col("n") > SPLIT * max_list).select("key", "node"))
        if long.limit(1).count():
            finer = long.join(nodes.select(F.col("node").alias("m"), "bands"), F.col("node") == F.col("m"))
            finer = finer.select("key", "node", F.explode("bands").alias("band")).where("band <> key").select(F.xxhash64("key", "band").alias("key"), "node")
            finer = cut(finer)
            left = left.where(F.col("n") <= SPLIT * max_list).unionByName(members_of(finer, listed(finer)).select("key", "n", "node"))
        return cut(dealt(left, max_list).select("key", "i", "j", "node"))

    def open_groups(placed: DataFrame, comps: DataFrame) -> DataFrame:
        """(rows) of each group that still has several components."""
        rows = labelled(placed, comps).join(small.select(F.col("node").alias("m"), "size", "sketch"), F.col("node") == F.col("m"))
        rows = rows.groupBy("key", "i", "j").agg(
            F.array_sort(F.collect_list(F.struct("node", "node_comp", "size", "sketch"))).alias("rows"), F.min("node_comp").alias("x"), F.max("node_comp").alias("y")
        )
        return rows.where("x <> y").select("rows")

    def pairs_in(blocks: DataFrame, whole: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for value in b.column("rows"):
                    node, comp, size = (value.values.field(c).to_numpy() for c in ("node", "node_comp", "size"))
                    sketch = value.values.field("sketch").flatten().to_numpy().view(np.uint64).reshape(len(node), WORDS + WHOLE)
                    if whole:
                        steps = ([(x, y) for _, x, y in candidates(at, comp, size, sketch, similarity, most)] for at in range(len(node) - 1))
                    else:
                        steps = iter([forest_by_estimate(comp, size, sketch, similarity, most)])
                    for pairs in steps:
                        if pairs:
                            x, y = (node[[p[e] for p in pairs]] for e in (0, 1))
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        return blocks.mapInArrow(run, "a long, b long").distinct()

    def across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        both = labelled(labelled(pairs.select("a", "b"), comps, "a"), comps, "b")
        return both.where("a_comp <> b_comp").select("a", "b")

    best = stars.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")
    tested = best = cut(best)
    links = verified(best)
    comps = connected_components(links)
    placed = open_lists(members, comps)
    for whole in (False, True):
        pairs = pairs_in(open_groups(placed, comps), whole).union(across(stars, comps)).distinct()
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"))
        release(spark)
        if not pairs.limit(1).count():
            continue
        tested, links = tested.union(pairs), links.union(verified(pairs))
        comps = connected_components(links)
    for path in (nodes_path, members_path, sets_path):
        discard(spark, path)

    linked = small.select("node", "least").join(comps.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).select("node", "least", "comp")
    reach = linked.groupBy("comp").agg(F.min("least").alias("reached"))
    linked = linked.join(reach, "comp").select(F.col("node").alias("m"), "reached")
    ids = small.select("node", "least").join(linked, F.col("node") == F.col("m"), "left")
    ids = ids.select(F.bitwise_not("node").alias("key"), F.coalesce("reached", "least").alias("reached"))
    # Joined on the complement, so that both sides are exchanged and a hot value can be split.
    left = found.select("doc_id", "size", F.when(F.col("doc_id").isNotNull(), F.bitwise_not("node")).alias("key"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("reached", "doc_id"))
    return left.join(ids, "key", "left").select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _sets(source: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the ``wanted`` (node, least). A map of fixed size keeps most other texts out of the shuffle."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    at = wanted.select(slot("least").alias("slot")).select(F.shiftright("slot", 15).alias("k"), F.expr("slot & 32767").alias("p"))
    bits = np.zeros(SLOTS // 8, dtype=np.uint8)
    for row in at.groupBy("k").agg(F.bitmap_construct_agg("p").alias("part")).collect():
        bits[row.k * 4096 : row.k * 4096 + 4096] = np.frombuffer(bytes(row.part), dtype=np.uint8)
    shared = source.sparkSession.sparkContext.broadcast(bits)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = b.column("slot").to_numpy()
            kept = pa.array((shared.value[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool))
            part, out, nodes = b.filter(kept), [], []
            for t in part.column("text"):
                x = shingle_set(t.as_py(), k)
                out.append(x.tobytes())
                nodes.append(node_of(x))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "own", "shingles"])

    rows = source.where("doc_id IS NOT NULL").withColumn("slot", slot("doc_id")).mapInArrow(some, "doc_id long, own long, shingles binary")
    # An id may have other texts too, and repeated rows.
    return rows.join(wanted, (F.col("doc_id") == F.col("least")) & (F.col("own") == F.col("node"))).select("node", "shingles")


def op12_odd_sketches(spark, sf_dir: str) -> DataFrame:
    """Query: all ``documents``, three-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))
