"""Language-model scores from a hierarchical Pitman-Yor model.

Every preceding token (the end token, at a text's start) is a context with a restaurant of
its own; all restaurants share the unigram restaurant as parent, whose base is uniform over
the V known tokens and one unknown. A context's customers for a token are the times that the
token follows it; each of their tables sends one customer to the parent.

* Gathering: texts are read in blocks; a block's (token, context) pairs go to buckets by
  token with the counts of the rows they occur in. A bucket, of about ``BUCKET`` tokens
  whatever the corpus, is a row of arrays. A token that is a good part of a bucket in a sample
  (at most ``MOST_HOT`` of them) is dealt by its pairs, so no bucket grows with a frequent token.
* Gibbs passes: all customers of a pair leave their tables and are drawn anew together, given
  the parent's probability and the context's totals of the pass before: up to ``EXACT`` of
  them from their exact conditional, more of them by Metropolis-Hastings steps that keep it
  and cost as much as there are tables. The parent's tables are drawn from their exact
  conditional up to ``EXACT`` customers of a token and carried on one by one beyond.
* Totals of contexts, and of tokens in several buckets, meet in a shuffle: each bucket sends
  one partial sum for each of its keys and gets the total back. Only histograms (at most a
  few hundred bins) come to the driver, which draws discount and strength from them by
  auxiliary variables; values over 1,024 are binned there at 16 bins an octave.
* Scores: the predictive probabilities of the kept passes are averaged pair by pair, summed
  for each row of a bucket and then for each row.

Tokens are told apart by XXH64, contexts by 48 bits of it. Texts: A-Z lower-cased, words are runs without ASCII white
space, then one end token. Null and empty texts are the end token alone. A null id counts
as the empty text in the choice of held-out rows. Repeated rows are scored each on its own.
An empty table has no rows. Without training rows N and V are 0 and the model is its base.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, release, shared_folder, stored, texts
from .simhash import remix, word_blocks

END = b""
FLUSH = 2_000_000
MOST_DOCS = 65_536
BUCKET = 2_000_000
MOST_HOT = 1 << 20
EXACT = 256
#: Steps a pass over whole pairs of more than ``EXACT`` customers, and as many over groups of about ``GROUP`` of their tables.
STEPS = 4
GROUP = 8
CONTEXT_BITS = (1 << 48) - 1
BLOB = "kind int, p int, q long, n long, data binary"
STATE, POSTS, ROWS = 0, 1, 2
ANSWER, STAT = 0, 1
IN_CONTEXT, IN_TABLES, AT_TABLE, AT_ROOT, SUMS = range(5)
N_TRAIN, N_TABLES, N_TYPES, N_ROOT_TABLES = range(4)


def is_held_out(doc) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; whole numbers in the narrowest type that holds them."""

    def narrow(x: np.ndarray) -> np.ndarray:
        if x.dtype.kind in "iu" and len(x) and x.min() >= 0 and x.max() < 1 << 32:
            return x.astype(np.min_scalar_type(int(x.max())))
        return x

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([narrow(x) for x in arrays], protocol=5))


def unpack(data: bytes) -> list[np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context keys (48 bits) in two columns."""
    return (keys >> 16).astype(np.uint32), (keys & 0xFFFF).astype(np.uint16)


def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.int64) << 16 | low


def blob(kind: int, p: int, q: int, n: int, data: bytes | None) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((kind, p, q, n, data), kinds, strict=True)], names=[c.split()[0] for c in BLOB.split(", ")])


def blobs(spark, path: str, kind: int) -> DataFrame:
    return spark.read.schema(BLOB).parquet(path).select(*(c.split()[0] for c in BLOB.split(", "))).where(F.col("kind") == kind)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by ``key``, group by group."""
    at, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if row[key] != at and held:
                yield at, held
                held = []
            at = row[key]
            held.append(row)
    if held:
        yield at, held


def dealt_to(keys: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (remix(keys.view(np.uint64), 7) % np.uint64(parts)).astype(np.int64)


def found(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


class Tokens:
    """Numbers tokens as they come, and hashes them."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.number[END]

    def of(self, text: str) -> np.ndarray:
        """The numbers of a text's tokens, the end token last."""
        parts = [np.fromiter(map(self.number.__getitem__, w), np.int64, len(w)) for w in word_blocks(text.encode().lower())]
        return np.concatenate([*parts, [0]])

    def hashed(self) -> np.ndarray:
        if len(self.number) > len(self.hashes):
            new = list(self.number)[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
        return self.hashes.view(np.int64)


def frequent_tokens(docs: DataFrame, share: float, sample: float) -> np.ndarray:
    """The sorted hashes of tokens that are over one in ``share`` of a sample of texts: fewer than ``share``.

    They decide where pairs lie, not what they count.
    """
    few = docs if sample >= 1 else docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < int(sample * (1 << 30)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pending, size = Tokens(), [], 0

        def counted() -> pa.RecordBatch:
            n = np.bincount(np.concatenate([*pending, np.zeros(0, np.int64)]), minlength=1)
            return pa.RecordBatch.from_arrays([pa.array(np.append(tokens.hashed()[: len(n)], 0)), pa.array(np.append(n, -size))], names=["token", "n"])

        for b in batches:
            for text in b.column("text"):
                pending.append(tokens.of(text.as_py()))
                size += len(pending[-1])
                if size > FLUSH:
                    yield counted()
                    tokens.clear()
                    pending, size = [], 0
        yield counted()

    counts, path = stored(few.select("text").mapInArrow(run, "token long, n long").groupBy("token", (F.col("n") < 0).alias("all")).agg(F.sum("n").alias("n")))
    total = -(counts.where("all").agg(F.sum("n")).first()[0] or 0)
    hot = counts.where(~F.col("all") & (F.col("n") > total / share)).select("token").toArrow()["token"].to_numpy()
    discard(docs.sparkSession, path)
    return np.sort(hot)


def gather(docs: DataFrame, hot: np.ndarray, buckets: int, asked: int, path: str) -> None:
    """Write the buckets' pairs (kind STATE), their rows (POSTS) and the rows of each block (ROWS)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def block(number: int, tokens: Tokens, pending: list) -> Iterator[pa.RecordBatch]:
        ids = [x for _, x in pending]
        held = np.array([is_held_out(d) for d, _ in pending], dtype=bool)
        sizes = np.array([len(x) for x in ids])
        names = np.array([0 if d is None else d for d, _ in pending], dtype=np.int64)
        none = np.array([d is None for d, _ in pending], dtype=bool)
        yield blob(ROWS, number % buckets, number, 0, pickle.dumps([names, none, held, sizes]))
        now = np.concatenate(ids)
        before = np.concatenate([[0], now[:-1]])  # the end token of the text before is every text's context
        hashed, k = tokens.hashed(), len(tokens.number)
        pair, doc = now * k + before, np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(pair, kind="stable")
        pair, doc = pair[order], doc[order]
        start = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])))
        many = np.diff(np.append(start, len(pair)))
        pair, doc = pair[start], doc[start]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        posts = np.diff(np.append(first, len(pair)))
        n = np.add.reduceat(np.where(held[doc], 0, many), first)
        token, context = hashed[pair[first] // k], hashed[pair[first] % k] & CONTEXT_BITS
        with np.errstate(over="ignore"):
            salted = np.where(found(token, shared.value), token ^ remix(context.view(np.uint64), 3).view(np.int64), token)
        # Small whole numbers are sorted by their digits.
        place = dealt_to(salted, buckets).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        by = np.argsort(place, kind="stable")
        rows = np.argsort(np.repeat(place, posts), kind="stable")
        doc, many = doc[rows], many[rows]
        token, context, n, posts = token[by], context[by], n[by], posts[by]
        ends = np.cumsum(np.bincount(place, minlength=buckets))
        row_ends = np.append(0, np.cumsum(posts))
        for p, (a, z) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
            if a < z:
                r = slice(row_ends[a], row_ends[z])
                yield blob(STATE, p, number, 0, pack(token[a:z], *split(context[a:z]), n[a:z], posts[a:z], doc[r], many[r]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pending, size = Tokens(), [], 0
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                pending.append((doc.as_py(), tokens.of(text.as_py())))
                size += len(pending[-1][1])
                if size > FLUSH or len(pending) == MOST_DOCS:
                    yield from block(number, tokens, pending)
                    pending, size, number = [], 0, number + 1
                    if len(tokens.number) > 1_000_000:
                        tokens.clear()
        if pending:
            yield from block(number, tokens, pending)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in groups(batches, "p"):
            for r in rows:
                if r["kind"] == ROWS:
                    yield blob(ROWS, p, r["q"], 0, r["data"])
            rows = sorted((r for r in rows if r["kind"] == STATE), key=lambda r: r["q"])
            if not rows:
                continue
            blocks = np.array([r["q"] for r in rows], dtype=np.int64)
            got = [unpack(r["data"]) for r in rows]
            token, high, low, n, posts, doc, many = (np.concatenate([x[i] for x in got]).astype(np.int64) for i in range(7))
            context = joined(high, low)
            of_block = np.repeat(np.arange(len(got)), [len(x[5]) for x in got])
            order = np.lexsort((context, token))
            first = np.append(True, (np.diff(token[order]) != 0) | (np.diff(context[order]) != 0))
            pair = np.empty(len(token), dtype=np.int64)
            pair[order] = np.cumsum(first) - 1
            owner = np.repeat(pair, posts)
            by = np.argsort(owner, kind="stable")
            token, context = token[order][first], context[order][first]
            c = np.bincount(pair, n).astype(np.int64)
            keys, of_token = np.unique(token, return_inverse=True)
            contexts, of_context = np.unique(context, return_inverse=True)
            at = np.lexsort((contexts, dealt_to(contexts, asked)))
            moved = np.empty(len(at), dtype=np.int64)
            moved[at] = np.arange(len(at))
            state = State(keys, of_token, found(keys, shared.value), contexts[at], moved[of_context], c, np.minimum(c, 1), c[c > 1], [])
            yield blob(STATE, p, 0, 0, state.pack())
            yield blob(POSTS, p, 0, 0, pack(np.bincount(owner), blocks, of_block[by], doc[by], many[by]))

    rows = docs.mapInArrow(run, BLOB).repartitionById(buckets, "p").sortWithinPartitions("p").mapInArrow(merge, BLOB)
    rows.write.partitionBy("kind").parquet(path)


@dataclass
class State:
    """A bucket: its pairs by token, customers and tables, and the sizes of tables of pairs with two customers or more."""

    tokens: np.ndarray
    of_token: np.ndarray
    hot: np.ndarray
    contexts: np.ndarray
    of_context: np.ndarray
    c: np.ndarray
    t: np.ndarray
    sizes: np.ndarray
    kept: list[np.ndarray]

    def pack(self) -> bytes:
        return pack(self.tokens, np.diff(self.of_token, prepend=0), self.hot, *split(self.contexts), self.of_context, self.c, self.t, self.sizes, *self.kept)

    @staticmethod
    def unpack(data: bytes) -> State:
        tokens, steps, hot, high, low, of_context, c, t, sizes, *kept = unpack(data)
        whole = lambda x: x.astype(np.int64)
        return State(whole(tokens), whole(np.cumsum(steps)), hot, joined(high, low), whole(of_context), whole(c), whole(t), whole(sizes), kept)

    def sums(self, n: np.ndarray, by: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(by, n, size).astype(np.int64)

    def shared_tokens(self, asked: int) -> np.ndarray:
        """Numbers of the tokens whose sums other buckets share, in the order of asking."""
        at = np.flatnonzero(self.hot)
        return at[np.lexsort((self.tokens[at], dealt_to(self.tokens[at], asked)))]


@dataclass
class Params:
    """What a pass is given: the parameters, global sums, and the parent's tables by customers."""

    discount: float = 0.7
    strength: float = 1.0
    root_discount: float = 0.7
    root_strength: float = 1.0
    sums: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    steps: np.ndarray = field(default_factory=lambda: root_table(0.7, 0.7))
    root_new: float = 0.7
    number: int = 0

    def base(self) -> float:
        return 1.0 / (self.sums[N_TYPES] + 1.0)


def root_table(new: float, discount: float) -> np.ndarray:
    """Row n, column t: the chance of at most t tables for n customers, as new^t S(n, t) has it."""
    with np.errstate(divide="ignore"):
        log_s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        log_s[1, 1] = math.log(new)
        t = np.arange(EXACT + 1)
        for n in range(1, EXACT):
            stay = log_s[n] + np.log(np.maximum(n - discount * t, 1e-300))
            log_s[n + 1] = np.logaddexp(stay, np.append(-np.inf, log_s[n, :-1] + math.log(new)))
        top = np.exp(log_s[1:] - log_s[1:].max(axis=1, keepdims=True))
    out = np.ones((EXACT + 1, EXACT + 1))
    out[1:] = np.cumsum(top, axis=1) / top.sum(axis=1, keepdims=True)
    return out


def root_tables(keys: np.ndarray, customers: np.ndarray, g: Params) -> np.ndarray:
    """Each token's tables in the parent restaurant: a draw that is the same wherever it is made."""
    with np.errstate(over="ignore"):
        u = (remix(keys.view(np.uint64) ^ np.uint64(0x5DEECE66D * (g.number + 1)), 11) >> np.uint64(11)).astype(np.float64) / 2.0**53
    n = np.minimum(customers, EXACT)
    t = n.copy()  # of one customer, one table
    low = 2
    for high in (4, 16, 64, EXACT):
        band = np.flatnonzero((n >= low) & (n <= high))
        for a in range(0, len(band), 1 << 14):
            at = band[a : a + (1 << 14)]
            t[at] = (g.steps[n[at], : high + 1] < u[at, None]).sum(axis=1)
        low = high + 1
    for i in np.flatnonzero(customers > EXACT).tolist():
        rng = np.random.default_rng([g.number, int(keys[i]) & (2**63 - 1)])
        t[i] = carry_on(int(t[i]), EXACT, int(customers[i]), g.root_new, g.root_discount, rng)
    return t


def carry_on(t: int, done: int, n: int, new: float, discount: float, rng) -> int:
    """Tables after customers ``done`` .. n - 1 come one by one; a customer sits alone with weight ``new``."""
    while done < n:
        step = min(n - done, 1 << 16)
        seated = np.arange(done, done + step)
        u = rng.random(step)
        # Alone if u < new / (new + seated - discount * t), that is if t > limit.
        limit = (new + seated - new / np.maximum(u, 1e-300)) / discount
        likely = np.flatnonzero(limit < t + 64)
        before = t
        for k in likely.tolist():
            if limit[k] < t:
                t += 1
                if t >= before + 64:
                    break
        done += (k + 1) if len(likely) and t >= before + 64 else step
    return t


def reseat(sizes: np.ndarray, t: np.ndarray, c: np.ndarray, new: np.ndarray, discount: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """One customer of each pair leaves its table and is drawn to one; (sizes, t) after that: the plain step of the passes' chain.

    ``sizes`` holds the pairs' tables one after another; a new table has weight ``new``, a table of
    n others n - discount.
    """
    ends = np.cumsum(t)
    starts = ends - t
    up_to = np.cumsum(sizes)
    base = up_to[starts] - sizes[starts]
    left = np.searchsorted(up_to, base + np.minimum((rng.random(len(c)) * c).astype(np.int64), c - 1), side="right")
    sizes = sizes.copy()
    sizes[left] -= 1
    empty = sizes[left] == 0
    others = t - empty
    alone = rng.random(len(c)) * (new + c - 1 - discount * others) < new
    weight = np.where(sizes > 0, sizes - discount, 0.0)
    up_to = np.cumsum(weight)
    low = up_to[starts] - weight[starts]
    to = np.searchsorted(up_to, low + rng.random(len(c)) * (up_to[ends - 1] - low), side="right")
    to = np.clip(to, starts, ends - 1)
    # Rounding may point at an emptied table; its pair's customer goes back there then.
    sizes[to[~alone]] += 1
    sizes[left[alone & empty]] = 1
    more, at = alone & ~empty, ends[alone & ~empty]
    keep = sizes > 0
    t = t + more - (~keep[left] & ~alone & empty)
    grown = np.insert(sizes, at, 1)
    return (grown[np.insert(keep, at, True)] if len(at) else sizes[keep]), t


def log_seatings(discount: float) -> np.ndarray:
    """Row n, column t: the logarithm of the weights of all seatings of n customers at t tables, up to ``EXACT``."""
    log_s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    log_s[1, 1] = 0.0
    t = np.arange(EXACT + 1)
    for n in range(1, EXACT):
        stay = log_s[n] + np.log(np.maximum(n - discount * t, 1e-300))
        log_s[n + 1] = np.logaddexp(stay, np.append(-np.inf, log_s[n, :-1]))
    return log_s


def seated(c: np.ndarray, new: np.ndarray, discount: float, log_s: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """All customers (2 to ``EXACT``) of each pair drawn at once from their exact conditional: (sizes, t).

    The tables' number has weight new^t times the weights of its seatings; who opens a table
    is drawn from the last customer back, and who joins one takes the table of a former
    customer, of weight 1, or 1 - discount where that one opened it.
    """
    t, out, pairs, low = np.ones(len(c), dtype=np.int64), [], [], 2
    for high in (4, 16, 64, EXACT):
        band = np.flatnonzero((c >= low) & (c <= high))
        k, low = np.arange(1, high + 1), high + 1
        for a in range(0, len(band), (1 << 20) // high):
            at = band[a : a + (1 << 20) // high]
            w = log_s[c[at], 1 : high + 1] + k * np.log(np.maximum(new[at], 1e-300))[:, None]
            w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[at] = 1 + np.minimum((w < rng.random(len(at))[:, None] * w[:, -1:]).sum(axis=1), c[at] - 1)
            at = at[(t[at] > 1) & (t[at] < c[at])]
            n_at, left, rows = c[at], t[at].copy(), np.arange(len(at))
            opens = np.zeros((high + 1, len(at)), dtype=bool)
            for n in range(high, 1, -1):
                with np.errstate(invalid="ignore"):
                    chance = np.exp(log_s[n - 1, left - 1] - log_s[n, left])
                opens[n] = (n_at >= n) & (rng.random(len(at)) < chance)
                left -= opens[n]
            size, joined_at = np.zeros((len(at), high), dtype=np.int64), np.zeros((len(at), high), dtype=np.int64)
            size[:, 0], tables, joined = 1, np.ones(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
            for n in range(2, high + 1):
                u, v = rng.random((2, len(at)))
                first = u * (n - 1 - discount * tables) < (1 - discount) * tables
                to = np.where(first | (joined == 0), (v * tables).astype(np.int64), joined_at[rows, (v * joined).astype(np.int64)])
                to, here = np.where(opens[n], tables, to), n_at >= n
                size[rows[here], to[here]] += 1
                tables += opens[n]
                joins = here & ~opens[n]
                joined_at[rows[joins], joined[joins]] = to[joins]
                joined += joins
            which, place = np.nonzero(size)
            out.append(size[which, place])
            pairs.append(at[which])
    plain = np.flatnonzero((t == 1) | (t == c))
    out.append(np.repeat(np.where(t[plain] == 1, c[plain], 1), t[plain]))
    pairs.append(np.repeat(plain, t[plain]))
    return np.concatenate(out)[np.argsort(np.concatenate(pairs), kind="stable")], t


def redrawn(sizes: np.ndarray, t: np.ndarray, c: np.ndarray, new: np.ndarray, discount: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """All customers of each pair leave and are drawn at once, by a Metropolis-Hastings step: (sizes, t).

    Tables are a Poisson number, new / discount on average, of Sibuya sizes, given their sum c.
    A random customer's table takes what the others, drawn freely, leave over; any tilt x^size
    of the others is right, and that with about c customers in them is taken. The steps' cost
    is that of the tables, however many customers sit there.
    """
    low, high = np.full(len(c), -700.0), np.zeros(len(c))
    for _ in range(60):
        mid = (low + high) / 2
        over = (c - 1) * np.exp(mid * (1 - discount)) > new * -np.expm1(mid)
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    log_x = np.log1p(-np.exp(np.minimum(low, -1e-12)))

    def weight(m: np.ndarray) -> np.ndarray:
        out = -discount * np.log(m) + discount * (1 + discount) / (2 * m)
        few = np.flatnonzero(m < 10_000)
        out[few] = [math.log(x) + math.lgamma(x - discount) - math.lgamma(x + 1) for x in m[few].tolist()]
        return out + m * log_x

    starts, up_to = np.cumsum(t) - t, np.cumsum(sizes)
    marked = np.searchsorted(up_to, up_to[starts] - sizes[starts] + np.minimum((rng.random(len(c)) * c).astype(np.int64), c - 1), side="right")
    owner = np.repeat(np.arange(len(c)), rng.poisson(new / discount * np.exp(log_x)))
    with np.errstate(divide="ignore", invalid="ignore"):
        y = np.floor(np.log(1 - rng.random(len(owner))) / np.log1p(-rng.beta(discount, 1 - discount, len(owner)))) + 1
    y = np.minimum(np.nan_to_num(y, nan=np.inf, posinf=np.inf), c[owner] + 1.0)
    kept = np.log(1 - rng.random(len(owner))) <= (y - 1) * log_x[owner]
    y, owner = y[kept].astype(np.int64), owner[kept]
    rest = c - np.bincount(owner, y, len(c)).astype(np.int64)
    ratio = weight(np.maximum(rest, 1).astype(float)) - weight(sizes[marked].astype(float))
    moves = (rest >= 1) & (np.log(1 - rng.random(len(c))) <= ratio)
    was, mine = np.repeat(np.arange(len(c)), t), moves[owner]
    stay = ~moves[was]
    pair = np.concatenate([was[stay], np.flatnonzero(moves), owner[mine]])
    return np.concatenate([sizes[stay], rest[moves], y[mine]])[np.argsort(pair, kind="stable")], np.bincount(pair, minlength=len(c))


def redrawn_by_groups(sizes: np.ndarray, t: np.ndarray, c: np.ndarray, new: np.ndarray, discount: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """``redrawn`` for whole pairs, then for random groups of about ``GROUP`` tables, in which few steps are turned down.

    Tables go to a pair's groups at random, so the tables of one of its k groups have weight
    new / k, given their customers, and groups are independent.
    """
    for _ in range(STEPS):
        sizes, t = redrawn(sizes, t, c, new, discount, rng)
    k = np.ceil(np.minimum(new / discount, c) / GROUP).astype(np.int64).clip(1)
    pair = np.repeat(np.arange(len(c)), t)
    group = (np.cumsum(k) - k)[pair] + (rng.random(len(pair)) * k[pair]).astype(np.int64)
    order = np.argsort(group, kind="stable")
    groups, own_t = np.unique(group, return_counts=True)
    sizes, of = sizes[order], np.searchsorted(np.cumsum(k), groups, side="right")
    own_c = np.add.reduceat(sizes, np.cumsum(own_t) - own_t)
    for _ in range(STEPS):
        sizes, own_t = redrawn(sizes, own_t, own_c, new[of] / k[of], discount, rng)
    return sizes, np.bincount(of, own_t, len(c)).astype(np.int64)


def gibbs(s: State, g: Params, totals: tuple[np.ndarray, np.ndarray, np.ndarray], rng) -> None:
    """Draw all of the bucket's customers anew, in place."""
    context_c, context_t, parent = totals
    multi = np.flatnonzero(s.c > 1)
    if not len(multi):
        return
    c, t = s.c[multi], s.t[multi]
    new = (g.strength + g.discount * context_t[s.of_context[multi]]) * parent[s.of_token[multi]]
    few = c <= EXACT
    small, many = np.flatnonzero(few), np.flatnonzero(~few)
    sizes, t[small] = seated(c[small], new[small], g.discount, log_seatings(g.discount), rng)
    if len(many):
        own, own_t = redrawn_by_groups(s.sizes[np.repeat(~few, s.t[multi])], t[many], c[many], new[many], g.discount, rng)
        pair = np.concatenate([np.repeat(small, t[small]), np.repeat(many, own_t)])
        t[many] = own_t
        sizes = np.concatenate([sizes, own])[np.argsort(pair, kind="stable")]
    s.t[multi], s.sizes = t, sizes


def binned(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, numbers) of positive values; exact up to 1,024, then 16 bins an octave."""
    v = values[values > 0]
    b = np.where(v <= 1024, v, 1024 + np.ceil(16 * np.log2(np.maximum(v, 1) / 1024.0))).astype(np.int64)
    n = np.bincount(b) if len(b) else np.zeros(0, np.int64)
    at = np.flatnonzero(n)
    return at, n[at]


def unbinned(b: np.ndarray) -> np.ndarray:
    return np.where(b <= 1024, b, 1024 * 2.0 ** ((b - 1024.5) / 16))


def ask(state: DataFrame, g: Params, asked: int) -> DataFrame:
    """A bucket's partial sums: a row for each part that adds them up, and its own histograms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column("p").to_pylist(), b.column("data").to_pylist(), strict=True):
                s = State.unpack(data)
                at = s.shared_tokens(asked)
                sides = []
                for keys, n, by in ((s.contexts, len(s.contexts), s.of_context), (s.tokens[at], len(s.tokens), s.of_token)):
                    sums = [s.sums(x, by, n) for x in (s.c, s.t)]
                    if by is s.of_token:
                        mine = np.flatnonzero(~s.hot)
                        own = [x[mine] for x in sums]
                        sums = [x[at] for x in sums]
                    sides.append((keys, *sums, np.searchsorted(dealt_to(keys, asked), np.arange(asked + 1))))
                known = own[0] > 0
                stats = [*binned(s.sizes), *binned(own[1])]
                sums = np.array([int(known.sum()), int(root_tables(s.tokens[mine], own[1], g).sum())])
                for q in range(asked):
                    (u, *u_sums), (w, *w_sums) = ([x[e[q] : e[q + 1]] for x in side] for *side, e in sides)
                    parts = [*split(u), *u_sums, w, *w_sums]
                    mine_too = [*stats, sums] if q == p % asked else [np.zeros(0, np.int64)] * 5
                    if any(map(len, parts)) or q == p % asked:
                        yield blob(ANSWER, p, q, 0, pack(*parts, *mine_too))

    return state.mapInArrow(run, BLOB)


def answer(asks: DataFrame, g: Params, asked: int) -> DataFrame:
    """The totals of the keys in each ask, in its order (kind ANSWER), and histograms (kind STAT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, rows in groups(batches, "q"):
            got = [(joined(high, low), *rest) for high, low, *rest in (unpack(r["data"]) for r in rows)]
            out: list[list[np.ndarray]] = [[] for _ in rows]
            stats: dict[tuple[int, int], int] = defaultdict(int)
            for side in (0, 3):
                asked_keys = np.concatenate([x[side] for x in got]).astype(np.int64)
                order = np.argsort(asked_keys, kind="stable")  # merges the asks, which are sorted each
                first = np.flatnonzero(np.append(True, np.diff(asked_keys[order]) != 0)) if len(order) else order
                keys, group = asked_keys[order][first], np.empty(len(order), dtype=np.int64)
                group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
                c, t = (np.add.reduceat(np.concatenate([x[side + i] for x in got]).astype(np.int64)[order], first) if len(first) else order for i in (1, 2))
                ends = np.cumsum([len(x[side]) for x in got])
                for k, (a, z) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
                    out[k] += [c[group[a:z]], t[group[a:z]]]
                hists = [(IN_CONTEXT, *binned(c)), (IN_TABLES, *binned(t))] if side == 0 else [(AT_ROOT, *binned(t))]
                for which, bins, n in hists:
                    for b, x in zip(bins.tolist(), n.tolist(), strict=True):
                        stats[which, b] += x
                if side == 0:
                    stats[SUMS, N_TRAIN] += int(c.sum())
                    stats[SUMS, N_TABLES] += int(t.sum())
                else:
                    stats[SUMS, N_TYPES] += int((c > 0).sum())
                    stats[SUMS, N_ROOT_TABLES] += int(root_tables(keys, t, g).sum())
            for *_, size_bins, size_n, root_bins, root_n, sums in got:
                for which, bins, n in ((AT_TABLE, size_bins, size_n), (AT_ROOT, root_bins, root_n)):
                    for b, x in zip(bins.tolist(), n.tolist(), strict=True):
                        stats[which, b] += x
                if len(sums):
                    stats[SUMS, N_TYPES] += int(sums[0])
                    stats[SUMS, N_ROOT_TABLES] += int(sums[1])
            for r, arrays in zip(rows, out, strict=True):
                yield blob(ANSWER, r["p"], q, 0, pack(*arrays))
            for (which, b), n in stats.items():
                yield blob(STAT, which, b, n, None)

    return asks.repartitionById(asked, F.col("q").cast("int")).sortWithinPartitions("q", "p").mapInArrow(run, BLOB)


def totals_of(s: State, t: np.ndarray, parts: list[bytes], g: Params, asked: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Customers and tables of the bucket's contexts, and probability and training count of its tokens, with the pairs' tables ``t``."""
    got = [unpack(x) for x in parts]
    context_c, context_t, hot_c, hot_t = (np.concatenate([x[i] for x in got]).astype(np.int64) if got else np.zeros(0, np.int64) for i in range(4))
    n = len(s.tokens)
    c, up = s.sums(s.c, s.of_token, n), s.sums(t, s.of_token, n)
    at = s.shared_tokens(asked)
    c[at], up[at] = hot_c, hot_t
    spare = (g.root_strength + g.root_discount * g.sums[N_ROOT_TABLES]) * g.base()
    parent = (up - g.root_discount * root_tables(s.tokens, up, g) + spare) / (g.root_strength + g.sums[N_TABLES])
    return context_c, context_t, parent, c


def by_bucket(buckets: int, *tables: DataFrame) -> DataFrame:
    """Rows of several tables, those of a bucket together: by the tables' order (``kind``), then by part."""
    rows = [x.select(F.lit(i).alias("kind"), "p", "q", "n", "data") for i, x in enumerate(tables)]
    both = rows[0]
    for x in rows[1:]:
        both = both.unionByName(x)
    return both.repartitionById(buckets, "p").sortWithinPartitions("p", "kind", "q")


def answers_in(rows: list[dict], kind: int) -> list[bytes]:
    return [r["data"] for r in rows if r["kind"] == kind]


def log_beta_sum(a: float, b: np.ndarray, n: np.ndarray, rng) -> float:
    """The sum of n logarithms of Beta(a, b) draws for each b; beyond 1,000 draws by their mean and variance."""

    def polygamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, d, v = np.asarray(x, dtype=float).copy(), 0.0, 0.0
        for _ in range(8):
            d, v, x = d - 1 / x, v + 1 / x**2, x + 1
        return d + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4), v + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5)

    out, few = 0.0, n <= 1000
    for y, k in zip(b[few].tolist(), n[few].tolist(), strict=True):
        out += float(np.log(np.maximum(rng.beta(a, y, k), 1e-300)).sum())
    (d0, v0), (d1, v1) = polygamma(np.array([a])), polygamma(a + b[~few])
    many = n[~few]
    return out + float((many * (d0 - d1)).sum() + np.sqrt(np.maximum(many * (v0 - v1), 0)).dot(rng.standard_normal(len(many))))


def trials(hist: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(i, how many of the values exceed i), with wider steps in i beyond 1,024."""
    if not hist:
        return np.zeros(0), np.zeros(0, np.int64)
    n = np.zeros(max(hist) + 1, dtype=np.int64)
    n[list(hist)] = list(hist.values())
    above = n[::-1].cumsum()[::-1]  # of values in this bin or over it
    bins = np.arange(1, len(n) - 1)
    width = np.where(bins < 1024, 1, np.diff(1024 * 2.0 ** (np.maximum(np.arange(1, len(n)) - 1024, 0) / 16)))
    return np.where(bins < 1024, bins, unbinned(bins + 1)), np.round(above[bins + 1] * width).astype(np.int64)


def old_tables(strength: float, discount: float, top: int, rng, one_by_one: int = 1_000_000) -> int:
    """How many of k = 1 .. top - 1 fall to the strength, each with chance strength / (strength + discount * k).

    Those beyond ``one_by_one`` are a Poisson number: it differs from theirs by less than
    (strength / discount)^2 / ``one_by_one`` in total variation.
    """
    k = np.arange(1, min(top, one_by_one))
    rest = np.log((strength + discount * (top - 0.5)) / (strength + discount * (one_by_one - 0.5))) * strength / discount if top > one_by_one else 0.0
    return int((rng.random(len(k)) < strength / (strength + discount * k)).sum() + rng.poisson(rest))


def draw_params(stats: list, g: Params, seed: int) -> Params:
    """Parameters and global sums for the next pass."""
    rng = np.random.default_rng([seed, g.number])
    hist: dict[int, dict[int, int]] = defaultdict(dict)
    for r in stats:
        hist[r.p][r.q] = r.n
    sums = [hist[SUMS].get(i, 0) for i in range(4)]
    out = Params(g.discount, g.strength, g.root_discount, g.root_strength, sums, g.steps, g.root_new, g.number)
    if not sums[N_TRAIN]:
        return out
    i, n = trials(hist[IN_TABLES])
    old = rng.binomial(n, g.strength / (g.strength + g.discount * i)) if len(i) else n
    j, m = trials(hist[AT_TABLE])
    apart = rng.binomial(m, (1 - g.discount) / (j - g.discount)) if len(j) else m
    out.discount = float(np.clip(rng.beta(1 + (n - old).sum(), 1 + apart.sum()), 0.01, 0.99))
    customers = np.array([[unbinned(np.array(b)), x] for b, x in hist[IN_CONTEXT].items() if b > 1]).reshape(-1, 2)
    logs = log_beta_sum(g.strength + 1, customers[:, 0] - 1, customers[:, 1].astype(np.int64), rng)
    out.strength = float(max(rng.gamma(1 + old.sum(), 1 / (1 - logs)), 1e-3))
    # The parent: its discount from the tokens with one and with two customers, its strength drawn.
    one, two = hist[AT_ROOT].get(1, 0), hist[AT_ROOT].get(2, 0)
    out.root_discount = min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
    top = sums[N_ROOT_TABLES]
    alone = old_tables(g.root_strength, out.root_discount, top, rng)
    logs = log_beta_sum(g.root_strength + 1, np.array([max(sums[N_TABLES] - 1.0, 1.0)]), np.array([1]), rng)
    out.root_strength = float(max(rng.gamma(1 + alone, 1 / (1 - logs)), 1e-3))
    return out


@dataclass
class Model:
    """Buckets at ``path`` and, for each kept pass, the totals sent back and what they were made with."""

    path: str
    state: str
    buckets: int
    asked: int
    kept: list[tuple[str, Params]]


def train(docs: DataFrame, *, burn_in: int = 2, samples: int = 2, seed: int = 5, bucket: int = BUCKET) -> Model:
    """Fit to the training rows of (doc_id, text); the held-out ones are gathered for scoring only."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text") / 6 + 1)).first()[0] or 0  # about its tokens
    buckets = max(4, math.ceil(size / bucket))
    hot = frequent_tokens(docs, min(4 * buckets, MOST_HOT), max(FLUSH / max(size, 1), 1 / 20_000))
    asked = max(2, buckets // 4)
    path = shared_folder(spark)
    gather(docs, hot, buckets, asked, path)
    release(spark)
    state_path, old = path, f"{path}/kind={STATE}"
    g, kept = Params(), []
    for number in range(burn_in + samples):
        state = blobs(spark, state_path, STATE)
        answers, answer_path = stored(answer(ask(state, g, asked), g, asked))
        stats = answers.where(F.col("kind") == STAT).groupBy("p", "q").agg(F.sum("n").alias("n")).collect()  # bins
        used = draw_params(stats, g, seed)
        keep, last = number >= burn_in, number == burn_in + samples - 1
        if keep:
            kept.append((answer_path, used))
        if not last:
            new_path = shared_folder(spark)
            both = by_bucket(buckets, state, answers.where(F.col("kind") == ANSWER))
            swept(both, used, asked, seed, keep).write.parquet(new_path)
            discard(spark, old)
            state_path = old = new_path
            new = (used.root_strength + used.root_discount * used.sums[N_ROOT_TABLES]) * used.base()
            g = Params(used.discount, used.strength, used.root_discount, used.root_strength, used.sums, root_table(new, used.root_discount), new, number + 1)
        if not keep:
            discard(spark, answer_path)
        release(spark)
    return Model(path, state_path, buckets, asked, kept)


def swept(rows: DataFrame, g: Params, asked: int, seed: int, keep: bool) -> DataFrame:
    """The buckets after a Gibbs pass; ``keep`` notes the tables from before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, got in groups(batches, "p"):
            s = State.unpack(got[0]["data"])
            *totals, _ = totals_of(s, s.t, answers_in(got, 1), g, asked)
            if keep:
                s.kept.append(s.t.copy())
            gibbs(s, g, tuple(totals), np.random.default_rng([seed, g.number, p]))
            yield blob(STATE, p, 0, 0, s.pack())

    return rows.mapInArrow(run, BLOB)


def chances(s: State, answers: list[list[bytes]], kept: list[Params], asked: int) -> tuple[np.ndarray, np.ndarray]:
    """Averaged predictive probability of each pair, and its token's training count."""
    out, tables = np.zeros(len(s.c)), [*s.kept, s.t]
    for parts, g, t in zip(answers, kept, tables, strict=True):
        c, context_t, parent, n = totals_of(s, t, parts, g, asked)
        here, up = c[s.of_context], context_t[s.of_context]
        out += (s.c - g.discount * t + (g.strength + g.discount * up) * parent[s.of_token]) / (g.strength + here)
    return out / len(kept), n[s.of_token]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of the rows gathered."""
    spark, asked = docs.sparkSession, model.asked
    kept = [g for _, g in model.kept]
    n, v = kept[-1].sums[N_TRAIN], kept[-1].sums[N_TYPES]
    answers = [blobs(spark, at, ANSWER) for at, _ in model.kept]
    rows = by_bucket(model.buckets, blobs(spark, model.state, STATE), blobs(spark, model.path, POSTS), *answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in groups(batches, "p"):
            s = State.unpack(got[0]["data"])
            p, c = chances(s, [answers_in(got, 2 + i) for i in range(len(kept))], kept, asked)
            per_pair, blocks, of_block, doc, many = unpack(got[1]["data"])
            pair = np.repeat(np.arange(len(p)), per_pair)
            # The rows of all blocks on one line, each block as long as its last row here.
            top = np.zeros(len(blocks), dtype=np.int64)
            np.maximum.at(top, of_block, doc.astype(np.int64) + 1)
            base = np.cumsum(top) - top
            where, n_rows = base[of_block] + doc, int(top.sum())
            met = np.flatnonzero(np.bincount(where, minlength=n_rows))
            sums = [
                np.bincount(where, many * x[pair], n_rows)[met]
                for x in (np.log10(p), np.log10((c + 1.0) / (n + v + 1.0)), (c > 0).astype(np.float64))
            ]
            ends = np.searchsorted(met, np.append(base, n_rows))
            for k, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if a < z:
                    out = [met[a:z] - base[k], sums[0][a:z], sums[1][a:z], sums[2][a:z].astype(np.int64)]
                    yield blob(POSTS, bucket, int(blocks[k]), 0, pack(*out))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in groups(batches, "q"):
            names, none, held, sizes = pickle.loads(next(r["data"] for r in got if r["kind"] == ROWS))
            sums = np.zeros((3, len(names)))
            for r in got:
                if r["kind"] == POSTS:
                    doc, *more = unpack(r["data"])
                    for i, x in enumerate(more):
                        sums[i][doc] += x
            cols = {
                "doc_id": pa.array(names, pa.int64(), mask=none), "held_out": pa.array(held), "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(np.round(sums[2]).astype(np.int64)), "train_tokens": pa.array(np.full(len(names), n), pa.int64()),
                "base_score": pa.array(sums[1]), "score": pa.array(sums[0]), "perplexity": pa.array(10.0 ** (-sums[0] / sizes)),
            }
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    blocks = blobs(spark, model.path, ROWS)
    everything = rows.mapInArrow(run, BLOB).unionByName(blocks).repartition(model.buckets, "q").sortWithinPartitions("q", "p", "kind")
    return everything.mapInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    )


def op4_language_model(spark, sf_dir: str) -> DataFrame:
    """Query: scores of all ``documents``, learned from those that are not held out."""
    docs = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    with batches_of(spark):
        return score(docs, train(docs))
