"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two machines run over whole texts:

* The pre-tokenizer: character classes with one character of look-ahead decide where
  pre-tokens begin; evaluated for all characters at once.
* The BPE transducer: it reads a pre-token byte by byte, and every transition carries
  the number of tokens by which the encoding of what has been read so far grows (or
  shrinks). By the compatibility property of BPE the encoding of a prefix is fixed by
  its last token, so a state needs, for each suffix that may still grow into a token,
  the suffix's trie node, the last token before it and the count there relative to now.
  States are determinised when first reached and kept in a table; when that is full, it
  is emptied and filled anew.

Texts are cut into chunks that advance in lockstep. A chunk's state map takes the state at
its entry to the state at its exit and the tokens between. Behind a chunk's first pre-token
start the map is constant, which the first pass gives. Of a chunk without a start, which
only a pre-token of more than a chunk has, the map is tabulated for the states that end in
the byte before it; paths that meet are walked as one from there on. Maps then compose in
a parallel prefix scan: in each round a map is joined to the one that ends where it begins,
so runs of any length take a logarithmic number of rounds. At last the heads before first
starts are replayed from the entry states so found.

Null and empty texts have no tokens; a null id stays null; an empty table gives no rows. Special tokens' strings in a text count as the
library counts them by default: one token each, and the text around is split there.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .token_ids import default_vocabulary

OTHER, LETTER, NUMBER, SPACE, WHITE = range(5)
#: White space other than U+0020, as the pre-tokenizer's pattern has it.
WHITE_SPACE = "\t\n\x0b\x0c\r\x85\xa0                　"
#: Endings that an apostrophe at the start of a pre-token takes along.
ENDINGS_1, ENDINGS_2 = b"stmd", (b"re", b"ve", b"ll")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

BLOCK = 4 << 20
CHUNK = 512
MAX_STATES = 250_000
BIAS = 32


def char_classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, dtype=np.int8)
    for k, of in (("L", LETTER), ("N", NUMBER)):
        out[[c for c in range(len(out)) if unicodedata.category(chr(c))[0] == k]] = of
    out[[ord(c) for c in WHITE_SPACE]] = WHITE
    out[ord(" ")] = SPACE
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class StateMap:
    """Exit state and token growth of some bytes for each of the sorted entry states."""

    def __init__(self, entries: np.ndarray, exits: np.ndarray, grown: np.ndarray):
        self.entries, self.exits, self.grown = entries, exits, grown


class BpeTransducer:
    """Lazily determinised; state 0 is the start of a pre-token."""

    def __init__(self, vocab: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]):
        self.merges = merges
        self.child: dict[tuple[int, int], int] = {}
        self.token: list = [None]
        self.inner = [True]
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        for word in vocab:
            node = 0
            for b in word:
                nxt = self.child.get((node, b))
                if nxt is None:
                    nxt = self.child[node, b] = len(self.token)
                    self.token.append(None)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token[node] = word
        self.column, self.bytes = np.full(256, -1, dtype=np.int64), []
        self.reset()

    def reset(self) -> None:
        start = ((0, None, 0),)
        self.states, self.number = [start], {start: 0}
        self.ends: dict[int, list[int]] = {}  # states by the byte read last
        self.table = np.full((1024, 32), -1, dtype=np.int32)

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The table's column of each byte; a byte gets one when first seen."""
        seen = np.flatnonzero(np.bincount(data, minlength=256))
        for b in seen[self.column[seen] < 0].tolist():
            self.column[b] = len(self.bytes)
            self.bytes.append(b)
        if len(self.bytes) > self.table.shape[1]:
            wider = np.full((len(self.table), -(-len(self.bytes) // 32) * 32), -1, dtype=np.int32)
            wider[:, : self.table.shape[1]] = self.table
            self.table = wider
        return self.column[data].astype(np.uint8)

    def encode(self, piece: bytes) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.merges.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 30:
                break
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: bytes, b: bytes) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            got = self.fits[a, b] = self.encode(a + b) == [a, b]
        return got

    def compile(self, state: int, column: int) -> int:
        """The transition's entry: next state and token growth."""
        byte = self.bytes[column]
        chosen, live = None, []
        for node, last, rel in self.states[state]:
            nxt = self.child.get((node, byte))
            if nxt is None:
                continue
            word = self.token[nxt]
            if chosen is None and word is not None and (last is None or self.compatible(last, word)):
                chosen = (word, rel + 1)
            if self.inner[nxt]:
                live.append((nxt, last, rel))
        word, growth = chosen
        if not -BIAS <= growth < BIAS:
            raise ValueError("a token count changes by more than an entry holds")
        key = (*((n, last, rel - growth) for n, last, rel in live), (0, word, 0))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            self.ends.setdefault(byte, []).append(number)
            if number >= len(self.table):
                more = np.full_like(self.table, -1)
                self.table = np.concatenate([self.table, more])
        entry = self.table[state, column] = number * 64 + growth + BIAS
        return int(entry)

    def step(self, states: np.ndarray, syms: np.ndarray) -> np.ndarray:
        got = self.table[states, syms]
        if got.min(initial=0) < 0:
            miss = np.flatnonzero(got < 0)
            keys, where = np.unique(states[miss] * np.int64(256) + syms[miss], return_inverse=True)
            got[miss] = np.array([self.compile(k >> 8, k & 255) for k in keys.tolist()], dtype=np.int32)[where]
        return got

    def maps_of(self, syms: np.ndarray, entries: list[np.ndarray]) -> list[StateMap]:
        """The state map of each column of bytes, for its sorted entry states; all columns in lockstep."""
        owner = np.repeat(np.arange(len(entries)), [len(x) for x in entries])
        states, lane, of = np.concatenate(entries).astype(np.int64), owner, np.arange(len(owner))
        grown, alone = np.zeros(len(owner), dtype=np.int64), np.zeros(len(entries), dtype=np.int64)
        for row in syms:
            got = self.step(states, row[lane]).astype(np.int64)
            growth, states = (got & 63) - BIAS, got >> 6
            if len(states) == len(entries):
                alone += growth
                continue
            grown += growth[of]
            key, back = np.unique(lane << 32 | states, return_inverse=True)
            lane, states, of = key >> 32, key & 0xFFFFFFFF, back[of]
        exits, grown = states[of], grown + alone[owner]
        ends = np.cumsum([len(x) for x in entries])
        return [StateMap(x, exits[z - len(x) : z], grown[z - len(x) : z]) for x, z in zip(entries, ends.tolist(), strict=True)]

    def scan(self, free: np.ndarray, syms_t: np.ndarray, state: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Tokens in the chunks ``free`` of starts; their exits and the entries behind them are set."""
        known = set(free.tolist())
        entries = []
        for k in free.tolist():
            if k and k - 1 in known:
                byte = self.bytes[int(syms_t[-1, k - 1])]
                entries.append(np.array(sorted(self.ends.get(byte, [0])), dtype=np.int64))
            else:  # behind a chunk whose exit is known
                entries.append(np.array([state[k - 1] if k else 0], dtype=np.int64))
        maps = dict(zip(free.tolist(), self.maps_of(syms_t[:, free], entries), strict=True))
        # Prefix maps of each run: after round r they reach back over 2^r chunks.
        prefix, reach = dict(maps), {k: k for k in maps}
        while any(first - 1 in known for first in reach.values()):
            before, was = dict(prefix), dict(reach)
            for k, first in was.items():
                if first - 1 in known:
                    prefix[k], reach[k] = self.joined(before[first - 1], before[k], range(first, k + 1), syms_t), was[first - 1]
        grown = np.zeros(len(free), dtype=np.int64)
        for k in free.tolist():
            state[k] = prefix[k].exits[0]  # a run's first chunk has one entry state
        entry[1:] = state[:-1]
        for i, k in enumerate(free.tolist()):
            m = maps[k]
            at = np.searchsorted(m.entries, entry[k])
            if at == len(m.entries) or m.entries[at] != entry[k]:
                m = self.maps_of(syms_t[:, k : k + 1], [np.array([entry[k]], dtype=np.int64)])[0]
                at = 0
            grown[i] = m.grown[at]
        return grown

    def joined(self, left: StateMap, right: StateMap, chunks: range, syms_t: np.ndarray) -> StateMap:
        """The map of ``left``, then of ``right``, which covers ``chunks``; states new to ``right`` are walked."""
        at = np.minimum(np.searchsorted(right.entries, left.exits), len(right.entries) - 1)
        missing = np.unique(left.exits[right.entries[at] != left.exits])
        if len(missing):
            more = self.maps_of(np.concatenate([syms_t[:, k] for k in chunks])[:, None], [missing.astype(np.int64)])[0]
            entries = np.concatenate([right.entries, more.entries])
            order = np.argsort(entries)
            right = StateMap(entries[order], np.concatenate([right.exits, more.exits])[order], np.concatenate([right.grown, more.grown])[order])
            at = np.searchsorted(right.entries, left.exits)
        return StateMap(left.entries, right.exits[at], left.grown + right.grown[at])

    def growths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The growth at each byte; ``starts`` marks the bytes that begin a pre-token."""
        n = len(data)
        lanes = -(-n // CHUNK)
        size = lanes * CHUNK
        syms = np.zeros(size, dtype=np.uint8)
        syms[:n] = self.columns(data)
        first = np.zeros(size, dtype=bool)
        first[:n] = starts
        first[n:] = True
        grid = first.reshape(lanes, CHUNK)
        head = np.where(grid.any(axis=1), grid.argmax(axis=1), CHUNK)
        syms_t = np.ascontiguousarray(syms.reshape(lanes, CHUNK).T)
        inside = np.ascontiguousarray(~grid.T).astype(np.int32)
        out = np.zeros((CHUNK, lanes), dtype=np.int16)
        state = np.zeros(lanes, dtype=np.int32)
        for t in range(CHUNK):
            got = self.step(state * inside[t], syms_t[t])
            state = got >> 6
            out[t] = (got & 63) - BIAS
        entry = np.zeros(lanes, dtype=np.int32)
        entry[1:] = state[:-1]
        free = np.flatnonzero(head == CHUNK)
        if len(free):
            grown = self.scan(free, syms_t, state, entry)
            out[:, free] = 0
            out[0, free] = grown  # no text ends inside, so the sum may stand at the first byte
        head[head == CHUNK] = 0
        active = np.flatnonzero(head)
        at = entry[active]
        for t in range(int(head.max(initial=0))):
            still = head[active] > t
            active, at = active[still], at[still]
            got = self.step(at, syms_t[t, active])
            at = got >> 6
            out[t, active] = (got & 63) - BIAS
        return np.ascontiguousarray(out.T).reshape(size)[:n]


def _is_byte_level(spec: dict | None) -> bool:
    """A pre-tokenizer that splits by the byte-level pattern and adds no leading space."""
    return bool(spec) and spec["type"] == "ByteLevel" and spec.get("use_regex", True) and not spec.get("add_prefix_space", False)


class TokenCounter:
    def __init__(self, path: str | None = None):
        with open(path or default_vocabulary(), encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or not _is_byte_level(spec.get("pre_tokenizer")) or spec.get("normalizer"):
            raise ValueError("the machines are those of a byte-level BPE vocabulary without a normalizer")
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.machine = BpeTransducer(vocab, {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)})
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True)) or b"(?!)")
        self.classes = char_classes()
        self.byte_classes = np.where(np.arange(256) < 128, self.classes[:256], OTHER).astype(np.int8)

    def pretokens(self, data: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """Marks of the bytes that begin a pre-token; ``segments`` are starts of texts."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        b0 = data[lead]
        c = self.byte_classes[b0]
        wide = np.flatnonzero(b0 >= 0x80)
        if len(wide):
            padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
            at = lead[wide]
            x, y, z, w = (padded[at + i] for i in range(4))
            y, z, w = y & 63, z & 63, w & 63
            point = np.where(x < 0xE0, (x & 31) << 6 | y, np.where(x < 0xF0, (x & 15) << 12 | y << 6 | z, (x & 7) << 18 | y << 12 | z << 6 | w))
            c[wide] = self.classes[point]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[segments] = True
        begins = first[lead]
        prev = np.empty_like(c)
        prev[0], prev[1:] = -1, c[:-1]
        prev[begins] = -1
        follow = np.full_like(c, -1)
        follow[:-1] = c[1:]
        follow[:-1][begins[1:]] = -1
        start = np.where(
            c < SPACE,
            (prev != c) & (prev != SPACE),
            (prev < SPACE) | ((follow >= 0) & (follow < SPACE)),
        )
        start |= begins
        quote = np.flatnonzero((b0 == 0x27) & start)
        if len(quote):
            ch = np.concatenate([np.where(b0 < 0x80, b0, 0), np.zeros(3, np.uint8)])
            stop = np.concatenate([begins, np.ones(3, bool)])
            a, b = ch[quote + 1], ch[quote + 2]
            whole = ~stop[quote + 1]
            one = whole & np.isin(a, list(ENDINGS_1))
            two = whole & ~stop[quote + 2] & np.logical_or.reduce([(a == e[0]) & (b == e[1]) for e in ENDINGS_2])
            start[quote[one | two] + 1] = False
            nxt = np.concatenate([quote[one] + 2, quote[two] + 3])
            start[nxt[nxt < len(start)]] = True
        marks = np.zeros(len(data), dtype=bool)
        marks[lead[start]] = True
        return marks

    def _block(self, parts: list[tuple[int, bytes]], counts: np.ndarray) -> None:
        if not parts:
            return
        if len(self.machine.states) > MAX_STATES:
            self.machine.reset()
        data = np.frombuffer(b"".join(p for _, p in parts), dtype=np.uint8)
        sizes = np.array([len(p) for _, p in parts])
        segments = np.cumsum(sizes) - sizes
        growths = self.machine.growths(data, self.pretokens(data, segments))
        np.add.at(counts, [k for k, _ in parts], np.add.reduceat(growths, segments, dtype=np.int64))

    def __call__(self, values: list[bytes]) -> np.ndarray:
        """The number of tokens of each UTF-8 text."""
        counts = np.zeros(len(values), dtype=np.int64)
        parts, size = [], 0
        for k, value in enumerate(values):
            segments = self.special.split(value)
            counts[k] += len(segments) - 1
            for segment in segments:
                for piece in _pieces(segment):
                    parts.append((k, piece))
                    size += len(piece)
                    if size >= BLOCK:
                        self._block(parts, counts)
                        parts, size = [], 0
        self._block(parts, counts)
        return counts


#: A single space between two ASCII characters that are no white space: a pre-token begins there.
SAFE = re.compile(rb"[!-~](?= [!-~])")


def _pieces(value: bytes) -> Iterator[bytes]:
    """A text in pieces of about BLOCK bytes whose counts add up to the text's."""
    at = 0
    while len(value) - at > 2 * BLOCK and (m := SAFE.search(value, at + BLOCK)):
        yield value[at : m.end()]
        at = m.end()
    if at < len(value):
        yield value[at:]


@functools.lru_cache(maxsize=1)
def worker_counter(path: str | None) -> TokenCounter:
    """One per worker process: states compiled for one task serve the next ones."""
    return TokenCounter(path)


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    limit: int = 1024,
    vocabulary: str | None = None,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per document. Row-local: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(vocabulary)
        for batch in batches:
            values = batch.column("text").cast(pa.binary()).to_pylist()
            n = counter(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(v) for v in values], pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
