"""Parts: words, horizontal spaces, newlines and single symbols that tile a text.

Offsets count UTF-16 code units, so a character outside the basic plane counts two.
Everything that depends on a document's parts alone (offsets, features, neighbours, nesting)
is computed where the document lies: the JVM splits the text, Arrow carries the lists, and
``part_table`` works on all parts of a batch at once. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD, SPACE, NEWLINE, SYMBOL = range(4)
KIND_NAMES = ("word", "space", "newline", "symbol")
#: Fixed value: the alternatives are word, space run, newline, any other single character.
PATTERN = (
    r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[\t\x0B\f ]+|\r\n|[\r\n]|"
    r"[^0-9A-Za-z_\x{80}-\x{10FFFF}\t\x0B\f \r\n]"
)
#: Neighbouring characters with a code of their own, codes 1-14 in order.
PAIRS = ("//", "/*", "*/", "--", "=>", "::", "</", "{{", "${", "}}", "->", "??", "?.", "<>")
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def part_values(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def kind_of(value: Column) -> Column:
    c = F.ascii(value)
    word = c.between(48, 57) | c.between(65, 90) | c.between(97, 122) | (c == 95) | (c > 127)
    return F.when(word, WORD).when(c.isin(9, 11, 12, 32), SPACE).when(c.isin(10, 13), NEWLINE).otherwise(SYMBOL)


def units_of(value: Column) -> Column:
    """Length in UTF-16 code units."""
    n = F.char_length(value)
    return F.when(F.octet_length(value) >= n + 3, n + F.regexp_count(value, F.lit(ASTRAL))).otherwise(n)


def explode_parts(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, *keep, i, value, kind, units), row-local."""
    rows = docs.select("doc_id", *keep, F.posexplode(part_values(F.coalesce("text", F.lit("")))).alias("i", "value"))
    return rows.select("*", kind_of(F.col("value")).alias("kind"), units_of(F.col("value")).alias("units"))


def in_order() -> "Window":
    return Window.partitionBy("doc_id").orderBy("i")


def with_offsets(parts: DataFrame) -> DataFrame:
    """Adds ``start`` and ``stop``."""
    stop = F.sum("units").over(in_order())
    return parts.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("units"))


#: Columns of ``part_table`` and their types.
PLAIN = {"i": "int", "value": "string", "kind": "int", "units": "int"}
PLACED = {"start": "long", "stop": "long"}
NEAR = {"prev_solid": "int", "next_solid": "int"}
NESTED = {"curly": "int", "round": "int", "square": "int"}
FEATURES = {
    n: "int"
    for n in (
        "len_bucket", "first_char", "last_char", "hash8", "hash7", "flags", "prev_pair", "next_pair", "prev_symbol_pair", "next_symbol_pair",
    )
}
#: Kinds and units among the parts within 32 of each.
LOCAL = {f"near_{k}": "int" for k in range(4)} | {"near_units": "int"}
RADIUS = 32
DOCS_AT_ONCE = 256


def _kinds() -> np.ndarray:
    out = np.full(256, SYMBOL, dtype=np.int32)
    out[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = WORD
    out[[9, 11, 12, 32]] = SPACE
    out[[10, 13]] = NEWLINE
    return out


def _flag_bits() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[97:123], out[65:91], out[48:58] = 1, 2, 4
    out[95], out[9] = 8, 32
    return out


KIND, FLAG_BITS = _kinds(), _flag_bits()
PAIR_CODES = np.zeros(1 << 16, dtype=np.int32)
for _k, (_a, _b) in enumerate(PAIRS, 1):
    PAIR_CODES[ord(_a) << 8 | ord(_b)] = _k


def normalised(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of strings in which every unit over 127 is an underscore."""
    other = pc.invert(pc.string_is_ascii(words))
    if pc.any(other).as_py():
        few = pc.replace_substring_regex(words.filter(other), r"[\x{10000}-\x{10FFFF}]", "__")
        words = pc.replace_with_mask(words, other, pc.replace_substring_regex(few, r"[^\x00-\x7F]", "_"))
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    return data, offsets


def fold_words(data: np.ndarray, offsets: np.ndarray, start: int, factor: int, mask: int) -> np.ndarray:
    """h = ((h ^ c) * factor) & mask over the bytes of each word, all words at once."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    at, ordered = offsets[:-1][order], -sizes[order]
    h = np.full(len(sizes), start, dtype=np.uint64)
    for t in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(ordered, -t, "left"))
        h[:n] = ((h[:n] ^ data[at[:n] + t]) * np.uint64(factor)) & np.uint64(mask)
    out = np.empty_like(h)
    out[order] = h
    return out


def _segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part: its document's number in the batch, and where that document's parts begin."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return doc, (np.cumsum(sizes) - sizes)[doc]


def _last_before(marked: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The last marked position before each one, -1 if there is none in its document."""
    at = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
    at = np.concatenate([[-1], at[:-1]]) if len(at) else at
    return np.where(at >= first, at, -1)


def _depths(step: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The running sum of steps before each part, never below zero."""
    sums = np.cumsum(step)
    sums = sums - (sums[first] - step[first]) if len(sums) else sums
    far = int(np.abs(sums).max(initial=0)) * 2 + 1
    lowest = np.minimum.accumulate(sums - far * doc) + far * doc  # falls from document to document, so each starts anew
    after = sums - np.minimum(0, lowest)
    before = np.concatenate([[0], after[:-1]]) if len(after) else after
    return np.where(np.arange(len(step)) == first, 0, before)


def _part_columns(words: pa.Array, sizes: np.ndarray, wanted: set[str]) -> dict:
    data, offsets = normalised(words)
    doc, first = _segments(sizes)
    units = np.diff(offsets)
    index = np.arange(len(units))
    head, tail = data[offsets[:-1]].astype(np.int64), data[offsets[1:] - 1].astype(np.int64)
    kind = KIND[head]
    out = {"i": index - first, "value": words, "kind": kind, "units": units}
    if wanted & PLACED.keys():
        stop = np.cumsum(units)
        stop = stop - (stop[first] - units[first]) if len(stop) else stop
        out |= {"stop": stop, "start": stop - units}
    if wanted & NEAR.keys():
        solid = (kind == WORD) | (kind == SYMBOL)
        back = _last_before(solid, first)
        last = (first + sizes[doc] - 1)[::-1]
        ahead = len(solid) - 1 - _last_before(solid[::-1], len(solid) - 1 - last)[::-1]
        none = ahead == len(solid)
        out |= {"prev_solid": pa.array(back - first, mask=back < 0), "next_solid": pa.array(ahead - first, mask=none)}
    if wanted & NESTED.keys():
        for name, (opening, closing) in {"curly": "{}", "round": "()", "square": "[]"}.items():
            out[name] = _depths((head == ord(opening)).astype(np.int64) - (head == ord(closing)), doc, first)
    if wanted & LOCAL.keys():
        low, high = np.maximum(first, index - RADIUS), np.minimum(first + sizes[doc], index + RADIUS + 1)
        for name, x in [*((f"near_{k}", kind == k) for k in range(4)), ("near_units", units)]:
            sums = np.concatenate([[0], np.cumsum(x)])
            out[name] = sums[high] - sums[low]
    if wanted & FEATURES.keys():
        word, symbol = kind == WORD, kind == SYMBOL
        bits = np.bitwise_or.reduceat(FLAG_BITS[data[: offsets[-1]]], offsets[:-1]) if len(units) else np.zeros(0, np.uint8)
        solid = _last_before(kind != SPACE, first)
        at_start = (solid < 0) | (kind[solid] == NEWLINE)
        flags = np.where(word, bits & 15, np.where(kind == SPACE, bits & 32, np.where(head == ord("\\"), 64, 0))).astype(np.int64) + 16 * at_start
        out |= {"len_bucket": np.where(units > 127, 7, np.log2(np.maximum(units, 1)).astype(np.int64)), "first_char": head, "last_char": tail, "flags": flags}
        if wanted & {"hash8", "hash7"}:
            at = np.flatnonzero(word)
            taken = offsets[:-1][at]
            compact = np.concatenate([[0], np.cumsum(units[at])])
            spread = np.repeat(taken - compact[:-1], units[at]) + np.arange(compact[-1])
            for name, start, factor, mask in (("hash8", 197, 147, 255), ("hash7", 57, 119, 127)):
                out[name] = np.zeros(len(units), dtype=np.int64)
                out[name][at] = fold_words(data[spread], compact, start, factor, mask)
        if wanted & {n for n in FEATURES if n.endswith("pair")}:
            none_before, none_after = index == first, index == first + sizes[doc] - 1
            for name, left, right, other, none in (
                ("prev", np.roll(tail, 1), head, np.roll(symbol, 1), none_before), ("next", tail, np.roll(head, -1), np.roll(symbol, -1), none_after),
            ):
                out[f"{name}_pair"] = np.where(none, 0, PAIR_CODES[left << 8 | right])
                out[f"{name}_symbol_pair"] = np.where(none | ~(symbol | other), 0, ((left + 1) * 131 ^ right) % 31 + 1)
    return out


def part_table(docs: DataFrame, *keep: str, columns: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, *keep, then ``columns``) of every part of (doc_id, text, ...). Row-local.

    ``columns`` are any of PLAIN, PLACED, NEAR, NESTED, LOCAL and FEATURES. A null text has no parts.
    """
    columns = columns or PLAIN | PLACED
    rows = docs.select("doc_id", *keep, part_values(F.coalesce("text", F.lit(""))).alias("_values"))
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                b = batch.slice(at, DOCS_AT_ONCE)
                lists = b.column("_values")
                sizes = np.diff(lists.offsets.to_numpy())
                got = _part_columns(lists.flatten(), sizes, set(columns))
                doc = pa.array(np.repeat(np.arange(b.num_rows), sizes))
                out = [b.column(n).take(doc) for n in ("doc_id", *keep)]
                out += [pa.array(got[n]).cast(kinds[t]) if not isinstance(got[n], pa.Array) else got[n].cast(kinds[t]) for n, t in columns.items()]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", *keep, *columns])

    schema = ", ".join([*(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in ("doc_id", *keep)), *(f"{n} {t}" for n, t in columns.items())])
    return rows.mapInArrow(run, schema)


def map_parts(docs: DataFrame, columns: set[str], function: Callable[[pa.RecordBatch, np.ndarray, dict], pa.RecordBatch], schema: str) -> DataFrame:
    """``function`` over whole documents: their other columns, the number of parts of each, and part columns.

    The part columns are numpy arrays (``value`` an Arrow one) of all parts of the documents,
    one document after the other. Row-local: what is made of a document needs no shuffle.
    """
    rows = docs.select(*(c for c in docs.columns if c != "text"), part_values(F.coalesce("text", F.lit(""))).alias("_values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                b = batch.slice(at, DOCS_AT_ONCE)
                lists = b.column("_values")
                sizes = np.diff(lists.offsets.to_numpy())
                yield function(b.drop_columns(["_values"]), sizes, _part_columns(lists.flatten(), sizes, set(columns)))

    return rows.mapInArrow(run, schema)


def part_features(docs: DataFrame) -> DataFrame:
    """One row per part with the unpacked feature record."""
    return part_table(docs, columns={"i": "int", "kind": "int"} | FEATURES)


def register_functions(spark) -> None:
    """SQL functions of the session: ``text_parts(text)`` as a table, and what a part is, by its value.

    ``SELECT d.doc_id, p.* FROM d, LATERAL text_parts(d.text) p`` has a row (i, value, kind,
    units) for each part. The bodies are SQL, so they run as built-in functions do.
    """
    quoted = PATTERN.replace("\\", "\\\\").replace("'", "\\'")
    code = "ascii(value)"
    kind = (
        f"CASE WHEN {code} BETWEEN 48 AND 57 OR {code} BETWEEN 65 AND 90 OR {code} BETWEEN 97 AND 122 OR {code} = 95 OR {code} > 127 THEN {WORD} "
        f"WHEN {code} IN (9, 11, 12, 32) THEN {SPACE} WHEN {code} IN (10, 13) THEN {NEWLINE} ELSE {SYMBOL} END"
    )
    units = "CAST(char_length(value) + regexp_count(value, '[\\\\x{10000}-\\\\x{10FFFF}]') AS INT)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION part_kind(value STRING) RETURNS INT RETURN {kind}")
    for number, name in enumerate(KIND_NAMES):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_{name}_part(value STRING) RETURNS BOOLEAN RETURN value IS NOT NULL AND value <> '' AND ({kind}) = {number}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION text_parts(text STRING) RETURNS TABLE (i INT, value STRING, kind INT, units INT) "
        f"RETURN SELECT i, value, {kind}, {units} FROM (SELECT posexplode(regexp_extract_all(coalesce(text, ''), '{quoted}', 0)) AS (i, value))"
    )
