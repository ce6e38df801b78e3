"""Raw-input tokens, the document profile and segment cuts.

Tokens here are runs of letters, runs of digits, runs of operator signs, or single other
characters; white space separates. Profile counts come straight from the text; the sketch
is a majority vote over the hashes of word tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the token alternatives.
TOKENS = r"[A-Za-z_\x{80}-\x{10FFFF}]+|[0-9]+|[-+*/%=!<>&|^~#$\\]+|[^\t-\r A-Za-z_\x{80}-\x{10FFFF}0-9+*/%=!<>&|^~#$\\-]"
#: What each profile dimension counts (pairs count double beside backslashes).
DENSITIES = {
    "brackets": r"[()\[\]{}]", "angles": "[<>]", "separators": "[;:,.]", "quotes": "['\"`]", "sigils": "[#$@]",
    "pairs": r"/(?=[/*])|-(?=-)|=(?=>)|:(?=:)|<(?=/)|\{(?=\{)", "layout": r"\n|(?<=\n)[ \t]", "identifiers": "[0-9A-Za-z_]",
}
TRAILING = r"[\t-\r ]+$"


def raw_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, i, value), row-local."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKENS), F.lit(0))).alias("i", "value"))


def density_bucket(count: Column, width: Column, ratio: bool) -> Column:
    if ratio:
        return F.when(count * 20 < width * 7, 0).when(count * 20 < width * 11, 1).when(count * 25 < width * 18, 2).otherwise(3)
    return F.when(count == 0, 0).when(count * 64 < width, 1).when(count * 64 < width * 3, 2).otherwise(3)


@F.pandas_udf(T.LongType())
def fnv32(words: pd.Series) -> pd.Series:
    """32-bit rolling hash over UTF-8 bytes, all words of a batch at once."""
    data = [w.encode() for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    codes = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    order = np.argsort(-sizes, kind="stable")
    at, ordered = (np.cumsum(sizes) - sizes)[order], sizes[order]
    h = np.full(len(data), 2166136261, dtype=np.uint64)
    for t in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-ordered, -t, "left"))
        h[:n] = ((h[:n] ^ codes[at[:n] + t]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    out = np.empty(len(data), dtype=np.int64)
    out[order] = h.astype(np.int64)
    return pd.Series(out)


def document_profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, one bucket per dimension, sketch)."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), TRAILING, "")
    counts = docs.select("doc_id", F.greatest(F.lit(1), F.char_length(body)).alias("width"), *(
        (F.regexp_count(body, F.lit(p)) * (2 if n == "pairs" else 1) + (F.regexp_count(body, F.lit(r"\\")) if n == "pairs" else 0)).alias(n)
        for n, p in DENSITIES.items()
    ))
    words = raw_tokens(docs).where(F.col("value").rlike("^[A-Za-z_]")).select("doc_id", fnv32("value").alias("h"))
    votes = words.groupBy("doc_id").agg(*(F.sum(F.when(F.shiftright("h", 4 * b).bitwiseAND(F.lit(1).cast("long")) == 1, 1).otherwise(-1)).alias(f"v{b}") for b in range(8)))
    sketch = sum(((F.coalesce(f"v{b}", F.lit(0)) > 0).cast("int") * (1 << b) for b in range(8)), F.lit(0))
    return counts.join(votes, "doc_id", "left").select("doc_id", *(density_bucket(F.col(n), F.col("width"), n == "identifiers").alias(n) for n in DENSITIES), sketch.alias("sketch"))


#: What hides line starts and brackets: comments and quoted text, closed or not.
HIDDEN = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\r\n]*|(['\"`])(?:\\.|(?!\1).)*(?:\1|\Z)", re.S)
SPLIT = re.compile(TOKENS.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"))


def line_starts(text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(number of tokens, tokens that start a line, those outside quotes, comments and brackets, those after a blank line)."""
    spans = np.array([m.span() for m in SPLIT.finditer(text)], dtype=np.int64).reshape(-1, 2)
    start, stop = spans[:, 0], spans[:, 1]
    gap = np.concatenate([[0], stop[:-1]]) if len(start) else start
    ends = np.array([m.start() for m in re.finditer(r"[\r\n]", text)], dtype=np.int64)
    feeds = np.array([m.start() for m in re.finditer(r"\n", text)], dtype=np.int64)
    between = lambda at: np.searchsorted(at, start) - np.searchsorted(at, gap)
    line, blank = between(ends) > 0, between(feeds) > 1
    hidden = np.array([m.span() for m in HIDDEN.finditer(text)], dtype=np.int64).reshape(-1, 2)
    last = np.searchsorted(hidden[:, 0], start, "left") - 1
    inside = (last >= 0) & (start < np.concatenate([hidden[:, 1], [0]])[last])
    quoted = inside | np.isin(start, hidden[:, 0])
    sign = [0 if q else (text[k] in "([{") - (text[k] in ")]}") for k, q in zip(start.tolist(), quoted.tolist(), strict=True)]
    sums = np.cumsum(np.array(sign, dtype=np.int64))
    depth = sums - np.minimum(0, np.minimum.accumulate(sums)) if len(sums) else sums
    free = line & ~inside & (np.concatenate([[0], depth[:-1]]) == 0) if len(depth) else line
    return len(start), np.flatnonzero(line), np.flatnonzero(free), np.flatnonzero(free & blank)


def segment_cuts(text: str, least: int = 384, most: int = 768) -> list[tuple[int, int]]:
    """(first, count) segments of a text's tokens.

    A segment has ``least`` tokens if a free line starts in the second half of these: it ends
    at the last one after a blank line, else at the last one. If none does, it ends at the next
    free line, within ``most`` tokens; then at the last line of any kind, or where it is full.
    Line starts are free outside quotes, comments and brackets.
    """
    n, *kinds = line_starts(text)
    line, free, blank = kinds

    def last(of: np.ndarray, low: int, high: int) -> int:
        k = int(np.searchsorted(of, high, "right")) - 1
        return int(of[k]) if k >= 0 and of[k] >= low else 0

    out, begin = [], 0
    while n - begin >= least:
        half, full = begin + least // 2, begin + least - 1
        cut = last(blank, half, full) or last(free, half, full)
        if not cut:
            k = int(np.searchsorted(free, full, "right"))
            cut = int(free[k]) if k < len(free) and free[k] < begin + most else 0
        if not cut:
            if n - begin < most:
                break
            cut = last(line, begin + 1, begin + most - 1) or begin + most
        out.append((begin, cut - begin))
        begin = cut
    if n > begin or not out:
        out.append((begin, n - begin))
    return out


def segments(docs: DataFrame, least: int = 384, most: int = 768) -> DataFrame:
    """(doc_id, first, count) segments of every document. Row-local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, *s) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True) for s in segment_cuts(text.as_py(), least, most)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "first", "count"])

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, first long, count long")


def lite_hashes(words: Column) -> Column:
    """The nine and seven bits that the lite layout keeps of a word's two hashes; as struct(hash9, hash7)."""
    return _lite(words)


@F.pandas_udf(T.StructType([T.StructField("hash9", T.IntegerType()), T.StructField("hash7", T.IntegerType())]))
def _lite(words: pd.Series) -> pd.DataFrame:
    data = words.str.replace(r"[\U00010000-\U0010FFFF]", "__", regex=True).str.replace(r"[^\x00-\x7f]", "_", regex=True)
    sizes = data.str.len().to_numpy(dtype=np.int64)
    codes = np.frombuffer("".join(data).encode("ascii"), np.uint8).astype(np.uint64)
    order = np.argsort(-sizes, kind="stable")
    at, ordered = (np.cumsum(sizes) - sizes)[order], sizes[order]
    out = {}
    for name, start, factor, keep in (("hash9", 2166136261, 16777619, 511), ("hash7", 0x9E3779B9, 2246822519, 127)):
        h = np.full(len(data), start, dtype=np.uint64)
        for t in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-ordered, -t, "left"))
            h[:n] = ((h[:n] ^ codes[at[:n] + t]) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
        low = np.empty(len(data), dtype=np.int32)
        low[order] = ((h ^ (h >> np.uint64(16))) & np.uint64(keep)).astype(np.int32)
        out[name] = low
    return pd.DataFrame(out)
