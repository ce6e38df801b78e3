"""Part classification by a hierarchical model whose weights are an input.

The model is sequential within a document (scans and a binary tree over its parts), so
documents stay whole: arrays of all parts and channels of several, one after another, with
their sizes; scans and trees of all go in step. Arrow batches in and out.
Weights are a dict of float arrays, sent once per executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.parts import NEWLINE, SPACE

N_CLASSES = 9
#: Offsets of the feature groups in the embedding.
OFFSETS = {
    "kind": 0, "len_bucket": 4, "first_char": 12, "last_char": 140, "hash8": 268, "hash7": 524, "flags": 652,
    "prev_pair": 659, "next_pair": 675, "prev_symbol_pair": 691, "next_symbol_pair": 723,
}
INPUT_SIZE = 755
FIELDS = ("kind", "len_bucket", "first_char", "last_char", "hash8", "hash7", "flags", "prev_pair", "next_pair", "prev_symbol_pair", "next_symbol_pair")
#: Parts that go through a model at once, unless one document has more.
PARTS_AT_ONCE = 8192


def whole_documents(sizes: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Neighbouring documents of ``PARTS_AT_ONCE`` parts together at most, or one that has more: their parts, their sizes."""
    begin, at, held = 0, 0, 0
    for k, n in enumerate([*sizes.tolist(), PARTS_AT_ONCE + 1]):
        if held and held + n > PARTS_AT_ONCE:
            yield slice(at, at + held), sizes[begin:k][sizes[begin:k] > 0]
            begin, at, held = k, at + held, 0
        held += n


def one_document(rows: np.ndarray) -> np.ndarray:
    return np.array([len(rows)] if len(rows) else [], dtype=np.int64)


def document_scan(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, reverse: bool = False) -> np.ndarray:
    """h = a h + b from zero along the rows of each document, all documents in step."""
    # Rows by their place in the document, longer documents first: a step is a stretch of rows.
    order = np.argsort(-sizes, kind="stable")
    alive = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
    steps = np.append(0, np.cumsum(alive))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    place = np.arange(len(b)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    to = steps[np.repeat(sizes, sizes) - 1 - place if reverse else place] + np.repeat(rank, sizes)
    keep, h = np.empty_like(a), np.empty_like(b)
    keep[to], h[to] = a, b
    ends = steps.tolist()
    for before, low, high in zip(ends, ends[1:], ends[2:]):
        h[low:high] += keep[low:high] * h[before : before + high - low]
    return h[to]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def feature_ids(parts: pd.DataFrame | dict) -> list[np.ndarray]:
    """The embedding rows of every part: one per field, one per flag set, hashes on words alone."""
    out = []
    for name in ("kind", "len_bucket", "first_char", "last_char", "prev_pair", "next_pair", "prev_symbol_pair", "next_symbol_pair"):
        out.append(np.asarray(parts[name]) + OFFSETS[name])
    word = np.asarray(parts["kind"]) == 0
    for name in ("hash8", "hash7"):
        out.append(np.where(word, np.asarray(parts[name]) + OFFSETS[name], -1))
    flags = np.asarray(parts["flags"])
    for bit in range(7):
        out.append(np.where(flags >> bit & 1, OFFSETS["flags"] + bit, -1))
    return out


def embed(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Sum of embedding rows; -1 stands for none."""
    padded = np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)])
    return sum(padded[x] for x in ids)


def affine_scan(gate: np.ndarray, value: np.ndarray, reverse: bool = False, sizes: np.ndarray | None = None) -> np.ndarray:
    """s = g s + (1 - g) v from zero, along each document's rows."""
    return document_scan(gate.astype(np.float64), ((1 - gate) * value).astype(np.float64), one_document(gate) if sizes is None else sizes, reverse)


def shifted(x: np.ndarray, by: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """Row i holds row i + by; zeros beyond the ends of each document."""
    out = np.zeros_like(x)
    if abs(by) >= len(x):
        return out
    if by >= 0:
        out[: len(x) - by] = x[by:]
    else:
        out[-by:] = x[:by]
    if sizes is not None and by:
        place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[(place + by < 0) | (place + by >= np.repeat(sizes, sizes))] = 0
    return out


def leaf_states(raw: np.ndarray, kinds: np.ndarray, m: dict, sizes: np.ndarray | None = None) -> np.ndarray:
    """Local mix of five neighbours and the nearest parts that are no space, then scans both ways."""
    n, sizes = len(raw), one_document(raw) if sizes is None else sizes
    if "stateInput" not in m:  # the three-part form
        s = m["neighborScale"]
        return np.tanh(shifted(raw, -1, sizes) * s[0] + raw * s[1] + shifted(raw, 1, sizes) * s[2] + m["leafBias"])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    solid = ~np.isin(kinds, (SPACE, NEWLINE))
    at = np.where(solid, np.arange(n), -1)
    prev = np.concatenate([[-1], np.maximum.accumulate(at)[:-1]])
    ahead = np.where(solid, np.arange(n), n)
    nxt = np.concatenate([np.minimum.accumulate(ahead[::-1])[::-1][1:], [n]])
    padded = np.vstack([raw, np.zeros((1, raw.shape[1]))])
    local = m["leafBias"] + sum(shifted(raw, k, sizes) * m["localOffsetScale"][k + 2] for k in range(-2, 3))
    local = local + padded[np.where(prev < first, n, prev)] * m["localNonspaceScale"][0] + padded[np.where(nxt >= end, n, nxt)] * m["localNonspaceScale"][1]
    local = np.tanh(local)
    gate = sigmoid(local @ m["stateGate"].T + m["stateGateBias"])
    value = np.tanh(local @ m["stateInput"].T + m["stateInputBias"])
    both = np.concatenate([affine_scan(gate, value, sizes=sizes), affine_scan(gate, value, True, sizes)], axis=1)
    return np.tanh(local + both @ m["stateMix"].T + m["stateMixBias"])


def _halves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where pairs of neighbours begin, where they go, and the same of the last nodes that have no right neighbour."""
    base, after = np.cumsum(counts) - counts, (counts + 1) // 2
    pairs, to = counts // 2, np.cumsum(after) - after
    k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    odd = np.flatnonzero(counts % 2)
    return np.repeat(base, pairs) + 2 * k, np.repeat(to, pairs) + k, (base + counts - 1)[odd], (to + after - 1)[odd]


def tree_contexts(leaf: np.ndarray, m: dict, sizes: np.ndarray | None = None) -> np.ndarray:
    """Merge neighbours pairwise to each document's root, then pass the root's state down to every leaf.

    A node without a right neighbour passes through unchanged on both ways; so does a root
    while larger trees are not done.
    """
    hidden = leaf.shape[1]
    channels = np.arange(hidden)
    deepest = max(0, int(np.log2(hidden)) - 1)
    level, counts, depth = leaf, one_document(leaf) if sizes is None else sizes, 0
    levels = [(level, counts)]
    half = channels < hidden / 2
    while counts.max(initial=0) > 1:
        k = min(depth, len(m["mergeOwnLeft"]) - 1)
        partner = channels ^ (1 << min(depth, deepest))
        at, to, odd, odd_to = _halves(counts)
        left, right = level[at], level[at + 1]
        mixed = np.tanh(
            left * m["mergeOwnLeft"][k] + right * m["mergeOwnRight"][k] + left[:, partner] * m["mergeCrossLeft"][k]
            + right[:, partner] * m["mergeCrossRight"][k] + m["mergeBias"][k]
        )
        merged = np.empty((len(to) + len(odd_to), hidden))
        merged[to], merged[odd_to] = (mixed + np.where(half, left, right)) * 0.5, level[odd]
        level, counts = merged, (counts + 1) // 2
        levels.append((level, counts))
        depth += 1
    down = level
    for depth in range(len(levels) - 2, -1, -1):
        children, counts = levels[depth]
        k = min(depth, len(m["downOwnParent"]) - 1)
        partner = channels ^ (1 << min(depth, deepest))
        at, to, odd, odd_to = _halves(counts)
        left, right, parent = children[at], children[at + 1], down[to]
        skip = sigmoid(m["downSkip"][k])

        def descend(own, other, bias):
            mixed = np.tanh(
                parent * m["downOwnParent"][k] + own * m["downOwnSelf"][k] + other * m["downOwnSibling"][k]  # noqa: B023
                + parent[:, partner] * m["downCrossParent"][k] + own[:, partner] * m["downCrossSelf"][k]  # noqa: B023
                + other[:, partner] * m["downCrossSibling"][k] + bias[k]  # noqa: B023
            )
            return parent * skip + mixed * (1 - skip)  # noqa: B023

        nxt = np.empty_like(children)
        nxt[at], nxt[at + 1] = descend(left, right, m["downLeftBias"]), descend(right, left, m["downRightBias"])
        nxt[odd] = down[odd_to]
        down = nxt
    return down


def probabilities(parts: pd.DataFrame | dict, m: dict, sizes: np.ndarray | None = None) -> np.ndarray:
    """(parts, classes) of documents one after another, by default one; white space is plain for certain."""
    kinds = np.asarray(parts["kind"])
    if not len(kinds):
        return np.zeros((0, N_CLASSES))
    sizes = one_document(kinds) if sizes is None else sizes[sizes > 0]
    leaf = leaf_states(embed(feature_ids(parts), m["featureEmbedding"]), kinds, m, sizes)
    joined = np.concatenate([leaf, tree_contexts(leaf, m, sizes)], axis=1)
    auxiliary = sigmoid(joined @ m["auxiliaryOutput"].T + m["auxiliaryBias"])
    hidden = np.tanh(np.concatenate([joined, auxiliary], axis=1) @ m["classifierInput"].T + m["classifierBias"])
    logits = hidden @ m["output"].T + m["outputBias"]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    p[np.isin(kinds, (SPACE, NEWLINE))] = np.eye(N_CLASSES)[0]
    return p


def random_weights(hidden: int = 16, classifier: int = 24, scales: int = 4, auxiliary: int = 16, seed: int = 0) -> dict:
    """Weights of the right shapes, for tests and timing."""
    rng = np.random.default_rng(seed)
    make = lambda *shape: rng.normal(scale=0.4, size=shape)
    m = {"featureEmbedding": make(INPUT_SIZE, hidden), "leafBias": make(hidden), "localOffsetScale": make(5, hidden), "localNonspaceScale": make(2, hidden)}
    m |= {n: make(hidden, hidden) for n in ("stateInput", "stateGate")} | {n: make(hidden) for n in ("stateInputBias", "stateGateBias", "stateMixBias")}
    m |= {"stateMix": make(hidden, 2 * hidden), "auxiliaryOutput": make(auxiliary, 2 * hidden), "auxiliaryBias": make(auxiliary)}
    m |= {n: make(scales, hidden) for n in (
        "mergeOwnLeft", "mergeOwnRight", "mergeCrossLeft", "mergeCrossRight", "mergeBias", "downOwnParent", "downOwnSelf", "downOwnSibling",
        "downCrossParent", "downCrossSelf", "downCrossSibling", "downSkip", "downLeftBias", "downRightBias")}
    return m | {"classifierInput": make(classifier, 2 * hidden + auxiliary), "classifierBias": make(classifier), "output": make(N_CLASSES, classifier), "outputBias": make(N_CLASSES)}


def classify_parts(features: DataFrame, weights: dict) -> DataFrame:
    """(doc_id, i, class code, level) from part feature rows; level is in sixteenths, 0-15."""
    shared = features.sparkSession.sparkContext.broadcast(weights)  # a model: fixed size

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        p = probabilities(pdf[list(FIELDS)], shared.value)
        best = p.argmax(axis=1)
        level = np.minimum(15, np.floor(16 * p[np.arange(len(p)), best])).astype("int32")
        return pd.DataFrame({"doc_id": pdf["doc_id"], "i": pdf["i"], "class": best.astype("int32"), "level": level})

    return features.groupBy("doc_id").applyInPandas(run, "doc_id long, i int, class int, level int")


def parse(texts: DataFrame, weights: dict) -> DataFrame:
    """(doc_id, text) to classified spans (doc_id, class, start, stop, confidence), where the texts lie.

    Documents go through the model together, ``PARTS_AT_ONCE`` parts at a time.
    """
    from pyspark.sql import functions as F

    from ..functions.rules import CLASSES
    from .spans import document_spans

    shared = texts.sparkSession.sparkContext.broadcast(weights)  # a model: fixed size

    def classify(parts: dict, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, level = np.zeros(len(parts["kind"]), np.int64), np.zeros(len(parts["kind"]), np.int64)
        for own, some in whole_documents(sizes):
            p = probabilities({n: parts[n][own] for n in FIELDS}, shared.value, some)
            best[own] = p.argmax(axis=1)
            level[own] = np.minimum(15, np.floor(16 * p.max(axis=1)))
        return best, level

    spans = document_spans(texts, classify, set(FIELDS), by_document=True)
    name = F.coalesce(F.get(F.lit(list(CLASSES)), F.col("class")), F.lit("plain"))
    return spans.select("doc_id", name.alias("class"), "start", "stop", ((F.col("level") + 1) / 16.0).alias("confidence"))
