"""The lite model: part classes by embeddings, document conditioning, three recurrent layers and pooled context.

Weights are an input: a dict of float arrays as ``random_lite_weights`` shapes them. The model
works on all parts of several documents at once; recurrences go through them in step. Row-local.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parts import DOCS_AT_ONCE, FEATURES, PLACED, _part_columns, fold_words, normalised, part_values
from ..functions.rules import CLASSES
from .infer import document_scan, one_document, shifted, whole_documents
from .spans import tiles

# Widths of the model and where its feature groups begin in the embedding.
DIM, EMBEDDED, LAYERS, KERNEL, DILATIONS = 64, 32, 3, 5, (1, 2, 4)
HEAD, FILM, ERASE, N_CLASSES = 96, 32, 8, 9
ROWS = {
    "kind": 0, "len_bucket": 4, "first_char": 12, "last_char": 140, "hash9": 268, "hash7": 780, "prev_pair": 908, "next_pair": 924,
    "prev_symbol_pair": 940, "next_symbol_pair": 972, "flags": 1004,
}
TABLE, N_FLAGS = 1012, 8


def sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.clip(x, -30, 30)
    np.exp(np.negative(y, out=y), out=y)
    y += 1
    return np.divide(1, y, out=y)


def tanh(x: np.ndarray) -> np.ndarray:
    y = np.clip(x, -15, 15)
    return np.tanh(y, out=y)


def normed(x: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Rows over their root mean square."""
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + 1e-6) * gain


def linear(x: np.ndarray, m: dict, name: str) -> np.ndarray:
    return x @ m[name].T + m[f"{name}.bias"]


def lite_ids(parts: dict) -> list[np.ndarray]:
    """Embedding rows of each part; -1 for none. Hashes count on words alone."""
    word = parts["kind"] == 0
    out = [np.where(word | (name not in ("hash9", "hash7")), parts[name] + ROWS[name], -1) for name in ROWS if name != "flags"]
    return out + [np.where(parts["flags"] >> bit & 1, ROWS["flags"] + bit, -1) for bit in range(N_FLAGS)]


def lite_parts(words: pa.Array, sizes: np.ndarray) -> dict:
    """The feature record with the lite layout's hashes and its flag for words in capitals."""
    p = _part_columns(words, sizes, set(FEATURES) | set(PLACED))
    data, offsets = normalised(words)
    for name, start, factor, keep in (("hash9", 2166136261, 16777619, 511), ("hash7", 0x9E3779B9, 2246822519, 127)):
        h = fold_words(data, offsets, start, factor, 0xFFFFFFFF)
        p[name] = ((h ^ (h >> np.uint64(16))) & np.uint64(keep)).astype(np.int64)
    capitals = (p["kind"] == 0) & (p["flags"] & 2 > 0) & (p["flags"] & 1 == 0)
    return p | {"flags": p["flags"] + 128 * capitals}


def lite_logits(ids: list[np.ndarray], m: dict, sizes: np.ndarray | None = None) -> np.ndarray:
    """(parts, classes) scores of documents of so many parts (none of none) one after another, by default of one."""
    sizes = one_document(ids[0]) if sizes is None else sizes
    begins = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(doc)) - begins[doc]
    of_each = lambda x: np.concatenate([np.add.reduceat(x, begins, axis=0) / sizes[:, None], np.maximum.reduceat(x, begins, axis=0)], axis=1)
    table = np.vstack([m["embedding"], np.zeros((1, EMBEDDED))])
    x = first = linear(sum(table[k] for k in ids), m, "up")
    # The document's signature sets a scale and a shift for each layer and channel.
    signature = normed(of_each(x), m["film.gain"])
    film = linear(tanh(linear(signature, m, "film.down")), m, "film.up").reshape(-1, LAYERS, 2, DIM)
    film = m["film.strength"][:, None, :] * tanh(film) + np.array([1.0, 0.0])[None, :, None]
    for layer in range(LAYERS):
        w = {k.split(".", 1)[1]: v for k, v in m.items() if k.startswith(f"layer{layer}.")}
        y = normed(x, w["gain"]) * film[doc, layer, 0] + film[doc, layer, 1]
        local = w["taps.bias"] + sum(shifted(y, (k - KERNEL // 2) * DILATIONS[layer], sizes) * w["taps"][:, k] for k in range(KERNEL))
        erase = sigmoid(linear(tanh(linear(local, w, "erase.down")), w, "erase.up"))
        both = linear(local, w, "in")
        put = tanh(both[:, :DIM]) * sigmoid(both[:, DIM:])
        keep = sigmoid(w["base"]) * (1 - erase)
        ahead, back = document_scan(keep[:, :DIM], put, sizes), document_scan(keep[:, DIM:], put, sizes, reverse=True)
        x = x + linear(np.concatenate([ahead, back], axis=1), w, "out") * sigmoid(w["gate"])
    weight, one = sigmoid(x * m["pool.declared"]), np.ones((len(x), 1))
    prefix = document_scan(one, x * weight, sizes) / np.maximum(1.0, document_scan(one, weight, sizes))
    suffix = document_scan(one, x, sizes, reverse=True) / (sizes[doc] - place)[:, None]
    whole = of_each(x)[doc]
    context = tanh(linear(np.concatenate([whole, prefix, suffix], axis=1), m, "pool")) * sigmoid(linear(x, m, "pool.gate"))
    top = normed(x + m["highway"] * first, m["head.gain"])
    hidden = linear(np.concatenate([top, context], axis=1), m, "head")
    hidden = 0.5 * hidden * (1 + tanh(0.7978845608 * (hidden + 0.044715 * hidden**3)))
    return linear(hidden, m, "classes")


def lite_classes(parts: dict, sizes: np.ndarray, m: dict) -> np.ndarray:
    """The class of each part of a batch of documents; ties go to the first one."""
    ids = lite_ids(parts)
    found = [lite_logits([x[own] for x in ids], m, some).argmax(axis=1) for own, some in whole_documents(sizes)]
    return np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)


def random_lite_weights(seed: int = 0, scale: float = 0.2) -> dict:
    """Weights of the right shapes, for tests and timing."""
    rng = np.random.default_rng(seed)
    shapes = {
        "embedding": (TABLE, EMBEDDED), "up": (DIM, EMBEDDED), "film.down": (FILM, 2 * DIM), "film.up": (LAYERS * 2 * DIM, FILM), "film.strength": (LAYERS, DIM),
        "pool.declared": (DIM,), "pool": (DIM, 4 * DIM), "pool.gate": (DIM, DIM), "head": (HEAD, 2 * DIM), "classes": (N_CLASSES, HEAD),
    }
    for k in range(LAYERS):
        shapes |= {f"layer{k}.{n}": s for n, s in {
            "taps": (DIM, KERNEL), "erase.down": (ERASE, DIM), "erase.up": (2 * DIM, ERASE), "in": (2 * DIM, DIM), "base": (2 * DIM,), "out": (DIM, 2 * DIM), "gate": (DIM,),
        }.items()}
    m = {name: rng.normal(scale=scale, size=shape) for name, shape in shapes.items()}
    m |= {f"{n}.bias": rng.normal(scale=scale, size=m[n].shape[0]) for n in shapes if m[n].ndim == 2 and n not in ("embedding", "film.strength")}
    m |= {f"layer{k}.gain": np.ones(DIM) for k in range(LAYERS)}
    return m | {"film.gain": np.ones(2 * DIM), "head.gain": np.ones(DIM), "highway": 0.5}


def classify_lite(docs: DataFrame, weights: dict) -> DataFrame:
    """(doc_id, i, kind, start, stop, class) of every part; ties go to the first class. Null texts have no parts."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a model: fixed size
    rows = docs.select("doc_id", part_values(F.coalesce("text", F.lit(""))).alias("_values"))
    names = np.array(CLASSES, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                b = batch.slice(at, DOCS_AT_ONCE)
                sizes = np.diff(b.column("_values").offsets.to_numpy())
                p = lite_parts(b.column("_values").flatten(), sizes)
                found = lite_classes(p, sizes, shared.value)
                doc = pa.array(np.repeat(np.arange(b.num_rows), sizes))
                cols = [pa.array(p["i"], pa.int32()), pa.array(p["kind"], pa.int32()), pa.array(p["start"], pa.int64()), pa.array(p["stop"], pa.int64())]
                label = pa.array(names[found], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(doc), *cols, label], names=["doc_id", "i", "kind", "start", "stop", "class"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, i int, kind int, start long, stop long, class string")


def parse_lite(docs: DataFrame, weights: dict) -> DataFrame:
    """(doc_id, text) to spans (doc_id, class, start, stop) that tile each text, as ``merge_spans_lite`` makes them, where the texts lie."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a model: fixed size
    rows = docs.select("doc_id", part_values(F.coalesce("text", F.lit(""))).alias("_values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                b = batch.slice(at, DOCS_AT_ONCE)
                sizes = np.diff(b.column("_values").offsets.to_numpy())
                p = lite_parts(b.column("_values").flatten(), sizes)
                yield tiles(b.column("doc_id"), sizes, p, lite_classes(p, sizes, shared.value))

    spans = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, class int, start long, stop long")
    return spans.select("doc_id", F.get(F.lit(list(CLASSES)), F.col("class")).alias("class"), "start", "stop")
