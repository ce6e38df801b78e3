"""Documents go through both models together and give what each gives alone; spans need no shuffle."""

import numpy as np
import pyarrow as pa
import pytest

from textloom.functions.parts import FEATURES, PLACED, _part_columns, part_features, part_table
from textloom.operators import infer, lite
from textloom.operators.spans import merge_spans, merge_spans_lite

TEXTS = ["let x = 1;", "", None, "  \n\t", "y", "def f(x):\n  return x + 1  # done", "a b " * 30, "(" * 17]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_models_of_documents_together(monkeypatch):
    words = [["a", " ", "b"], [], ["x"], ["if", " ", "(", "y", ")", "\n", "z"] * 9, [" "], ["Q"] * 5]
    sizes = np.array(list(map(len, words)))
    flat = [w for ws in words for w in ws]
    ends = np.cumsum(sizes)
    p, m = _part_columns(pa.array(flat), sizes, set(FEATURES) | set(PLACED)), infer.random_weights(hidden=8, classifier=6)
    q, lm = lite.lite_parts(pa.array(flat), sizes), lite.random_lite_weights(3)
    ids = lite.lite_ids(q)
    alone = [slice(z - n, z) for n, z in zip(sizes, ends) if n]
    one = np.concatenate([infer.probabilities({k: p[k][x] for k in infer.FIELDS}, m) for x in alone])
    assert np.allclose(infer.probabilities(p, m, sizes), one, atol=1e-12)
    one = np.concatenate([lite.lite_logits([x[s] for x in ids], lm) for s in alone])
    assert np.allclose(lite.lite_logits(ids, lm, sizes[sizes > 0]), one, atol=1e-10)
    for most in (1, 4, 70, 1000):
        monkeypatch.setattr(infer, "PARTS_AT_ONCE", most)
        got = list(infer.whole_documents(sizes))
        assert np.concatenate([s for _, s in got]).tolist() == sizes[sizes > 0].tolist()
        assert [x for own, _ in got for x in flat[own]] == flat and all(len(s) == 1 or s.sum() <= most for _, s in got)
        assert (lite.lite_classes(q, sizes, lm) == one.argmax(axis=1)).all()
    assert list(infer.whole_documents(np.zeros(3, np.int64))) == []


def test_parsed_where_texts_lie(spark, docs):
    m, lm = infer.random_weights(hidden=8, classifier=6), lite.random_lite_weights(3)
    placed = part_table(docs, columns={"i": "int"} | PLACED)
    by_table = merge_spans(infer.classify_parts(part_features(docs), m).join(placed, ["doc_id", "i"])).where("class >= 0")
    got = infer.parse(docs, m)
    assert sorted(map(tuple, by_table.select("doc_id", "start", "stop", "confidence").collect())) == sorted(map(tuple, got.select("doc_id", "start", "stop", "confidence").collect()))
    tiled = lite.parse_lite(docs, lm)
    names = ["doc_id", "class", "start", "stop"]
    assert sorted(map(tuple, merge_spans_lite(lite.classify_lite(docs, lm)).select(*names).collect())) == sorted(map(tuple, tiled.select(*names).collect()))
    for df in (got, tiled):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
