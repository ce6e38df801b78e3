"""Core operators on small tables: literal expectations and properties."""

import hashlib
import math
import os
import random
from collections import Counter

import numpy as np

import pytest
from pyspark.sql import functions as F

from textloom.functions import parts as P
from textloom.functions import raw_input
from textloom.functions import rules
from textloom.operators import align, corpus, html_labels, infer, lite, metrics, mining, quantize, spans, training
from textloom.sources import files
from textloom.streaming import streams


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def values(spark, text):
    return [r.value for r in P.explode_parts(docs(spark, text)).orderBy("i").collect()]


def test_parts(spark):
    assert values(spark, "wsl:${fp}\r\n café++") == ["wsl", ":", "$", "{", "fp", "}", "\r\n", " ", "café", "+", "+"]
    text = "a😀b \t\x0b\r\r\n\n_9é{}"
    assert "".join(values(spark, text)) == text
    got = P.part_table(docs(spark, "a😀b x")).orderBy("i").collect()
    assert [(r.start, r.stop) for r in got] == [(0, 4), (4, 5), (5, 6)]
    assert P.explode_parts(docs(spark, None, "")).count() == 0


def test_features(spark):
    same = P.part_features(docs(spark, "café", "caf_")).drop("doc_id").collect()
    assert same[0] == same[1]
    got = {r.i: r for r in P.part_features(docs(spark, "Foo_1 BAR\n  \\//x")).collect()}
    assert (got[0].kind, got[0].len_bucket, got[0].first_char, got[0].last_char, got[0].flags) == (0, 2, 70, 49, 31)
    assert got[4].kind == 1 and got[4].flags & 16
    assert got[5].flags & 64
    assert got[6].next_pair == 1 and got[7].prev_pair == 1

    def wrapping(word, start, factor, keep):
        h = start
        for c in word:
            h = ((h ^ ord(c)) * factor) & 0xFFFFFFFF
        return h & keep

    for word in ("a", "hello", "snake_case_9", "Z" * 200):
        r = P.part_features(docs(spark, word)).first()
        assert r.hash8 == wrapping(word, 2166136261, 16777619, 255)
        assert r.hash7 == wrapping(word, 0x9E3779B9, 2246822519, 127)


def test_neighbours_and_depth(spark):
    got = P.part_table(docs(spark, "a  b\n c"), columns={"i": "int"} | P.NEAR).orderBy("i").collect()
    assert [(r.prev_solid, r.next_solid) for r in got] == [(None, 2), (0, 2), (0, 5), (2, 5), (2, 5), (2, None)]
    depth = P.part_table(docs(spark, "}{{x}}"), columns=P.PLAIN | P.NESTED).orderBy("i").collect()
    assert [r.curly for r in depth] == [0, 0, 1, 2, 2, 1]


def labelled(spark, text, rows):
    p = P.part_table(docs(spark, text))
    table = spark.createDataFrame([(i, c, lv) for i, (c, lv) in enumerate(rows)], "i int, class string, level int")
    return p.join(table, "i")


def test_span_merges(spark):
    rows = [("plain", 15), ("plain", 15), ("plain", 9), ("plain", 15), ("operator", 3), ("plain", 15), ("plain", 15)]
    got = spans.merge_spans(labelled(spark, "a b + c", rows)).orderBy("start").collect()
    assert [(r["class"], r.start, r.stop, r.confidence) for r in got] == [("plain", 0, 4, 10 / 16), ("operator", 4, 5, 4 / 16), ("plain", 5, 7, 1.0)]
    text = "  value + 42  \n1 2 x"
    cls = {"value": "plain", "+": "operator", "42": "number", "1": "number", "2": "number", "x": "plain"}
    rows = [(cls.get(v, "plain"), 15) for v in values(spark, text)]
    got = spans.merge_spans_lite(labelled(spark, text, rows)).orderBy("start").collect()
    assert [(r["class"], text[r.start : r.stop]) for r in got] == [("plain", "  value "), ("operator", "+ "), ("number", "42  \n1 2 "), ("plain", "x")]
    blank = spans.merge_spans_lite(labelled(spark, " \t\r\n ", [("plain", 15)] * 3)).collect()
    assert [(r["class"], r.start, r.stop) for r in blank] == [("plain", 0, 5)]


def test_run_lengths_round_trip(spark):
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate("aabbbacc")], "doc_id long, i int, class string")
    runs = spans.run_lengths(df, block=4)
    assert [(r.block, r["class"], r.length) for r in runs.orderBy("block", "run").collect()] == [(0, "a", 2), (0, "b", 2), (1, "b", 1), (1, "a", 1), (1, "c", 2)]
    back = spans.expand_runs(runs).orderBy("block", "run", "offset").collect()
    assert "".join(r["class"] for r in back) == "aabbbacc"


def aligned(spark, labels, ranges, slot=256):
    ls = spark.createDataFrame([(0, k, *x) for k, x in enumerate(labels)], "doc_id long, seq long, from long, to long, class string, confidence double, auxiliary int")
    ps = spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(ranges)], "doc_id long, i int, start long, stop long")
    return [(r["class"], r.auxiliary, r.confidence, r.coverage) for r in align.align_labels(ls, ps, slot).orderBy("i").collect()]


@pytest.mark.parametrize("slot", [1, 3, 256])
def test_alignment(spark, slot):
    labels = [(0, 2, "string", None, 2), (2, 5, "plain", None, 16), (5, 7, "string", 0.5, 2)]
    assert aligned(spark, labels, [(0, 7), (7, 9), (5, 9)], slot) == [("string", 18, 109, 1.0), ("plain", 0, 0, 0.0), ("string", 2, 64, 0.5)]
    labels = [(0, 2, "keyword", None, None), (2, 4, "string", None, None)]
    assert [(c, n) for c, _, n, _ in aligned(spark, labels, [(2, 4), (0, 4), (1, 3)], slot)] == [("string", 255), ("keyword", 128), ("keyword", 128)]


def test_label_checks_and_gaps(spark):
    ls = spark.createDataFrame(
        [(0, 0, 2, 4, "string", None, None), (0, 1, 3, 6, "number", None, None), (0, 2, 8, 8, "plain", None, None), (0, 3, 9, 10, "odd", 2.0, None)],
        "doc_id long, seq long, from long, to long, class string, confidence double, auxiliary int",
    )
    assert [r.seq for r in align.invalid_labels(ls, list(rules.CLASSES)).orderBy("seq").collect()] == [1, 2, 3]
    assert [(r["from"], r.to) for r in align.clip_labels(ls, 5).orderBy("seq").collect()] == [(2, 4), (3, 5)]
    good = ls.where("seq = 0").union(ls.where("seq = 3"))
    lengths = spark.createDataFrame([(0, 12), (1, 3)], "doc_id long, length long")
    tiled = align.fill_gaps(good, lengths).orderBy("doc_id", "from").collect()
    assert [(r.doc_id, r["from"], r.to, r["class"]) for r in tiled] == [(0, 0, 2, "plain"), (0, 2, 4, "string"), (0, 4, 9, "plain"), (0, 9, 10, "odd"), (0, 10, 12, "plain"), (1, 0, 3, "plain")]
    assert align.rasterize(good).count() == 3


def test_scores(spark):
    pairs = spark.createDataFrame([("plain", "plain"), ("keyword", "keyword"), ("keyword", "plain"), ("string", "string")], "expected string, predicted string")
    m = metrics.confusion(pairs)
    o = metrics.overall(m, exclude=("plain",)).first()
    assert o.accuracy == 0.75 and o.macro_f1 == pytest.approx(5 / 6)
    assert m.where("expected = 'keyword' AND predicted = 'plain'").first().n == 1
    s = metrics.set_metrics(pairs.select("expected"), pairs.select(F.col("predicted").alias("expected")), ["expected"]).first()
    assert (s.matched, s.expected, s.predicted) == (3, 3, 3)
    sizes = spark.createDataFrame([("a", 100)] * 10 + [("b", 4000)] + [("b", 20)] * 5 + [("c", 0)], "language string, n long")
    e = {r.language: r.effective_files for r in metrics.effective_files(sizes, "language", "n").collect()}
    assert e["a"] == 10 and 1 < e["b"] < 1.1 and e["c"] == 0


def test_objective_and_guards(spark):
    cols = "family string, support long, errors long, plain_support long, false_colors long"
    base = spark.createDataFrame([("a", 1000, 100, 500, 10), ("b", 1000, 100, 500, 10), ("c", 5, 1, 5, 0), ("d", 10, 1, 5, 0)], cols)
    cand = spark.createDataFrame([("a", 1000, 105, 500, 10), ("b", 1000, 300, 500, 10), ("c", 5, 1, 5, 0), ("d", 11, 1, 5, 0)], cols)
    g = metrics.guard_decisions(cand, base, min_support=8, min_plain=1, error_allowance=0.01, color_allowance=0.01, z=1.64)
    got = {r.family: r.decision for r in g.where("metric = 'error'").collect()}
    assert got == {"a": "passed", "b": "regression", "c": "insufficient support", "d": "support mismatch"}
    objective = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "family string, weight double")
    whole = metrics.weighted_error(metrics.language_metrics(base.where("family IN ('a', 'b')"), objective)).first()
    assert whole.complete and whole.weighted_error == pytest.approx(0.1)
    part = metrics.weighted_error(metrics.language_metrics(base, objective)).first()
    assert not part.complete and part.weighted_error is None and part.n_unknown == 2
    before = spark.createDataFrame([("yaml", 1000, 100), ("vue", 1000, 100), ("awk", 100, 1), ("zig", 1000, 100)], "language string, support long, errors long")
    after = spark.createDataFrame([("yaml", 1000, 400), ("vue", 1000, 125), ("awk", 100, 90), ("zig", 1000, 10)], "language string, support long, errors long")
    assert [(r.language, round(r.drop, 3)) for r in training.language_drops(after, before).collect()] == [("yaml", 0.3), ("vue", 0.025)]


def test_scopes(spark):
    rows = [["keyword.control.js", "string.quoted.js"], ["invalid.x"], ["punctuation.definition.template-expression.begin.js", "string.template.js"], ["meta.embedded.x", "string.template.js"], ["keyword.operator.x"]]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, s array<string>")
    got = df.select(rules.class_of_scopes(F.col("s")), rules.confidence_of_scopes(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("string", 0.5), ("plain", 0.25), ("operator", 0.5), ("plain", 1.0), ("operator", 1.0)]


def test_paths(spark):
    cases = {
        "src/index.ts": ("typescript", "typescript", "author"), "tests/fixtures/x.tsx": ("tsx", "typescript", "tests"), "README.md": ("markdown", "markdown", "documentation"),
        "dist/index.js": ("javascript", "javascript", None), "a/Dockerfile.alpine": ("docker", "dockerfile", "author"), "Makefile.am": (None, None, "author"),
        "x/rules.mk": ("make", "makefile", "author"), "a.pyx": ("python", "cython", "author"), "samples/Objective-C/a.m": ("objective-c", "objective-c", "tests"),
        "samples/Unknown/a.d": (None, None, "tests"), "BUILD": ("python", "starlark", None), "a\\b\\Main.JAVA": ("java", "java", "author"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string").withColumn("k", rules.language_for_path(F.col("p")))
    got = {r.p: (r.language, r.family, r.stratum) for r in df.select("p", "k.language", "k.family", rules.stratum_of(F.col("p"), F.col("k.language")).alias("stratum")).collect()}
    assert got == cases
    flags = spark.createDataFrame([("a.min.js",), ("a.d.ts",), ("x/package-lock.json",), ("a.ts",)], "p string").select(rules.is_generated(F.col("p"))).collect()
    assert [r[0] for r in flags] == [True, True, True, False]


def test_constructs(spark):
    df = spark.createDataFrame([("/* a\n b */ ${x} \\n", "javascript"), ("a { b: c }", "css"), ("```js\nx\n```", "markdown"), ("^\n", "bat"), ("plain", "x")], "s string, l string")
    got = [r[0] for r in df.select(rules.constructs_of(F.col("s"), F.col("l"), F.col("l"))).collect()]
    assert got == [["multiline-comment", "interpolation", "escape-sequence"], ["css-selector", "css-declaration"], ["multiline-string", "embedded-language"], ["line-continuation"], []]


def test_selection(spark):
    assert corpus.stratum_quotas(200, {"a": 0.7, "b": 0.15, "c": 0.1, "d": 0.05}) == {"a": 140, "b": 30, "c": 20, "d": 10}
    assert sum(corpus.allocate_targets(1000, {"x": 3.0, "y": 1.0, "z": 1.0}, 100).values()) == 1000
    rows = spark.createDataFrame([(k, "ab"[k % 2], 100) for k in range(4)], "seq long, source string, n long")
    got = corpus.balanced_take(rows, "source", "seq", "n", 200).groupBy("source").agg(F.sum("take").alias("t")).collect()
    assert {r.source: r.t for r in got} == {"a": 100, "b": 100}
    one_sided = spark.createDataFrame([(0, "a", 10)] + [(k, "b", 30) for k in range(1, 9)], "seq long, source string, n long")
    assert corpus.balanced_take(one_sided, "source", "seq", "n", 155).agg(F.sum("take")).first()[0] == 155
    turns = spark.createDataFrame([(k, "r", "xxxy"[k % 4]) for k in range(8)], "k long, repo string, g string")
    assert [r.k for r in corpus.round_robin_limit(turns, "repo", "g", "k", 4).orderBy("place").collect()] == [0, 3, 1, 7]


def quota_records(spark, rows):
    names = "seq long, stratum string, family string, language string, source string, minified boolean, n long"
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], names)


def test_select_corpus(spark):
    strata = {"author": 0.7, "compiled": 0.15, "tests": 0.1, "documentation": 0.05}
    rows = [(s, "js", "javascript", f"repo{k % 2}", False, 100) for s in strata for k in range(4)]
    got = corpus.select_corpus(quota_records(spark, rows), 200, strata, {"js": 1.0}, weighted=("author",))
    assert {r.stratum: r.t for r in got.groupBy("stratum").agg(F.sum("take").alias("t")).collect()} == {"author": 140, "compiled": 30, "tests": 20, "documentation": 10}
    two = quota_records(spark, [("author", "js", "javascript", f"repo{k // 2}", False, 100) for k in range(4)])
    got = corpus.select_corpus(two, 200, {"author": 1.0}, {"js": 1.0}, weighted=("author",)).join(two, "seq")
    assert {r.source: r.t for r in got.groupBy("source").agg(F.sum("take").alias("t")).collect()} == {"repo0": 100, "repo1": 100}
    mixed = quota_records(spark, [("author", "ts", lang, f"r{k}", False, 100) for k, lang in enumerate(("typescript", "typescript", "typescript", "tsx", "tsx"))])
    got = corpus.select_corpus(mixed, 300, {"author": 1.0}, {"ts": 1.0}, weighted=("author",), language_floors={"tsx": 150}).join(mixed, "seq")
    per = {r.language: r.t for r in got.groupBy("language").agg(F.sum("take").alias("t")).collect()}
    assert sum(per.values()) == 300 and per["tsx"] == 150
    small = quota_records(spark, [("compiled", "js", "javascript", f"r{k}", k % 2 == 0, 100) for k in range(6)])
    got = corpus.select_corpus(small, 200, {"compiled": 1.0}, {"js": 1.0}, minified_share=0.5).join(small, "seq")
    assert {r.minified: r.t for r in got.groupBy("minified").agg(F.sum("take").alias("t")).collect()} == {True: 100, False: 100}
    uneven = quota_records(spark, [("author", "js", "javascript", "r", False, 40), ("author", "py", "python", "r", False, 500), ("author", "go", "go", "r", False, 500)])
    got = corpus.select_corpus(uneven, 600, {"author": 1.0}, {"js": 2.0, "py": 1.0}, weighted=("author",)).join(uneven, "seq")
    per = {r.family: r.t for r in got.groupBy("family").agg(F.sum("take").alias("t")).collect()}
    assert per["js"] == 40 and sum(per.values()) == 600
    with pytest.raises(ValueError):
        corpus.select_corpus(uneven, 2000, {"author": 1.0}, {"js": 1.0})
    with pytest.raises(ValueError):
        corpus.select_corpus(uneven, 600, {"author": 1.0}, {"js": 1.0}, language_floors={"rust": 10})


def test_select_mining(spark):
    rng = random.Random(12)
    rows = [(rng.choice(("minified", "author")), rng.choice("abc"), "x", rng.choice("st"), False, rng.randint(1, 50)) for _ in range(60)]

    def pool(items, total, floor):
        used, out, left = set(), [], total
        for family in dict.fromkeys(r[1] for _, r in items):
            room = min(floor, left)
            for k, r in items:
                if r[1] == family and room > 0:
                    n = min(room, r[5])
                    out.append((k, n))
                    used.add(k)
                    room, left = room - n, left - n
        queues = {}
        for k, r in items:
            if k not in used:
                queues.setdefault((r[3], r[1]), []).append((k, r[5]))
        while left > 0:
            for queue in queues.values():
                if queue and left > 0:
                    k, n = queue.pop(0)
                    out.append((k, min(n, left)))
                    left -= min(n, left)
        return out

    numbered = list(enumerate(rows))
    got = corpus.select_mining(quota_records(spark, rows), 500, 0.4, 60).orderBy("place", "side").collect()
    want = [pool([x for x in numbered if (x[1][0] == "minified") == small], total, floor) for small, total, floor in ((True, 200, 0), (False, 300, 60))]
    assert [[(r.seq, r["take"]) for r in got if r.side == side] for side in (0, 1)] == want
    with pytest.raises(ValueError):
        corpus.select_mining(quota_records(spark, rows[:3]), 5000)


def test_missed_conditions(spark):
    sums = spark.createDataFrame([("all", "", 200), ("stratum", "a", 141), ("stratum", "b", 59), ("family", "js", 200), ("language", "tsx", 20)], "dimension string, value string, n long")
    bad = corpus.missed_conditions(sums, 200, {"a": 0.7, "b": 0.31}, families=("js", "py"), languages={"tsx": 30}, constructs={"heredoc": 1})
    assert sorted((r.condition, r.name) for r in bad.collect()) == [("construct", "heredoc"), ("family", "py"), ("language", "tsx"), ("stratum", "b")]


def test_running_sums(spark):
    df = spark.createDataFrame([(k % 3, k, k * 2) for k in range(50)], "g int, k long, v long")
    got = {r.k: r.s for r in corpus.running_sums(df, ["g"], "k", {"s": F.col("v")}, width=7).collect()}
    assert got == {k: sum(2 * j for j in range(k % 3, k + 1, 3)) for k in range(50)}


def test_deduplication(spark):
    body = "word " * 40
    rows = [(0, "x", "same "), (1, "x", "same\r\n"), (2, "y", "same"), (3, "x", body + "!"), (4, "x", body.replace(" ", "  ") + "!"), (5, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert sorted(r.doc_id for r in corpus.deduplicate(df, "lang", "doc_id").collect()) == [0, 2, 3, 5]
    assert {r.doc_id: r.copies for r in corpus.exact_duplicates(df, "lang", "doc_id").collect()}[0] == 2
    code = "int x = 1; // first\n/* why */ " + "call(a, b);\n" * 20
    other = code.replace("first", "second thoughts").replace("why", "because")
    twins = spark.createDataFrame([(0, "c", code), (1, "c", other), (2, "d", other), (3, "c", code.replace("x", "y"))], "doc_id long, lang string, text string")
    assert sorted(r.doc_id for r in corpus.deduplicate(twins, "lang", "doc_id").collect()) == [0, 2, 3]


def html_classes(spark, html, engine, family=None):
    df = spark.createDataFrame([(1, html, family)], "k long, html string, family string")
    return [(r.start, r.stop, r["class"]) for r in html_labels.label_html(df, "k", "html", engine, F.col("family")).orderBy("start").collect()]


def test_html_labels(spark):
    html = '<span class="token keyword">const</span> x <span class="token operator">=</span> <span class="token string">"hi"</span> <span class="token operator">&lt;</span> <span class="token number">2</span>'
    assert [c for _, _, c in html_classes(spark, html, "prism")] == ["keyword", "plain", "operator", "plain", "string", "plain", "operator", "plain", "number"]
    nested = '<span class="token template-string">`value <span class="token interpolation"><span class="token interpolation-punctuation punctuation">${</span>name<span class="token interpolation-punctuation punctuation">}</span></span>`</span>'
    assert [c for _, _, c in html_classes(spark, nested, "prism")] == ["string", "operator", "plain", "operator", "string"]
    stray = "</span>a<span class='hljs-title function_'>b<br/>😀</span></span></span><SPAN CLASS=\"hljs-type\">c"
    assert html_classes(spark, stray, "highlight.js") == [(0, 1, "plain"), (1, 5, "function"), (5, 6, "type")]
    prop = '<span class="hljs-attribute">color</span>'
    assert [html_classes(spark, prop, "highlight.js", f)[0][2] for f in ("css", "html")] == ["type", "plain"]
    assert [html_classes(spark, '<span class="token selector">h1</span>', "prism", f)[0][2] for f in ("css", None)] == ["type", "plain"]
    sugar = "".join(f'<span class="sh__token--{k}" style="x">{v}</span>' for k, v in (("class", "12"), ("class", "True"), ("class", "Foo"), ("sign", "="), ("jsxliterals", "y")))
    assert [c for _, _, c in html_classes(spark, sugar, "sugar-high")] == ["number", "constant", "type", "operator", "plain"]
    starry = '<span class="pl-k">if</span><span class="pl-k">=&gt;</span><span class="pl-c1">-1</span><span class="pl-c1">nil</span><span class="pl-s"><span class="pl-x">y</span></span>'
    assert [c for _, _, c in html_classes(spark, starry, "starry-night")] == ["keyword", "operator", "number", "constant", "plain"]
    df = spark.createDataFrame([(1, "y", "<span>x</span>"), (2, "a\n<", "a<br>&#60;"), (3, None, None)], "k long, source string, html string")
    assert [r.k for r in html_labels.unfaithful(df, "source", "html").collect()] == [1]
    text = spark.createDataFrame([("&#65;&#x42;&amp;&apos;&QUOT;&#039; &nbsp;& &#x1F600;&#99999999999;",)], "t string")
    assert text.select(html_labels.decode_entities(F.col("t"))).first()[0] == "AB&'\"' &nbsp;& 😀\ufffd"


def test_quantize(spark):
    df = spark.createDataFrame([([-1.0, 0.0, 1.0, 0.5, -0.5],), ([0.0],)], "v array<double>")
    s = quantize.scale_of(F.col("v"))
    got = df.select(quantize.codes_of(F.col("v"), s).alias("c"), s.alias("s")).collect()
    assert got[0].c == [-31, 0, 31, 16, -15] and got[1].s == 1.0
    assert spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>").select(quantize.argmax(F.col("v"))).first()[0] == 1


def slow_probabilities(p, m):
    """The model written out part by part, for comparison."""
    n, h = len(p), len(m["leafBias"])
    ids = infer.feature_ids(p)
    raw = [sum((m["featureEmbedding"][x[i]] for x in ids if x[i] >= 0), np.zeros(h)) for i in range(n)]
    solid = [k not in (1, 2) for k in p["kind"]]
    zero = np.zeros(h)
    local = []
    for i in range(n):
        v = m["leafBias"].copy()
        for o in range(-2, 3):
            if 0 <= i + o < n:
                v = v + raw[i + o] * m["localOffsetScale"][o + 2]
        before = next((raw[j] for j in range(i - 1, -1, -1) if solid[j]), zero)
        after = next((raw[j] for j in range(i + 1, n) if solid[j]), zero)
        local.append(np.tanh(v + before * m["localNonspaceScale"][0] + after * m["localNonspaceScale"][1]))
    gate = [1 / (1 + np.exp(-(m["stateGate"] @ x + m["stateGateBias"]))) for x in local]
    val = [np.tanh(m["stateInput"] @ x + m["stateInputBias"]) for x in local]
    fwd, s = [], zero
    for i in range(n):
        s = gate[i] * s + (1 - gate[i]) * val[i]
        fwd.append(s)
    bwd, s = [None] * n, zero
    for i in reversed(range(n)):
        s = gate[i] * s + (1 - gate[i]) * val[i]
        bwd[i] = s
    leaf = [np.tanh(local[i] + m["stateMix"] @ np.concatenate([fwd[i], bwd[i]]) + m["stateMixBias"]) for i in range(n)]
    return np.array(leaf)


def test_inference_against_a_plain_form(spark):
    m = infer.random_weights(hidden=8, classifier=6)
    f = P.part_features(docs(spark, "let x = f(a, 'b');\n  return {x};")).orderBy("i").toPandas()
    raw = infer.embed(infer.feature_ids(f), m["featureEmbedding"])
    assert np.allclose(infer.leaf_states(raw, f["kind"].to_numpy(), m), slow_probabilities(f, m))
    leaf = infer.leaf_states(raw, f["kind"].to_numpy(), m)
    assert np.allclose(infer.tree_contexts(leaf[:1], m), leaf[:1])
    p = infer.probabilities(f, m)
    assert np.allclose(p.sum(axis=1), 1) and (p[f["kind"].isin([1, 2])][:, 0] == 1).all()
    got = infer.parse(docs(spark, "let x = 1;", "y"), m).collect()
    assert {r.doc_id for r in got} == {0, 1}
    assert max(r.stop for r in got if r.doc_id == 0) == 10


def test_affine_scan():
    g, v = np.array([[0.5]] * 3), np.array([[2.0], [3.5], [6.0]])
    want, s = [], 0.0
    for a, b in zip(g[:, 0], v[:, 0]):
        s = a * s + (1 - a) * b
        want.append(s)
    assert np.allclose(infer.affine_scan(g, v)[:, 0], want)
    rng = np.random.default_rng(0)
    g, v = rng.random((37, 2)), rng.random((37, 2))
    assert np.allclose(infer.affine_scan(g, v, True), infer.affine_scan(g[::-1], v[::-1])[::-1])


def test_mining(spark):
    rows = []
    for rid, (fam, wrong) in enumerate([("css", "10101000"), ("lua", "01000100"), ("js", "11111111")]):
        for i, w in enumerate(wrong):
            rows.append((rid, fam, fam, i, 8, True, 1, 1 - int(w), 0.25 if w == "1" else 0.9))
    df = spark.createDataFrame(rows, "record_id long, family string, source string, i int, n_parts int, supervised boolean, target int, predicted int, chance double")
    wins = mining.error_windows(df, window=4, stride=2, context=1)
    chosen = mining.choose_windows(wins, ["css", "lua"], max_parts=8, per_source=1).collect()
    assert sorted(r.family for r in chosen) == ["css", "lua"] and sum(r.to - r["from"] for r in chosen) == 8


def test_training_helpers(spark):
    e = spark.createDataFrame([("l", f"f{k % 2}", "x" * (k + 1), None, f"2026-01-0{k + 1}", f"h{k}", None) for k in range(6)] + [("l", "f0", "old", None, "2025", "h0", None)], files.FAILURE_SCHEMA)
    picked = training.diverse_failures(e, max_entries=3).orderBy("place").collect()
    assert [r.source_sha256 for r in picked] == ["h5", "h4", "h3"]
    assert training.newest_failures(e).where("source_sha256 = 'h0'").first().source == "x"
    recs = spark.createDataFrame([(0, "a", 10), (1, "a", 7), (2, "b", 50)], "k long, family string, n long")
    filled = training.fill_floor(recs, "family", "k", "n", {"a": 40}).groupBy("family").agg(F.sum("take").alias("t"))
    assert {r.family: r.t for r in filled.collect()} == {"a": 40, "b": 50}
    batches = training.length_batches(recs, "k", "n", 12).collect()
    assert len({(r.bucket, r.batch) for r in batches}) == 3
    bounds = spark.createDataFrame([(0, i, t, s) for i, (t, s) in enumerate([(1, True), (1, True), (0, False), (2, True), (2, True)])], "doc_id long, i int, target int, supervised boolean")
    assert [r.factor for r in training.boundary_factors(bounds, [2]).orderBy("i").collect()] == [1.0, 2.0, 1.0, 2.0, 1.0]
    assert training.promotion({"weighted_error": 0.1, "top_agreement": 0.9}, {"weighted_error": 0.2, "top_agreement": 0.9}, []) == (True, [])
    assert training.guarded_score(0.9, 0.05, 0.02) == pytest.approx(0.87)
    assert training.upsample(recs, F.col("family") == "b", 3).count() == 5
    counts = spark.createDataFrame([("a", 100, 20), ("b", 100, 1)], "language string, support long, errors long")
    assert {r.language: round(r.multiplier, 6) for r in training.agreement_multipliers(counts, []).collect()} == {"a": 2.0, "b": 1.0}


def test_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"split":"train","source":"a b","path":"p"}\n\n{"split":"train","source":"c"}', encoding="utf-8")
    got = files.read_shard(spark, str(tmp_path / "s.jsonl"))
    assert sorted(r.source for r in got.collect()) == ["a b", "c"]
    files.write_shard(got, str(tmp_path / "out"))
    assert files.read_shard(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"split": nope\n')
    with pytest.raises(Exception):
        files.read_shard(spark, str(tmp_path / "bad.jsonl")).collect()
    d = tmp_path / "scan" / "deep"
    d.mkdir(parents=True)
    (d / "ok.txt").write_text("héllo", encoding="utf-8")
    (d / "bad.txt").write_bytes(b"\xff\xfe")
    (d / "big.txt").write_bytes(b"x" * 100)
    (d / "none.txt").write_bytes(b"")
    status = {r.path.rsplit("/", 1)[1]: (r.status, r.text) for r in files.scan_folder(spark, str(tmp_path / "scan"), 50).collect()}
    assert status == {"ok.txt": ("ok", "héllo"), "bad.txt": ("not UTF-8", None), "big.txt": ("too large", None)}
    assert files.failures_or_none(spark, str(tmp_path / "nothing.json")).count() == 0
    rows = spark.createDataFrame([(k, "f", 10) for k in range(10)], "k long, family string, n long")
    assert [(r.k, r["take"]) for r in files.load_within(rows, "k", "n", 25).orderBy("k").collect()] == [(0, 10), (1, 10), (2, 5)]
    name = spark.range(1).select(files.safe_file_name(F.lit("a b/c"))).first()[0]
    assert name == "a-b-c-" + hashlib.sha256(b"a b/c").hexdigest()[:12]


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(u, k, f"v{k}") for k, u in enumerate([1, 2, 1, 1, 2])], "user long, k long, v string")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.text_stream(spark, str(tmp_path / "in"), "user long, k long, v string", 1)
    q = streams.write_latest(stream, "user", ["k"], ["k", "v"], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.user: r.v for r in got.collect()} == {1: "v3", 2: "v4"}
    chunk = "doc_id long, i int, start long, stop long, class string, level int, last boolean"
    rows = [(0, 0, 0, 2, "a", 9, False), (0, 1, 2, 3, "a", 5, False), (0, 2, 3, 4, "b", 7, False), (0, 3, 4, 9, "b", 6, True)]
    for k in range(2):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], chunk).coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    out = streams.stream_spans(streams.text_stream(spark, str(tmp_path / "chunks"), chunk, 1))
    q = out.writeStream.format("memory").queryName("open_spans").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(90)
    got = sorted((r["class"], r.start, r.stop, r.level) for r in spark.sql("SELECT * FROM open_spans").collect())
    assert got == [("a", 0, 3, 5), ("b", 3, 9, 6)] or sum(x[2] - x[1] for x in got) == 9


def test_weights(spark):
    counts = spark.createDataFrame([("a", 90), ("b", 10)], "class string, n long")
    w = {r["class"]: r.weight for r in metrics.class_weights(counts).collect()}
    raw = {k: min(4, math.sqrt(100 / (2 * n))) for k, n in (("a", 90), ("b", 10))}
    assert w["b"] == pytest.approx(raw["b"] / (sum(raw.values()) / 2))
    bits = spark.createDataFrame([(1,), (1,), (0,), (0,), (0,)], "m int")
    got = {r.bit: r.weight for r in metrics.auxiliary_weights(bits, "m", bits=2).collect()}
    assert got == {0: pytest.approx(math.sqrt(1.5)), 1: 1.0}


def test_raw_tokens_and_segments(spark):
    got = [r.value for r in raw_input.raw_tokens(docs(spark, "ab12 += é_x(';')\n--z")).orderBy("i").collect()]
    assert got == ["ab", "12", "+=", "é_x", "(", "'", ";", "'", ")", "--", "z"]
    text = "\n".join(["word " * 9] * 40 + [""] + ["word " * 9] * 60)
    rows = raw_input.segments(docs(spark, text, "", None), least=100, most=200).orderBy("doc_id", "first").collect()
    mine = [(r["first"], r["count"]) for r in rows if r.doc_id == 0]
    assert [a + n for a, n in mine][:-1] == [a for a, _ in mine][1:] and sum(n for _, n in mine) == 900
    assert all(n <= 200 for _, n in mine) and all(a % 9 == 0 for a, _ in mine)
    assert [(r["first"], r["count"]) for r in rows if r.doc_id > 0] == [(0, 0), (0, 0)]
    assert [n for _, n in raw_input.segment_cuts("'" + " word" * 500, 100, 200)] == [200, 200, 101]
    assert raw_input.segment_cuts("") == [(0, 0)] and raw_input.segment_cuts("a b", 1, 2) == [(0, 2)]
    code = ("x = 1\n" * 30 + "/* a\nb */ f(\n" + "y, \n" * 30 + ")\n\n") * 4
    for least, most in ((20, 40), (64, 100), (100, 130)):
        n, line, free, blank = raw_input.line_starts(code)
        begin, cuts = 0, raw_input.segment_cuts(code, least, most)
        assert cuts[0][0] == 0 and sum(c for _, c in cuts) == n
        for first, count in cuts[:-1]:
            second_half = range(first + least // 2, first + least)
            choice = [k for k in second_half if k in blank] or [k for k in second_half if k in free]
            choice = choice[-1:] or [k for k in range(first + least, first + most) if k in free][:1]
            choice = choice or [k for k in range(first + 1, first + most) if k in line][-1:] or [first + most]
            assert first == begin and [first + count] == choice
            begin = first + count


def test_line_starts():
    n, line, free, blank = raw_input.line_starts("a /* b\nc */ d\n(e\nf)\ng 'h\ni' j // ' (\nk\n \nl")
    tokens = [m[0] for m in raw_input.SPLIT.finditer("a /* b\nc */ d\n(e\nf)\ng 'h\ni' j // ' (\nk\n \nl")]
    assert n == len(tokens) and [tokens[k] for k in line] == ["c", "(", "f", "g", "i", "k", "l"]
    assert [tokens[k] for k in free] == ["(", "g", "k", "l"] and [tokens[k] for k in blank] == ["l"]


def test_profile_and_lite_hashes(spark):
    p = raw_input.document_profiles(docs(spark, "f(a)[b] // <>\n  x", "", None)).orderBy("doc_id").collect()
    assert p[0].brackets == 3 and p[0].pairs == 3 and p[0].sigils == 0
    assert (p[1].brackets, p[1].sketch, p[2].sketch) == (0, 0, 0)

    def low(word, start, factor, keep):
        h = start
        for c in word:
            h = ((h ^ ord(c)) * factor) & 0xFFFFFFFF
        return (h ^ h >> 16) & keep

    got = docs(spark, "Foo_1").select(raw_input.lite_hashes(F.col("text")).alias("h")).first().h
    assert tuple(got) == (low("Foo_1", 2166136261, 16777619, 511), low("Foo_1", 0x9E3779B9, 2246822519, 127))


def test_agreement(spark):
    rows = "doc_id long, i int, class string"
    a = spark.createDataFrame([(0, 0, "plain"), (0, 1, "string"), (1, 0, "plain")], rows)
    b = spark.createDataFrame([(0, 0, "plain"), (0, 1, "number")], rows)
    assert {r.doc_id: (r.correct, r.total, r.value) for r in metrics.agreement(a, b).collect()} == {0: (1, 2, 0.5), 1: (1, 1, 1.0)}


def test_codecs():
    from textloom.functions import codec

    codes = np.array([-31, 0, 31, 16, -15])
    packed = codec.pack_signed(codes, 6)
    assert len(packed) == 4 and (codec.unpack_signed(packed, 6, 5) == codes).all()
    assert (codec.unzigzag(codec.zigzag(codes)) == codes).all()
    assert codec.half_to_float(np.array([0x3C00, 0x0001]))[0] == 1.0
    import base64

    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~"
    assert codec.decode_base85(base64.b85encode(b"hello, codec").decode(), alphabet) == b"hello, codec"


def test_token_labels_and_engines(spark):
    kind = "doc_id long, offset long, content string, explanation array<struct<content:string,scopes:array<string>>>"
    rows = [(0, 0, "a=1", [("a", ["source.x"]), ("=", ["keyword.operator.x"]), ("1", ["constant.numeric.x"])]), (0, 4, "zz", [("z", ["x"])])]
    t = spark.createDataFrame(rows, kind)
    got = align.labels_of_tokens(t.where("offset = 0")).orderBy("from").collect()
    assert [(r["from"], r.to, r["class"]) for r in got] == [(0, 1, "plain"), (1, 2, "operator"), (2, 3, "number")]
    assert [r.offset for r in align.malformed_tokens(t, docs(spark, "a=1 zz")).collect()] == [4]
    counts = spark.createDataFrame([("e", "a", 10, 9, True), ("e", "b", 10, 5, True), ("f", "a", 10, 10, True), ("f", "b", 10, 10, False)], "engine string, family string, support long, correct long, mapped boolean")
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "family string, weight double")
    assert [(r.engine, r.agreement, r.coverage) for r in metrics.engine_agreement(counts, weights).collect()] == [("e", pytest.approx(0.7), 1.0), ("f", 0.5, 0.5)]
    bands = spark.createDataFrame([(0.96,), (0.9,), (0.1,)], "a double").select(metrics.accuracy_band(F.col("a"))).collect()
    assert [r[0] for r in bands] == ["95+", "90+", "below"]


def test_replay_mix(spark):
    rng = random.Random(8)
    for case in range(4):
        base = [(k, rng.randint(1, 60)) for k in range(rng.choice((5, 40)))]
        hard = [(100 + k, rng.randint(1, 30)) for k in range(rng.choice((0, 1, 6)))]
        fraction, repeats = rng.choice((0.1, 0.25, 0.6)), rng.choice((1, 3))
        tables = [spark.createDataFrame(x, "k long, n long") for x in (base, hard)]
        plan = training.mix_replay(*tables, "k", "n", fraction, repeats).orderBy("order1", "order2", "order3").collect()
        target = math.floor(sum(n for _, n in base) * fraction / (1 - fraction) + 0.5)
        want = min(target, repeats * sum(n for _, n in hard))
        held = {"base": 0, "hard": 0}
        for r in plan:
            share = held["hard"] / max(1, sum(held.values()))
            if r.side == "hard":
                assert share < fraction or held["base"] == sum(n for _, n in base)
            else:
                assert share >= fraction - 1e-12 or held["hard"] == want
            held[r.side] += r["take"]
        assert held == {"base": sum(n for _, n in base), "hard": want}
        assert [r.k for r in plan if r.side == "base"] == [k for k, _ in base]
        again = [k for _ in range(repeats) for k, _ in hard]
        assert [r.k for r in plan if r.side == "hard"] == again[: sum(r.side == "hard" for r in plan)]


def test_partition_and_batches(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice((1, 5, 5, 9, 40))) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, n long")
    got = training.balanced_partition(df, "k", "n", 7).collect()
    loads = Counter()
    for r in got:
        loads[r.bin] += r.n
    assert len(got) == 200 and set(loads) == set(range(7)) and max(loads.values()) - min(loads.values()) <= 40
    sums = {(r.bucket, r.batch): r.s for r in training.length_batches(df, "k", "n", 50).groupBy("bucket", "batch").agg(F.sum("n").alias("s")).collect()}
    assert sum(sums.values()) == sum(n for _, n in rows) and max(sums.values()) < 50 + 40


def test_shard_errors_and_folders(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"split":"train"}\n\nnot json\n{"path":"\u2028 in"}\n{"x"', encoding="utf-8")
    bad = files.malformed_lines(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()
    assert [(r.line, r.text) for r in bad] == [(3, "not json"), (5, '{"x"')] and bad[0].file.endswith("a.jsonl")
    root = tmp_path / "tree"
    for name, body in (("b.txt", b"b"), ("a.txt", b"a"), ("empty", b""), ("node_modules/x.js", b"x"), ("src/bad", b"\xff"), ("src/long", b"y" * 99)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    got = files.scan_folder(spark, str(root), 50).collect()
    assert [(r.path.rsplit("/", 1)[1], r.status) for r in got] == [("a.txt", "ok"), ("b.txt", "ok"), ("bad", "not UTF-8"), ("long", "too large")]
    names = [str(root / n) for n in ("a.txt", "empty", "src/bad", "src/long", "b.txt")]
    status = {r.path.rsplit("/", 1)[1]: r.status.split(":")[0] for r in files.listed_files(spark, names, 4, 50).collect()}
    assert status == {"a.txt": "record", "empty": "skipped", "bad": "malformed", "long": "skipped", "b.txt": "skipped"}


def test_listed_files_match_whole_relative_paths(spark, tmp_path, monkeypatch):
    (tmp_path / "s").mkdir()
    (tmp_path / "a b+%.js").write_text("outer")
    (tmp_path / "s" / "a b+%.js").write_text("inner")
    names = [os.path.relpath(tmp_path / x) for x in ("a b+%.js", "s/a b+%.js", "a b+%.js")]
    got = files.listed_files(spark, names, 9, 50)
    assert [r.text for r in sorted(got.collect(), key=lambda r: r.path)] == ["outer", "outer", "inner"]
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_csr_round_trip_and_replace(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, [rng.randint(-9, 10**6) for _ in range(rng.randint(0, 5))]) for k in range(50)]
    df = spark.createDataFrame(rows, "k long, v array<int>")
    files.write_csr(df, str(tmp_path / "csr"), "k", "v", block=8)
    assert sorted((r.key, r["values"]) for r in files.read_csr(spark, str(tmp_path / "csr")).collect()) == rows
    assert sorted(r.key for r in files.read_csr(spark, str(tmp_path / "csr"), 13, 29).collect()) == list(range(13, 29))
    plan = files.read_csr(spark, str(tmp_path / "csr"), 13, 29)._jdf.queryExecution().toString()
    assert "LessThan(first,29)" in plan and "GreaterThanOrEqual(last,13)" in plan
    for n in (3, 5):
        files.replace(df.limit(n), str(tmp_path / "table"))
        assert spark.read.parquet(str(tmp_path / "table")).count() == n
    files.write_summary(df.agg(F.count("*").alias("n")), str(tmp_path / "summary.json"))
    assert spark.read.json(str(tmp_path / "summary.json")).first().n == 50
    assert not [p.name for p in tmp_path.iterdir() if ".new-" in p.name or ".old-" in p.name]


def test_checkpoint_and_codecs(spark, tmp_path):
    import json

    from textloom.functions import codec

    folder = tmp_path / "model"
    folder.mkdir()
    codes = np.array([-31, 0, 31, 16, -15])
    packed, floats = codec.pack_signed(codes, 6), np.array([1.5, -2.0], "<f4").tobytes()
    (folder / "data.bin").write_bytes(packed + floats)
    manifest = [{"name": "a", "shape": [5], "offset": 0, "length": len(packed), "bits": 6, "scale": 0.5}, {"name": "b", "shape": [2, 1], "offset": len(packed), "length": 8}]
    (folder / "model.json").write_text(json.dumps(manifest))
    got = files.load_checkpoint(spark, str(folder))
    assert got["a"].tolist() == (codes * 0.5).tolist() and got["b"].tolist() == [[1.5], [-2.0]]
    (folder / "other.bin").write_bytes(b"x")
    with pytest.raises(ValueError):
        files.load_checkpoint(spark, str(folder))
    some = np.arange(37) % 16
    assert codec.unpack_bit_planes(codec.pack_bit_planes(some, 4), 4, 37).tolist() == some.tolist()
    x = codec.xorshift(7, 1000)
    assert 0 <= x.min() and x.max() < 1 and 0.45 < x.mean() < 0.55 and len(set(x.tolist())) == 1000
    kept = codec.runtime_rows()
    assert len(kept) == 749 and codec.runtime_ids(np.array([0, 658, 660, 754, -1])).tolist() == [0, 658, 659, 748, -1]
    assert codec.widened_rows(np.arange(6).reshape(6, 1), 2, 2, 4).ravel().tolist() == [0, 1, 2, 3, 2, 3, 4, 5]


def test_stream_shard(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text('{"split":"train","source":"x%d"}\n' % k)
    query = files.stream_shard(spark, str(tmp_path / "in"), max_files=1).writeStream.format("memory").queryName("shards").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.source for r in spark.table("shards").collect()) == ["x0", "x1", "x2"]


def lite_by_loops(ids, m):
    """The lite model part by part and channel by channel."""
    sig, tanh = (lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))), (lambda x: math.tanh(max(-15, min(15, x))))
    dot = lambda name, k, x: m[f"{name}.bias"][k] + sum(w * v for w, v in zip(m[name][k], x))
    rms = lambda x, gain: [v / math.sqrt(sum(y * y for y in x) / len(x) + 1e-6) * g for v, g in zip(x, gain)]
    n, d = len(ids[0]), lite.DIM
    x = [[dot("up", c, [sum(m["embedding"][int(f[t])][e] for f in ids if f[t] >= 0) for e in range(32)]) for c in range(d)] for t in range(n)]
    first = [row[:] for row in x]
    mean, most = ([f([row[c] for row in x]) for c in range(d)] for f in (lambda v: sum(v) / n, max))
    low = rms(mean + most, m["film.gain"])
    low = [tanh(dot("film.down", k, low)) for k in range(lite.FILM)]
    up = [tanh(dot("film.up", k, low)) for k in range(lite.LAYERS * 2 * d)]
    for layer, dilation in enumerate(lite.DILATIONS):
        name, s = f"layer{layer}", m["film.strength"][layer]
        y = [[v * (1 + s[c] * up[(2 * layer) * d + c]) + s[c] * up[(2 * layer + 1) * d + c] for c, v in enumerate(rms(row, m[f"{name}.gain"]))] for row in x]
        at = lambda t, c: y[t][c] if 0 <= t < n else 0.0  # noqa: E731, B023
        local = [[m[f"{name}.taps.bias"][c] + sum(m[f"{name}.taps"][c][k] * at(t + (k - 2) * dilation, c) for k in range(5)) for c in range(d)] for t in range(n)]
        put, erase = [], []
        for row in local:
            rank = [tanh(dot(f"{name}.erase.down", k, row)) for k in range(lite.ERASE)]
            erase.append([sig(dot(f"{name}.erase.up", k, rank)) for k in range(2 * d)])
            put.append([tanh(dot(f"{name}.in", c, row)) * sig(dot(f"{name}.in", d + c, row)) for c in range(d)])
        ahead, back = [[0.0] * d for _ in range(n)], [[0.0] * d for _ in range(n)]
        for c in range(d):
            h = 0.0
            for t in range(n):
                ahead[t][c] = h = sig(m[f"{name}.base"][c]) * (1 - erase[t][c]) * h + put[t][c]
            h = 0.0
            for t in reversed(range(n)):
                back[t][c] = h = sig(m[f"{name}.base"][d + c]) * (1 - erase[t][d + c]) * h + put[t][c]
        x = [[x[t][c] + dot(f"{name}.out", c, ahead[t] + back[t]) * sig(m[f"{name}.gate"][c]) for c in range(d)] for t in range(n)]
    out = []
    mean, most = ([f([row[c] for row in x]) for c in range(d)] for f in (lambda v: sum(v) / n, max))
    for t in range(n):
        g = [[sig(x[k][c] * m["pool.declared"][c]) for k in range(t + 1)] for c in range(d)]
        prefix = [sum(x[k][c] * g[c][k] for k in range(t + 1)) / max(1.0, sum(g[c])) for c in range(d)]
        suffix = [sum(x[k][c] for k in range(t, n)) / (n - t) for c in range(d)]
        context = [tanh(dot("pool", c, mean + most + prefix + suffix)) * sig(dot("pool.gate", c, x[t])) for c in range(d)]
        joined = rms([x[t][c] + m["highway"] * first[t][c] for c in range(d)], m["head.gain"]) + context
        hidden = [dot("head", k, joined) for k in range(lite.HEAD)]
        hidden = [0.5 * a * (1 + tanh(0.7978845608 * (a + 0.044715 * a**3))) for a in hidden]
        out.append([dot("classes", k, hidden) for k in range(lite.N_CLASSES)])
    return np.array(out)


def test_lite_model(spark):
    import pyarrow as pa

    words = ["Foo_1", " ", "BAR", "\n", "  ", "\\", "/", "/", "x", "é9"]
    p = lite.lite_parts(pa.array(words), np.array([len(words)]))
    assert (p["len_bucket"][0], p["first_char"][0], p["last_char"][0], p["flags"][0]) == (2, 70, 49, 31) and p["flags"][2] & 128
    assert p["flags"][4] & 16 and p["flags"][5] & 64 and p["next_pair"][6] == p["prev_pair"][7] == 1
    m = lite.random_lite_weights(3)
    ids = lite.lite_ids(p)
    assert np.allclose(lite.lite_logits(ids, m), lite_by_loops(ids, m), atol=1e-9)
    rows = docs(spark, "a b + c", "", None, "def f(x):\n  return x")
    got = lite.parse_lite(rows, m).orderBy("doc_id", "start").collect()
    for doc, n in ((0, 7), (3, 20)):
        mine = [(r.start, r.stop) for r in got if r.doc_id == doc]
        assert mine[0][0] == 0 and mine[-1][1] == n and [b for _, b in mine[:-1]] == [a for a, _ in mine[1:]]
    alone = {i: [r["class"] for r in lite.classify_lite(docs(spark, t), m).orderBy("i").collect()] for i, t in ((0, "a b + c"), (3, "def f(x):\n  return x"))}
    both = lite.classify_lite(rows, m).orderBy("doc_id", "i").collect()
    assert {i: [r["class"] for r in both if r.doc_id == i] for i in (0, 3)} == alone


def test_aligned_documents_equal_the_interval_join(spark):
    rng, texts, labels = random.Random(2), [], []
    for d in range(12):
        texts.append((d, "".join(rng.choice(("word", " ", "a1", "+", "é😀", "\n")) for _ in range(rng.randint(0, 60)))))
        for seq in range(rng.randint(0, 20)):
            a = rng.randint(0, 150)
            labels.append((d, seq, a, a + rng.randint(-1, 40), rng.choice(rules.CLASSES), rng.choice((None, 0.25, 1.0)), rng.choice((None, 1, 6))))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    ls = spark.createDataFrame(labels, "doc_id long, seq long, from long, to long, class string, confidence double, auxiliary int")
    row = lambda r: (r.doc_id, r.i, r.start, r.stop, r["class"], r.auxiliary, r.confidence, round(r.coverage, 9))
    want = sorted(map(row, align.align_labels(ls, P.part_table(df)).collect()))
    got = sorted(map(row, align.align_documents(df, ls, rules.CLASSES).collect()))
    assert got == want and len(got) > 200
