"""Structural digests by language and by labels, SQL functions of parts, and locale order."""

import random

from pyspark.sql import functions as F

from textloom.functions import parts
from textloom.operators import corpus, folds


def test_comments_are_those_of_the_language(spark):
    defines = lambda tag: f"#include <{tag}.h>\n" + "".join(f"#define {tag}{k} {k}\n" for k in range(20))
    headings = lambda tag: "".join(f"# {tag} {k}\nsome text below\n" for k in range(12))
    python = lambda tag: "".join(f"x{k} = {k}  # {tag}\n" for k in range(20))
    rows = [(k, f, make(t)) for k, (f, make, t) in enumerate((f, m, t) for f, m in (("c", defines), ("markdown", headings), ("python", python), ("nothing", python)) for t in ("one", "two"))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    # Two C files with other defines and two documents with other headings differ; only Python's # is a comment.
    assert sorted(r.doc_id for r in corpus.deduplicate(df, "lang", "doc_id").collect()) == [0, 1, 2, 3, 4, 6, 7]


def test_labels_say_what_a_comment_is(spark):
    rng = random.Random(4)
    docs, labels, want = [], [], {}
    for k in range(40):
        words = [rng.choice(["a", "bc", "#x", "12", "é", "😀"]) for _ in range(rng.choice([5, 60, 80]))]
        text = " ".join(words)
        units = lambda s: len(s.encode("utf-16-le")) // 2
        spots = [(0, 3), (10, 11), (10, 40), (5, 5)][: k % 5] if k % 3 else []
        docs.append((k, "f", text))
        labels += [(k, a, b) for a, b in spots]
        tokens, at = [], 0
        for value in spark_parts(text):
            tokens.append((at, at + units(value), value))
            at += units(value)
        keep = tuple(v for a, b, v in tokens if not any(s < b and e > a and e > s for s, e in spots))
        want[k] = keep if at >= 128 and len(tokens) >= 16 else None
    df = spark.createDataFrame([*docs, (90, "f", None), (91, None, docs[1][2])], "doc_id long, lang string, text string")
    spots = spark.createDataFrame([*labels, (1, 2, 9)], "doc_id long, start long, stop long") if labels else None
    got = {r.doc_id: r.digest for r in corpus.labelled_digests(df, spots.where("NOT (doc_id = 1 AND start = 2)"), "lang").collect()}
    assert got[90] is None and (got[91] is None) == (want[1] is None)
    assert {k for k, v in want.items() if v is None} == {k for k in want if got[k] is None}
    for a in want:
        for b in want:
            if want[a] is not None and want[b] is not None:
                assert (got[a] == got[b]) == (want[a] == want[b])


def spark_parts(text):
    import re

    return re.findall(r"[0-9A-Za-z_\x80-\U0010FFFF]+|[\t\x0B\f ]+|\r\n|[\r\n]|[^0-9A-Za-z_\x80-\U0010FFFF\t\x0B\f \r\n]", text)


def test_sql_functions_of_parts(spark):
    texts = ["let x = 1;\r\n\tend", "", None, "é😀 'q' \\d", "\f\n"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    parts.register_functions(spark)
    got = spark.sql("SELECT doc_id, p.i, p.value, p.kind, p.units FROM {d} d, LATERAL text_parts(d.text) p", d=docs).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in parts.explode_parts(docs).select("doc_id", "i", "value", "kind", "units").collect())
    row = spark.sql("SELECT is_word_part('a1'), is_space_part('\t'), is_newline_part('\r\n'), is_symbol_part(';'), is_word_part(';'), is_word_part(''), is_word_part(null), part_kind('é')").first()
    assert list(row) == [True, True, True, True, False, False, False, 0]
    plan = spark.sql("SELECT p.kind, count(*) FROM {d} d, LATERAL text_parts(d.text) p GROUP BY ALL", d=docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Join" not in plan.split("== Physical Plan ==")[1]


def test_names_in_locale_order(spark):
    names = ["b", "A", "a", "Ä", "z", "B", "ä", None, "a b", "ab"]
    df = spark.createDataFrame([*enumerate(names)], "id long, name string")
    got = [r.name for r in sorted(folds.ranked(df, [], [F.collate("name", "UNICODE"), F.asc("id")]).collect(), key=lambda r: r["rank"])]
    assert got == [None, "a", "A", "ä", "Ä", "a b", "ab", "b", "B", "z"]


def test_truncation_counts_units(spark):
    from textloom.functions import names

    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "é", "😀", "\uf8ff", "𝒳"]) for _ in range(rng.randrange(12))) for _ in range(60)] + ["", None, "x" * 9]
    df = spark.createDataFrame([*enumerate(texts)], "k int, t string")
    for most in (1, 4, 7):
        got = {r.k: r.s for r in df.select("k", names.truncated(F.col("t"), most).alias("s")).collect()}
        want = {k: t and t.encode("utf-16-le")[: 2 * most].decode("utf-16-le", "ignore") for k, t in enumerate(texts)}
        assert got == want
