"""The pipeline on a small folder of tables: what goes, what stays, and that every id is packed once."""

import random

import corpus_pipeline
import pyarrow as pa
from textloom.llm.decontaminate import decontaminate_stage
from textloom.llm.quality import quality_stage
from textloom.llm.secrets import clean_stage
from textloom.llm.simhash_groups import near_dedup_stage, near_groups

from .test_operators import ids_of, prose

KEY = "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def test_pipeline(spark, tmp_path):
    item = " ".join(f"quiz{k}" for k in range(30))
    rows = [(k, prose(120, k)) for k in range(80)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]  # exact copies
    rows += [(200 + k, rows[k][1].replace(" ", " ", 1) + " end") for k in range(5)]  # near copies
    rows += [(300 + k, " ".join(w + "$$$" for w in prose(120, 900 + k).split())) for k in range(20)]  # junk
    rows += [(400, f"{prose(60, 77)} {item} {prose(60, 78)}")]
    for k in (50, 52, 54, 55):
        rows[k] = (k, f"{rows[k][1]} {KEY} end{k}")
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, 1, 0) for i in range(60)] + [(300 + k, 0, 0) for k in range(10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert at.columns == docs.columns
        left[name] = {r.doc_id for r in at.collect()}
    everything = {i for i, _ in rows}
    assert left["quality"] == everything - set(range(300, 320)) | (left["quality"] & {400})
    assert left["near_dedup"] == left["quality"] - set(range(100, 105)) - set(range(200, 205))
    assert left["decontaminate"] == left["near_dedup"] - {400}
    assert left["secrets"] == left["decontaminate"] == left["packing"]
    clean = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "stage3")).collect()}
    assert KEY not in clean[50].text and "[SECRET]" in clean[50].text and clean[50].n_chars == len(clean[50].text)
    assert all(clean[i].text == t for i, t in rows if i in clean and KEY not in t)
    packed = spark.read.parquet(str(tmp_path / "stage4")).groupBy("doc_id").sum("length").collect()
    want = {i: len(x) + 1 for i, x in zip(clean, ids_of([r.text for r in clean.values()]))}
    assert {r.doc_id: r["sum(length)"] for r in packed} == want
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in again.collect()} == left["packing"]


def test_stages_take_awkward_rows(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, None, 3)], "doc_id long, text string, index int")
    assert decontaminate_stage(spark, df, str(tmp_path)).count() == 3
    assert sorted((r["index"], r.text) for r in clean_stage(spark, df, "").collect()) == [(1, None), (2, ""), (3, None)]


def small_folder(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_on_empty_tables(spark, tmp_path):
    small_folder(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_awkward_rows(spark, tmp_path):
    rows = [(None, None, "en", "s", None, "k"), (1, None, "en", "s", 0, "k"), (2, "", None, None, 0, "k"), (3, "same words here", "en", "s", 15, "k"), (3, "same words here", "en", "s", 15, "k"), (4, prose(30_000, 5), "en", "s", None, None)]
    small_folder(spark, str(tmp_path), rows, [])
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert quality_stage(spark, at, str(tmp_path)).count() == len(rows)
    kept = near_dedup_stage(spark, at, str(tmp_path)).collect()
    # Null and empty texts are copies of each other; a row without an id stays, repeated rows stay together.
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3, 3, 4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {None, 1, 3, 4}


def test_stages_hold_small_batches_of_texts(spark, tmp_path):
    docs = [(k, "word " * 1_000) for k in range(2_000)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["n_bytes", "n_rows"])

    stage = corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(measured, "n_bytes long, n_rows long"))
    found = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect()
    # All 10 MB were one batch.
    assert sum(r.n_rows for r in found) == 2_000 and max(r.n_bytes for r in found) < 2 << 20
    assert all(hasattr(s, "__wrapped__") for _, s in corpus_pipeline.STAGES)


def test_near_dedup_stage_by_brute_force(spark):
    rng, texts = random.Random(17), []
    for k in range(12):
        words = prose(rng.randint(5, 80), k).split()
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(w if rng.random() > 0.02 else f"new{rng.random()}" for w in words))
    rows = list(enumerate(texts))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in (t.lower().split() for t in texts)]
    top = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(top[a], top[b]), min(top[a], top[b])
                top = [new if x == old else x for x in top]
    kept = near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(top))


def test_near_dedup_stage_where_ids_recur(spark):
    """No group goes as a whole: of an id with several texts, each goes by its own group."""
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, a), (5, a + " end"), (5, b), (9, b), (9, c), (9, c), (12, c.upper()), (12, None), (13, ""), (None, a), (None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row long, doc_id long, text string")
    kept = near_dedup_stage(spark, df, "")
    assert kept.columns == df.columns
    # Of a: id 1; of b: 5; of c: both rows of 9; of no words: 12. Rows without an id stay.
    assert sorted(r.row for r in kept.collect()) == [0, 2, 4, 5, 7, 9, 10]
    groups = near_groups(df)
    assert groups.columns == ["doc_id", "group_id"]
    assert sorted(map(tuple, groups.collect())) == [(1, 1), (5, 1), (5, 5), (9, 5), (9, 9), (9, 9), (12, 9), (12, 12), (13, 12)]
