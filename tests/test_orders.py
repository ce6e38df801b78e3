"""Ranks, bins, turns, chosen windows, aliases and closures against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import folds, graphs, mining, training


def test_ranks_of_groups_of_any_size(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.randrange(6)) for k in range(500)]
    got = folds.ranked(spark.createDataFrame(rows, "id long, g string, n int"), ["g"], [F.desc("n"), F.asc("id")]).collect()
    for g in "ab", None:
        want = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == [r[0] for r in want]
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(1, len(want) + 1))
    assert folds.ranked(spark.createDataFrame([], "id long"), [], [F.asc("id")]).count() == 0


def bins_by_loop(sizes, count):
    loads, out = [0] * count, []
    for n in sizes:
        b = loads.index(min(loads))
        loads[b] += n
        out.append(b)
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=6), st.integers(0, 9), st.integers(1, 50))
def test_equal_sizes_go_to_the_least_loaded_bins(loads, size, items):
    loads = np.array(loads)
    want, now = [], loads.copy()
    for _ in range(items):
        b = int(np.argmin(now))
        want.append(b)
        now[b] += size
    assert folds.bins_taken(loads, size, np.arange(items)).tolist() == want
    assert folds.loads_taken(loads, size, items).tolist() == [want.count(b) for b in range(len(loads))]


def test_least_loaded(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([0, 1, 5, 5, 5, 33, 400])) for k in range(300)] + [(999, None)]
    got = {r.id: r.bin for r in folds.least_loaded(spark.createDataFrame(rows, "id long, n long"), "id", "n", 7).collect()}
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    assert got == dict(zip([r[0] for r in order], bins_by_loop([r[1] for r in order], 7)))


def test_heavier_records_come_earlier_in_proportion(spark):
    """Of two records with weights 1 and 3, the heavier one is first in three of four seeds."""
    first = Counter()
    df = spark.createDataFrame([(k, 1.0 if k % 2 == 0 else 3.0) for k in range(1200)], "id long, w double").withColumn("pair", F.floor(F.col("id") / 2))
    rows = df.withColumn("d", folds.drawn(F.col("id"), F.col("w"), 3)).groupBy("pair").agg(F.max_by("w", "d").alias("w")).collect()
    first.update(r.w for r in rows)
    assert 0.69 < first[3.0] / 600 < 0.81


def test_weighted_turns(spark):
    rows = [(k, "abc"[k % 3] if k < 20 else "a") for k in range(30)]
    got = sorted(folds.weighted_turns(spark.createDataFrame(rows, "id long, f string"), "id", "f", F.lit(1), 1).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, 31)) and [r.turn for r in got] == sorted(r.turn for r in got)
    assert [r.f for r in got[:6]] == ["a", "b", "c"] * 2
    assert [r.id for r in got if r.f == "a"] != sorted(r.id for r in got if r.f == "a")


def kept_by_list(windows):
    out = []
    for w in sorted(windows, key=lambda w: (-w[5], -w[3], -w[4], w[1])):
        if all(mining.overlap_share(w[1], w[2], x[1], x[2]) <= 0.5 for x in out):
            out.append(w)
    return out


def test_covered_windows_of_a_long_record(spark):
    """Windows of one record, thousands of them, ties and a falling chain of scores among them."""
    rng = random.Random(7)
    rows = []
    for record, n in ((1, 3000), (2, 40), (3, 1)):
        for k in range(n):
            start = 32 * k + rng.choice([0, 0, 5])
            rows.append((record, start, start + rng.choice([128, 128, 70]), rng.randrange(3), 0.5, float(rng.randrange(4)) if k > 60 else 100.0 - k))
    df = spark.createDataFrame(rows, "record_id long, from long, to long, errors int, density double, score double").withColumn("down", -F.col("from"))
    got = sorted(tuple(r)[:6] for r in mining.uncovered(df, ["score", "errors", "density", "down"]).collect())
    assert got == sorted(w for r in (1, 2, 3) for w in kept_by_list([x for x in rows if x[0] == r]))


def test_chosen_windows_by_the_loop(spark):
    rng = random.Random(8)
    rows = []
    for record in range(12):
        for k in range(rng.randrange(1, 9)):
            rows.append((record, "css" if record % 2 else "lua", f"s{record % 4}", 64 * k, 64 * k + 128, rng.randrange(4), 0.25, float(rng.randrange(50))))
    got = mining.choose_windows(spark.createDataFrame(rows, mining.WINDOW_SCHEMA), ["css", "lua"], max_parts=10_000, per_source=3).collect()
    want, full = [], Counter()
    groups = {f: sorted((r for r in rows if r[1] == f), key=lambda r: (-r[7], -r[5], -r[6], r[0], r[3])) for f in ("css", "lua")}
    while any(groups.values()):
        for f in ("css", "lua"):
            while groups[f]:
                w = groups[f].pop(0)
                if full[w[2]] < 3 and all(x[0] != w[0] or mining.overlap_share(w[3], w[4], x[3], x[4]) <= 0.5 for x in want):
                    want.append(w)
                    full[w[2]] += 1
                    break
    assert sorted(tuple(r)[:8] for r in got) == sorted(want)


def test_diverse_failures_skip_what_does_not_fit(spark):
    rows = [("js", f"d{k}", f, "x" * n, k) for k, (f, n) in enumerate([("a", 5), ("b", 9), ("a", 40), ("b", 3), ("c", 4), ("c", 30), ("a", 2)])]
    e = spark.createDataFrame(rows, "language string, source_sha256 string, family string, source string, created_at long")
    picked = sorted(training.diverse_failures(e, 10, 20).collect(), key=lambda r: r.place)
    # Newest first: a (2), then c whose 30 is skipped, then b (3); in the second turn a's 40 is skipped, c (4), b (9).
    assert [(r.family, len(r.source)) for r in picked] == [("a", 2), ("b", 3), ("c", 4), ("b", 9)]


def roots_by_loop(alias):
    out = {}
    for name in alias:
        at, steps, seen = name, 0, {name}
        while alias.get(at) is not None and alias[at] != at:
            at, steps = alias[at], steps + 1
            if at in seen:
                at = steps = None
                break
            seen.add(at)
        out[name] = (at, steps, at is None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_alias_chains_and_cycles(spark, seed):
    rng = random.Random(seed)
    alias = {k: k + 1 for k in range(60)} | {60: None, 61: 61, 70: 500} | {k: 80 + (k - 79) % 7 for k in range(80, 87)} | {k: rng.randrange(60, 130) for k in range(87, 130)}
    df = spark.createDataFrame([*alias.items(), (None, 3)], "name long, alias long")
    got = {r.name: (r.root, r.steps, r.cyclic) for r in graphs.resolved(df, "name", "alias").collect()}
    assert got == roots_by_loop(alias)


def test_closure_of_grammars(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", "lost"), (None, "q")]
    df = spark.createDataFrame(edges, "node string, next string")
    got = {r.node: r.depth for r in graphs.closure(df, spark.createDataFrame([("a",), ("a",), (None,)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "lost": 4}
    known = spark.createDataFrame([(c,) for c in "abcdxyq"], "node string")
    assert [r.node for r in graphs.missing(df, known).collect()] == ["lost"]
