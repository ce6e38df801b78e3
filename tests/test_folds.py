"""Exact folds over ordered records against plain loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators import folds


def by_loop(sizes, limit, after=False):
    out, number, filled, some = [], 0, 0, False
    for n in sizes:
        if not after and some and filled + n > limit:
            number, filled = number + 1, 0
        out.append(number)
        filled, some = filled + n, True
        if after and filled >= limit:
            number, filled, some = number + 1, 0, False
    return out


@pytest.mark.parametrize("after", [False, True])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(1, 60), st.integers(1, 7), st.integers(2, 4))
def test_summaries_carry_the_open_batch(after, sizes, limit, width, fan):
    """Blocks summarised, composed level by level and carried down again number as the loop does."""
    blocks = [np.array(sizes[k : k + width]) for k in range(0, len(sizes), width)]
    levels = [[folds.block_cuts(b, limit, after) for b in blocks]]
    while len(levels[-1]) > 1:
        levels.append([folds.composed(levels[-1][k : k + fan], limit, after) for k in range(0, len(levels[-1]), fan)])
    entry = [(0, 0, True)]
    for below in reversed(levels[:-1]):
        down = []
        for k, c in enumerate(below):
            now = entry[k // fan] if k % fan == 0 else now  # noqa: F821
            down.append(now)
            fill, closed = c.entered(np.array([now[0]]), limit, after)
            now = int(fill[0]), now[1] + int(closed[0]) - int(now[2] and not after and c.upto[0] > limit), False
        entry = down
    got = [x for b, (fill, number, fresh) in zip(blocks, entry) for x in folds.batch_numbers(b, fill, number, limit, after, fresh).tolist()]
    assert got == by_loop(sizes, limit, after)


@pytest.mark.parametrize("after", [False, True])
def test_greedy_batches(spark, after):
    rng = random.Random(4)
    rows = [(k, "a" if k % 3 else "b", rng.choice([1, 2, 5, 40, 130])) for k in range(900)] + [(5000, "c", 7), (5001, None, 500), (5002, None, 1), (5003, None, 1), (None, "a", 3), (6000, "a", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, lang string, n long")
    got = folds.greedy_batches(df, ["lang"], "id", "n", 100, after=after, width=7, fan=3).collect()
    assert len(got) == 904
    for lang in "abc", None:
        own = sorted((r.id, r.n, r.batch) for r in got if r.lang == lang)
        assert [b for _, _, b in own] == by_loop([n for _, n, _ in own], 100, after)
    if not after:
        size = {}
        for r in got:
            size.setdefault((r.lang, r.batch), []).append(r.n)
        assert all(sum(x) <= 100 or len(x) == 1 for x in size.values())


def test_greedy_batches_of_nothing_and_of_one_group(spark):
    none = spark.createDataFrame([], "id long, n long")
    assert folds.greedy_batches(none, [], "id", "n", 5).count() == 0
    df = spark.range(50).selectExpr("id", "1L AS n")
    assert sorted(r.batch for r in folds.greedy_batches(df, [], "id", "n", 20, width=4).collect()) == [0] * 20 + [1] * 20 + [2] * 10


def taken_by_loop(rows, most, units):
    """Turn by turn, families in order; a turn in which nothing is taken ends it."""
    out, used = [], 0
    for turn in sorted({r[0] for r in rows}):
        if turn != len({r[0] for r in out}) + 1:
            break
        for r in sorted(x for x in rows if x[0] == turn):
            if len(out) < most and used + r[2] <= units:
                out.append(r)
                used += r[2]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_taken_while_they_fit(spark, seed):
    rng = random.Random(seed)
    rows = [(t, f, rng.choice([1, 3, 20, 45])) for f in range(5) for t in range(1, rng.choice([2, 4, 12]))]
    df = spark.createDataFrame(rows, "turn int, family int, n int")
    for most, units in ((4, 1000), (30, 90), (7, 60)):
        got = sorted(folds.taken_while_they_fit(df, "turn", ["family"], "n", most, units).collect(), key=lambda r: r.place)
        assert [(r.turn, r.family, r.n) for r in got] == taken_by_loop(rows, most, units)
