"""Near-duplicates by odd sketches against pairwise comparison of whole sets."""

import random
import re

import numpy as np
import pytest

from textloom.llm import odd_sketches
from textloom.llm.simhash_groups import shingle_set

from .test_operators import AWKWARD, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def set_of(text, k=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def by_pairs(rows, percent=85):
    """(doc_id, size, component, kept), sorted, for rows with ids."""
    sets = [set_of(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                group[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((doc, len(s), least[top(i)], doc == least[top(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "n", 1, "k") for i, t in rows], "doc_id long, text string, node string, size int, key string")
    return sorted(tuple(r) for r in odd_sketches.near_duplicates(docs.repartition(3), **options).collect())


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in text.split())


def family(seed, many=70):
    """Copies of copies, templates with a third in common, and texts of a few words."""
    rng = random.Random(seed)
    rows = []
    for base in range(many):
        text = prose(rng.choice([3, 6, 7, 8, 20, 60, 200]), base + 1000 * seed)
        for _ in range(rng.choice([1, 1, 2, 4])):
            rows.append(edited(rng, text, rng.choice([0, 0.01, 0.02, 0.03])))
    rows += [prose(1, 5), prose(1, 5), prose(2, 6)]
    return list(enumerate(rows))


def test_equals_all_pairs(spark):
    rows = family(3)
    assert run(spark, rows) == by_pairs(rows)


def test_long_lists_split_and_lose_nothing(spark, monkeypatch):
    """A large group around its middle, no two copies of which need be similar; a list holds four nodes at most."""
    rng = random.Random(8)
    middle = prose(250, 77)
    rows = [(1000 + i, edited(rng, middle, 0.021)) for i in range(60)] + [(5, middle)]
    want = by_pairs(rows)
    assert len({r[2] for r in want}) < 30
    assert run(spark, rows, max_list=4) == want
    monkeypatch.setattr(odd_sketches, "SPLIT", 1)
    assert run(spark, rows, max_list=4) == want


def test_odd_rows(spark, nothing):
    with_ids = [(i, t) for i, t in AWKWARD if i is not None]
    got = run(spark, with_ids)
    assert got == by_pairs(with_ids)
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (3, "other text of three"), (2, "A B  c\td")], "doc_id long, text string")
    rows = sorted(odd_sketches.near_duplicates(docs).collect(), key=lambda r: (r.doc_id or 0, r.component_id or 0))
    assert [tuple(r) for r in rows] == [(None, 2, None, None), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (3, 2, 3, True)]
    assert odd_sketches.near_duplicates(nothing).count() == 0


def bits_apart(a, b):
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def test_sketches_estimate_similar_sets():
    rng = np.random.default_rng(4)
    most = odd_sketches.most_apart(0.85)
    for shared, own in ((2000, 176), (2000, 20), (170, 15), (6, 0)):
        s = shared / (shared + 2 * own)
        found = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
            a, b = (odd_sketches.odd_sketch(odd_sketches.min_samples(np.concatenate([x[:shared], y]))) for y in (x[shared : shared + own], x[shared + own :]))
            found.append(bits_apart(a, b))
        assert abs(odd_sketches.estimate(np.array(found)).mean() - s) < 0.02
        assert max(found) <= most or s < 0.85
    # Unrelated sets are no candidates.
    a, b = (odd_sketches.odd_sketch(odd_sketches.min_samples(shingle_set(prose(400, i), 3))) for i in (1, 2))
    assert bits_apart(a, b) > most


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.95])
def test_bound_of_differing_bits(similarity):
    """The bound's tail by simulation of the samples and bits themselves."""
    rng = np.random.default_rng(1)
    n = 20_000
    apart = rng.binomial(odd_sketches.SAMPLES, 1 - similarity, n)
    most = odd_sketches.most_apart(similarity, 1e-3)
    odd = [np.bincount(rng.integers(0, odd_sketches.BITS, 2 * d), minlength=odd_sketches.BITS).astype(np.int64) % 2 for d in apart[:4000]]
    assert np.mean([o.sum() > most for o in odd]) < 5e-3
    assert odd_sketches.most_apart(similarity) > most > np.mean([o.sum() for o in odd])
