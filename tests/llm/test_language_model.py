"""The Pitman-Yor model: its draws against exact distributions, its scores against plain loops."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from textloom.llm import common, pitman_yor

from .test_operators import AWKWARD, WORDS


def chain(n, seed):
    """Words that depend on the word before."""
    rng, at, out = random.Random(seed), 0, []
    for _ in range(n):
        at = (7 * at + rng.choice((1, 2))) % len(WORDS)
        out.append(WORDS[at])
    return " ".join(out)


def is_held(doc):
    return zlib.crc32(str("" if doc is None else doc).encode()) % 7 == 2


def tokens_of(text):
    return [*(text or "").lower().split(), ""]


CORPUS = [(i, chain(60, i)) for i in range(100)] + [(None, None), (500, ""), (501, "unseen words"), (7, "alpha")]


@pytest.fixture(scope="module")
def fitted(spark):
    df = common.texts(spark.createDataFrame([(i, t, 0) for i, t in CORPUS], "doc_id long, text string, score int"))
    with common.batches_of(spark):
        model = pitman_yor.train(df, bucket=900)
        return model, pitman_yor.score(df, model).collect()


def test_counts_and_base_scores_by_brute_force(fitted):
    _, got = fitted
    assert len(got) == len(CORPUS)
    seen = Counter(w for i, t in CORPUS if not is_held(i) for w in tokens_of(t))
    n, v = sum(seen.values()), len(seen)
    texts = defaultdict(list)
    for i, t in CORPUS:
        texts[i].append(tokens_of(t))
    for r in got:
        options = [(len(w), sum(seen[x] > 0 for x in w), sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w)) for w in texts[r.doc_id]]
        assert r.held_out == is_held(r.doc_id) and r.train_tokens == n
        assert any(r.n_tokens == a and r.n_known == b and r.base_score == pytest.approx(c) for a, b, c in options)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    held_out = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held_out) > 0.5 * sum(r.base_score for r in held_out)


def seatings(spark, model):
    """Per kept pass: {(context, token): (customers, tables)}, as the buckets hold them."""
    rows = spark.read.parquet(model.state).collect()
    out = [{} for _ in model.kept]
    for r in rows:
        s = pitman_yor.State.unpack(r.data)
        assert s.sizes.sum() == s.c[s.c > 1].sum() and len(s.sizes) == s.t[s.c > 1].sum() and (s.sizes > 0).all()
        for k, t in enumerate([*s.kept, s.t]):
            for w, u, c, tables in zip(s.tokens[s.of_token].tolist(), s.contexts[s.of_context].tolist(), s.c.tolist(), t.tolist(), strict=True):
                assert (u, w) not in out[k] and (1 <= tables <= c or tables == c == 0)
                out[k][u, w] = (c, tables)
    return out


def chance_of(pairs, g):
    """The predictive probability by plain dictionaries: (context, token) -> probability."""
    customers, tables, up = Counter(), Counter(), Counter()
    for (u, w), (c, t) in pairs.items():
        customers[u] += c
        tables[u] += t
        up[w] += t
    known = sorted({w for (_, w), (c, _) in pairs.items() if c})
    root = dict(zip(known, pitman_yor.root_tables(np.array(known), np.array([up[w] for w in known]), g).tolist(), strict=True))
    all_up, all_root = sum(up.values()), sum(root.values())

    def parent(w):
        spare = (g.root_strength + g.root_discount * all_root) / (g.root_strength + all_up)
        return (up[w] - g.root_discount * root.get(w, 0)) / (g.root_strength + all_up) + spare / (len(known) + 1)

    def chance(u, w):
        c, t = pairs.get((u, w), (0, 0))
        spare = (g.strength + g.discount * tables[u]) / (g.strength + customers[u])
        return (c - g.discount * t) / (g.strength + customers[u]) + spare * parent(w)

    return chance, known


def number(word):
    h = xxhash.xxh64_intdigest(word.encode())
    return h - (1 << 64) if h >> 63 else h


def context_of(word):
    return number(word) & pitman_yor.CONTEXT_BITS


def test_scores_by_plain_loops(spark, fitted):
    model, got = fitted
    chances = [chance_of(p, g)[0] for p, (_, g) in zip(seatings(spark, model), model.kept, strict=True)]
    want = defaultdict(list)
    for i, t in CORPUS:
        words = [number(w) for w in tokens_of(t)]
        pairs = zip([context_of(w) for w in ("", *tokens_of(t))], words, strict=False)
        want[i].append(sum(math.log10(sum(f(u, w) for f in chances) / len(chances)) for u, w in pairs))
    for r in got:
        assert any(r.score == pytest.approx(x) for x in want[r.doc_id])


def test_probabilities_sum_to_one(spark, fitted):
    model, _ = fitted
    for pairs, (_, g) in zip(seatings(spark, model), model.kept, strict=True):
        chance, known = chance_of(pairs, g)
        for u in (context_of(""), context_of(WORDS[3]), context_of("never seen")):
            assert sum(chance(u, w) for w in known) + chance(u, number("nor this")) == pytest.approx(1.0)


def stirling(n, discount):
    """Weights of t tables for n customers: sums over partitions, by the recursion."""
    row = {1: 1.0}
    for k in range(1, n):
        row = {t: row.get(t - 1, 0.0) + (k - discount * t) * row.get(t, 0.0) for t in range(1, k + 2)}
    return row


@pytest.mark.parametrize(("n", "new", "discount"), [(2, 0.4, 0.6), (5, 0.7, 0.3), (6, 3.0, 0.8)])
def test_reseating_keeps_the_exact_distribution(n, new, discount):
    rng, rows = np.random.default_rng(4), 20_000
    sizes, t, c = np.full(rows, n), np.ones(rows, dtype=np.int64), np.full(rows, n)
    for _ in range(80):
        sizes, t = pitman_yor.reseat(sizes, t, c, np.full(rows, new), discount, rng)
    assert sizes.sum() == rows * n and len(sizes) == t.sum() and (np.add.reduceat(sizes, np.cumsum(t) - t) == n).all()
    weights = {k: x * new**k for k, x in stirling(n, discount).items()}
    share = np.bincount(t, minlength=n + 1)[1:] / rows
    want = np.array([weights[k] for k in range(1, n + 1)]) / sum(weights.values())
    assert np.abs(share - want).max() < 0.015


def test_parent_tables_follow_the_exact_conditional():
    table = pitman_yor.root_table(0.7, 0.6)
    for n in (1, 2, 7):
        weights = [x * 0.7**k for k, x in sorted(stirling(n, 0.6).items())]
        assert np.diff(table[n])[:n] == pytest.approx(np.array(weights) / sum(weights))
    rng = np.random.default_rng(2)
    fast = [pitman_yor.carry_on(1, 1, 400, 0.7, 0.6, rng) for _ in range(3000)]
    slow = []
    for _ in range(3000):
        t = 1
        for i in range(1, 400):
            t += rng.random() < 0.7 / (0.7 + i - 0.6 * t)
        slow.append(t)
    assert np.mean(fast) == pytest.approx(np.mean(slow), abs=0.12)


def test_awkward_and_empty_tables(spark, awkward, nothing):
    with common.batches_of(spark):
        assert pitman_yor.score(nothing, pitman_yor.train(nothing)).count() == 0
        wide = common.texts(awkward)
        assert pitman_yor.score(wide, pitman_yor.train(wide)).count() == len(AWKWARD)
        held = common.texts(spark.createDataFrame([(i, "only held out") for i in range(200) if is_held(i)], "doc_id long, text string"))
        for r in pitman_yor.score(held, pitman_yor.train(held)).collect():
            assert (r.n_known, r.train_tokens) == (0, 0) and r.base_score == r.score == 0.0


def test_long_ranges_of_histograms():
    values = np.array([1, 1, 2, 5, 1024, 5000, 100_000])
    bins, n = pitman_yor.binned(values)
    assert n.sum() == len(values)
    i, over = pitman_yor.trials(dict(zip(bins.tolist(), n.tolist(), strict=True)))
    want = sum(int((values > k).sum()) for k in range(1, 100_000))
    assert over.sum() == pytest.approx(want, rel=0.1) and over[0] == 5


def log_stirling(n, discount):
    """The logarithms of ``stirling``."""
    row = np.array([-np.inf, 0.0])
    for k in range(1, n):
        stay = row + np.log(np.maximum(k - discount * np.arange(k + 1), 1e-300))
        row = np.logaddexp(np.append(stay, -np.inf), np.append(-np.inf, row))
    return row[1:]


@pytest.mark.parametrize(("n", "discount", "strength"), [(2, 0.6, 0.4), (9, 0.3, 2.0), (120, 0.7, 3.0), (257, 0.7, 2.0), (400, 0.6, 60.0), (3000, 0.75, 20.0)])
def test_a_pass_draws_all_customers_however_many(n, discount, strength):
    """After two passes from one table each, tables and sizes have their exact distribution."""
    rows = 3000 if n < 1000 else 600
    known = np.arange(rows)
    s = pitman_yor.State(known, known, known < 0, known, known, np.full(rows, n), np.ones(rows, dtype=np.int64), np.full(rows, n), [])
    g, rng = pitman_yor.Params(discount, strength), np.random.default_rng(8)
    for _ in range(2):
        pitman_yor.gibbs(s, g, (s.c, np.zeros(rows), np.ones(rows)), rng)
    assert len(s.sizes) == s.t.sum() and (np.add.reduceat(s.sizes, np.cumsum(s.t) - s.t) == n).all() and (s.sizes > 0).all()
    w = log_stirling(n, discount) + np.arange(1, n + 1) * math.log(strength)
    w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
    mean = w @ np.arange(1, n + 1)
    sd = math.sqrt(w @ (np.arange(1, n + 1) - mean) ** 2)
    assert abs(s.t.mean() - mean) < 5 * sd / math.sqrt(rows) and s.t.std() == pytest.approx(sd, rel=0.1)
    # The least table: a customer alone has weight strength times the seatings of the others.
    if n <= 400:
        others = log_stirling(n - 1, discount) + np.arange(1, n) * math.log(strength)
        top = max(others.max(), (log_stirling(n, discount) + np.arange(1, n + 1) * math.log(strength)).max())
        all_ = np.exp(log_stirling(n, discount) + np.arange(1, n + 1) * math.log(strength) - top).sum()
        alone = n * strength * np.exp(others - top).sum() / all_
        assert (s.sizes == 1).sum() / rows == pytest.approx(alone, rel=0.06, abs=0.02)


def test_old_tables_beyond_those_drawn_one_by_one():
    rng = np.random.default_rng(3)
    got = [pitman_yor.old_tables(5.0, 0.6, 20_000, rng, 1_000) for _ in range(2000)]
    want = (5.0 / (5.0 + 0.6 * np.arange(1, 20_000))).sum()
    assert np.mean(got) == pytest.approx(want, abs=0.5)
    assert pitman_yor.old_tables(5.0, 0.6, 1, rng) == 0
