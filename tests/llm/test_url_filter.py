"""The URL filter against plain Python: rules by string operations, features by loops, boosted trees by exhaustive search."""

import math
import random
from collections import Counter

import pytest

from textloom.llm import urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def rule_of(url):
    host, path = parts(url)
    fits = [(len(h + p), h + p, said) for said, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def suffix(host):
    return ".".join(host.split(".")[-2:])


def features(url, rates, prior):
    url = url or ""
    host, path = parts(url)
    n = len(url)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(url).values()) if n else 0.0
    query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    return {
        "length": n, "depth": path.count("/"), "digit_ratio": sum(c in "0123456789" for c in url) / n if n else 0.0, "entropy": entropy,
        "n_params": len(query.split("&")) if query else 0, "host_length": len(host), "host_labels": len(host.split(".")), "hyphens": host.count("-"),
        "path_length": len(path), "secure": float(url.startswith("https")), "suffix_rate": rates.get(suffix(host), prior),
    }


def value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def boosted(rows, n_trees, depth, bins=16, rate=0.3, ridge=1.0):
    """(trees, bias, rates, prior) of (url, label) rows; every split by trying all of them."""
    count, blocked = Counter(u for u, _ in rows), Counter(u for u, y in rows if y)
    n, pos = len(rows), sum(y for _, y in rows)
    prior = (pos + 0.5) / (n + 1)
    by = {}
    for u in count:
        s = by.setdefault(suffix(parts(u)[0]), [0, 0])
        s[0], s[1] = s[0] + count[u], s[1] + blocked[u]
    rates = {s: (b + 4 * prior) / (c + 4) for s, (c, b) in by.items()}
    table = [(features(u, rates, prior), blocked[u] / count[u], count[u]) for u in count]
    cuts = {f: sorted({sorted(x[f] for x, _, _ in table)[math.ceil(i / bins * len(table)) - 1] for i in range(1, bins)}) for f in urls.FEATURES}
    bias, trees = math.log(prior / (1 - prior)), []
    for _ in range(n_trees):
        margin = [bias + sum(value(t, x) for t in trees) for x, _, _ in table]
        grads = [(x, w * (y - (p := 1 / (1 + math.exp(-m)))), w * p * (1 - p)) for (x, y, w), m in zip(table, margin)]
        trees.append(grown(grads, cuts, depth, 0.0, rate, ridge))
    return trees, bias, rates, prior


def grown(rows, cuts, depth, leaf, rate, ridge):
    if not depth or not rows:
        return leaf
    total = lambda part: (sum(r[1] for r in part), sum(r[2] for r in part))
    gain = lambda g, h: g * g / (h + ridge)
    g, h = total(rows)
    best = (1e-6, None)
    for f in urls.FEATURES:
        for c in cuts[f]:
            low, high = [r for r in rows if r[0][f] <= c], [r for r in rows if r[0][f] > c]
            (gl, hl), (gh, hh) = total(low), total(high)
            if hl < 1e-3 or hh < 1e-3:
                continue
            if (won := gain(gl, hl) + gain(gh, hh) - gain(g, h)) > best[0] + 1e-9:
                best = (won, (f, c, low, high, rate * gl / (hl + ridge), rate * gh / (hh + ridge)))
    if not best[1]:
        return leaf
    f, c, low, high, a, b = best[1]
    return (f, c, grown(low, cuts, depth - 1, a, rate, ridge), grown(high, cuts, depth - 1, b, rate, ridge))


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return a == pytest.approx(b, abs=1e-9)
    return a[0] == b[0] and a[1] == pytest.approx(b[1]) and same(a[2], b[2]) and same(a[3], b[3])


def some_urls(seed, n):
    rng = random.Random(seed)
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "badexample.org", "x.com", "y-z.com", "shop.net", "a.b.c.net", "org", "com", "", "h.org:80"]
    tails = ["/es/", "/es", "/en/1", "/en/12/x", "/fr/a", "/de/b-7", "/", "", "/q?x=1&y=2#f", "?a=/de/", "#/fr/", "/de/?p=http://k.com/fr/"]
    out = [rng.choice(["http", "https", "HTTP", "ftp"]) + "://" + rng.choice(hosts) + rng.choice(tails) + rng.choice(["", "", str(rng.randrange(99))]) for _ in range(n)]
    return out + [None, "", "no scheme/fr/", "://org/", "x://com/de/", "http://com", "http://é.org/ü", "http://x.net/" + "long/" * 3000]


def test_rules_trees_and_verdicts_by_brute_force(spark):
    rows = some_urls(3, 260)
    rows += [rows[0]] * 130  # a third of all rows
    df = spark.createDataFrame([(k if k % 50 else None, u, "x", "y") for k, u in enumerate(rows)], "page_id long, url string, host string, said string").repartition(3)
    labelled = [(u or "", int(rule_of(u)[1] == "block")) for u in rows if rule_of(u)[1]]
    trees, bias, rates, prior = boosted(labelled, 3, 2)
    model = urls.fit_url_model(spark.createDataFrame(labelled, "url string, blocked int"), n_trees=3, depth=2)
    assert len(model.trees) == 3 and all(map(same, model.trees, trees))
    want = Counter()
    for k, u in enumerate(rows):
        x = features(u, rates, prior)
        score = 1 / (1 + math.exp(-bias - sum(value(t, x) for t in trees)))
        rule, said = rule_of(u)
        want[k if k % 50 else None, *parts(u), rule, said or ("block" if score >= 0.5 else "allow"), round(score, 6)] += 1
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.block_score, 6)) for r in urls.filter_urls(df, n_trees=3, depth=2).collect())
    assert got == want
