"""URL filter: allow/block rules first, gradient-boosted trees on lexical features else.

Everything runs as DataFrame expressions. Labelled rows are first summed by URL, so a URL
that holds a third of all rows is one row with a count. Suffix statistics cover all of
them. The trees learn from a bounded, deterministic sample of the different URLs
(``max_training_rows`` expected by a hash of the URL), each weighted by its count, and grow
from histograms: each level of each tree is one aggregation whose result has at most
nodes x features x bins rows. Scoring is row-local but for one join with the suffix
statistics, which are broadcast up to ``MOST_BROADCAST`` suffixes and shuffled beyond; the
result is the same.

A null URL, or one without ``://``, has an empty host and path, matches no rule and gets
the model's verdict for the empty URL. Repeated rows get equal verdicts; without labelled
rows of both classes the model is a constant (allow when there are none at all). A URL of
any length is read whole. A null id stays null, its row judged like any other. An empty
table gives no rows.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (verdict, rule); a rule is a host, which stands for its subdomains too, and a path prefix.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

MOST_BROADCAST = 100_000

FEATURES = (
    "length", "depth", "digit_ratio", "entropy", "n_params", "host_length",
    "host_labels", "hyphens", "path_length", "secure", "suffix_rate",
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _lexical(df: DataFrame) -> DataFrame:
    """Adds the features that depend on the URL alone to (url_text, host, path, ...)."""
    url = F.col("url_text")
    n = F.char_length(url)
    entropy = F.aggregate(
        F.array_distinct(F.split(url, "")),
        F.lit(0.0),
        lambda acc, c: acc
        + F.when(c == "", 0.0).otherwise(
            -((n - F.char_length(F.replace(url, c, F.lit("")))) / n)
            * F.log2((n - F.char_length(F.replace(url, c, F.lit("")))) / n)
        ),
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.select(
        "*",
        n.cast("double").alias("length"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("depth"),
        F.coalesce(F.try_divide(F.regexp_count(url, F.lit("[0-9]")), n), F.lit(0.0)).alias("digit_ratio"),
        F.when(n > 0, entropy).otherwise(0.0).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("n_params"),
        F.char_length("host").cast("double").alias("host_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_labels"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
        F.char_length("path").cast("double").alias("path_length"),
        url.startswith("https").cast("double").alias("secure"),
    )


@dataclass
class UrlModel:
    """Trees as nested tuples (feature, threshold, left, right) with float leaves."""

    trees: list
    bias: float
    suffixes: DataFrame
    few_suffixes: bool
    prior: float

    def margin(self) -> Column:
        out = F.lit(self.bias)
        for tree in self.trees:
            out = out + _tree_value(tree)
        return out

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``block_score``, the probability of block, to (url_text, host, path, ...)."""
        known = F.broadcast(self.suffixes) if self.few_suffixes else self.suffixes
        joined = df.withColumn("suffix", suffix_of(F.col("host"))).join(known, "suffix", "left")
        joined = _lexical(joined).withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(self.prior)))
        kept = [c for c in df.columns]
        return joined.select(*kept, (1 / (1 + F.exp(-self.margin()))).alias("block_score"))


def _tree_value(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, threshold, left, right = tree
    return F.when(F.col(feature) > threshold, _tree_value(right)).otherwise(_tree_value(left))


def _node_of(tree, path: int = 1) -> Column:
    """The number of the leaf that a row falls into: children of k are 2k and 2k+1."""
    if not isinstance(tree, tuple):
        return F.lit(path)
    feature, threshold, left, right = tree
    return F.when(F.col(feature) > threshold, _node_of(right, 2 * path + 1)).otherwise(_node_of(left, 2 * path))


def _split_leaf(tree, path: int, found: dict, at: int = 1):
    """The tree with leaf ``path`` replaced by ``found[path]``."""
    if not isinstance(tree, tuple):
        return found.get(at, tree)
    feature, threshold, left, right = tree
    return (feature, threshold, _split_leaf(left, path, found, 2 * at), _split_leaf(right, path, found, 2 * at + 1))


def fit_url_model(
    labelled: DataFrame,
    url_col: str = "url",
    label_col: str = "blocked",
    *,
    max_training_rows: int = 20_000,
    n_trees: int = 10,
    depth: int = 3,
    n_bins: int = 16,
    learning_rate: float = 0.3,
    ridge: float = 1.0,
) -> UrlModel:
    """Fit boosted trees to labelled URLs (label 1: block)."""
    base = labelled.select(
        F.coalesce(F.col(url_col), F.lit("")).alias("url_text"), F.col(label_col).cast("double").alias("y")
    ).where("y IS NOT NULL")
    urls = cut(
        base.groupBy("url_text").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("y"))
        .withColumn("host", host_of(F.col("url_text"))).withColumn("suffix", suffix_of(F.col("host")))
    )
    different, n, pos = urls.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    prior = (pos + 0.5) / (n + 1.0) if n else 0.0
    suffixes = cut(urls.groupBy("suffix").agg(((F.sum("y") + 4 * prior) / (F.sum("n") + 4.0)).alias("suffix_rate")))
    few = suffixes.count() <= MOST_BROADCAST
    rate = min(1.0, max_training_rows / max(different, 1))
    sample = urls.where(F.pmod(F.xxhash64("url_text"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)
    sample = sample.withColumn("path", path_of(F.col("url_text")))
    sample = _lexical(sample).withColumn("w", F.col("n")).withColumn("y", F.col("y") / F.col("n")).drop("url_text", "host", "path", "n")
    bias = math.log(prior / (1 - prior)) if 0 < pos < n else (-20.0 if pos == 0 else 20.0)
    model = UrlModel([], bias, suffixes, few, prior)
    if not 0 < pos < n:
        return model
    rows = cut(sample.join(F.broadcast(suffixes) if few else suffixes, "suffix"))  # about max_training_rows
    cuts_row = rows.agg(
        *(F.percentile_approx(f, [i / n_bins for i in range(1, n_bins)], 1000).alias(f) for f in FEATURES)
    ).first()
    cuts = {f: sorted(set(cuts_row[f] or [])) for f in FEATURES}
    bins = F.array(
        *(sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)) for f in FEATURES)
    )
    # One row per URL and feature, made once: every level of every tree sums them up anew.
    rows = cut(rows.select(*FEATURES, "y", "w", bins.alias("bins")).repartition(4).select(*FEATURES, "y", "w", F.posexplode("bins").alias("f", "bin")))
    for _ in range(n_trees):
        tree = 0.0
        p = 1 / (1 + F.exp(-model.margin()))
        stats = rows.select(*FEATURES, "f", "bin", (F.col("w") * (F.col("y") - p)).alias("g"), (F.col("w") * p * (1 - p)).alias("h"))
        for level in range(depth):
            hist = (
                stats.select(_node_of(tree).alias("node"), "g", "h", "f", "bin")
                .groupBy("node", "f", "bin")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                .collect()  # at most 2^level x features x bins rows
            )
            tree = _grow(tree, hist, cuts, ridge, learning_rate, level)
        model.trees.append(tree)
    return model


def _grow(tree, hist, cuts, ridge: float, learning_rate: float, level: int):
    """One more level: the best split of every leaf that gains from one."""
    sums: dict = {}
    for r in hist:
        g, h = sums.setdefault(r.node, {}).setdefault(r.f, {}).get(r.bin, (0.0, 0.0))
        sums[r.node][r.f][r.bin] = (g + r.g, h + r.h)
    found = {}
    for node, by_feature in sums.items():
        if node < 1 << level:  # a leaf that did not split at an earlier level
            continue
        any_feature = next(iter(by_feature.values()))
        all_g, all_h = (sum(x[i] for x in any_feature.values()) for i in (0, 1))
        best = (1e-6, None)
        for f, by_bin in sorted(by_feature.items()):
            g = h = 0.0
            for b, threshold in enumerate(cuts[FEATURES[f]]):
                x = by_bin.get(b, (0.0, 0.0))
                g, h = g + x[0], h + x[1]
                if h < 1e-3 or all_h - h < 1e-3:
                    continue
                gain = g * g / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                if gain > best[0] + 1e-9:
                    leaf = lambda a, c: learning_rate * a / (c + ridge)
                    best = (gain, (FEATURES[f], threshold, leaf(g, h), leaf(all_g - g, all_h - h)))
        if best[1]:
            found[node] = best[1]
    return _split_leaf(tree, 1, found)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, **fit) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row.

    The URLs that a rule decides are the labelled ones; the trees learn from them and
    judge the others.
    """
    url = F.col(url_col)
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(url.cast("string"), F.lit("")).alias("url_text"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
    )
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), said.alias("said"))
    labelled = base.where("said IS NOT NULL").select("url_text", (F.col("said") == "block").cast("int").alias("blocked"))
    model = fit_url_model(labelled, "url_text", "blocked", **fit)
    verdict = F.coalesce("said", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return model.score(base).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Query: every row of ``pages``."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
