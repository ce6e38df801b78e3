"""Counts and scores of expected against predicted classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(pairs: DataFrame, *by: str, weight: Column | None = None) -> DataFrame:
    """(by..., expected, predicted, n)."""
    n = F.sum(weight) if weight is not None else F.count("*")
    return pairs.groupBy(*by, "expected", "predicted").agg(n.cast("long").alias("n"))


def per_class(matrix: DataFrame, *by: str) -> DataFrame:
    """Support, precision, recall and F1 of each class from a long confusion matrix."""
    sides = matrix.select(
        *by, F.explode(F.array(
            F.struct(F.col("expected").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hits")),
        )).alias("x"),
    ).select(*by, "x.*")
    sums = sides.groupBy(*by, "class").agg(*(F.sum(c).alias(c) for c in ("support", "guessed", "hits")))
    p, r = ratio(F.col("hits"), F.col("guessed")), ratio(F.col("hits"), F.col("support"))
    return sums.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("guessed")).alias("f1"))


def overall(matrix: DataFrame, *by: str, exclude: tuple[str, ...] = (), n_classes: int | None = None) -> DataFrame:
    """Accuracy and macro F1 over all classes but the excluded ones."""
    hits = F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0))
    acc = matrix.groupBy(*by).agg(F.sum("n").alias("total"), hits.alias("correct"))
    scored = per_class(matrix, *by).where(~F.col("class").isin(*exclude)) if exclude else per_class(matrix, *by)
    macro = scored.groupBy(*by).agg((F.sum("f1") / (F.lit(n_classes) if n_classes else F.count("*"))).alias("macro_f1"))
    out = acc.join(macro, list(by)) if by else acc.crossJoin(macro)  # one row each
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def set_metrics(expected: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Matched, expected and predicted counts of exact keys, with precision, recall and F1."""
    sides = expected.select(*keys).withColumn("e", F.lit(1)).unionByName(predicted.select(*keys).withColumn("p", F.lit(1)), allowMissingColumns=True)
    both = sides.groupBy(*keys).agg(F.max("e").alias("e"), F.max("p").alias("p"))
    return set_scores(both.agg(
        F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("matched"), F.count("e").alias("expected"), F.count("p").alias("predicted")
    ))


def set_scores(n: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 to (matched, expected, predicted)."""
    return n.select(
        "*", ratio(F.col("matched"), F.col("predicted")).alias("precision"), ratio(F.col("matched"), F.col("expected")).alias("recall"),
        ratio(2 * F.col("matched"), F.col("expected") + F.col("predicted")).alias("f1"),
    )


def effective_files(files: DataFrame, by: str, size: str) -> DataFrame:
    """Inverse Simpson index of the sizes of a group's files; 0 for none."""
    n = F.col(size).cast("double")
    return files.groupBy(by).agg(ratio(F.sum(n) * F.sum(n), F.sum(n * n)).alias("effective_files"))


def class_weights(counts: DataFrame, power: float = 0.5) -> DataFrame:
    """(class, n) -> weight: min(4, (total / (k * max(1, n)))^power), scaled to mean 1."""
    from pyspark.sql import Window

    everyone = Window.partitionBy(F.lit(0))  # one row per class
    raw = F.least(F.lit(4.0), F.pow(F.sum("n").over(everyone) / (F.count("*").over(everyone) * F.greatest(F.lit(1), F.col("n"))), F.lit(power)))
    return counts.select("*", raw.alias("raw")).select(*counts.columns, (F.col("raw") / F.avg("raw").over(everyone)).alias("weight"))


def auxiliary_weights(rows: DataFrame, mask: str, bits: int = 16, cap: float = 8.0) -> DataFrame:
    """Per bit: min(cap, max(1, sqrt((N - pos) / pos))); 1 where the bit is always or never set."""
    sums = rows.agg(F.count("*").alias("n"), *(F.sum(F.expr(f"shiftright({mask}, {k}) & 1")).alias(f"b{k}") for k in range(bits)))
    long = sums.select("n", F.posexplode(F.array(*(F.col(f"b{k}") for k in range(bits)))).alias("bit", "pos"))
    w = F.least(F.lit(cap), F.greatest(F.lit(1.0), F.sqrt((F.col("n") - F.col("pos")) / F.col("pos"))))
    return long.select("bit", "pos", F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n")), 1.0).otherwise(w).alias("weight"))


def language_metrics(counts: DataFrame, objective: DataFrame) -> DataFrame:
    """Full join of (family, support, errors, plain_support, false_colors) with (family, weight)."""
    j = counts.join(objective, "family", "full")
    support = F.coalesce("support", F.lit(0))
    return j.select(
        "family", F.coalesce("weight", F.lit(0.0)).alias("weight"), support.alias("support"),
        F.try_divide(F.col("errors").cast("double"), F.col("support")).alias("error"),
        F.try_divide(F.col("false_colors").cast("double"), F.col("plain_support")).alias("false_color_rate"),
        ((F.coalesce("weight", F.lit(0.0)) > 0) & (support == 0)).alias("missing"),
        (F.col("weight").isNull() & (support > 0)).alias("unknown"),
    )


def weighted_error(metrics: DataFrame) -> DataFrame:
    """One row; null unless every weighted family has support and every family a weight."""
    complete = ~F.bool_or(F.col("missing") | F.col("unknown"))
    total = F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.col("error")).otherwise(0.0))
    return metrics.agg(complete.alias("complete"), F.when(complete, total).alias("weighted_error"), F.count_if("missing").alias("n_missing"), F.count_if("unknown").alias("n_unknown"))


def guard_decisions(candidate: DataFrame, baseline: DataFrame, *, min_support: int, min_plain: int, error_allowance: float, color_allowance: float, z: float) -> DataFrame:
    """Per family and metric: may the candidate replace the baseline?

    Fails without metrics on both sides, on unequal or insufficient support, and where the
    rate rose by more than the larger of the allowance and z standard errors of the
    difference of add-one smoothed rates.
    """
    c = candidate.select("family", *(F.col(x).alias(f"c_{x}") for x in ("support", "errors", "plain_support", "false_colors")))
    b = baseline.select("family", *(F.col(x).alias(f"b_{x}") for x in ("support", "errors", "plain_support", "false_colors")))
    one = lambda name, n, k, least, allow: F.struct(
        F.lit(name).alias("metric"), F.col(f"c_{n}").alias("n"), F.col(f"b_{n}").alias("bn"), F.col(f"c_{k}").alias("ck"),
        F.col(f"b_{k}").alias("bk"), F.lit(least).alias("least"), F.lit(allow).alias("allow"),
    )
    rows = c.join(b, "family", "full").select("family", F.inline(F.array(
        one("error", "support", "errors", min_support, error_allowance),
        one("false_color_rate", "plain_support", "false_colors", min_plain, color_allowance),
    )))
    pc, pb = (F.col("ck") + 1) / (F.col("n") + 2), (F.col("bk") + 1) / (F.col("n") + 2)
    tolerance = F.greatest(F.col("allow"), z * F.sqrt((pc * (1 - pc) + pb * (1 - pb)) / F.nullif(F.col("n"), F.lit(0))))
    delta = F.try_divide((F.col("ck") - F.col("bk")).cast("double"), F.col("n"))
    reason = (
        F.when(F.col("n").isNull() | F.col("bn").isNull(), "missing metrics")
        .when(F.col("n") != F.col("bn"), "support mismatch")
        .when(F.col("n") < F.col("least"), "insufficient support")
        .when(delta > tolerance, "regression")
    )
    return rows.select("family", "metric", F.coalesce("n", F.lit(0)).alias("support"), delta.alias("delta"), tolerance.alias("tolerance"), F.coalesce(reason, F.lit("passed")).alias("decision"))


def agreement(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(doc_id, correct, total, value) over two aligned sets of (doc_id, i, class); nothing to compare is agreement."""
    r = reference.select("doc_id", "i", F.col("class").alias("expected"))
    c = candidate.select("doc_id", "i", F.col("class").alias("actual"))
    hits = F.count_if(F.col("expected") == F.coalesce("actual", F.lit("plain")))
    n = r.join(c, ["doc_id", "i"], "left").groupBy("doc_id").agg(hits.alias("correct"), F.count("*").alias("total"))
    return n.select("doc_id", "correct", "total", F.when(F.col("total") == 0, 1.0).otherwise(F.col("correct") / F.col("total")).alias("value"))


def engine_agreement(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """(engine, family, support, correct, mapped) and (family, weight) -> agreement and coverage per engine, best first.

    A family that an engine does not map counts as wrong throughout.
    """
    j = weights.join(counts, "family")
    hits = F.when(F.col("mapped"), F.col("correct")).otherwise(0)
    share = lambda n: F.sum(F.col("weight") * ratio(n, F.col("support"))) / F.sum("weight")
    covered = F.sum(F.when(F.col("mapped"), F.col("weight")).otherwise(0.0)) / F.sum("weight")
    return j.groupBy("engine").agg(share(hits).alias("agreement"), covered.alias("coverage")).orderBy(F.desc("agreement"), "engine")


def accuracy_band(accuracy: Column, bounds: tuple[float, ...] = (0.95, 0.9, 0.8, 0.7)) -> Column:
    """The band's lower bound, in percent; bands are half open."""
    out = F.lit("below")
    for b in sorted(bounds):
        out = F.when(accuracy >= b, f"{b * 100:g}+").otherwise(out)
    return out


def median_of(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.median(value).alias("median"))


def length_bands(units: Column) -> Column:
    return F.when(units <= 64, "1-64").when(units <= 256, "65-256").when(units <= 1024, "257-1024").otherwise("1025+")
