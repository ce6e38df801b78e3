"""Decisions and schedules over small tables: guards, promotion, enrolment, epochs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier_guards(candidate: DataFrame, baseline: DataFrame, tiers: DataFrame, *, min_support: int, min_plain: int) -> DataFrame:
    """Per language of (language, tier, error_allowance, color_allowance) and metric: does the candidate keep its cap?

    Counts are (language, support, errors, plain_support, false_colors). In order of reasons:
    missing language metrics, support mismatch, insufficient support, regression.
    """
    names = ("support", "errors", "plain_support", "false_colors")
    c = candidate.select(F.col("language").alias("_c"), *(F.col(n).alias(f"c_{n}") for n in names))
    b = baseline.select(F.col("language").alias("_b"), *(F.col(n).alias(f"b_{n}") for n in names))
    j = tiers.join(c, F.col("language") == F.col("_c"), "left").join(b, F.col("language") == F.col("_b"), "left")
    one = lambda name, n, k, least, allow: F.struct(
        F.lit(name).alias("metric"), F.col(f"c_{n}").alias("n"), F.col(f"b_{n}").alias("bn"), F.col(f"c_{k}").alias("ck"), F.col(f"b_{k}").alias("bk"),
        F.lit(least).alias("least"), F.col(allow).alias("tolerance"),
    )
    rows = j.select("language", "tier", F.inline(F.array(
        one("error", "support", "errors", min_support, "error_allowance"), one("false_color_rate", "plain_support", "false_colors", min_plain, "color_allowance"),
    )))
    early = (
        F.when(F.col("n").isNull() | F.col("bn").isNull(), "missing language metrics")
        .when(F.col("n") != F.col("bn"), "support mismatch").when(F.col("n") < F.col("least"), "insufficient support")
    )
    delta = F.when(early.isNull() & (F.col("n") > 0), (F.col("ck") - F.col("bk")) / F.col("n"))
    reason = F.coalesce(early, F.when(delta > F.col("tolerance"), "regression"))
    return rows.select("language", "tier", "metric", F.coalesce("n", F.lit(0)).alias("support"), delta.alias("delta"), "tolerance", reason.isNull().alias("passed"), reason.alias("reason"))


def promotion_decision(candidate: DataFrame, baseline: DataFrame, guards: DataFrame) -> DataFrame:
    """One row (eligible, reasons) of one-row (weighted_error, top_agreement) tables and guards with ``passed``."""
    c = candidate.select(*(F.col(n).alias(f"c_{n}") for n in ("weighted_error", "top_agreement")))
    b = baseline.select(*(F.col(n).alias(f"b_{n}") for n in ("weighted_error", "top_agreement")))
    failed = guards.agg(F.count_if(~F.col("passed")).alias("n_failed"))
    better = F.coalesce(F.col("b_weighted_error") - F.col("c_weighted_error") > 0, F.lit(False))
    kept = F.coalesce(F.col("c_top_agreement") >= F.col("b_top_agreement"), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.col("n_failed") > 0, "guards failed"), F.when(~better, "weighted error did not improve"), F.when(~kept, "top agreement fell"),
    ))
    return c.join(b).join(failed).select((F.size(reasons) == 0).alias("eligible"), F.array_join(reasons, "; ").alias("reasons"))  # one row each


def may_auto_promote(teacher: Column, eligible: Column, accuracy: Column, baseline_accuracy: Column) -> Column:
    """Only an eligible run that is no teacher's and beats a known baseline."""
    return F.coalesce(~teacher & eligible & (accuracy > baseline_accuracy), F.lit(False))


def major_languages(counts: DataFrame, weights: DataFrame, protected: list[str], guarded: list[str]) -> DataFrame:
    """(language, family, support, error, guarded, place) of supported languages of protected families, heaviest family first."""
    w = weights.select(F.col("family").alias("_f"), "weight")
    rows = counts.where(F.col("family").isin(protected) & (F.col("support") > 0)).join(w, F.col("family") == F.col("_f"), "left")
    order = F.struct(-F.coalesce("weight", F.lit(0.0)), "family", "language")
    from pyspark.sql import Window

    everyone = Window.partitionBy(F.lit(0)).orderBy(order)  # one row per language
    return rows.select(
        "language", "family", "support", (F.col("errors") / F.col("support")).alias("error"), F.col("language").isin(guarded).alias("guarded"), F.row_number().over(everyone).alias("place")
    )


def top_language_share(counts: DataFrame, *, share: float, limit: float) -> DataFrame:
    """(language, count, weight) -> factor: weight per count relative to all, mixed in by ``share`` and capped."""
    total = counts.agg(F.sum("count").alias("_total"))
    raw = (1 - share) + share * F.col("weight") * F.col("_total") / F.col("count")
    return counts.join(F.broadcast(total)).select("language", F.least(F.lit(limit), raw).alias("factor"))  # one row of totals


def best_checkpoint(rows: DataFrame, score: str, seq: str, *keep: str) -> DataFrame:
    """The row of the highest score, the earliest of equal ones."""
    return rows.agg(F.max_by(F.struct(seq, score, *keep), F.struct(score, -F.col(seq))).alias("x")).select("x.*")


def cosine_rate(start: float, end: float, step: Column, steps: int) -> Column:
    """From ``start`` at step 1 down to ``end`` at the last step along half a cosine."""
    if steps <= 1:
        return F.lit(float(end))
    return end + (start - end) * (1 + F.cos(math.pi * (step - 1) / (steps - 1))) / 2


def stage_schedule(spark, stages: list[tuple[str, int, float, float]]) -> DataFrame:
    """(epoch, stage, step, steps, rate) of (name, epochs, first rate, last rate) stages, one after another."""
    total = sum(n for _, n, _, _ in stages)
    epochs = spark.range(1, total + 1).withColumnRenamed("id", "epoch")
    out, first = None, 0
    for name, n, a, b in stages:
        here = epochs.where(F.col("epoch").between(first + 1, first + n)).withColumn("step", F.col("epoch") - first)
        here = here.select("epoch", F.lit(name).alias("stage"), "step", F.lit(n).alias("steps"), cosine_rate(a, b, F.col("step"), n).alias("rate"))
        out, first = here if out is None else out.unionByName(here), first + n
    return out


def experiment_plan(spark, **choices: list) -> DataFrame:
    """Every combination of the choices, numbered in order; choices are short lists of values."""
    out = spark.range(1).select(F.lit(0).cast("long").alias("number"))
    for name, values in choices.items():
        table = F.explode(F.lit(list(values)))
        out = out.select("*", table.alias(name), F.lit(len(values)).alias("_n"))
        out = out.withColumn("number", F.col("number") * F.col("_n") + F.array_position(F.lit(list(values)), F.col(name)) - 1).drop("_n")
    return out


def moving_average(values: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """(key, average): exponential moving average, the newest value weighing 1 - decay; the first one starts it."""
    series = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double"))
    rows = values.groupBy(key).agg(series.alias("_x"))
    rest = F.slice("_x", F.lit(2), F.greatest(F.size("_x") - 1, F.lit(0)))
    return rows.select(key, F.aggregate(rest, F.element_at("_x", 1), lambda a, x: a * decay + x * (1 - decay)).alias("average"))


def early_stop(epochs: DataFrame, run: str, epoch: str, score: str, patience: int) -> DataFrame:
    """(run, best_epoch, stop_epoch): the first epoch ``patience`` after the best one so far, null if none is reached."""
    from pyspark.sql import Window

    so_far = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    rows = epochs.withColumn("_best", F.max_by(epoch, F.struct(F.col(score), -F.col(epoch))).over(so_far))
    stops = rows.groupBy(run).agg(F.min(F.when(F.col(epoch) - F.col("_best") >= patience, F.col(epoch))).alias("stop_epoch"))
    seen = rows.join(stops.withColumnRenamed(run, "_run"), F.col(run) == F.col("_run"))
    kept = seen.where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return kept.groupBy(run).agg(F.max_by("_best", epoch).alias("best_epoch"), F.first("stop_epoch").alias("stop_epoch"))
