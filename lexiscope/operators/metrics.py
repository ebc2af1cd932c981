"""Confusion counts and classification metrics (A-01 to A-14, J-02)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.text import harmonic, ratio


def confusion(truth: str | Column, predicted: str | Column) -> list[Column]:
    """tp, fp, fn and tn as aggregates."""
    t, p = (F.col(x) if isinstance(x, str) else x for x in (truth, predicted))
    return [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]


def with_scores(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Adds precision, recall, f1 and accuracy; 0 where a denominator is 0."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    acc = ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return counts.select("*", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(harmonic(p, r), digits).alias("f1"), F.round(acc, digits).alias("accuracy"))


def metrics_by(rows: DataFrame, sets: list[list[str]], truth: str = "has_bias", predicted: str = "predicted") -> DataFrame:
    """A-01, A-02: metrics for each grouping set; a column outside its set reads OVERALL."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    counts = grouped.agg(*[F.grouping(c).alias(f"g_{c}") for c in names], *confusion(truth, predicted))
    named = [F.when(F.col(f"g_{c}") == 1, "OVERALL").otherwise(F.col(c)).alias(c) for c in names]
    return with_scores(counts.select(*named, "tp", "fp", "fn", "tn"))


def rates_by_group(rows: DataFrame, group: str, truth: str = "has_bias", predicted: str = "predicted") -> DataFrame:
    """Positive, true-positive and false-positive rates of every group; null where undefined."""
    counts = rows.groupBy(group).agg(*confusion(truth, predicted), F.count(F.lit(1)).alias("n"))
    div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(group, "n", "tp", "fp", "fn", "tn", div(tp + fp, F.col("n")).alias("positive_rate"), div(tp, tp + fn).alias("tpr"), div(fp, fp + tn).alias("fpr"))


def fairness(rows: DataFrame, group: str, truth: str = "has_bias", predicted: str = "predicted") -> DataFrame:
    """A-07 to A-09: demographic parity, equal opportunity and equalized odds, as gaps between groups."""
    rates = rates_by_group(rows, group, truth, predicted)
    gap = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c)).otherwise(0.0)
    filled = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rates.agg(
        F.round(gap(F.col("positive_rate")), 6).alias("demographic_parity"),
        F.round(gap(F.col("tpr")), 6).alias("equal_opportunity"),
        F.round(F.greatest(gap(filled("tpr")), gap(filled("fpr"))), 6).alias("equalized_odds"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def balance_scores(by_language: DataFrame, f1: str = "f1", target: float = 0.75) -> DataFrame:
    """A-10 and A-11: how even F1 is over languages, in both forms."""
    sd, n = F.stddev_pop(f1), F.count(f1)
    mbe = F.when(n < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - sd / target)))
    variant = F.when(n < 2, 1.0).otherwise(1 - F.coalesce(F.try_divide(sd, F.avg(f1)), F.lit(0.0)))
    return by_language.agg(F.round(mbe, 6).alias("mbe"), F.round(variant, 6).alias("mbe_variant"))


def estimates_and_tier(scores: DataFrame) -> DataFrame:
    """A-13: parity and opportunity estimated from precision and recall, and a tier (fixed thresholds)."""
    dp, eo = F.abs(F.col("precision") - F.col("recall")) * 0.1, (1 - F.col("recall")) * 0.05
    tier = F.when((F.col("f1") >= 0.85) & (dp <= 0.05), "Gold").when((F.col("f1") >= 0.80) & (dp <= 0.08), "Silver").when((F.col("f1") >= 0.75) & (dp <= 0.10), "Bronze").otherwise("None")
    return scores.select("*", F.round(dp, 6).alias("dp_estimate"), F.round(eo, 6).alias("eo_estimate"), tier.alias("tier"))


def compare_detectors(rows: DataFrame, detectors: list[str], by: str, truth: str = "has_bias") -> DataFrame:
    """A-03: metrics of every detector column by group, and whether it is the group's best (f1, then name)."""
    long = rows.select(by, truth, F.explode(F.array(*[F.struct(F.lit(d).alias("model"), F.col(d).alias("predicted")) for d in detectors])).alias("d")).select(by, truth, "d.model", "d.predicted")
    scores = with_scores(long.groupBy(by, "model").agg(*confusion(truth, "predicted")))
    best = scores.groupBy(by).agg(F.max_by("model", F.struct("f1", "model")).alias("best_model"))
    return scores.join(best, by).withColumn("is_best", F.col("model") == F.col("best_model")).drop("best_model")


def run_detectors(docs: DataFrame, detectors: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """X-06: (doc_id, model, has_bias, score) of plug-in detectors: each takes the texts and gives doc_id, has_bias and score."""
    parts = [own(docs).select("doc_id", F.lit(name).alias("model"), F.col("has_bias").cast("boolean").alias("has_bias"), F.col("score").cast("double").alias("score")) for name, own in detectors.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def improvement(base: Column, full: Column) -> Column:
    """A-05: gain over a baseline in hundredths; null if the baseline is 0."""
    return F.round(F.try_divide((full - base) * 100, base), 4)


def agreement_rate(a: Column, b: Column) -> Column:
    """A-14: share of equal decisions."""
    return F.avg((a == b).cast("int"))
