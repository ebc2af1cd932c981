"""Annotation quality: distributions, balance, coverage, consistency and fatigue (A-26 to A-34, W-01, W-02)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiscope.functions.text import ratio
from lexiscope.operators.datasets import numbered
from lexiscope.sources.scratch import saved

RANKS = {"very_low": 1, "low": 2, "medium": 3, "high": 4, "very_high": 5}

#: Rows of a part of an order, and groups up to which their sums are broadcast.
PART_ROWS, MOST_GROUPS = 200_000, 500_000


def confidence_profile(rows: DataFrame, by: str) -> DataFrame:
    """A-26: counts by confidence; balanced if high and very high make 40 to 70 in a hundred."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("confidence") == c).alias(c) for c in RANKS])
    share = ratio(F.col("high") + F.col("very_high"), F.col("n"))
    return counts.withColumn("high_share", F.round(share, 6)).withColumn("balanced", share.between(0.4, 0.7))


def bias_balance(rows: DataFrame, by: str) -> DataFrame:
    """A-27: share of biased rows; balanced between 30 and 70 in a hundred."""
    share = F.avg(F.col("has_bias").cast("int"))
    return rows.groupBy(by).agg(F.round(share, 6).alias("bias_share"), share.between(0.3, 0.7).alias("balanced"))


def coverage(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A-28, A-29: filled share of every column in hundredths, long."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns])
    long = counts.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("f"))
    share = F.round(100 * ratio(F.col("f.filled"), F.col("n")), 4)
    return long.select("f.field", "f.filled", share.alias("coverage"), (F.col("f.filled") == F.col("n")).alias("complete"))


def missing_fields(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A-29: names of the empty columns of every row that has any."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return rows.select(key, names.alias("missing")).where(F.size("missing") > 0)


def consistency(rows: DataFrame, by: str, order: Sequence[str], size: int = 10, most: float = 0.20, part_rows: int = PART_ROWS) -> DataFrame:
    """W-01: spread of the bias rate over all full windows; fewer than two windows' rows pass.

    All rows are numbered in order and dealt into parts of ``part_rows``, each with the first rows of the part after it, so
    that no task holds all rows of one that has very many; the parts' moments add up.
    """
    part_rows = max(part_rows, size - 1)
    placed = numbered(rows.select(by, *order, "has_bias"), [by, *order], start=-1, name="_rank")
    part, ahead = F.floor(F.col("_rank") / part_rows), F.col("_rank") % part_rows < size - 1
    parts = F.when(ahead & (part > 0), F.array(part, part - 1)).otherwise(F.array(part))
    dealt = placed.withColumn("_own", part).withColumn("_part", F.explode(parts))
    frame = W.partitionBy(by, "_part").orderBy("_rank").rowsBetween(0, size - 1)
    x = F.col("has_bias").cast("double")
    rates = dealt.withColumn("rate", F.avg(x).over(frame)).withColumn("held", F.count(F.lit(1)).over(frame)).where(F.col("_own") == F.col("_part"))
    full = F.when(F.col("held") == size, F.col("rate"))
    out = rates.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(full).alias("windows"), F.round(F.avg(full), 6).alias("mean_rate"), F.round(F.stddev_pop(full), 6).alias("sd"))
    return out.withColumn("consistent", (F.col("n") < 2 * size) | (F.col("sd") < most))


def fatigue(rows: DataFrame, by: str, ts: str = "ts", key: str = "doc_id", least: int = 20, most: float = 0.30) -> DataFrame:
    """W-02: rows per minute in both halves by time; fatigue if the second is over 30 in a hundred slower.

    A row's half follows from its number in order and its group's first number and count, which are combined before the shuffle.
    """
    placed = numbered(rows.where(F.col(ts).isNotNull()).select(by, ts, key), [by, ts, key], name="_rank")
    groups = saved(placed.groupBy(F.col(by).alias("_by")).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    groups = F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups
    halves = placed.join(groups, F.col(by).eqNullSafe(F.col("_by"))).withColumn("half", F.when(F.col("_rank") - F.col("_first") < F.floor(F.col("n") / 2), 1).otherwise(2))
    seconds = lambda h: (F.max(F.when(F.col("half") == h, F.unix_timestamp(ts))) - F.min(F.when(F.col("half") == h, F.unix_timestamp(ts)))).cast("double")
    rate = lambda h: F.when(F.count_if(F.col("half") == h) >= 2, F.try_divide(F.count_if(F.col("half") == h) * 60.0, F.nullif(seconds(h), F.lit(0.0))))
    out = halves.groupBy(by).agg(rate(1).alias("r1"), rate(2).alias("r2"))
    slower = F.try_divide(F.col("r1") - F.col("r2"), F.col("r1"))
    return out.select(by, F.round("r1", 6).alias("first_rate"), F.round("r2", 6).alias("second_rate"), F.coalesce(slower > most, F.lit(False)).alias("fatigue"))


def quality_score(rows: DataFrame, by: str, required: Sequence[str], order: Sequence[str], compatible: bool = False) -> DataFrame:
    """A-30: 20 points for each passed check, and a word for the sum.

    ``compatible`` gives the fatigue points where fatigue *is* found, as older reports do.
    """
    conf = confidence_profile(rows, by).select(by, F.col("balanced").alias("confidence_ok"))
    bias = bias_balance(rows, by).select(by, F.col("balanced").alias("bias_ok"))
    full = rows.groupBy(by).agg(F.bool_and(F.expr(" and ".join(f"`{c}` is not null" for c in required))).alias("schema_ok"))
    even = consistency(rows, by, order).select(by, F.col("consistent").alias("consistent_ok"))
    tired = fatigue(rows, by).select(by, F.col("fatigue"))
    all_ = conf.join(bias, by).join(full, by).join(even, by).join(tired, by, "left").withColumn("fatigue", F.coalesce("fatigue", F.lit(False)))
    rested = F.col("fatigue") if compatible else ~F.col("fatigue")
    checks = [F.col("confidence_ok"), F.col("bias_ok"), F.col("schema_ok"), F.col("consistent_ok"), rested]
    score = sum((F.when(c, 20).otherwise(0) for c in checks), F.lit(0))
    word = F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")
    return all_.select(by, "confidence_ok", "bias_ok", "schema_ok", "consistent_ok", "fatigue", score.alias("score"), word.alias("assessment"))


def batch_statistics(rows: DataFrame, by: str) -> DataFrame:
    """A-32: counts, bias share, mean confidence rank (3 where unknown), agreement with the model."""
    rank = F.coalesce(*[F.when(F.col("confidence") == k, v) for k, v in RANKS.items()], F.lit(3))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("has_bias").alias("biased"),
        F.round(100 * F.avg(F.col("has_bias").cast("int")), 4).alias("bias_percent"),
        F.round(F.avg(rank), 6).alias("mean_confidence"),
        F.round(F.avg((F.col("ml_prediction") == F.col("has_bias")).cast("int")), 6).alias("agreement_rate"),
    )


def tier_requirements(rows: DataFrame, item: str, tiers: Sequence[tuple[str, int, float]] = (("bronze", 1200, 0.1), ("silver", 5000, 0.2), ("gold", 10000, 0.3))) -> DataFrame:
    """A-33: per tier, whether samples and the share of items with several raters suffice."""
    items = rows.groupBy(item).agg(F.count_distinct("annotator").alias("raters"))
    known = items.agg(F.count(F.lit(1)).alias("samples"), F.round(F.coalesce(F.avg((F.col("raters") > 1).cast("int")), F.lit(0.0)), 6).alias("multi_share"))
    levels = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(n).alias("least"), F.lit(s).alias("share")) for t, n, s in tiers])).alias("t")
    out = known.select("samples", "multi_share", levels).select("t.tier", "samples", "multi_share", F.col("t.least").alias("least"), F.col("t.share").alias("share"))
    return out.withColumn("met", (F.col("samples") >= F.col("least")) & (F.col("multi_share") >= F.col("share")))


def dataset_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A-34, W-08: counts and shares of every value of the columns, in one pass of grouping sets."""
    grouped = rows.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(*[F.grouping(c).alias(f"g_{c}") for c in columns], F.count(F.lit(1)).alias("n"))
    field = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.coalesce(F.col(c).cast("string"), F.lit("(none)"))) for c in columns])
    share = F.col("n") / F.sum("n").over(W.partitionBy("field"))
    return grouped.select(field.alias("field"), value.alias("value"), "n").withColumn("percent", F.round(100 * share, 4))
