"""Agreement between raters (A-14 to A-25, J-03 to J-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiscope.functions.text import ratio


def kappa(p_o: Column, p_e: Column, certain: Column | float, floor: bool = False) -> Column:
    """(p_o - p_e) / (1 - p_e); ``certain`` where p_e is 1; not below 0 with ``floor``."""
    k = F.when(p_e >= 1, certain).otherwise((p_o - p_e) / (1 - p_e))
    return F.greatest(F.lit(0.0), k) if floor else k


def binary_kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """A-15, A-19: the 2x2 cells and Cohen's kappa in its variants' edge rules, in one pass."""
    x, y = F.col(a), F.col(b)
    cells = pairs.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(x & y).alias("both_true"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("both_false"))
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    p_o = (F.col("both_true") + F.col("both_false")) / n
    pa, pb = (F.col("both_true") + F.col("only_a")) / n, (F.col("both_true") + F.col("only_b")) / n
    p_e = pa * pb + (1 - pa) * (1 - pb)
    k = kappa(p_o, p_e, F.when(p_o >= 1, 1.0).otherwise(0.0))
    return cells.select(
        *(by or []), "n", "both_true", "only_a", "only_b", "both_false",
        F.round(p_o, 6).alias("agreement"),
        F.round(kappa(p_o, p_e, 0.0, floor=True), 6).alias("kappa_floored"),
        F.round(k, 6).alias("kappa"),
        F.round(kappa(p_o, p_e, 1.0), 6).alias("kappa_certain_one"),
        kappa_label(k).alias("label"),
        (k >= 0.70).alias("bronze"), (k >= 0.75).alias("silver"), (k >= 0.80).alias("gold"),
    )


def kappa_label(k: Column) -> Column:
    """A-20: the usual six words for a kappa."""
    return F.when(k < 0, "poor").when(k < 0.2, "slight").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("almost perfect")


def alpha_label(a: Column) -> Column:
    """A-20: what an alpha allows."""
    return F.when(a >= 0.8, "reliable").when(a >= 0.667, "tentative").otherwise("unreliable")


def multiclass_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """A-16: kappa over any labels; rows with a blank label don't count."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.trim(a) != "") & (F.trim(b) != ""))
    marg = rows.select(F.explode(F.array(F.struct(F.col(a).alias("label"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col(b).alias("label"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("m"))
    chance = marg.groupBy("m.label").agg(F.sum("m.x").alias("na"), F.sum("m.y").alias("nb")).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    p_o, p_e = ratio(F.col("same"), F.col("n")), ratio(F.coalesce("chance", F.lit(0)), F.col("n") * F.col("n"))
    return seen.join(chance).select("n", F.round(p_o, 6).alias("agreement"), F.round(F.when(F.col("n") == 0, 0.0).otherwise(kappa(p_o, p_e, 1.0)), 6).alias("kappa"))


def weighted_kappa(pairs: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """A-18: kappa where every item counts by a weight."""
    w = F.col(weight)
    of = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0.0))
    sums = pairs.agg(F.sum(w).alias("w"), of(F.col(a) == F.col(b)).alias("same"), of(F.col(a)).alias("pa"), of(F.col(b)).alias("pb"))
    p_o, pa, pb = (ratio(F.col(c), F.col("w")) for c in ("same", "pa", "pb"))
    p_e = pa * pb + (1 - pa) * (1 - pb)
    return sums.select(F.round(p_o, 6).alias("agreement"), F.round(kappa(p_o, p_e, F.when(p_o >= 1, 1.0).otherwise(0.0)), 6).alias("weighted_kappa"))


def alpha(ratings: DataFrame, item: str = "doc_id", label: str = "label") -> DataFrame:
    """A-21, A-22: Krippendorff's alpha for two classes; per item the unequal pairs are n1 * n0."""
    counts = ratings.where(F.col(label).isNotNull()).groupBy(item).agg(F.count_if(F.col(label)).alias("n1"), F.count_if(~F.col(label)).alias("n0")).where("n1 + n0 >= 2")
    total = counts.agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("n1") * F.col("n0")).alias("unequal"), F.sum((F.col("n1") + F.col("n0")) * (F.col("n1") + F.col("n0") - 1) / 2).alias("pairs"), F.sum("n1").alias("ones"), F.sum("n0").alias("zeros"))
    d_o = ratio(F.col("unequal"), F.col("pairs"))
    p = ratio(F.col("ones"), F.col("ones") + F.col("zeros"))
    d_e = 2 * p * (1 - p)
    a = F.when(d_e == 0, F.when(d_o == 0, 1.0).otherwise(0.0)).otherwise(1 - d_o / d_e)
    clamped = F.when(d_e == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d_o / d_e)))
    return total.select("items", F.round(d_o, 6).alias("observed"), F.round(d_e, 6).alias("expected"), F.round(a, 6).alias("alpha"), F.round(clamped, 6).alias("alpha_clamped"), alpha_label(a).alias("label"))


def pairwise(ratings: DataFrame, item: str = "doc_id") -> DataFrame:
    """J-04, A-23: agreement of every pair of raters on the items that both rated."""
    left = ratings.select(item, F.col("annotator").alias("first"), F.col("label").alias("x"))
    right = ratings.select(item, F.col("annotator").alias("second"), F.col("label").alias("y"))
    met = left.join(right, item).where("first < second")
    return met.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 6).alias("agreement"))


def first_two(ratings: DataFrame, item: str = "doc_id") -> DataFrame:
    """J-05, W-11: the first two raters' labels of every item, side by side."""
    n = F.row_number().over(W.partitionBy(item).orderBy("annotator"))
    numbered = ratings.withColumn("n", n).where("n <= 2")
    return numbered.groupBy(item).agg(F.max(F.when(F.col("n") == 1, F.col("label"))).alias("x"), F.max(F.when(F.col("n") == 2, F.col("label"))).alias("y")).where("x is not null and y is not null")


def majority(ratings: DataFrame, item: str = "doc_id") -> DataFrame:
    """A-25: majority vote (a tie is false) and the share that agrees with it."""
    counts = ratings.groupBy(item).agg(F.count_if("label").alias("yes"), F.count(F.lit(1)).alias("n"))
    vote = F.col("yes") * 2 > F.col("n")
    return counts.select(item, "n", vote.alias("majority"), F.round(F.when(vote, F.col("yes")).otherwise(F.col("n") - F.col("yes")) / F.col("n"), 6).alias("agreement"))
