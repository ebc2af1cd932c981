"""ML-01: a class-weighted text classifier in spark.ml, with scores for the cascade (D-20)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.operators.datasets import stratified_split


def fit_classifier(rows: DataFrame, text: str = "text", label: str = "has_bias", features: int = 1 << 15) -> PipelineModel:
    """Hashed term weights and logistic regression; the rarer class weighs n_neutral / n_biased. Blank texts don't count."""
    used = rows.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(text, F.col(label).cast("double").alias("y"))
    n = used.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q")).first()
    weighted = used.withColumn("w", F.when(F.col("y") == 1, n["q"] / max(1, n["p"])).otherwise(1.0))
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}_]+", gaps=False)
    return Pipeline(stages=[words, HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="y", weightCol="w", maxIter=20, regParam=0.01)]).fit(weighted)


def scores(model: PipelineModel, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): probability of bias."""
    filled = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))
    return model.transform(filled).select(key, F.round(vector_to_array("probability")[1], 6).alias("score"))


def trained_scores(rows: DataFrame, key: str = "doc_id", share: float = 0.15, seed: int = 42) -> DataFrame:
    """Scores of the validation part (M-06) by a model of the training part."""
    split = stratified_split(rows, "has_bias", key, share, seed)
    model = fit_classifier(split.where("split = 'train'"))
    held = split.where("split = 'val'")
    return scores(model, held, key).join(held.select(key, "has_bias"), key)
