"""Query op3: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import fold, saved, table
from lexiscope.llm.toxicity import fit, labelled_sample, toxicity

FOLDS = 5


def learned(docs: DataFrame, labels: DataFrame) -> dict:
    """The grammar fitted on the labelled rows outside the held-out fold."""
    return fit(saved(labelled_sample(docs, labels.where(fold(F.col("doc_id"), FOLDS) != 0)), "toxicity-sample"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four fifths of the ids, scores all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
