"""Query op1: the language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import fold, table
from lexiscope.llm.langid import fit, identify


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from two thirds of the ids, predicts for all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = fold(F.col("doc_id"), 3)
    model = fit(docs.where(rest != 1))
    said = docs.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), identify(F.col("text"), model, spark).alias("s"))
    return said.select("doc_id", "held_out", F.col("s.lang").alias("lang_pred"), "s.score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
