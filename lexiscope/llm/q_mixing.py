"""Query op6: all documents mixed to the sources' targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import saved, table
from lexiscope.llm.mixing import mixed, shown_shares, word_count


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, by shard too, and its source's size and target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    planned = mixed(saved(docs, "mix-sizes"))
    return planned.select("doc_id", "size", "source_size", "target", "taken", shown_shares(F.col("pieces")).alias("shard_words"))


QUERIES = {"op6_mixing": op6_mixing}
ORACLES: dict[str, str] = {}
