"""Query op9: tokens of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import table
from lexiscope.llm.tokens import token_count

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of whole texts; over_limit beyond 1024 tokens."""
    import public_tokenizers  # here, so that the other queries do without it

    docs = table(spark, sf_dir, "documents")
    n_tokens = token_count(F.col("text"), public_tokenizers.path(VOCABULARY))
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
