"""Query op5: all documents into 24 shards of equal row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import table
from lexiscope.llm.sharding import record_bytes, shuffled_shards

N_SHARDS = 24


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: shard counts are at most one apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shuffled_shards(docs, N_SHARDS)
    return placed.select(
        "doc_id",
        record_bytes(F.col("text")).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict[str, str] = {}
