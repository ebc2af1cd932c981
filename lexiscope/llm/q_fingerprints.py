"""Query op12: fingerprints of all documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiscope.llm.common import table
from lexiscope.llm.fingerprints import fingerprinted


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; rows that share id and text share their result."""
    return fingerprinted(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op12_document_fingerprints": op12_document_fingerprints}
ORACLES: dict[str, str] = {}
