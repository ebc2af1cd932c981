"""Query op8: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import table
from lexiscope.llm.secrets import Scanner, scan


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans by count and digest, all spans with those of the randomness battery, and its verdict on base values."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = docs.select("doc_id", scan(F.col("text"), Scanner(docs)).alias("s"))
    return scanned.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", "s.spans", "s.n_random", "s.n_base_random", "s.base_encodings")


QUERIES = {"op8_secret_scans": op8_secret_scans}
ORACLES: dict[str, str] = {}
