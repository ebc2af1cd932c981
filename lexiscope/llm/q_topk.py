"""Query op2: the five best inner products for every fiftieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import table
from lexiscope.llm.topk import scaled, top_k

K, EVERY = 5, 50


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 50, candidates all rows but the query's own."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), scaled(F.col("embedding")).alias("v"))
    return top_k(vectors.where(F.col("id") % EVERY == 0), vectors, K)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor(256 * CAST(x AS DOUBLE)), -9223372036854775808.0), 9223372036854774784.0) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(least(greatest(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])), -9223372036854775808.0), 9223372036854774784.0) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

QUERIES = {"op2_exact_topk": op2_exact_topk}
ORACLES = {"op2_exact_topk": ORACLE}
