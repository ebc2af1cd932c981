"""Query op7: hit words and contaminating items of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import table
from lexiscope.llm.decontaminate import find_hits, hit_words, is_contaminated


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; rows that share id and text share their result."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, hits = find_hits(docs, table(spark, sf_dir, "benchmark"))
    hits = hits.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "spans", "items")
    met = rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    n_hit = F.coalesce(hit_words(F.col("spans")), F.lit(0)).cast("long")
    items = F.coalesce(F.array_sort(F.transform("items", lambda i: i.cast("string"))), F.array().cast("array<string>"))
    out = met.select(
        F.col("id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


ORACLE = r"""
WITH w AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
starts AS (
  SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)),
hits AS (SELECT rid, item_id, i, s.n FROM starts s JOIN windows w ON s.win = w.win AND s.n = w.n),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
by_doc AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN by_doc USING (rid)
"""

QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {"op7_decontamination": ORACLE}
