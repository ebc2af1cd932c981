"""Query op10: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiscope.llm.common import table
from lexiscope.llm.neardup import near_duplicates

PERCENT = 85


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links are confirmed at 85 hundredths of the union."""
    return near_duplicates(table(spark, sf_dir, "documents"), PERCENT)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * inter >= 85 * (x.n + y.n - inter)),
reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a),
least_other AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(other, doc_id)) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_other USING (doc_id)
"""

QUERIES = {"op10_minhash_dedup": op10_minhash_dedup}
ORACLES = {"op10_minhash_dedup": ORACLE}
