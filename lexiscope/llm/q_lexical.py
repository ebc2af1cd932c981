"""Query op11: the documents that rank highest for every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiscope.llm.common import table
from lexiscope.llm.lexical import search

BEST = 20


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents of each item, exact."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), BEST)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_all FROM d WHERE len(ws) > 0),
items AS (
  SELECT item_id, row_number() OVER () AS qid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item_id, qid, term, count(*) AS times FROM (SELECT item_id, qid, unnest(ws) AS term FROM items) GROUP BY ALL),
posts AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), totals),
lengths AS (SELECT rid, doc_id, 100 - 25 + ((25 * len(ws) * n_docs) // n_all) AS m FROM d, totals),
scored AS (
  SELECT item_id, qid, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN posts USING (term) JOIN weighed USING (term) JOIN lengths USING (rid) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""

QUERIES = {"op11_lexical_search": op11_lexical_search}
ORACLES = {"op11_lexical_search": ORACLE}
