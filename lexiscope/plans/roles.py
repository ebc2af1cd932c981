"""The driver tables in the roles of the library's inputs, for the registered queries, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.operators.lexicon import detection

#: Words that stand in for a lexicon of biased terms (fixed values), with what their rules say.
REPLACE_TERMS = ("trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid")
WARN_TERMS = ("he", "of the")
CATEGORIES = ("profession", "family_role", "leadership", "capability")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon_rows() -> list[tuple]:
    terms = [(t, "replace") for t in REPLACE_TERMS] + [(t, "warn") for t in WARN_TERMS]
    return [(i, t, f"neutral {t}", s, CATEGORIES[i % len(CATEGORIES)]) for i, (t, s) in enumerate(terms)]


def lexicon(spark: SparkSession) -> DataFrame:
    """A local relation, so that Spark knows its size and broadcasts it while it is small."""
    return spark.sql(f"SELECT * FROM VALUES {_VALUES} AS t(rule_no, biased, neutral_primary, severity, stereotype_category)")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, text, lang, source, has_bias, quality."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("has_bias"), "quality")
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select("doc_id", "text", "lang", "source", "has_bias", "quality")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the detector's decision."""
    docs = truth(spark, sf_dir)
    found = detection(docs, lexicon(spark))
    return docs.join(found.select("doc_id", F.col("has_bias").alias("predicted"), F.coalesce("primary_category", F.lit("none")).alias("category")), "doc_id")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raters of every labelled document, long: doc_id, annotator, label."""
    rows = judged(spark, sf_dir)
    of = lambda name, c: F.struct(F.lit(name).alias("annotator"), c.alias("label"))
    return rows.select("doc_id", F.explode(F.array(of("a", F.col("has_bias")), of("b", F.col("predicted")), of("c", F.col("quality") == 0))).alias("r")).select("doc_id", "r.annotator", "r.label")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as annotation samples."""
    d = truth(spark, sf_dir)
    levels = F.array(*[F.lit(x) for x in ("very_low", "low", "medium", "high", "very_high", "unsure")])
    n = F.col("doc_id")
    return d.select(
        "doc_id",
        F.col("source").alias("annotator_id"),
        "lang",
        "text",
        "has_bias",
        F.when(F.pmod(n, F.lit(7)) != 0, F.when(F.col("has_bias"), "occupation")).alias("bias_category"),
        F.when(F.pmod(n, F.lit(5)) != 0, F.when(F.col("has_bias"), F.lit("a correction"))).alias("expected_correction"),
        F.element_at(levels, (F.pmod(n, F.lit(6)) + 1).cast("int")).alias("confidence"),
        F.when(F.pmod(n, F.lit(3)) == 0, "male").when(F.pmod(n, F.lit(3)) == 1, "female").otherwise("neutral").alias("demographic_group"),
        (F.pmod(n, F.lit(13)) / 10.0).alias("fairness_score"),
        F.timestamp_seconds(F.lit(1_704_067_200) + n * F.lit(60) + F.when(n > 500, n * F.lit(20)).otherwise(0)).alias("ts"),
        (F.col("quality") == 0).alias("ml_prediction"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a review log of all documents: review_id, audit_id, reviewer, ts, action."""
    action = F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "purchase", "approve_with_edit").when(F.col("event_type") == "error", "reject").otherwise("other")
    n = max(1, table(spark, sf_dir, "documents").count())
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("review_id"), F.pmod("event_id", F.lit(n)).alias("audit_id"), F.col("user_id").alias("reviewer"), "ts", action.alias("action"))


# The same roles as SQL, for the oracles.
_VALUES = ", ".join(f"({i}, '{t}', '{n}', '{s}', '{c}')" for i, t, n, s, c in lexicon_rows())
LEXICON = f"lexicon(rule_no, biased, neutral_primary, severity, stereotype_category) AS (VALUES {_VALUES})"
TRUTH = "truth AS (SELECT d.doc_id, d.text, d.lang, d.source, l.toxic = 1 AS has_bias, l.quality FROM documents d JOIN labels l USING (doc_id))"
HITS = r"""hits AS (
  SELECT DISTINCT d.doc_id, l.* FROM (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS t FROM documents) d
  JOIN lexicon l ON contains(d.t, ' ' || l.biased || ' ')
  WHERE l.biased <> l.neutral_primary AND (l.biased NOT LIKE '% %' OR EXISTS (
    SELECT 1 FROM documents x WHERE x.doc_id = d.doc_id AND regexp_matches(x.text, '(^|[^\p{L}\p{N}_])' || l.biased || '($|[^\p{L}\p{N}_])', 'i'))))"""
JUDGED = f"""{LEXICON}, {TRUTH}, {HITS},
judged AS (
  SELECT t.*, coalesce(h.n, 0) > 0 AS predicted, coalesce(h.category, 'none') AS category
  FROM truth t LEFT JOIN (
    SELECT doc_id, count(*) AS n, arg_min(stereotype_category, rule_no) AS category FROM hits WHERE severity <> 'warn' GROUP BY doc_id) h USING (doc_id))"""
RATINGS = JUDGED + """,
ratings AS (
  SELECT doc_id, 'a' AS annotator, has_bias AS label FROM judged UNION ALL
  SELECT doc_id, 'b', predicted FROM judged UNION ALL
  SELECT doc_id, 'c', quality = 0 FROM judged)"""
SAMPLES = f"""{TRUTH},
samples AS (
  SELECT doc_id, source AS annotator_id, lang, text, has_bias,
    CASE WHEN doc_id % 7 <> 0 AND has_bias THEN 'occupation' END AS bias_category,
    CASE WHEN doc_id % 5 <> 0 AND has_bias THEN 'a correction' END AS expected_correction,
    ['very_low', 'low', 'medium', 'high', 'very_high', 'unsure'][doc_id % 6 + 1] AS confidence,
    CASE doc_id % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'neutral' END AS demographic_group,
    (doc_id % 13) / 10.0 AS fairness_score,
    1704067200 + doc_id * 60 + CASE WHEN doc_id > 500 THEN doc_id * 20 ELSE 0 END AS ts,
    quality = 0 AS ml_prediction
  FROM truth)"""
REVIEWS = """reviews AS (
  SELECT event_id AS review_id, event_id % greatest(1, (SELECT count(*) FROM documents)) AS audit_id, user_id AS reviewer, ts,
    CASE event_type WHEN 'click' THEN 'approve' WHEN 'purchase' THEN 'approve_with_edit' WHEN 'error' THEN 'reject' ELSE 'other' END AS action
  FROM events)"""
SCORES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy"""
CELLS = """count(*) FILTER (WHERE has_bias AND predicted) AS tp, count(*) FILTER (WHERE NOT has_bias AND predicted) AS fp,
  count(*) FILTER (WHERE has_bias AND NOT predicted) AS fn, count(*) FILTER (WHERE NOT has_bias AND NOT predicted) AS tn"""
