"""Queries on detection, metrics, agreement and quality, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.operators import agreement as A
from lexiscope.operators import lexicon as L
from lexiscope.operators import metrics as M
from lexiscope.operators import quality as Q
from lexiscope.plans import roles as R

QUERIES, ORACLES = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


docs = lambda s, d: R.table(s, d, "documents")

add("J01_lexicon_matches", lambda s, d: L.matches(docs(s, d), R.lexicon(s)).select("doc_id", "rule_no", "biased", "severity"),
    f"WITH {R.LEXICON}, {R.HITS} SELECT doc_id, rule_no, biased, severity FROM hits")
add("D01_lexicon_detection", lambda s, d: L.detection(docs(s, d), R.lexicon(s)).select("doc_id", "n_replace", "n_warn", "has_bias", "primary_category"),
    f"""WITH {R.LEXICON}, {R.HITS}
SELECT d.doc_id, CAST(count(h.doc_id) FILTER (WHERE severity <> 'warn') AS INTEGER) AS n_replace, CAST(count(h.doc_id) FILTER (WHERE severity = 'warn') AS INTEGER) AS n_warn,
  count(h.doc_id) FILTER (WHERE severity <> 'warn') > 0 AS has_bias, arg_min(stereotype_category, rule_no) FILTER (WHERE severity <> 'warn') AS primary_category
FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY d.doc_id""")
add("D02_edit_lists", lambda s, d: L.detection(docs(s, d), R.lexicon(s)).where("n_replace + n_warn > 0").select("doc_id", F.array_join(F.transform("replace_edits", lambda e: e["from"]), "|").alias("replaced"), F.array_join(F.transform("warn_edits", lambda e: e["from"]), "|").alias("warned")),
    f"""WITH {R.LEXICON}, {R.HITS} SELECT doc_id, coalesce(string_agg(biased, '|' ORDER BY rule_no) FILTER (WHERE severity <> 'warn'), '') AS replaced,
coalesce(string_agg(biased, '|' ORDER BY rule_no) FILTER (WHERE severity = 'warn'), '') AS warned FROM hits GROUP BY doc_id""")
add("A02_metrics_by_language", lambda s, d: M.metrics_by(R.judged(s, d), [[], ["lang"]]),
    f"""WITH {R.JUDGED}, c AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'OVERALL' ELSE lang END AS lang, {R.CELLS} FROM judged GROUP BY GROUPING SETS ((), (lang)))
SELECT lang, tp, fp, fn, tn, {R.SCORES} FROM c""")
add("A02_metrics_by_category", lambda s, d: M.metrics_by(R.judged(s, d).where("category <> 'none'"), [["lang"], ["lang", "category"]]),
    f"""WITH {R.JUDGED}, c AS (SELECT lang, CASE WHEN grouping(category) = 1 THEN 'OVERALL' ELSE category END AS category, {R.CELLS} FROM judged WHERE category <> 'none' GROUP BY GROUPING SETS ((lang), (lang, category)))
SELECT lang, category, tp, fp, fn, tn, {R.SCORES} FROM c""")


def detectors(s, d):
    rows = R.judged(s, d)
    return rows.withColumn("quality_low", F.col("quality") == 0).withColumn("always", F.lit(True))


add("A03_compare_detectors", lambda s, d: M.compare_detectors(detectors(s, d), ["predicted", "quality_low", "always"], "lang"),
    f"""WITH {R.JUDGED}, long AS (
  SELECT lang, 'predicted' AS model, has_bias, predicted FROM judged UNION ALL SELECT lang, 'quality_low', has_bias, quality = 0 FROM judged UNION ALL SELECT lang, 'always', has_bias, true FROM judged),
c AS (SELECT lang, model, {R.CELLS} FROM long GROUP BY ALL), sc AS (SELECT *, {R.SCORES} FROM c)
SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, model DESC) = 1 AS is_best FROM sc""")
add("A05_baseline_improvement", lambda s, d: M.compare_detectors(detectors(s, d), ["predicted", "quality_low"], "lang").groupBy("lang").agg(F.max(F.when(F.col("model") == "quality_low", F.col("f1"))).alias("base_f1"), F.max(F.when(F.col("model") == "predicted", F.col("f1"))).alias("full_f1")).withColumn("improvement", M.improvement(F.col("base_f1"), F.col("full_f1"))),
    f"""WITH {R.JUDGED}, long AS (SELECT lang, 'full' AS model, has_bias, predicted FROM judged UNION ALL SELECT lang, 'base', has_bias, quality = 0 FROM judged),
c AS (SELECT lang, model, {R.CELLS} FROM long GROUP BY ALL), sc AS (SELECT *, {R.SCORES} FROM c),
w AS (SELECT lang, max(f1) FILTER (WHERE model = 'base') AS base_f1, max(f1) FILTER (WHERE model = 'full') AS full_f1 FROM sc GROUP BY lang)
SELECT *, round((full_f1 - base_f1) * 100 / nullif(base_f1, 0), 4) AS improvement FROM w""")
add("A04_ablation_by_severity", lambda s, d: ablation(s, d),
    f"""WITH {R.JUDGED}, full_ AS (SELECT lang, {R.CELLS} FROM judged GROUP BY lang),
half AS (SELECT t.doc_id, t.lang, t.has_bias, EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = t.doc_id AND h.severity <> 'warn' AND h.rule_no < 5) AS predicted FROM truth t),
reduced AS (SELECT lang, {R.CELLS} FROM half GROUP BY lang), f AS (SELECT lang, {R.SCORES} FROM full_), r AS (SELECT lang, {R.SCORES} FROM reduced)
SELECT lang, r.f1 AS reduced_f1, f.f1 AS full_f1, round(f.f1 - r.f1, 6) AS gain FROM f JOIN r USING (lang)""")


def ablation(s, d):
    """A-04: the same detection with a part of the lexicon."""
    rows = R.truth(s, d)
    part = L.detection(rows, R.lexicon(s).where("rule_no < 5")).select("doc_id", F.col("has_bias").alias("reduced"))
    both = R.judged(s, d).join(part, "doc_id")
    f1 = lambda p, n: M.with_scores(both.groupBy("lang").agg(*M.confusion("has_bias", p))).select("lang", F.col("f1").alias(n))
    return f1("reduced", "reduced_f1").join(f1("predicted", "full_f1"), "lang").withColumn("gain", F.round(F.col("full_f1") - F.col("reduced_f1"), 6))


add("A06_failures", lambda s, d: R.judged(s, d).where("has_bias <> predicted").select("doc_id", "lang", F.when(F.col("has_bias"), "false_negative").otherwise("false_positive").alias("failure_type")),
    f"WITH {R.JUDGED} SELECT doc_id, lang, CASE WHEN has_bias THEN 'false_negative' ELSE 'false_positive' END AS failure_type FROM judged WHERE has_bias <> predicted")
_RATES = """g AS (SELECT lang, count(*) AS n, {cells} FROM judged GROUP BY lang),
r AS (SELECT (tp + fp) / n AS pr, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr FROM g)""".format(cells=R.CELLS)
add("A07_fairness_gaps", lambda s, d: M.fairness(R.judged(s, d), "lang"),
    f"""WITH {R.JUDGED}, {_RATES} SELECT round(CASE WHEN count(pr) >= 2 THEN max(pr) - min(pr) ELSE 0 END, 6) AS demographic_parity,
round(CASE WHEN count(tpr) >= 2 THEN max(tpr) - min(tpr) ELSE 0 END, 6) AS equal_opportunity,
round(CASE WHEN count(*) >= 2 THEN greatest(max(coalesce(tpr, 0)) - min(coalesce(tpr, 0)), max(coalesce(fpr, 0)) - min(coalesce(fpr, 0))) ELSE 0 END, 6) AS equalized_odds, count(*) AS n_groups FROM r""")
add("A12_group_rates", lambda s, d: M.with_scores(M.rates_by_group(R.judged(s, d), "source").select("source", "n", "tp", "fp", "fn", "tn")),
    f"WITH {R.JUDGED}, c AS (SELECT source, count(*) AS n, {R.CELLS} FROM judged GROUP BY source) SELECT *, {R.SCORES} FROM c")
add("A10_balance_scores", lambda s, d: M.balance_scores(M.metrics_by(R.judged(s, d), [["lang"]])),
    f"""WITH {R.JUDGED}, c AS (SELECT lang, {R.CELLS} FROM judged GROUP BY lang), s AS (SELECT {R.SCORES} FROM c)
SELECT round(CASE WHEN count(f1) < 2 THEN 0 ELSE greatest(0, least(1, 1 - stddev_pop(f1) / 0.75)) END, 6) AS mbe,
round(CASE WHEN count(f1) < 2 THEN 1 ELSE 1 - coalesce(stddev_pop(f1) / nullif(avg(f1), 0), 0) END, 6) AS mbe_variant FROM s""")
add("A13_estimates_and_tier", lambda s, d: M.estimates_and_tier(M.metrics_by(R.judged(s, d), [[], ["lang"]])).select("lang", "dp_estimate", "eo_estimate", "tier"),
    f"""WITH {R.JUDGED}, c AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'OVERALL' ELSE lang END AS lang, {R.CELLS} FROM judged GROUP BY GROUPING SETS ((), (lang))), s AS (SELECT lang, {R.SCORES} FROM c),
e AS (SELECT *, abs(precision - recall) * 0.1 AS dp, (1 - recall) * 0.05 AS eo FROM s)
SELECT lang, round(dp, 6) AS dp_estimate, round(eo, 6) AS eo_estimate, CASE WHEN f1 >= 0.85 AND dp <= 0.05 THEN 'Gold' WHEN f1 >= 0.8 AND dp <= 0.08 THEN 'Silver' WHEN f1 >= 0.75 AND dp <= 0.1 THEN 'Bronze' ELSE 'None' END AS tier FROM e""")
add("A14_human_model_agreement", lambda s, d: R.judged(s, d).agg(F.round(M.agreement_rate(F.col("has_bias"), F.col("predicted")), 6).alias("hmar"), F.round(F.avg(F.when(F.col("has_bias"), F.col("predicted").cast("int"))), 6).alias("on_biased"), F.round(F.avg(F.when(~F.col("has_bias"), (~F.col("predicted")).cast("int"))), 6).alias("on_neutral")),
    f"WITH {R.JUDGED} SELECT round(avg(CAST(has_bias = predicted AS INT)), 6) AS hmar, round(avg(CAST(predicted AS INT)) FILTER (WHERE has_bias), 6) AS on_biased, round(avg(CAST(NOT predicted AS INT)) FILTER (WHERE NOT has_bias), 6) AS on_neutral FROM judged")
_K = """n, a AS both_true, b AS only_a, c AS only_b, d AS both_false, round(po, 6) AS agreement,
round(CASE WHEN pe >= 1 THEN 0 ELSE greatest(0, (po - pe) / (1 - pe)) END, 6) AS kappa_floored, round(k, 6) AS kappa,
round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa_certain_one,
CASE WHEN k < 0 THEN 'poor' WHEN k < 0.2 THEN 'slight' WHEN k < 0.4 THEN 'fair' WHEN k < 0.6 THEN 'moderate' WHEN k < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS label,
k >= 0.7 AS bronze, k >= 0.75 AS silver, k >= 0.8 AS gold"""
_KC = """count(*) AS n, count(*) FILTER (WHERE x AND y) AS a, count(*) FILTER (WHERE x AND NOT y) AS b, count(*) FILTER (WHERE NOT x AND y) AS c, count(*) FILTER (WHERE NOT x AND NOT y) AS d"""
_KP = "SELECT *, (a + d) / n AS po, (a + b) / n * ((a + c) / n) + (1 - (a + b) / n) * (1 - (a + c) / n) AS pe"
_KK = "SELECT *, CASE WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END AS k"
add("A15_kappa_by_language", lambda s, d: A.binary_kappa(R.judged(s, d), "has_bias", "predicted", ["lang"]),
    f"WITH {R.JUDGED}, c AS (SELECT lang, {_KC.replace('x AND', 'has_bias AND').replace('NOT x', 'NOT has_bias').replace('AND y', 'AND predicted').replace('NOT y', 'NOT predicted')} FROM judged GROUP BY lang), p AS ({_KP} FROM c), q AS ({_KK} FROM p) SELECT lang, {_K} FROM q")
add("A16_multiclass_kappa", lambda s, d: A.multiclass_kappa(docs(s, d).select("lang", F.when(F.length("text") % 5 == 0, "en").otherwise(F.col("lang")).alias("other")), "lang", "other"),
    """WITH p AS (SELECT lang AS x, CASE WHEN length(text) % 5 = 0 THEN 'en' ELSE lang END AS y FROM documents), m AS (SELECT sum(nx * ny) AS e FROM (SELECT x AS l, count(*) AS nx FROM p GROUP BY x) JOIN (SELECT y AS l, count(*) AS ny FROM p GROUP BY y) USING (l)),
s AS (SELECT count(*) AS n, avg(CAST(x = y AS INT)) AS po FROM p) SELECT n, round(po, 6) AS agreement, round((po - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM s, m""")
add("A18_weighted_kappa", lambda s, d: A.weighted_kappa(R.judged(s, d).withColumn("w", (F.pmod("doc_id", F.lit(5)) + 1) / 5.0), "has_bias", "predicted", "w"),
    f"""WITH {R.JUDGED}, s AS (SELECT sum(w) AS w, sum(w) FILTER (WHERE has_bias = predicted) AS same, sum(w) FILTER (WHERE has_bias) AS pa, sum(w) FILTER (WHERE predicted) AS pb FROM (SELECT *, (doc_id % 5 + 1) / 5.0 AS w FROM judged)),
p AS (SELECT same / w AS po, pa / w AS pa, pb / w AS pb FROM s), q AS (SELECT po, pa * pb + (1 - pa) * (1 - pb) AS pe FROM p) SELECT round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS weighted_kappa FROM q""")
add("A21_alpha", lambda s, d: A.alpha(R.ratings(s, d)),
    f"""WITH {R.RATINGS}, i AS (SELECT doc_id, count(*) FILTER (WHERE label) AS n1, count(*) FILTER (WHERE NOT label) AS n0 FROM ratings GROUP BY doc_id HAVING count(label) >= 2),
t AS (SELECT count(*) AS items, sum(n1 * n0) / sum((n1 + n0) * (n1 + n0 - 1) / 2) AS o, sum(n1) / sum(n1 + n0) AS p FROM i), e AS (SELECT *, 2 * p * (1 - p) AS x FROM t)
SELECT items, round(o, 6) AS observed, round(x, 6) AS expected, round(1 - o / x, 6) AS alpha, round(greatest(0, least(1, 1 - o / x)), 6) AS alpha_clamped,
CASE WHEN 1 - o / x >= 0.8 THEN 'reliable' WHEN 1 - o / x >= 0.667 THEN 'tentative' ELSE 'unreliable' END AS label FROM e""")
add("A23_pairwise_agreement", lambda s, d: A.pairwise(R.ratings(s, d)),
    f"WITH {R.RATINGS} SELECT a.annotator AS first, b.annotator AS second, count(*) AS n, round(avg(CAST(a.label = b.label AS INT)), 6) AS agreement FROM ratings a JOIN ratings b USING (doc_id) WHERE a.annotator < b.annotator GROUP BY ALL")
add("J05_first_two_kappa", lambda s, d: A.binary_kappa(A.first_two(R.ratings(s, d)), "x", "y"),
    f"WITH {R.RATINGS}, t AS (SELECT a.label AS x, b.label AS y FROM ratings a JOIN ratings b USING (doc_id) WHERE a.annotator = 'a' AND b.annotator = 'b'), c AS (SELECT {_KC} FROM t), p AS ({_KP} FROM c), q AS ({_KK} FROM p) SELECT {_K} FROM q")
add("A25_majority_vote", lambda s, d: A.majority(R.ratings(s, d)),
    f"WITH {R.RATINGS}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE label) AS yes FROM ratings GROUP BY doc_id) SELECT doc_id, n, yes * 2 > n AS majority, round(CASE WHEN yes * 2 > n THEN yes ELSE n - yes END / n, 6) AS agreement FROM c")
add("A26_confidence_profile", lambda s, d: Q.confidence_profile(R.samples(s, d), "annotator_id"),
    f"""WITH {R.SAMPLES}, c AS (SELECT annotator_id, count(*) AS n, count(*) FILTER (WHERE confidence = 'very_low') AS very_low, count(*) FILTER (WHERE confidence = 'low') AS low, count(*) FILTER (WHERE confidence = 'medium') AS medium, count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'very_high') AS very_high FROM samples GROUP BY annotator_id)
SELECT *, round((high + very_high) / n, 6) AS high_share, (high + very_high) / n BETWEEN 0.4 AND 0.7 AS balanced FROM c""")
add("A27_bias_balance", lambda s, d: Q.bias_balance(R.samples(s, d), "annotator_id"),
    f"WITH {R.SAMPLES} SELECT annotator_id, round(avg(CAST(has_bias AS INT)), 6) AS bias_share, avg(CAST(has_bias AS INT)) BETWEEN 0.3 AND 0.7 AS balanced FROM samples GROUP BY annotator_id")
_FIELDS = ("text", "bias_category", "expected_correction", "confidence", "fairness_score")
add("A28_field_coverage", lambda s, d: Q.coverage(R.samples(s, d), _FIELDS),
    f"WITH {R.SAMPLES} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS filled, round(100.0 * count({c}) / count(*), 4) AS coverage, count({c}) = count(*) AS complete FROM samples" for c in _FIELDS))
add("A29_missing_fields", lambda s, d: Q.missing_fields(R.samples(s, d), "doc_id", _FIELDS).select("doc_id", F.array_join("missing", ",").alias("missing")),
    f"WITH {R.SAMPLES} SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _FIELDS) + ") AS missing FROM samples WHERE " + " OR ".join(f"{c} IS NULL" for c in _FIELDS))
_W01 = f"""{R.SAMPLES}, f AS (SELECT *, avg(CAST(has_bias AS INT)) OVER w AS rate, count(*) OVER w AS held FROM samples WINDOW w AS (PARTITION BY annotator_id ORDER BY ts, doc_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
cons AS (SELECT annotator_id, count(*) AS n, count(*) FILTER (WHERE held = 10) AS windows, round(avg(rate) FILTER (WHERE held = 10), 6) AS mean_rate, round(stddev_pop(rate) FILTER (WHERE held = 10), 6) AS sd FROM f GROUP BY annotator_id)"""
add("W01_consistency", lambda s, d: Q.consistency(R.samples(s, d), "annotator_id", ["ts", "doc_id"]), f"WITH {_W01} SELECT *, n < 20 OR sd < 0.2 AS consistent FROM cons")
_W02 = f"""{R.SAMPLES}, h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY annotator_id ORDER BY ts, doc_id) <= count(*) OVER (PARTITION BY annotator_id) // 2 THEN 1 ELSE 2 END AS half, count(*) OVER (PARTITION BY annotator_id) AS n FROM samples),
r AS (SELECT annotator_id, count(*) FILTER (WHERE half = 1) * 60.0 / nullif(max(ts) FILTER (WHERE half = 1) - min(ts) FILTER (WHERE half = 1), 0) AS r1, count(*) FILTER (WHERE half = 2) * 60.0 / nullif(max(ts) FILTER (WHERE half = 2) - min(ts) FILTER (WHERE half = 2), 0) AS r2 FROM h WHERE n >= 20 GROUP BY annotator_id)"""
add("W02_fatigue", lambda s, d: Q.fatigue(R.samples(s, d), "annotator_id"), f"WITH {_W02} SELECT annotator_id, round(r1, 6) AS first_rate, round(r2, 6) AS second_rate, coalesce((r1 - r2) / r1 > 0.3, false) AS fatigue FROM r")
add("A30_quality_score", lambda s, d: Q.quality_score(R.samples(s, d), "annotator_id", ["text", "confidence"], ["ts", "doc_id"]),
    f"""WITH {_W01}, h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY annotator_id ORDER BY ts, doc_id) <= count(*) OVER (PARTITION BY annotator_id) // 2 THEN 1 ELSE 2 END AS half, count(*) OVER (PARTITION BY annotator_id) AS n FROM samples),
r AS (SELECT annotator_id, count(*) FILTER (WHERE half = 1) * 60.0 / nullif(max(ts) FILTER (WHERE half = 1) - min(ts) FILTER (WHERE half = 1), 0) AS r1, count(*) FILTER (WHERE half = 2) * 60.0 / nullif(max(ts) FILTER (WHERE half = 2) - min(ts) FILTER (WHERE half = 2), 0) AS r2 FROM h WHERE n >= 20 GROUP BY annotator_id),
b AS (SELECT annotator_id, avg(CAST(confidence IN ('high', 'very_high') AS INT)) BETWEEN 0.4 AND 0.7 AS confidence_ok, avg(CAST(has_bias AS INT)) BETWEEN 0.3 AND 0.7 AS bias_ok, bool_and(text IS NOT NULL AND confidence IS NOT NULL) AS schema_ok FROM samples GROUP BY annotator_id),
j AS (SELECT annotator_id, confidence_ok, bias_ok, schema_ok, cons.n < 20 OR sd < 0.2 AS consistent_ok, coalesce((r1 - r2) / r1 > 0.3, false) AS fatigue FROM b JOIN cons USING (annotator_id) LEFT JOIN r USING (annotator_id)),
s AS (SELECT *, CAST(20 * (CAST(confidence_ok AS INT) + CAST(bias_ok AS INT) + CAST(schema_ok AS INT) + CAST(consistent_ok AS INT) + CAST(NOT fatigue AS INT)) AS INTEGER) AS score FROM j)
SELECT *, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS assessment FROM s""")
add("A32_batch_statistics", lambda s, d: Q.batch_statistics(R.samples(s, d), "annotator_id"),
    f"""WITH {R.SAMPLES} SELECT annotator_id, count(*) AS n, count(*) FILTER (WHERE has_bias) AS biased, round(100 * avg(CAST(has_bias AS INT)), 4) AS bias_percent,
round(avg(CASE confidence WHEN 'very_low' THEN 1 WHEN 'low' THEN 2 WHEN 'high' THEN 4 WHEN 'very_high' THEN 5 ELSE 3 END), 6) AS mean_confidence, round(avg(CAST(ml_prediction = has_bias AS INT)), 6) AS agreement_rate FROM samples GROUP BY annotator_id""")
add("A33_tier_requirements", lambda s, d: Q.tier_requirements(R.ratings(s, d), "doc_id").select("tier", "samples", "multi_share", "met"),
    f"""WITH {R.RATINGS}, i AS (SELECT doc_id, count(DISTINCT annotator) AS k FROM ratings GROUP BY doc_id), t AS (SELECT count(*) AS samples, round(avg(CAST(k > 1 AS INT)), 6) AS multi_share FROM i)
SELECT tier, samples, multi_share, samples >= least_ AND multi_share >= share AS met FROM t, (VALUES ('bronze', 1200, 0.1), ('silver', 5000, 0.2), ('gold', 10000, 0.3)) v(tier, least_, share)""")
add("A34_dataset_profile", lambda s, d: Q.dataset_profile(R.samples(s, d), ["lang", "annotator_id", "demographic_group", "bias_category"]),
    f"WITH {R.SAMPLES}, c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce({c}, '(none)') AS value, count(*) AS n FROM samples GROUP BY {c}" for c in ("lang", "annotator_id", "demographic_group", "bias_category")) + ") SELECT *, round(100 * n / sum(n) OVER (PARTITION BY field), 4) AS percent FROM c")
add("A36_acceptance_rate", lambda s, d: R.reviews(s, d).where("action <> 'other'").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("action").isin("approve", "approve_with_edit").cast("int")), 6).alias("acceptance")),
    f"WITH {R.REVIEWS} SELECT count(*) AS n, round(avg(CAST(action IN ('approve', 'approve_with_edit') AS INT)), 6) AS acceptance FROM reviews WHERE action <> 'other'")
add("A48_class_weight", lambda s, d: R.truth(s, d).agg(F.round(F.try_divide(F.count_if(~F.col("has_bias")), F.count_if("has_bias")), 6).alias("positive_weight")), f"WITH {R.TRUTH} SELECT round(count(*) FILTER (WHERE NOT has_bias) / nullif(count(*) FILTER (WHERE has_bias), 0), 6) AS positive_weight FROM truth")
add("A49_length_distribution", lambda s, d: docs(s, d).groupBy("lang").agg(F.min(F.length("text")).cast("long").alias("least"), F.round(F.expr("percentile(length(text), 0.5)"), 4).alias("median"), F.round(F.expr("percentile(length(text), 0.95)"), 4).alias("p95"), F.max(F.length("text")).cast("long").alias("most")),
    "SELECT lang, min(length(text)) AS least, round(quantile_cont(length(text), 0.5), 4) AS median, round(quantile_cont(length(text), 0.95), 4) AS p95, max(length(text)) AS most FROM documents GROUP BY lang")
add("A50_hit_rate", lambda s, d: L.detection(docs(s, d), R.lexicon(s)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("has_bias").cast("int")), 6).alias("hit_rate")),
    f"WITH {R.LEXICON}, {R.HITS} SELECT count(*) AS n, round(avg(CAST(EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = d.doc_id AND h.severity <> 'warn') AS INT)), 6) AS hit_rate FROM documents d")
