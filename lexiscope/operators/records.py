"""Records, reports and projections around annotation (P-14, P-19, P-23, J-02, C-04, C-06, A-17, A-19, A-24, A-31, A-46, A-47, T-08, F-06, F-10, F-15, M-03, M-04, M-08, M-13)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiscope.functions.text import ratio
from lexiscope.operators.agreement import alpha, binary_kappa, kappa
from lexiscope.operators.correct import replaced
from lexiscope.operators.datasets import numbered
from lexiscope.operators.lexicon import matches
from lexiscope.operators.quality import coverage, dataset_profile

#: Outcomes of a rewrite in words (fixed values).
REASON_PRESERVED = "Original preserved — correction would damage meaning (semantic score below threshold)."
REASON_MODEL = "No lexicon rules matched; ML fallback applied. Human review required."
REASON_NONE = "No gender bias detected."
REASON_SKIPPED = "but skipped — biographical, quote, or statistical context."
#: Least values that a review bundle passes with (fixed values).
LEAST_AGREEMENT, LEAST_KAPPA, LEAST_ALPHA = 0.80, 0.70, 0.80
#: Cells of the annotation format that are the same in all rows (fixed values).
NEWS_CELLS = {
    "language": "sw", "script": "latin", "country": "Kenya", "region_dialect": "", "source_type": "web_public", "translation": "", "domain": "news", "theme": "occupations",
    "sensitive_characteristic": "gender", "target_gender": "NEEDS_ANNOTATION", "bias_label": "NEEDS_ANNOTATION", "stereotype_category": "NEEDS_ANNOTATION", "explicitness": "NEEDS_ANNOTATION",
    "safety_flag": "safe", "pii_removed": "false", "qa_status": "needs_review", "eval_split": "train",
}


def strict_labels(rows: DataFrame, text: str = "text", label: str = "has_bias") -> DataFrame:
    """P-14: ``valid`` for rows with a non-blank text and a label that reads true or false; the label as 0 or 1."""
    word = F.lower(F.trim(F.col(label).cast("string")))
    valid = (F.trim(F.coalesce(text, F.lit(""))) != "") & F.coalesce(word.isin("true", "false"), F.lit(False))
    return rows.withColumn("valid", valid).withColumn("y", F.when(valid, (word == "true").cast("int")))


def category_group(category: Column) -> Column:
    """P-19: the group that a bias category stands for."""
    c = F.lower(F.coalesce(category, F.lit("")))
    return F.when(F.contains(c, F.lit("occupation")) | F.contains(c, F.lit("pronoun")), "female_referent").otherwise("neutral_referent")


def attributed(rows: DataFrame, sources: Mapping[str, tuple[str, str]], hints: Sequence[tuple[str, str]], by: str = "data_source", text: str = "text", notes: str = "notes") -> DataFrame:
    """P-23: name and address of a row's source by its ``data_source``, else by the first hint in the text; notes say so."""
    table = F.create_map(*[x for k, (name, url) in sources.items() for x in (F.lit(k), F.struct(F.lit(name).alias("name"), F.lit(url).alias("url")))])
    hinted = F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(h)), F.lit(k)) for h, k in hints], F.lit(None).cast("string"))
    found = F.try_element_at(table, F.coalesce(F.when(F.array_contains(F.map_keys(table), F.col(by)), F.col(by)), hinted, F.lit("")))
    own = F.nullif(F.trim(F.col(notes)), F.lit(""))
    return rows.withColumn("source_name", found["name"]).withColumn("source_url", found["url"]).withColumn(notes, F.concat_ws("; ", own, F.concat(F.lit("source: "), F.col("source_name"))))


def paired(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """J-02: truth and prediction side by side; both must have the same keys."""
    met = truth.withColumn("_t", F.lit(True)).join(predicted.withColumn("_p", F.lit(True)), key, "full_outer")
    lonely = met.agg(F.count_if(F.col("_t").isNull() | F.col("_p").isNull()).alias("n")).first()["n"]
    if lonely:
        raise ValueError(f"{lonely} rows have no partner")
    return met.drop("_t", "_p")


def kappa_by_column(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A-17: kappa of every column pair (c_a, c_b) over the rows in which both are filled, at least two."""
    clean = lambda c: F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    cells = F.array(*[F.struct(F.lit(c).alias("field"), clean(f"{c}_a").alias("a"), clean(f"{c}_b").alias("b")) for c in columns])
    long = pairs.select(F.explode(cells).alias("p")).select("p.*").where("a is not null and b is not null")
    sides = F.explode(F.array(F.struct(F.col("a").alias("label"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col("b").alias("label"), F.lit(0).alias("x"), F.lit(1).alias("y"))))
    marginal = long.select("field", sides.alias("m")).groupBy("field", "m.label").agg(F.sum("m.x").alias("na"), F.sum("m.y").alias("nb"))
    chance = marginal.groupBy("field").agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    seen = long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same")).where("n >= 2")
    p_o, p_e = ratio(F.col("same"), F.col("n")), ratio(F.col("chance"), F.col("n") * F.col("n"))
    return seen.join(chance, "field").select("field", "n", F.round(kappa(p_o, p_e, 1.0), 4).alias("kappa"))


def disagreements(pairs: DataFrame, a: str, b: str, keep: Sequence[str]) -> DataFrame:
    """A-19: the rows in which two raters differ."""
    return pairs.where(F.col(a) != F.col(b)).select(*keep, a, b)


def review_bundle(rows: DataFrame, ratings: DataFrame, first: str, second: str) -> DataFrame:
    """A-24: agreement of model and person, kappa of the first two raters, alpha of all, each with its flag; one row."""
    same = (F.col("predicted") == F.col("has_bias")).cast("int")
    model = rows.agg(F.count(F.lit(1)).alias("samples"), F.round(F.coalesce(F.avg(same), F.lit(0.0)), 6).alias("hmar"), F.round(F.coalesce(F.avg(F.when(F.col("has_bias"), same)), F.lit(0.0)), 6).alias("bias_detected"), F.round(F.coalesce(F.avg(F.when(~F.col("has_bias"), same)), F.lit(0.0)), 6).alias("no_bias"))
    side = lambda who, c: ratings.where(F.col("annotator") == who).select("doc_id", F.col("label").alias(c))
    two = binary_kappa(side(first, "x").join(side(second, "y"), "doc_id"), "x", "y").select(F.col("kappa_floored").alias("kappa"))
    every = alpha(ratings).select(F.col("alpha_clamped").alias("alpha"))
    raters = ratings.agg(F.count_distinct("annotator").alias("annotators"))
    one = model.join(two).join(every).join(raters)  # each side is one row
    return one.select("*", (F.col("hmar") >= LEAST_AGREEMENT).alias("hmar_ok"), (F.col("kappa") >= LEAST_KAPPA).alias("kappa_ok"), (F.col("alpha") >= LEAST_ALPHA).alias("alpha_ok"))


def multi_batch_report(scores: DataFrame) -> DataFrame:
    """A-31: over quality scores by batch: their mean and word, and how many batches fail each check."""
    checks = ("confidence_ok", "bias_ok", "schema_ok", "consistent_ok")
    out = scores.agg(F.count(F.lit(1)).alias("batches"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("mean_score"), *[F.count_if(~F.col(c)).alias(f"failed_{c[:-3]}") for c in checks], F.count_if("fatigue").alias("failed_fatigue"))
    m = F.col("mean_score")
    word = F.when(m >= 80, "Excellent").when(m >= 60, "Good").when(m >= 40, "Fair").otherwise("Poor")
    return out.withColumn("assessment", word).withColumn("passes", m >= 60)


def field_report(rows: DataFrame, columns: Sequence[str], of: Sequence[str]) -> DataFrame:
    """A-46: (field, value, n, percent): the filled share of all columns (value null) and the values of some."""
    filled = coverage(rows, columns).select("field", F.lit(None).cast("string").alias("value"), F.col("filled").alias("n"), F.col("coverage").alias("percent"))
    return filled.unionByName(dataset_profile(rows, of))


def migration_statistics(rows: DataFrame) -> DataFrame:
    """A-47: (statistic, value, n): rows, rows by label and device, rows that need a manual review."""
    review = (F.coalesce("stereotype_category", F.lit("")) == "") & (F.col("bias_label") != "neutral")
    item = lambda name, value, when: F.when(when, F.struct(F.lit(name).alias("statistic"), value.alias("value")))
    nothing = F.lit(None).cast("string")
    cells = F.array(item("total_rows", nothing, F.lit(True)), item("bias_label", F.col("bias_label"), F.lit(True)), item("device", F.col("device"), F.coalesce("device", F.lit("")) != ""), item("needs_manual_review", nothing, review))
    return rows.select(F.explode(F.array_compact(cells)).alias("s")).groupBy("s.statistic", "s.value").agg(F.count(F.lit(1)).alias("n"))


def split_summary(rows: DataFrame, split: str = "split", label: str = "has_bias") -> DataFrame:
    """M-08: rows and share of every label in every split."""
    counts = rows.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy(split)), 4))


def annotation_rows(rows: DataFrame, order: Sequence[str], collected: str, source: str = "source", terms: str = "terms", prefix: str = "SW-NEWS-", cells: Mapping[str, str] = NEWS_CELLS) -> DataFrame:
    """M-13, M-04: sampled texts in the annotation format, with ids in order."""
    n = numbered(rows, order, name="_no")
    listed = F.array_join(terms, ", ")
    own = [F.concat(F.lit(prefix), F.lpad(F.col("_no").cast("string"), 5, "0")).alias("id"), F.col(source).alias("source_ref"), F.lit(collected).alias("collection_date"), F.col("text"), F.array_join(terms, ",").alias("topic"), F.concat(F.lit("Occupation terms: "), listed).alias("notes")]
    return n.select(*own, *[F.lit(v).alias(c) for c, v in cells.items()])


def inferred_label(text: Column, negative: Sequence[str], counter: Sequence[str]) -> Column:
    """M-03: derogation or counter-stereotype by substring, else stereotype."""
    has = lambda own: F.exists(F.array(*[F.lit(x) for x in own]), lambda x: F.contains(F.lower(text), x))
    return F.when(has(negative), "derogation").when(has(counter), "counter-stereotype").otherwise("stereotype")


def example_sentences(rows: DataFrame, order: Sequence[str], n: int, prefix: str) -> DataFrame:
    """T-08: the first ``n`` rows with an id from their place."""
    first = rows.orderBy(*order).limit(n)
    return first.withColumn("id", F.format_string(f"{prefix}%04d", F.row_number().over(W.orderBy(*order))))


def without_pronoun(text: Column) -> Column:
    """F-06: a leading pronoun is dropped and what follows keeps its case (fixed pairs)."""
    for old, new in (("Yeye ni", "Ni"), ("yeye ni", "ni"), ("Yeye anafanya", "Anafanya"), ("yeye anafanya", "anafanya")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def minutes_between(start: Column, end: Column) -> Column:
    """F-10: minutes from one time to another."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 60.0


def stamped(rows: DataFrame, key: str = "audit_id", ts: str = "created_at") -> DataFrame:
    """F-15: a random id and the time of the run for every row."""
    return rows.withColumn(key, F.uuid()).withColumn(ts, F.current_timestamp())


def span_corrected(rows: DataFrame, lexicon: DataFrame, spans: str = "spans") -> DataFrame:
    """C-04: per flagged span the first rule whose term it holds is applied to the text, span after span."""
    flagged = rows.select("doc_id", F.posexplode(spans).alias("pos", "span")).withColumn("span_id", F.struct("doc_id", "pos"))
    rule = F.struct("rule_no", "biased", "neutral_primary", "severity")
    hit = matches(flagged, lexicon, "span_id", "span").groupBy(F.col("doc_id").alias("span_id")).agg(F.min(rule).alias("rule"))
    per_doc = hit.groupBy(F.col("span_id.doc_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("span_id.pos").alias("pos"), "rule"))).alias("picked"))
    out = rows.select("doc_id", "text").join(per_doc, "doc_id", "left")
    fold = F.aggregate("picked", F.col("text"), lambda t, p: replaced(t, p["rule"]["biased"], p["rule"]["neutral_primary"], p["rule"]["severity"] == "warn"))
    return out.select("doc_id", F.coalesce(fold, F.col("text")).alias("rewrite"), F.coalesce(F.size("picked"), F.lit(0)).alias("n_edits"))


def edit_records(found: DataFrame) -> DataFrame:
    """C-06: matched rules as edit records with their reason."""
    tags = F.coalesce(F.nullif(F.col("tags"), F.lit("")), F.lit("occupation/role")) if "tags" in found.columns else F.lit("occupation/role")
    why = F.concat(F.lit("'"), F.col("biased"), F.lit("' is gender-biased ("), tags, F.lit("); use gender-neutral '"), F.col("neutral_primary"), F.lit("'"))
    return found.select("doc_id", F.col("biased").alias("from"), F.col("neutral_primary").alias("to"), "severity", tags.alias("tags"), "stereotype_category", why.alias("reason"))


def outcome_reason(source: Column, terms: Column, skipped: Column) -> Column:
    """C-06: the five outcomes of a rewrite in words."""
    quoted = lambda own: F.array_join(F.transform(own, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    corrected = F.concat(F.size(terms).cast("string"), F.lit(" biased term(s) corrected: "), quoted(terms), F.lit("."))
    passed = F.concat(F.lit("Bias terms detected ("), quoted(skipped), F.lit(") "), F.lit(REASON_SKIPPED))
    return F.when(source == "preserved", REASON_PRESERVED).when(source == "ml", REASON_MODEL).when(F.size(terms) > 0, corrected).when(F.size(skipped) > 0, passed).otherwise(REASON_NONE)
