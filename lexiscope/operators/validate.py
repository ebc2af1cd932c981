"""Row and file validation as tables of issues (V-01 to V-10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED_HEADER = ("language", "biased", "neutral_primary", "severity")
RECOMMENDED_HEADER = ("tags", "pos", "bias_label", "stereotype_category", "example_biased", "example_neutral")


def header_issues(columns: Sequence[str], required: Sequence[str] = REQUIRED_HEADER, recommended: Sequence[str] = RECOMMENDED_HEADER) -> list[tuple[str, str]]:
    """V-01: (level, column) of absent columns."""
    return [("error", c) for c in required if c not in columns] + [("warning", c) for c in recommended if c not in columns]


def header_reports(headers: DataFrame, required: Sequence[str] = REQUIRED_HEADER, recommended: Sequence[str] = RECOMMENDED_HEADER) -> DataFrame:
    """V-01 over many files (``header``: array of names): a row for every absent column of every file, with what else is known of the file."""
    def absent(level: str, own: Sequence[str]) -> Column:
        return F.transform(F.array_except(F.array(*[F.lit(c) for c in own]), "header"), lambda c: F.struct(F.lit(level).alias("level"), c.alias("column")))

    return headers.select(*[c for c in headers.columns if c != "header"], F.inline(F.concat(absent("error", required), absent("warning", recommended))))


def absent_columns(rows: DataFrame, key: str, required: Sequence[str], value: str = "value") -> DataFrame:
    """U-05: required minus present columns of rows of JSON, for every row that lacks some."""
    present = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    absent = F.array_except(F.array(*[F.lit(c) for c in required]), present)
    return rows.select(F.get_json_object(value, f"$.{key}").alias(key), absent.alias("absent")).where(F.size("absent") > 0)


def issue(kind: str, level: str | Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("issue"), (F.lit(level) if isinstance(level, str) else level).alias("level")))


def issues(rows: DataFrame, key: str, checks: Sequence[Column]) -> DataFrame:
    """One row per failed check of every row."""
    return rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("i")).select(key, "i.issue", "i.level")


def lexicon_checks() -> list[Column]:
    """V-02: a lexicon row's checks; what warn rules do on purpose is a warning only."""
    c = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    b, n, eb, en, tags = (c(x) for x in ("biased", "neutral_primary", "example_biased", "example_neutral", "tags"))
    soft = F.when(F.lower(c("severity")) == "warn", "warning").otherwise("error")
    has = b != ""
    alike = (eb != en) & (F.replace(F.lower(eb), F.lower(b), F.lit("")) == F.replace(F.lower(en), F.lower(n), F.lit("")))
    return [
        issue("IDENTICAL_TERMS", soft, has & (b == n)),
        issue("MISSING_NEUTRAL", "warning", has & (n == "") & ~tags.rlike("morphology|suffix")),
        issue("IDENTICAL_EXAMPLES", soft, has & (eb != "") & (eb == en)),
        issue("SIMILAR_EXAMPLES", "warning", has & (eb != "") & (en != "") & alike),
        issue("MISSING_EXAMPLE_BIASED", "warning", has & (eb == "") & (en != "")),
        issue("MISSING_EXAMPLE_NEUTRAL", "warning", has & (eb != "") & (en == "")),
        issue("MISSING_BIAS_LABEL", "info", has & (c("bias_label") == "")),
        issue("MISSING_STEREOTYPE_CATEGORY", "info", has & (c("stereotype_category") == "")),
    ]


def report(rows: DataFrame, found: DataFrame, key: str, by: str) -> DataFrame:
    """V-03: rows, rows without errors and issues by level of every file; valid iff it has no errors."""
    per_row = found.groupBy(key).agg(*[F.count_if(F.col("level") == x).alias(x) for x in ("error", "warning", "info")])
    joined = rows.select(key, by).join(per_row, key, "left").na.fill(0, ["error", "warning", "info"])
    out = joined.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") == 0).alias("n_valid"), *[F.sum(x).alias(f"{x}s") for x in ("error", "warning", "info")])
    return out.withColumn("valid", F.col("errors") == 0)


def sample_checks(confidences: Sequence[str], groups: Sequence[str]) -> list[Column]:
    """V-04, V-06: rules of an annotation sample."""
    bias, cat, corr = F.col("has_bias"), F.col("bias_category").isNotNull(), F.col("expected_correction").isNotNull()
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    outside = lambda c: F.coalesce(~F.col(c).between(0, 1), F.lit(False))
    return [
        issue("CATEGORY_MISSING", "error", bias & ~cat),
        issue("CORRECTION_MISSING", "error", bias & ~corr),
        issue("CATEGORY_UNEXPECTED", "error", ~bias & cat),
        issue("CORRECTION_UNEXPECTED", "error", ~bias & corr),
        issue("TEXT_EMPTY", "error", blank("text")),
        issue("ANNOTATOR_EMPTY", "error", blank("annotator_id")),
        issue("CONFIDENCE_INVALID", "error", ~F.coalesce(F.col("confidence").isin(*confidences), F.lit(False))),
        issue("GROUP_INVALID", "error", ~F.coalesce(F.col("demographic_group").isin(*groups), F.lit(False))),
        issue("FAIRNESS_OUT_OF_RANGE", "error", outside("fairness_score")),
    ]


def batch_report(rows: DataFrame, found: DataFrame, key: str, batch: str) -> DataFrame:
    """V-05: per batch the rows, valid rows, annotators and languages, and whether it has one of each."""
    bad = found.select(key).distinct().withColumn("bad", F.lit(True))
    joined = rows.join(bad, key, "left")
    out = joined.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bad").isNull()).alias("n_valid"), F.count_distinct("annotator_id").alias("annotators"), F.count_distinct("lang").alias("languages"))
    return out.withColumn("single_annotator", F.col("annotators") == 1).withColumn("single_language", F.col("languages") == 1)


def with_defaults(rows: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """V-07: absent columns added with their defaults, null cells filled."""
    return rows.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in rows.columns], *[F.lit(v).alias(c) for c, v in defaults.items() if c not in rows.columns])


def review_checks(required: Sequence[str], allowed: Mapping[str, Sequence[str]]) -> list[Column]:
    """V-08: required fields, allowed values, and what biased and religious rows need beside."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    out = [issue(f"MISSING_{c.upper()}", "error", blank(c)) for c in required]
    out += [issue(f"INVALID_{c.upper()}", "error", ~blank(c) & ~F.col(c).isin(*v)) for c, v in allowed.items()]
    biased = F.coalesce(F.col("bias_label"), F.lit("")) != "neutral"
    out += [issue("EXPLICITNESS_REQUIRED", "error", biased & blank("explicitness")), issue("CATEGORY_RECOMMENDED", "warning", biased & blank("stereotype_category"))]
    holy = F.coalesce(F.col("domain").isin("religious_text", "culture_and_religion"), F.lit(False))
    return [*out, issue("DEVICE_NOT_SCRIPTURE", "error", holy & ~F.coalesce(F.col("device") == "scripture_quote", F.lit(False))), issue("FLAG_NOT_SENSITIVE", "error", holy & ~F.coalesce(F.col("safety_flag") == "sensitive", F.lit(False)))]


def file_report(rows: DataFrame, found: DataFrame, key: str, by: str, least: int = 1200) -> DataFrame:
    """V-10: per file rows, rows without issues, compliance in hundredths, and whether it is large enough. All rows are read."""
    out = report(rows, found, key, by)
    return out.select(by, "n", "n_valid", F.round(100 * F.col("n_valid") / F.col("n"), 4).alias("compliance"), (F.col("n") >= least).alias("enough"))
