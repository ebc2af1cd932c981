"""Rewriting and its scores (C-01 to C-16, A-37 to A-40, D-26)."""

from __future__ import annotations

from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexiscope.functions.text import harmonic, like_case, literal, ratio, tokens
from lexiscope.operators.lexicon import matches
from lexiscope.operators.metrics import confusion

#: Parts of the composite score and its least value for a rewrite to stand (fixed values).
WEIGHTS = {"bleu": 0.3, "rouge_l": 0.3, "overlap": 0.2, "edit": 0.2}
LEAST_COMPOSITE = 0.70
SOURCE_CONFIDENCE = {"rules": 0.9, "preserved": 1.0, "disambiguated": 0.8, "ml": 0.6, "none": 0.7}


def replaced(text: Column, term: Column, to: Column, warn: Column | bool = False) -> Column:
    """C-01, C-02: every whole-word hit replaced in its own case; a warn rule appends [consider ...] instead.

    One pass: the text between hits and the hits are taken apart and zipped, so that a replacement
    that contains its own term isn't met again.
    """
    pattern = F.concat(F.lit(r"(?iuU)\b"), literal(term), F.lit(r"\b"))
    warned = F.lit(warn) if isinstance(warn, bool) else warn
    whole = lambda gaps, new: F.array_join(F.zip_with(gaps, new, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")

    def put(hits: Column) -> Column:
        marks = F.transform(F.array(like_case(F.get(hits, F.lit(0)), to)), lambda first: whole(F.split(text, pattern, -1), F.transform(hits, lambda h: F.concat(h, F.lit(" [consider "), first, F.lit("]")))))
        plain = whole(F.split(text, pattern, -1), F.transform(hits, lambda h: like_case(h, to)))
        return F.when(F.size(hits) == 0, text).when(warned, F.get(marks, F.lit(0))).otherwise(plain)

    return F.get(F.transform(F.array(F.regexp_extract_all(text, pattern, F.lit(0))), put), F.lit(0))


def rewritten(docs: DataFrame, lexicon: DataFrame, only_replace: bool = False) -> DataFrame:
    """C-03, C-05: each document's matched rules applied in lexicon order, each to the text so far.

    Only rules whose term a document holds (an equi join) reach it, so the fold over them is short.
    """
    rules = lexicon.where("severity <> 'warn'") if only_replace else lexicon
    found = matches(docs, rules).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule_no", "biased", "neutral_primary", "severity"))).alias("rules"))
    out = docs.select("doc_id", "text").join(found, "doc_id", "left")
    fold = F.aggregate("rules", F.col("text"), lambda t, r: replaced(t, r["biased"], r["neutral_primary"], r["severity"] == "warn"))
    return out.select("doc_id", "text", F.coalesce(fold, F.col("text")).alias("rewrite"), F.coalesce(F.size("rules"), F.lit(0)).alias("n_edits"))


@F.pandas_udf(DoubleType())
def bleu_like(a: pd.Series, b: pd.Series) -> pd.Series:
    """C-12: mean share of b's words and word pairs that occur in a (membership, not counts)."""

    def share(x: list, y: list) -> float:
        known = set(x)
        return sum(g in known for g in y) / len(y)

    def one(x: list, y: list) -> float:
        if not x or not y:
            return 0.0
        alone = share(x, y)
        return alone if len(y) < 2 else (alone + share(list(pairwise(x)), list(pairwise(y)))) / 2

    return pd.Series([one(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_overlap(a: Column, b: Column) -> Column:
    """C-14: distinct common words over distinct words of either; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))))


def apart_ends(a: list, b: list) -> tuple[int, list, list]:
    """How many words two lists share at their beginning and end, and what is left of each: that alone needs comparing."""
    most = min(len(a), len(b))
    head = next((i for i in range(most) if a[i] != b[i]), most)
    tail = next((i for i in range(most - head) if a[-1 - i] != b[-1 - i]), most - head)
    return head + tail, a[head : len(a) - tail], b[head : len(b) - tail]


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence of two word lists, a bit per word of ``a``."""
    same, a, b = apart_ends(a, b)
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return same + (len(a) - row.bit_count() if a else 0)


@F.pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """C-13: F1 of the longest common subsequence of words."""

    def one(x: list, y: list) -> float:
        if not len(x) or not len(y):
            return 0.0
        n = lcs_length(list(x), list(y))
        return 2 * n / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def edit_distance(x: list, y: list) -> int:
    """Levenshtein distance of word lists, a bit per word of ``x``: vertical differences as two bit sets."""
    _, x, y = apart_ends(x, y)
    if not x:
        return len(y)
    places: dict[str, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | (1 << i)
    full, last, score = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
    up, down = full, 0
    for w in y:
        same = places.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = (down | ~(diagonal | up)) & full, up & diagonal
        score += bool(rise & last) - bool(fall & last)
        rise = (rise << 1) | 1
        up = ((fall << 1) | ~(same | down | rise)) & full
        down = rise & (same | down)
    return score


@F.pandas_udf(DoubleType())
def edit_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """C-15: 1 - word edit distance / longer length; 1 for two empty lists."""
    return pd.Series([1 - edit_distance(list(x), list(y)) / max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)], dtype="float64")


def preservation(rows: DataFrame, before: str = "text", after: str = "rewrite") -> DataFrame:
    """C-12 to C-16 for every row; rows whose text hasn't changed score 1 without being compared."""
    same = F.coalesce(F.col(before) == F.col(after), F.lit(True))
    words = lambda c: F.when(same, F.array().cast("array<string>")).otherwise(tokens(F.col(c)))
    both = rows.withColumn("_a", words(before)).withColumn("_b", words(after))
    parts = {"bleu": bleu_like(F.col("_a"), F.col("_b")), "rouge_l": rouge_l("_a", "_b"), "overlap": token_overlap(F.col("_a"), F.col("_b")), "edit": edit_similarity("_a", "_b")}
    both = both.withColumns({k: F.when(same, 1.0).otherwise(v) for k, v in parts.items()}).drop("_a", "_b")
    return both.withColumn("composite", sum((w * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0)))


def gated_rewrite(rows: DataFrame) -> DataFrame:
    """C-07: a rewrite whose composite score is too low is dropped for the original."""
    low = F.col("composite") < LEAST_COMPOSITE
    source = F.when(low, "preserved").when(F.col("n_edits") > 0, "rules").otherwise("none")
    return rows.withColumn("source", source).withColumn("rewrite", F.when(low, F.col("text")).otherwise(F.col("rewrite"))).withColumn("semantic_score", F.when(low, 1.0).otherwise(F.round("composite", 6)))


def with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """C-08: for warn-only rows, true promotes the edits, false drops them, null leaves them."""
    out = rows.join(verdicts.select("doc_id", F.col("verdict").alias("_v")), "doc_id", "left")
    warn_only = (F.col("n_replace") == 0) & (F.col("n_warn") > 0)
    up, down = warn_only & F.col("_v"), warn_only & ~F.col("_v")
    return out.select("doc_id", F.when(up, F.col("n_warn")).otherwise(F.col("n_replace")).alias("n_replace"), F.when(up | down, 0).otherwise(F.col("n_warn")).alias("n_warn"), F.when(up, "disambiguated").when(F.col("n_replace") > 0, "rules").otherwise("none").alias("source"))


def with_candidates(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """C-09: where no rule matched, the candidate rewrite stands in, marked for review."""
    out = rows.join(candidates.select("doc_id", F.col("best").alias("_best")), "doc_id", "left")
    use = (F.col("n_edits") == 0) & F.col("_best").isNotNull() & (F.col("_best") != F.col("text"))
    return out.withColumn("rewrite", F.when(use, F.col("_best")).otherwise(F.col("rewrite"))).withColumn("from_model", F.coalesce(use, F.lit(False))).drop("_best")


def rewrite_record(rows: DataFrame) -> DataFrame:
    """C-06, C-10: source, confidence, review flag and reason of every rewrite."""
    confidence = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_CONFIDENCE.items() for x in kv]), F.col("source"))
    reason = F.when(F.col("source") == "preserved", "Kept as it was: a rewrite would lose meaning.").when(F.col("source") == "ml", "A model's rewrite: to be reviewed.").when(F.col("n_edits") > 0, F.concat(F.col("n_edits").cast("string"), F.lit(" biased term(s) corrected"))).otherwise("No bias detected")
    return rows.withColumn("confidence", confidence).withColumn("needs_review", F.col("source").isin("preserved", "ml")).withColumn("has_bias_detected", F.col("n_edits") > 0).withColumn("reason", reason)


def effectiveness(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A-38, A-39: before and after detection, removal rate, harmonic score, mean scores of changed rows."""
    changed = F.col("text") != F.col("rewrite")
    removed = F.col("before") & ~F.col("after")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(changed, F.col(c))), F.lit(0.0)), 6).alias(f"mean_{c}")
    agg = rows.groupBy(*(by or [])).agg(*confusion("has_bias", "before"), F.count_if(removed & F.col("has_bias")).alias("removed"), F.count_if(removed).alias("all_removed"), F.count_if(F.col("before")).alias("detected"), F.count_if(changed & ~F.col("has_bias")).alias("over_corrections"), F.count_if(changed & (F.col("composite") >= 0.85)).alias("high_quality"), *[mean(c) for c in (*WEIGHTS, "composite")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1, rate = harmonic(p, r), ratio(F.col("removed"), F.col("tp"))
    h = harmonic(f1, rate)
    word = F.when(h >= 0.85, "excellent").when(h >= 0.7, "good").when(h >= 0.5, "fair").otherwise("poor")
    return agg.select("*", F.round(f1, 6).alias("f1"), F.round(rate, 6).alias("removal_rate"), F.round(ratio(F.col("all_removed"), F.col("detected")), 6).alias("removal_of_detected"), F.round(h, 6).alias("harmonic_score"), word.alias("assessment"))
