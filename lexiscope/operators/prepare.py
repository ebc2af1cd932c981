"""Further dataset work: annotation heuristics, augmentation, samples, mined lexicons, importers (M-02, M-03, M-05, M-11, M-12, M-16, M-17, M-19, A-35, A-43, A-51, V-07, V-09, F-16, F-17)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiscope.functions.text import mapped, tokens
from lexiscope.operators.datasets import capped_by_key, numbered, seeded, text_key, unseen
from lexiscope.operators.mining import mined_ngrams, mined_sentences


def heuristic_annotation(rows: DataFrame, male: Sequence[str], female: Sequence[str], text: str = "text") -> DataFrame:
    """M-02: target gender, label, explicitness and safety of rows from term lists (substrings, as older files did)."""
    has = lambda own: F.exists(F.array(*[F.lit(t) for t in own]), lambda t: F.contains(F.lower(text), t))
    m, f = has(male), has(female)
    gender = F.when(m & f, "mixed").when(m, "male").when(f, "female").otherwise("neutral")
    label = F.when(F.col("has_bias"), "stereotype").otherwise("neutral")
    return rows.withColumn("target_gender", gender).withColumn("bias_label", label).withColumn("explicitness", F.when(F.col("has_bias") & (m | f), "explicit").when(F.col("has_bias"), "implicit")).withColumn("safety_flag", F.lit("safe"))


def merged_sentences(existing: DataFrame, docs: DataFrame, terms: Sequence[str], start: Column | int) -> DataFrame:
    """M-03, M-05: mined sentences that ``existing`` lacks, the first of each text, numbered on."""
    found = mined_sentences(docs, terms).select(F.col("sentence").alias("text"), "doc_id", "pos")
    fresh = unseen(found, existing)
    rank = F.row_number().over(W.partitionBy(text_key("text")).orderBy("doc_id", "pos"))
    first = fresh.withColumn("_r", rank).where(F.col("_r") == 1).drop("_r")
    return numbered(first, ["doc_id", "pos"], start)


def augmented(rows: DataFrame, synonyms: Mapping[str, str], key: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    """M-11: half of the rows get their first known word swapped, three in ten of the longer ones lose one inner word; by hash."""
    draw = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), F.col(key)), F.lit(100))
    known = F.array(*[F.lit(k) for k in synonyms])
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    def swapped(w: Column) -> Column:
        at = F.array_position(F.transform(w, lambda x: F.array_contains(known, x)), True)
        new = let(at, lambda k: F.transform(w, lambda x, i: F.when(i + 1 == k, mapped(x, synonyms)).otherwise(x)))
        return F.when((draw(1) < 50) & (at > 0), new).otherwise(w)

    def dropped(w: Column) -> Column:
        gone = F.pmod(F.xxhash64(F.lit(seed), F.lit(3), F.col(key)), F.greatest(F.size(w) - 2, F.lit(1))) + 1
        return F.when((draw(2) < 30) & (F.size(w) > 5), let(gone, lambda k: F.filter(w, lambda x, i: i != k))).otherwise(w)

    return rows.withColumn("augmented", F.array_join(let(let(F.split(text, " "), swapped), dropped), " "))


def annotation_sample(docs: DataFrame, terms: Sequence[str], target: int, per_term: int = 200, seed: int = 42) -> DataFrame:
    """M-12: up to a quota of documents per term, each once, filled up by hash order; sampling is the feature."""
    hits = docs.select("doc_id", F.explode(F.array_intersect(F.array(*[F.lit(t) for t in terms]), tokens(F.col("text")))).alias("term"))
    quota = min(per_term, max(1, target // max(1, len(terms))))
    first = capped_by_key(hits, "term", quota, [seeded("doc_id", seed)]).groupBy("doc_id").agg(F.min("term").alias("term"))
    rest = docs.select("doc_id").join(first, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("string").alias("term"))
    return first.unionByName(rest).orderBy(F.col("term").isNull(), seeded("doc_id", seed)).limit(target)


def mined_lexicon(docs: DataFrame, seeds: Sequence[str], neutral: Mapping[str, str], lengths: Sequence[int] = (2, 3), least: int = 2) -> DataFrame:
    """M-16, F-17: n-grams with a seed, their words neutralised by a map; those that don't change are left out."""
    grams = mined_ngrams(docs, seeds, lengths, least)
    new = F.array_join(F.transform(F.split("phrase", " "), lambda w: mapped(w, neutral)), " ")
    return grams.select(F.col("phrase").alias("biased"), new.alias("neutral_primary"), "n").where("biased <> neutral_primary").dropDuplicates(["biased", "neutral_primary"])


def new_rules(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """M-17: candidates whose term, ignoring case, the lexicon lacks; one per term."""
    known = existing.select(text_key("biased").alias("_k")).distinct()
    fresh = candidates.join(known, text_key(candidates["biased"]) == F.col("_k"), "left_anti")
    return fresh.groupBy(text_key("biased").alias("_key")).agg(F.min("biased").alias("biased")).drop("_key")


def bias_patterns(docs: DataFrame, roles: Sequence[str], gendered: Sequence[str], key: str = "doc_id") -> DataFrame:
    """M-19: documents with a role and a gendered word, and which."""
    found = lambda own: F.array_intersect(F.array(*[F.lit(t) for t in own]), tokens(F.col("text")))
    out = docs.select(key, found(roles).alias("roles"), found(gendered).alias("gendered"))
    return out.where((F.size("roles") > 0) & (F.size("gendered") > 0))


def person_terms(tagged: DataFrame) -> DataFrame:
    """A-43: lower-cased tokens outside entities, counted in sentences (sentence, pos, token, tag) with a person.

    Where the reader says so in ``person``, no token is shuffled to find out.
    """
    if "person" in tagged.columns:
        own = tagged.where("person")
    else:
        people = tagged.where(F.col("tag").endswith("PER")).select("sentence").distinct()
        own = tagged.join(people, "sentence", "left_semi")
    return own.where("tag = 'O'").groupBy(F.lower("token").alias("term")).agg(F.count(F.lit(1)).alias("n"))


def rewrite_ratios(rows: DataFrame, before: str = "text", after: str = "rewrite") -> DataFrame:
    """A-51: length ratio and whether it is within 0.8 to 1.2, over all rows."""
    r = F.length(after) / F.greatest(F.length(before), F.lit(1))
    return rows.agg(F.round(F.avg(r), 6).alias("mean_ratio"), F.round(F.avg(r.between(0.8, 1.2).cast("int")), 6).alias("within"))


def suggestions(rows: DataFrame) -> DataFrame:
    """V-09: a category for biased rows that lack one, a device for religious rows."""
    text = F.lower("text")
    category = F.when(F.contains(text, F.lit("mũthĩnjĩri")), "religion_culture").when(text.rlike("daktari|mũrutani|mũrĩmi"), "profession").when(text.rlike("rera|ciana"), "family_role").when(F.contains(text, F.lit("mũtongoria")), "leadership")
    lacking = (F.coalesce(F.col("stereotype_category"), F.lit("")) == "") & (F.col("bias_label") != "neutral")
    return rows.withColumn("suggested_category", F.when(lacking, category)).withColumn("suggested_device", F.when((F.col("domain") == "religious_text") & (F.coalesce(F.col("device"), F.lit("")) == ""), "scripture_quote"))


def severity_of(phrase: Column) -> Column:
    """F-16: warn for phrases that assert or forbid, else replace (fixed markers)."""
    padded = F.concat(F.lit(" "), phrase, F.lit(" "))
    return F.when(padded.rlike(" nĩ wa | no mũhaka | ti | ndangĩ "), "warn").otherwise("replace")
