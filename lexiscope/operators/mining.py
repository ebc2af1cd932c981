"""Term and sentence mining (A-41 to A-45, P-08, W-09, T-01 to T-03, T-09, M-16, M-18, M-19)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.text import ngrams, sentences, tokens


def term_frequency(docs: DataFrame, keep: Column | None = None, text: str = "text") -> DataFrame:
    """A-41: counts of terms; ``keep`` is a condition on the column ``term``."""
    words = docs.select(F.explode(tokens(F.col(text))).alias("term"))
    return (words if keep is None else words.where(keep)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def term_contexts(docs: DataFrame, terms: Sequence[str], context: Column, values: Sequence[str], text: str = "text") -> DataFrame:
    """A-42: documents by term and context, a column per context."""
    rows = docs.select(context.alias("_ctx"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).where(F.col("term").isin(*terms))
    return rows.groupBy("term").pivot("_ctx", list(values)).agg(F.count(F.lit(1))).na.fill(0)


def mined_ngrams(docs: DataFrame, seeds: Sequence[str], lengths: Sequence[int], least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A-44: n-grams with a seed word, their counts and the first document they occur in."""
    words = docs.select(key, tokens(F.col(text)).alias("w")).where(F.arrays_overlap("w", F.array(*[F.lit(s) for s in seeds])))
    grams = words.select(key, F.explode(F.concat(*[ngrams(F.col("w"), n) for n in lengths])).alias("phrase"))
    seeded = grams.where(F.arrays_overlap(F.split("phrase", " "), F.array(*[F.lit(s) for s in seeds])))
    return seeded.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_doc")).where(F.col("n") >= least)


def document_frequency(docs: DataFrame, examples: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A-45: documents with a token, and the smallest ids of those as examples.

    Example lists are cut per partition's group by ``examples`` smallest ids: they are the first
    in a bounded running minimum, so no token gathers all its documents.
    """
    words = docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("term").orderBy(key))
    first = words.withColumn("r", rank).where(F.col("r") <= examples).groupBy("term").agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return counts.join(first, "term")


def top_terms(counts: DataFrame, k: int, least: int = 2, lengths: tuple[int, int] = (4, 15)) -> DataFrame:
    """T-01, T-02: the k most frequent terms of bounded length."""
    return counts.where((F.col("n") >= least) & F.length("term").between(*lengths)).orderBy(F.desc("n"), "term").limit(k)


def frequency_tiers(counts: DataFrame, excluded: Sequence[str], known: Sequence[str]) -> DataFrame:
    """T-03, T-09: a confidence tier for every term, with its reason."""
    t, n = F.col("term"), F.col("n")
    tier = F.when(t.isin(*excluded), "excluded").when(t.isin(*known), "high").when(n >= 20, "high").when(n >= 5, "medium").otherwise("low")
    reason = F.when(t.isin(*excluded), "in the exclusion list").when(t.isin(*known), "known term").when(n >= 20, "frequent").when(n >= 5, "occurs several times").otherwise("rare")
    return counts.select("term", "n", tier.alias("tier"), reason.alias("reason"))


def mined_sentences(docs: DataFrame, terms: Sequence[str], least: int = 40, most: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """M-18: sentences of bounded length that hold a term, with the terms."""
    parts = docs.select(key, F.posexplode(sentences(F.col(text), least, most)).alias("pos", "sentence"))
    found = F.array_intersect(F.array(*[F.lit(t) for t in terms]), tokens(F.col("sentence")))
    return parts.withColumn("terms", found).where(F.size("terms") > 0)


def context_windows(docs: DataFrame, markers: Sequence[str], size: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """W-09: ``size`` words from every marker word on."""
    words = docs.select(key, tokens(F.col(text)).alias("w"))
    at = words.select(key, "w", F.posexplode("w").alias("pos", "word")).where(F.col("word").isin(*markers))
    return at.select(key, "pos", F.array_join(F.slice("w", F.col("pos") + 1, size), " ").alias("window"))
