"""Language identification by word-first backoff.

A word that the model knows counts with its log frequency in every language. An unseen word falls
back to its character n-grams (with word ends marked), from the longest down: the first length of
which any n-gram is known decides, by the mean over those n-grams, at a discount per step.

The model is fitted on a bounded sample of labelled rows (``per_language`` documents of each
language, chosen by a hash) and keeps every word and n-gram of that sample. It is collected once and
sent to the workers. Prediction reads whole texts, however long.

Cases: null and empty texts and texts without a letter (Unicode category L) give ``und`` with score 0;
ties go to the language that sorts first; rows without a language are not learned from; without any
labelled row all texts give ``und``; repeated rows and words count as often as they occur; an empty table
gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiscope.llm.common import bernoulli

LETTERS = re.compile(r"[^\W\d_]+")
#: Word characters of Python's ``re`` that are numbers but neither digits nor letters, such as fractions.
NUMBERS = {c: " " for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()}
UNDETERMINED = "und"
#: Bounds of the sample: documents of each language, characters of all languages together, and of one document.
PER_LANGUAGE, CHARACTERS, LONGEST = 500, 3_000_000, 50_000
GRAM_LENGTHS = (5, 4, 3, 2, 1)
SMOOTHING, DISCOUNT = 0.5, 0.7
#: Words of evidence that the score is taken to rest on at most.
EVIDENCE = 40
#: Unseen words that a worker remembers; then it starts afresh.
CACHE_WORDS = 400_000


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    text = text.lower()
    if not text.isascii() and not NUMBERS.keys().isdisjoint(text):
        text = text.translate(str.maketrans(NUMBERS))
    return LETTERS.findall(text)


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, seed: int = 7) -> dict:
    """The model: languages, and per kind (word, n-gram) entries with their log frequencies by language."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")).where("text is not null and lang is not null")
    rows = rows.where(F.length("text") <= LONGEST)
    found = {r["lang"]: (r["n"], r["c"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c")).collect()}
    if not found:
        return {"langs": [], "tables": []}
    langs = sorted(found)
    rates = {k: min(1.0, per_language / n, CHARACTERS / len(langs) / max(1, c)) for k, (n, c) in found.items()}
    rate = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, rates[k])]), F.col("lang"))
    sample = rows.where(bernoulli(F.col("key"), rate, seed))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[tuple[str, str], int] = Counter()
            for t, of in zip(b["text"], b["lang"], strict=True):
                for w, n in Counter(words_of(t)).items():
                    counts[of, w] += n
            yield pd.DataFrame([(of, w, n) for (of, w), n in counts.items()], columns=["lang", "entry", "n"])

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[tuple[str, int, str], int] = Counter()
            for of, w, n in zip(b["lang"], b["entry"], b["n"], strict=True):
                for size in GRAM_LENGTHS:
                    for g in grams_of(w, size):
                        counts[of, size, g] += n
            yield pd.DataFrame([(of, size, g, n) for (of, size, g), n in counts.items()], columns=["lang", "size", "entry", "n"])

    by_word = sample.mapInPandas(words, "lang string, entry string, n long").groupBy("lang", "entry").agg(F.sum("n").alias("n"))
    by_gram = by_word.mapInPandas(grams, "lang string, size int, entry string, n long").groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))
    every = by_word.select("lang", F.lit(0).alias("size"), "entry", "n").unionByName(by_gram)
    kept = every.withColumn("total", F.sum("n").over(W.partitionBy("lang", "size")))

    at = {k: i for i, k in enumerate(langs)}
    tables: list[tuple[dict[str, int], np.ndarray]] = []
    got = kept.select("lang", "size", "entry", "n", "total").toPandas()
    for size in (0, *GRAM_LENGTHS):
        own = got[got["size"] == size]
        entries = {e: i for i, e in enumerate(sorted(set(own["entry"])))}
        counts = np.zeros((len(entries), len(langs)), dtype=np.float32)
        totals = np.zeros(len(langs))
        cols = own["lang"].map(at).to_numpy(dtype=int)
        counts[own["entry"].map(entries).to_numpy(dtype=int), cols] = own["n"].to_numpy()
        totals[cols] = own["total"].to_numpy()
        logs = np.log(counts + np.float32(SMOOTHING)) - np.log(totals + SMOOTHING * (len(entries) + 1)).astype(np.float32)
        tables.append((entries, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32) if len(entries) else logs.astype(np.float32)))
    return {"langs": langs, "tables": tables}


class Scorer:
    """Scores texts in one worker and remembers the words met so far."""

    def __init__(self, model: dict) -> None:
        self.langs, self.tables = model["langs"], model["tables"]
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.vectors = np.zeros((1024, max(1, len(self.langs))), dtype=np.float32)

    def word(self, w: str) -> np.ndarray:
        known, logs = self.tables[0]
        if w in known:
            return logs[known[w]]
        for step, (known, logs) in enumerate(self.tables[1:]):
            rows = [known[g] for g in grams_of(w, GRAM_LENGTHS[step]) if g in known]
            if rows:
                return logs[rows].mean(axis=0) * DISCOUNT ** (step + 1)
        return np.zeros(len(self.langs), dtype=np.float32)

    def add(self, w: str) -> int:
        i = self.row[w] = len(self.row)
        if i >= len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[i] = self.word(w)
        return i

    def score(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        if len(self.row) > CACHE_WORDS:
            self.reset()
        get = self.row.get
        rows = [i if (i := get(w)) is not None else self.add(w) for w in words]
        total = self.vectors[rows].sum(axis=0, dtype=np.float64)
        z = total / len(words) * min(len(words), EVIDENCE)
        best = int(np.argmax(z))
        return self.langs[best], float(1 / np.exp(z - z[best]).sum())


def identify(text: Column, model: dict, spark) -> Column:
    """struct(lang, score) for every text."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def own(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pd.DataFrame([scorer.score(t if isinstance(t, str) else None) for t in texts], columns=["lang", "score"])

    return own(text)
