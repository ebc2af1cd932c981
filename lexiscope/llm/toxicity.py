"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (I), threat verb (T), target (Y), negation (N), reported speech (R),
quote (Q), comma and other. Three weighted transducers over the symbols of a clause are composed into one:
negation (an insult or threat shortly after a negation turns into ``n``), reported speech and
quotation (``r``), and targets (insults turn into ``y``, threats into ``t``). A second one reads the clause
backwards for targets that follow. An arc's weight falls with the distance between the two words. What comes out
is a list of matched patterns by kind; each weighs its word's learned weight times the arcs' weights.
A document's score is the logistic of a weighted sum over kinds, so that clauses, not isolated words,
are scored; what one kind adds levels off towards MOST. Clauses end at . ! ? ; : and line ends.

Insults are learned from labels: words, and word beginnings (stems that take many endings). An entry's
weight is the log ratio of its document frequencies in both classes; it is kept if a lower confidence
bound of that ratio is high enough. Documents that are near copies count once, by the smallest
hash of their runs of three words. Both the stems and the weights of the kinds are fitted on a bounded sample
(``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows, chosen by hash); scoring reads all whole texts.

Cases: null and empty texts match nothing and get the score of a text without patterns; very long texts
are read whole; several labels of one id count by their mean (one half is toxic); null labels don't count;
without labels all scores are the prior's; ties between stems go to all of them; repeated rows get equal
scores; an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import BROADCAST_BYTES, bernoulli

#: Bounds of the labelled sample, on average (ids are drawn by hash).
MAX_TOXIC, MAX_CLEAN = 2000, 6000
#: Least lower bound of the log ratio, its width in standard errors, and lengths of word beginnings.
LEAST_RATIO, ERRORS, STEM_LENGTHS = math.log(6), 1.64, range(4, 10)
CACHE_WORDS = 100_000

CLAUSE = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»,]")
#: Closed word classes (fixed values), in English, German, French and Spanish.
TARGETS = "you your yours yourself u he him she her they them their these those people everyone du dich dir dein deine ihr euch sie ihn ihm diese leute tu toi te ton ta vous votre il elle ils elles leur ces gens tú ti tus usted ustedes él ella ellos ellas esos esas gente"
NEGATIONS = "not no never don't doesn't didn't isn't aren't wasn't weren't won't can't cannot without nicht kein keine keinen nie niemals ohne pas jamais sans nunca jamás sin"
REPORTS = "said says say called calls wrote writes quoted quote reported claimed alleged sagte sagt nannte schrieb behauptet zitiert dit disait appelle écrit cite dijo dice llamó escribió citó"
THREATS = "kill hurt destroy murder shoot stab beat hang burn töten umbringen schlagen tuer tuerai tuer frapper matar golpear"
QUOTES = "\"“”„«»"
CLASSES = {w: s for words, s in ((TARGETS, "Y"), (NEGATIONS, "N"), (REPORTS, "R"), (THREATS, "T")) for w in words.split()} | dict.fromkeys(QUOTES, "Q") | {",": ","}
#: Kinds of matched patterns, with the prior mean of each kind's coefficient (fixed values).
KINDS = {"I": 1.0, "y": 1.2, "n": 0.4, "r": 0.4, "t": 0.8}
PRIOR_BIAS, PRIOR_SD = -3.0, 1.5
#: Weight of a threat that has a target, in the unit of the learned insult weights.
THREAT_WEIGHT = 2.0
#: Level that one kind's sum in a document approaches, and weight of an arc that is one word longer.
MOST, FADE = 12.0, 0.95
SYMBOLS = "ITYNRQ,.nryt"


class Transducer:
    """Arcs (state, symbol) to (state, symbol out, weight); ``rest`` says where other symbols lead from a state."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]], rest: dict[int, int]) -> None:
        self.arcs, self.rest = arcs, rest

    def run(self, tape: Iterable[tuple[str, float]]) -> list[tuple[str, float]]:
        state, out = 0, []
        for symbol, weight in tape:
            if (state, symbol) in self.arcs:
                state, symbol, factor = self.arcs[state, symbol]
                weight *= factor
            else:
                state = self.rest[state]
            out.append((symbol, weight))
        return out


def composed(one: Transducer, two: Transducer) -> Transducer:
    """The transducer that does what ``two`` makes of ``one``'s output: states are pairs, weights multiply."""
    number, todo, arcs, rest = {(0, 0): 0}, [(0, 0)], {}, {}
    for a, b in todo:
        for s in SYMBOLS:
            a2, mid, w1 = one.arcs.get((a, s), (one.rest[a], s, 1.0))
            b2, out, w2 = two.arcs.get((b, mid), (two.rest[b], mid, 1.0))
            if (a2, b2) not in number:
                number[a2, b2] = len(number)
                todo.append((a2, b2))
            arcs[number[a, b], s] = (number[a2, b2], out, w1 * w2)
        rest[number[a, b]] = arcs[number[a, b], "."][0]
    return Transducer(arcs, rest)


def window(opens: str, turns: dict[str, tuple[str, float]], reach: int, stops: str = "") -> Transducer:
    """Symbols in ``turns`` change if they stand within ``reach`` symbols after one of ``opens``; farther ones weigh less."""
    arcs, rest = {}, {0: 0}
    for state in range(reach + 1):
        rest[state] = max(0, state - 1)
        arcs |= {(state, s): (reach, s, 1.0) for s in opens} | {(state, s): (0, s, 1.0) for s in stops}
        if state:
            arcs |= {(state, s): (state - 1, to, w * FADE ** (reach - state)) for s, (to, w) in turns.items()}
    return Transducer(arcs, rest)


def reported() -> Transducer:
    """After a verb of saying to the clause's end, and between quotes, insults and threats are reported."""
    turn = {"I": "r", "T": "r"}
    arcs = {(0, "Q"): (2, "Q", 1.0), (2, "Q"): (0, "Q", 1.0), (0, "R"): (1, "R", 1.0), (1, "Q"): (3, "Q", 1.0), (3, "Q"): (1, "Q", 1.0)}
    arcs |= {(state, s): (state, to, 1.0) for state in (1, 2, 3) for s, to in turn.items()}
    return Transducer(arcs, {0: 0, 1: 1, 2: 2, 3: 3})


NEGATION = window("N", {"I": ("n", 1.0), "T": (".", 0.0)}, 3, ",")
REPORTED = reported()
TARGETED = window("Y", {"I": ("y", 1.0), "T": ("t", 1.0)}, 4)
FORWARD = composed(composed(NEGATION, REPORTED), TARGETED)


def patterns(tape: list[tuple[str, float]]) -> Iterator[tuple[str, float]]:
    """(kind, weight) of the patterns in a clause: forwards, then backwards for targets that follow."""
    for symbol, weight in reversed(TARGETED.run(reversed(FORWARD.run(tape)))):
        if symbol in KINDS:
            yield symbol, weight


class Grammar:
    """Scores whole texts with learned stems and coefficients; remembers the words met so far."""

    def __init__(self, stems: dict[str, float], coefficients: dict[str, float]) -> None:
        self.stems, self.coefficients = stems, coefficients
        self.lengths = sorted({len(s) - 1 for s in stems if s.endswith("*")})
        self.symbols: dict[str, tuple[str, float]] = {}

    def symbol(self, word: str) -> tuple[str, float]:
        found = [self.stems[word]] if word in self.stems else []
        found += [self.stems[s] for n in self.lengths if n <= len(word) and (s := word[:n] + "*") in self.stems]
        kind = CLASSES.get(word, ".")
        own = ("I", max(found)) if found else (kind, THREAT_WEIGHT if kind == "T" else 0.0)
        if len(self.symbols) > CACHE_WORDS:
            self.symbols.clear()
        self.symbols[word] = own
        return own

    def features(self, text: str | None) -> list[float]:
        """Sums of pattern weights by kind, each levelling off towards MOST."""
        sums = dict.fromkeys(KINDS, 0.0)
        get = self.symbols.get
        for clause in CLAUSE.split(text.lower()) if text else ():
            tape = [get(w) or self.symbol(w) for w in TOKEN.findall(clause)]
            if any(s in "IT" for s, _ in tape):
                for kind, weight in patterns(tape):
                    sums[kind] += weight
        return [MOST * math.tanh(v / MOST) for v in sums.values()]

    def score(self, text: str | None) -> float:
        z = self.coefficients["bias"] + sum(self.coefficients[k] * v for k, v in zip(KINDS, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features_of_words(text: str) -> set[str]:
    """Words and word beginnings (marked by *) of a text."""
    words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if n < len(w)}


def copy_key(text: str) -> int:
    """The smallest hash of the text's runs of three words: near copies mostly share it, other texts hardly ever."""
    words = text.lower().split()
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """(text, y) of the bounded sample. ``labels`` is cut to it before it meets the texts."""
    by_id = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in by_id.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("y") == 1, min(1.0, MAX_TOXIC / max(1, counts.get(1, 0)))).otherwise(min(1.0, MAX_CLEAN / max(1, counts.get(0, 0))))
    picked = by_id.where(bernoulli(F.col("key"), rate, seed))
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").join(picked if counts and min(MAX_TOXIC, counts.get(1, 0)) + min(MAX_CLEAN, counts.get(0, 0)) > BROADCAST_BYTES // 64 else F.broadcast(picked), "key").select("text", "y")


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Entries with their log ratios."""

    def toxic_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, e) for t in b["text"] for k in [copy_key(t)] for e in features_of_words(t)]
            yield pd.DataFrame(rows, columns=["copies", "entry"])

    toxic, clean = sample.where("y = 1").select("text"), sample.where("y = 0").select("text")
    kind = "copies long, entry string"

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"copies": [copy_key(t) for t in b["text"]]})

    n_pos, n_neg = (part.mapInPandas(copies, "copies long").distinct().count() for part in (toxic, clean))
    # entries of fewer toxic documents can't be chosen even if no clean document has them
    least = next((p for p in range(2, n_pos + 1) if surely(p, 0, n_pos, n_neg) >= LEAST_RATIO), n_pos + 1)
    counted = toxic.mapInPandas(toxic_entries, kind).groupBy("entry").agg(F.countDistinct("copies").alias("n")).where(F.col("n") >= least)
    pos = {r["entry"]: r["n"] for r in counted.collect()}
    candidates = frozenset(pos)

    def clean_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, e) for t in b["text"] for k in [copy_key(t)] for e in features_of_words(t) & candidates]
            yield pd.DataFrame(rows, columns=["copies", "entry"])

    neg = {r["entry"]: r["n"] for r in clean.mapInPandas(clean_entries, kind).groupBy("entry").agg(F.countDistinct("copies").alias("n")).collect()}

    return chosen_stems(pos, neg, n_pos, n_neg)


def log_ratio(p: int, q: int, n_pos: int, n_neg: int) -> float:
    return math.log((p + 0.5) / (n_pos + 1)) - math.log((q + 0.5) / (n_neg + 1))


def surely(p: int, q: int, n_pos: int, n_neg: int) -> float:
    """Lower confidence bound of the log ratio."""
    return log_ratio(p, q, n_pos, n_neg) - ERRORS * math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))


def chosen_stems(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int) -> dict[str, float]:
    """Entries whose ratio is surely high; of a word and its beginnings, the longest that loses no documents."""
    good = {}
    for e, p in pos.items():
        q = neg.get(e, 0)
        if surely(p, q, n_pos, n_neg) >= LEAST_RATIO:
            good[e] = log_ratio(p, q, n_pos, n_neg)
    out: dict[str, float] = {}
    longer: dict[str, list[str]] = {}
    for e in good:
        body = e.rstrip("*")
        for n in STEM_LENGTHS:
            if n < len(body) or (n == len(body) and not e.endswith("*")):
                longer.setdefault(body[:n] + "*", []).append(e)
    for e, ratio in good.items():
        covered = any(pos[x] >= 0.95 * pos[e] for x in longer.get(e, ()))
        body = e.rstrip("*")
        general = any(good[s] >= ratio - 1 and pos[s] > pos[e] / 0.95 for n in STEM_LENGTHS if n < len(body) and (s := body[:n] + "*") in good)
        if not covered and not general:
            out[e] = ratio
    return dict(sorted(out.items(), key=lambda x: (-pos[x[0]], x[0])))


def fit_coefficients(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Logistic regression by Newton's method, with normal priors around the kinds' prior means."""
    x = np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, 1 + len(KINDS)))
    mean = np.array([PRIOR_BIAS, *KINDS.values()])
    precision = np.eye(len(mean)) / PRIOR_SD**2
    w = mean.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + precision @ (w - mean)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + precision, gradient)
        w[1:] = np.maximum(w[1:], 0.0)
    return dict(zip(["bias", *KINDS], w.tolist(), strict=True))


def fit(sample: DataFrame) -> dict:
    """The grammar's learned part, from rows (text, y). ``sample`` is bounded, and so is what is collected."""
    stems = learn_stems(sample)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(stems, {})
        for b in batches:
            rows = [grammar.features(t) for t in b["text"]]
            yield pd.DataFrame(rows, columns=list(KINDS)).assign(u=b["y"].to_numpy())

    got = sample.mapInPandas(measured, ", ".join(f"{k} double" for k in KINDS) + ", u long").toPandas()
    return {"stems": stems, "coefficients": fit_coefficients(got[list(KINDS)].to_numpy(dtype=float), got["u"].to_numpy(dtype=float))}


def toxicity(text: Column, model: dict, spark) -> Column:
    """Score of every text, 0 to 1."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def own(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(sent.value["stems"], sent.value["coefficients"])
        for texts in batches:
            yield pd.Series([grammar.score(t if isinstance(t, str) else None) for t in texts], dtype="float64")

    return own(text)
