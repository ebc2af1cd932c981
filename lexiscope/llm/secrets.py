"""Secret scans: base patterns, and a battery of randomness tests for their values and for everything else.

Base spans come from three patterns (``assign``, ``access``, ``hex``). The battery takes their values and every
other run of at least LEAST secret-like characters that isn't plain lower-case letters (which any
word is), cut at "=" that isn't padding, infers its encoding (the smallest alphabet that holds it) and asks
how much better *uniform* draws from that alphabet explain it than writing does. Three statistics are computed:
chi-squared distance of the letter counts from uniformity, runs above and below the middle of the alphabet,
and lag-one serial correlation. What writing gives is fitted on the corpus: one pass counts the neighbouring
letters of all texts, and their table gives each statistic's mean and spread at a run's length, for each
encoding. The three are combined into one score, each with the weight of what uniform draws move it by.
Runs that hold other signs are also cut at "/", then at "-", "_" and "+" (URL paths, prefixed keys), and
their parts are tested in the same way.

Hypotheses are grouped by encoding and length class. A second pass counts scores in narrow bins by group. As runs are not
all like running text (slugs, names, dates), a group of GROUP tests or more has its own middle and spread, by
median and quartile, where those are wider than what the fit says; smaller groups take those of their encoding.
All tests of a corpus then go through Benjamini-Hochberg together, with weights in proportion to their lengths
(mean 1): the false-discovery rate is held over the corpus while longer runs, where the tests have power, get
more of it. A third pass finds the spans. Of a run and its parts the outermost discovery counts.

Cases: a null text is empty and has no spans; offsets are code points, end exclusive; whole texts
are scanned, however long; a part that overlaps a base span isn't added again; spans that start together go
in the order of the kinds; repeated rows are tested each and get equal results; an empty table gives an
empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the base spans (fixed values), with what else each match must fulfil.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: Runs that the battery looks at: this long at least, with a digit or both cases or a sign. Shorter ones
#: can't reach a small p-value.
LEAST = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
MIXED = re.compile(r"[0-9+/_=-]|[a-z][A-Z]|[A-Z]{2}[a-z]")
#: What a run is cut into, round by round (fixed values); signs at its end are padding.
PARTS = (re.compile(r"[^=]+(?:=+\Z)?"), re.compile(r"[^/]+"), re.compile(r"[^_+-]+"))
#: Alphabets by encoding, in order of their values (fixed values).
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
#: Shares in a thousand of letters in writing from a to z (fixed values); capitals are taken for a twentieth of them, other signs for 5.
LETTERS = np.array([82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1], dtype=np.float64)
#: Score that bin 0 begins at, negated; a group whose median is beyond this share of uniform draws' score is mostly secrets.
ZERO, MOSTLY_SECRETS = 20.0, 0.8
_PLACE = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
FALSE_DISCOVERY = 0.05
#: Bins of scores: STEPS to a unit, from 0 on. Length classes end below these lengths. Tests that fit a group by themselves.
BINS, STEPS = 640, 16
LENGTHS = (20, 24, 28, 32, 40, 56, 80)
GROUP = 50
#: Middle and spread of groups too small to tell, as runs are somewhat less like writing than texts are.
UNKNOWN = 0.4, 1.0
#: Spread that a group has at least, and neighbouring letters of even writing that are counted in with the corpus's.
LEAST_SPREAD, EVEN = 1.0, 2000.0
Groups = dict[tuple[str, int], tuple[float, float]]


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding_of(run: str) -> str | None:
    """The first and smallest alphabet that holds all characters of ``run``; none for plain numbers."""
    used = frozenset(run)
    if run.isdigit():
        return None
    return next((k for k, own in _SETS.items() if used <= own), None)


def neighbours(texts: Iterable[str | None]) -> np.ndarray:
    """Counts of neighbouring ASCII characters, 128 by 128."""
    out = np.zeros(128 * 128, dtype=np.int64)
    for t in texts:
        codes = np.frombuffer((t or "").encode("utf-8", "replace"), dtype=np.uint8).astype(np.int32)
        a, b = codes[:-1], codes[1:]
        plain = (a < 128) & (b < 128)
        out += np.bincount(a[plain] * 128 + b[plain], minlength=128 * 128)
    return out.reshape(128, 128)


def writing(table: np.ndarray) -> dict[str, tuple[float, float, float]]:
    """For each encoding what writing does: chi-squared effect per character, chance of a change of half, serial correlation.

    ``table`` counts neighbouring characters of the corpus; letters of other cases count where an alphabet has one case.
    """
    out = {}
    for kind, alphabet in ALPHABETS.items():
        places = np.full(128, -1)
        for c, i in _PLACE[kind].items():
            places[ord(c)] = i
            if c.swapcase() not in _SETS[kind]:
                places[ord(c.swapcase())] = i
        size = len(alphabet)
        a, b = np.nonzero((places[:, None] >= 0) & (places[None, :] >= 0))
        pairs = np.zeros((size, size))
        np.add.at(pairs, (places[a], places[b]), table[a, b])
        both = any(c.islower() for c in alphabet) and any(c.isupper() for c in alphabet)
        letters = np.array([(LETTERS[ord(c.lower()) - 97] * (0.05 if both and c.isupper() else 1)) if c.isalpha() else 5.0 for c in alphabet])
        pairs += EVEN * np.outer(letters, letters) / letters.sum() ** 2
        pairs /= pairs.sum()
        p, v = pairs.sum(axis=0), np.arange(size)
        high = v >= size / 2
        mean, spread = (p * v).sum(), max((p * v * v).sum() - (p * v).sum() ** 2, 1e-9)
        serial = float(((pairs * np.outer(v - mean, v - mean)).sum()) / spread)
        out[kind] = float(size * (p * p).sum() - 1), float(pairs[high][:, ~high].sum() + pairs[~high][:, high].sum()), max(-0.9, min(0.9, serial))
    return out


def battery(run: str, model: Mapping[str, tuple[float, float, float]]) -> tuple[str, float] | None:
    """Encoding and score of a run: how far it is from writing on the way to uniform draws; None if no alphabet fits."""
    body = run.rstrip("=")
    kind = encoding_of(body)
    if kind is None or len(body) < LEAST:
        return None
    n, size = len(body), len(ALPHABETS[kind])
    v = np.fromiter((_PLACE[kind][c] for c in body), dtype=np.float64, count=n)
    counts = np.bincount(v.astype(int), minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    high = v >= size / 2
    changes = float((high[1:] != high[:-1]).mean())
    d = v - v.mean()
    r = float((d[1:] * d[:-1]).sum() / max((d * d).sum(), 1e-9))
    known = moments(kind, n, model)
    total = sum((uniform - mean) / spread * (x - mean) / spread for x, (mean, uniform, spread) in zip((chi, changes, r), known, strict=True))
    return kind, total / pull(known)


def moments(kind: str, n: int, model: Mapping[str, tuple[float, float, float]]) -> tuple[tuple[float, float, float], ...]:
    """(mean in writing, mean in uniform draws, spread in writing) of the three statistics at a run's length."""
    effect, change, serial = model[kind]
    size = len(ALPHABETS[kind])
    chi = size - 1 + n * effect, size - 1.0, math.sqrt(2 * (size - 1 + 2 * n * effect))
    return chi, (change, 0.5, 0.5 / math.sqrt(n - 1)), (serial, -1.0 / n, 1 / math.sqrt(n - 1))


def pull(known: tuple[tuple[float, float, float], ...]) -> float:
    """The score that uniform draws have on average."""
    return math.sqrt(sum(((uniform - mean) / spread) ** 2 for mean, uniform, spread in known)) + 1e-9


def length_class(n: int) -> int:
    return bisect.bisect_right(LENGTHS, n)


def bin_of(score: float) -> int:
    return min(BINS - 1, max(0, math.floor((score + ZERO) * STEPS)))


def middle_and_spread(counts: Mapping[int, int]) -> tuple[float, float]:
    """Median of binned scores, and the spread below it as of a normal distribution: secrets lie above."""
    total, seen, quarter, half = sum(counts.values()), 0, None, None
    for k in sorted(counts):
        seen += counts[k]
        at = (k + 0.5) / STEPS - ZERO
        quarter = at if quarter is None and seen * 4 >= total else quarter
        half = at if half is None and seen * 2 >= total else half
    return half, (half - quarter) / 0.6745


def fitted_groups(found: Mapping[tuple[str, int, int], tuple[int, int]], model: Mapping) -> Groups:
    """Middle and spread of each (encoding, length class), at least 0 and LEAST_SPREAD; UNKNOWN where there are too few tests."""
    by_group: dict[tuple[str, int], Counter] = {}
    size: Counter = Counter()
    for (kind, length, k), (n, c) in found.items():
        by_group.setdefault((kind, length), Counter())[k] += n
        size[kind, length] += c
    out = {}
    for kind, length in by_group:
        own = by_group[kind, length]
        uniform = pull(moments(kind, max(LEAST, size[kind, length] // sum(own.values())), model))
        if sum(own.values()) < GROUP:
            own = sum((c for (other, _), c in by_group.items() if other == kind), Counter())
        middle, spread = middle_and_spread(own) if sum(own.values()) >= GROUP else UNKNOWN
        # a group that is mostly secrets says nothing about writing
        out[kind, length] = (max(0.0, middle), max(LEAST_SPREAD, spread)) if middle < MOSTLY_SECRETS * uniform else UNKNOWN
    return out


def discoveries(found: Mapping[tuple[str, int, int], tuple[int, int]], model: Mapping, rate: float = FALSE_DISCOVERY) -> dict[tuple[str, int], int]:
    """Weighted Benjamini-Hochberg over (encoding, length class, bin) -> (number, characters): each group's first bin of discoveries."""
    groups = fitted_groups(found, model)
    n_all, characters = (sum(c[i] for c in found.values()) for i in (0, 1))
    rows = []
    for (kind, length, k), (n, c) in found.items():
        middle, spread = groups[kind, length]
        p = normal_tail((k / STEPS - ZERO - middle) / spread)
        rows.append((p * (characters / n_all) / (c / n), kind, length, k, n))
    rows.sort()
    seen, cut = 0, -1.0
    for weighted, _, _, _, n in rows:
        seen += n
        if weighted <= rate * seen / n_all:
            cut = weighted
    limits: dict[tuple[str, int], int] = {}
    for weighted, kind, length, k, _ in rows:
        if weighted <= cut:
            limits[kind, length] = min(k, limits.get((kind, length), BINS))
    return limits


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def base_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the secret itself in every base span."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [m.span() for m in HEX.finditer(text)]


Tests = list[tuple[int, int, str, int, int]]


def tested_runs(text: str, base: list[tuple[int, int, int]], model: Mapping) -> Tests:
    """(start, end, encoding, length class, bin) of all runs and parts of runs beside the base spans that can be tested, wholes first."""
    out: Tests = []
    left = [(m.start(), m.end()) for m in RUN.finditer(text)]
    for parts in PARTS:
        after = []
        for start, end in left:
            for m in parts.finditer(text[start:end]):
                s, e = start + m.start(), start + m.end()
                if e - s < LEAST:
                    continue
                beside = not any(x < e and s < y for x, _, y in base)
                value = battery(m[0], model) if beside and MIXED.search(m[0]) else None
                if value is not None:
                    out.append((s, e, value[0], length_class(e - s), bin_of(value[1])))
                if not m[0].isalnum():
                    after.append((s, e))
        left = after
    return list(dict.fromkeys(out))


def tested_values(text: str, model: Mapping) -> Tests:
    """The same of the base spans' values."""
    out: Tests = []
    for s, e in base_values(text):
        value = battery(text[s:e], model)
        if value is not None:
            out.append((s, e, value[0], length_class(e - s), bin_of(value[1])))
    return out


def counted(tests: Iterable[tuple[int, int, str, int, int]]) -> dict[tuple[str, int, int], tuple[int, int]]:
    out: dict[tuple[str, int, int], tuple[int, int]] = {}
    for s, e, kind, length, k in tests:
        n, c = out.get((kind, length, k), (0, 0))
        out[kind, length, k] = n + 1, c + e - s
    return out


def random_spans(text: str, base: list[tuple[int, int, int]], model: Mapping | None = None, limits: Mapping | None = None) -> list[tuple[int, int, int]]:
    """Runs and parts of runs beside the base spans that the battery takes for random; without ``limits`` the text is the corpus."""
    model = writing(neighbours([text])) if model is None else model
    tests = tested_runs(text, base, model)
    if limits is None:
        limits = discoveries(counted([*tests, *tested_values(text, model)]), model)
    found: list[tuple[int, int, int]] = []
    for s, e, kind, length, k in tests:
        if k >= limits.get((kind, length), BINS) and not any(x < e and s < y for x, _, y in found):
            found.append((s, 3, e))
    return sorted(found)


class Scanner:
    """What a corpus says: how writing goes, and from which bin on each group's tests are discoveries."""

    def __init__(self, docs: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERY) -> None:
        texts = docs.select(F.col(text).alias("text")).where("text is not null")

        def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                table = neighbours(b["text"])
                a, c = np.nonzero(table)
                yield pd.DataFrame({"a": a, "b": c, "n": table[a, c]})

        pairs = np.zeros((128, 128))
        for r in texts.mapInPandas(letters, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
            pairs[r["a"], r["b"]] = r["n"]
        self.model = model = writing(pairs)

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                tests = (x for t in b["text"] for x in (*tested_runs(t, base_spans(t), model), *tested_values(t, model)))
                yield pd.DataFrame([(*g, n, c) for g, (n, c) in counted(tests).items()], columns=["kind", "length", "bin", "n", "characters"])

        sums = texts.mapInPandas(own, "kind string, length int, bin int, n long, characters long").groupBy("kind", "length", "bin").agg(F.sum("n").alias("n"), F.sum("characters").alias("c"))
        found = {(r["kind"], r["length"], r["bin"]): (r["n"], r["c"]) for r in sums.collect()}
        self.limits = discoveries(found, model, rate) if found else {}


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long, n_base_random long, base_encodings string"


def scan(text: Column, known: Scanner) -> Column:
    """A struct of SCHEMA for every text: counts, digest of the base spans, all spans, and which base values are random in what encoding."""
    model, limits = known.model, known.limits

    @F.pandas_udf(SCHEMA)
    def own(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                t = t if isinstance(t, str) else ""
                base = base_spans(t)
                more = random_spans(t, base, model, limits)
                sure = [kind for _, _, kind, length, k in sorted(tested_values(t, model)) if k >= limits.get((kind, length), BINS)]
                kinds = [k for _, k, _ in base]
                digest = hashlib.sha256(shown(base).encode()).hexdigest()
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, shown(sorted(base + more)), len(more), len(sure), ",".join(sure)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", "n_base_random", "base_encodings"])

    return own(text)


def masked(text: Column, spans: Column, mask: str = "*") -> Column:
    """The text with every character of its spans replaced by ``mask``, in DataFrame functions."""
    parts = F.transform(F.filter(F.split(spans, ","), lambda s: s != ""), lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("s"), F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("e")))
    cover = lambda acc, x: F.overlay(acc, F.repeat(F.lit(mask), x["e"] - x["s"]), x["s"] + 1, x["e"] - x["s"])
    return F.aggregate(parts, text, cover)
