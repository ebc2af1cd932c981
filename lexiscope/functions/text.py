"""Column functions on text: tokens, normal forms, quality filters, markers, personal data."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """F-01: lower-cased words."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def letter_tokens(text: Column) -> Column:
    """F-02: words of letters, marks and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}'’]+"), F.lit(0))


def stripped_tokens(text: Column, marks: str = ".,!?;:") -> Column:
    """F-03: words between white space, without the marks around them."""
    return F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.btrim(w, F.lit(marks))), lambda w: w != "")


def literal(term: Column) -> Column:
    """F-04: a pattern that matches ``term`` as it stands."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def capitalized(text: Column) -> Column:
    """F-05: first letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def like_case(found: Column, replacement: Column) -> Column:
    """Replacement in the case of what was found: all upper, first upper, or as given."""
    first = F.substring(found, 1, 1)
    is_upper = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    return F.when(is_upper(found), F.upper(replacement)).when(is_upper(first), capitalized(replacement)).otherwise(replacement)


def eval_form(text: Column) -> Column:
    """P-02: lower case, other characters to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " "), " +", " "))


def settled_characters(blocks: Sequence[tuple[int, int]] = ((0, 0x2FF), (0x370, 0x482), (0x48A, 0x52F), (0x2010, 0x204F), (0x20A0, 0x20BF))) -> str:
    """A pattern's class of characters of which any text is in NFKC form: each is its own form, and none combines."""
    own = [c for a, b in blocks for c in range(a, b + 1) if unicodedata.is_normalized("NFKC", chr(c)) and not unicodedata.category(chr(c)).startswith(("M", "C")) or c in range(0x80)]
    runs = [(c, next(e for e in range(c, 0x10FFFF) if e + 1 not in set(own))) for c in own if c - 1 not in own]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)


#: Found where a text may not be in NFKC form; most characters are ASCII and need one comparison.
UNSETTLED = rf"[^\x00-\x7F](?<![{settled_characters()}])"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC form, which Spark SQL lacks."""
    return text.str.normalize("NFKC")


def clean_text(text: Column) -> Column:
    """P-01: NFKC, blanks collapsed and trimmed; null where nothing is left. Only texts that may change go to Python."""
    form = F.coalesce(nfkc(F.when(text.rlike(UNSETTLED), text)), text)
    return F.nullif(F.trim(F.regexp_replace(form, r"\s+", " ")), F.lit(""))


def letter_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))


def quality_prose(text: Column) -> Column:
    """P-03: 50 to 400 characters, three fifths letters, no link, mention or tag."""
    return F.length(text).between(50, 400) & (letter_share(text) >= 0.6) & ~text.rlike("http|@|#")


def quality_tweet(text: Column) -> Column:
    """P-04: 20 to 280 characters, a letter, no repost, few tags and links."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return F.length(text).between(20, 280) & text.rlike(r"\p{L}") & ~text.startswith("RT") & (count("#") <= 3) & (count("http") <= 1)


def quality_web(text: Column) -> Column:
    """P-05: a letter, and at most 15 in a hundred characters are marks."""
    return text.rlike(r"\p{L}") & (F.regexp_count(text, F.lit("[.,!?;:]")) / F.greatest(F.length(text), F.lit(1)) <= 0.15)


def quality_social(text: Column, function_words: Sequence[str]) -> Column:
    """P-06: 30 to 280 characters, a function word, few links, tags and mentions."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    own = F.arrays_overlap(tokens(text), F.array(*[F.lit(w) for w in function_words]))
    return F.length(text).between(30, 280) & own & (count("https?://") <= 2) & (count("#") <= 5) & (count("@") <= 3)


def quality_line(text: Column) -> Column:
    """P-07: 20 to 500 characters and a word character."""
    return F.length(text).between(20, 500) & text.rlike(r"[\p{L}\p{N}_]")


def sentences(text: Column, least: int = 40, most: int = 200) -> Column:
    """P-08: trimmed sentences between . ! ? of bounded length."""
    parts = F.transform(F.split(text, "[.!?]+"), lambda x: F.trim(x))
    return F.filter(parts, lambda s: F.length(s).between(least, most))


def has_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """P-09: any keyword as a substring, ignoring case."""
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(text), k))


def terms_found(text: Column, terms: Sequence[str]) -> Column:
    """P-10: the terms that occur as whole words."""
    return F.array_intersect(F.array(*[F.lit(t) for t in terms]), tokens(text))


def marker_class(text: Column, markers: Mapping[str, Sequence[str]]) -> Column:
    """P-17: mixed, female, male or neutral by substring markers."""
    has = {k: F.exists(F.array(*[F.lit(m) for m in v]), lambda m: F.contains(F.lower(text), m)) for k, v in markers.items()}
    return F.when(has["female"] & has["male"], "mixed").when(has["female"], "female").when(has["male"], "male").otherwise("neutral")


def group_of(text: Column, male: Sequence[str], female: Sequence[str], neutral: Sequence[str] = ()) -> Column:
    """P-16: the group that a text refers to, by blank-padded markers."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    any_of = lambda words: F.exists(F.array(*[F.lit(f" {w} ") for w in words]), lambda m: F.contains(padded, m)) if words else F.lit(False)
    m, f, n = any_of(male), any_of(female), any_of(neutral)
    return F.when(m & ~f, "male_referent").when(f & ~m, "female_referent").when(n & ~m & ~f, "neutral_referent").otherwise("unknown")


def target_of(text: Column) -> Column:
    """P-18: the gender that pronouns point to."""
    words = tokens(text)
    has = lambda own: F.arrays_overlap(words, F.array(*[F.lit(w) for w in own]))
    m, f = has(("he", "him", "his")), has(("she", "her", "hers"))
    return F.when(m & f, "mixed").when(m, "male").when(f, "female").otherwise("neutral")


def entities(text: Column) -> Column:
    """P-20: capitalised words that don't start a sentence, acronyms, and two-word names."""
    inner = F.flatten(F.transform(F.split(text, r"[.!?]\s+"), lambda s: F.filter(F.transform(F.slice(F.split(F.trim(s), r"\s+"), 2, 1 << 20), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")), lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) > 1))))
    acronyms = F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,6}\b"), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(inner, acronyms, names)))


def in_quotes(text: Column, term: Column) -> Column:
    """P-21: the term between two quotes of a kind, ignoring case."""
    q = lambda c: F.regexp_like(text, F.concat(F.lit(f"(?iu){c}[^{c}]*"), literal(term), F.lit(f"[^{c}]*{c}")))
    return q('"') | q("'")


#: Kinds of personal data and their patterns (fixed values).
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "url": r"https?://[^\s]+",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "phone_us": r"(?:\+?1[-.\s]?)?\(?\b\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "id_number": r"\b[A-Z]{2}\d{6,10}\b",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|M|Mme|Mlle|Bwana|Bibi|Dkt)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?",
}


def pii_found(text: Column) -> Column:
    """F-08: kind to matches."""
    return F.create_map(*[x for k, p in PII.items() for x in (F.lit(k), F.regexp_extract_all(text, F.lit(p), F.lit(0)))])


def redacted(text: Column, placeholders: bool = True) -> Column:
    """F-09: every match replaced as a whole by its kind's placeholder, or removed; other text untouched."""
    out = text
    for k, p in PII.items():
        out = F.regexp_replace(out, p, f"[{k.upper()}]" if placeholders else "")
    return out


def social_form(text: Column) -> Column:
    """F-07: addresses, links, phone numbers and mentions replaced, addresses first."""
    steps = ((PII["email"], "[EMAIL]"), (r"https?://\S+", "[URL]"), (r"(?:\+254|\b0)[17]\d{8}\b", "[PHONE]"), (r"@[A-Za-z0-9_]+", "[USER]"))
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def ngrams(words: Column, n: int) -> Column:
    """F-12: runs of n words, joined by blanks."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, grams(w)).otherwise(none)))


def mapped(value: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """F-13, P-22: a value through a dictionary; ``default`` (the value itself) where it isn't in it."""
    literal_map = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(literal_map, value), value if default is None else default)


def harmonic(a: Column, b: Column) -> Column:
    """F-11: harmonic mean, 0 if both are 0."""
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, ``empty`` where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))
