"""Context gate, pattern detectors and the decision cascade (D-04 to D-27)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.functions import patterns as P
from lexiscope.functions.text import literal, stripped_tokens, tokens
from lexiscope.operators.lexicon import matches
from lexiscope.sources.scratch import saved

NOCASE, CASED = "(?iuU)", "(?uU)"
#: Characters on either side of a term that context patterns look at, and some more.
REACH = 256
CONFIDENCE = {"counter-stereotype": 0.85, "derogation": 0.9, "suffix": 0.95, "stereotype": 0.85, "neutral": 0.7}


def starts(pattern: str) -> set[str] | None:
    """What a match of a pattern that begins with words or digits can begin with, letters or digits; None where that isn't known."""
    rest = pattern.removeprefix(r"\b")
    if rest.startswith(r"\d"):
        return {r"\d"} if rest[2:3] not in ("?", "*") and not rest.startswith(r"\d{0") else None
    if rest == pattern or not rest:
        return None
    if not rest.startswith("("):
        return {rest[0]} if rest[0].isalpha() and rest[1:2] not in ("?", "*", "{") else None
    depth, found, end = 0, set(), 0
    for end, (before, c) in enumerate(zip(rest, rest[1:] + " ", strict=True), 1):
        depth += (before == "(") - (before == ")")
        if depth == 0:
            break
        if depth == 1 and before in "(|":
            found.add(c)
    if not all(c.isalpha() for c in found) or rest[end : end + 1] in ("*", "{"):
        return None
    if rest[end : end + 1] != "?":
        return found
    # the group may be absent: what follows it may come first
    after = starts(r"\b" + rest[end + 1 :])
    return None if after is None else found | after


def quick(pattern: str) -> str:
    """The pattern behind a look at the next letter, where it starts with words: cheaper, at most places, than whether a word begins."""
    first = starts(pattern) if pattern.startswith(r"\b") else None
    return f"(?=[{''.join(sorted(first))}]){pattern}" if first else pattern


def cue(pattern: str) -> str | None:
    """The words or digits without which a pattern with a term can't match, as a pattern of their own."""
    before, _, after = pattern.partition("{term}")
    own = re.sub(r"\.\{0,\d+\}$", "", before) if before else re.sub(r"^\.\{0,\d+\}", "", after)
    return own if own and starts(own) else None


def apart(text: Column, made: Callable[[Column], Column]) -> Column:
    """``made(text)`` evaluated in a lambda, so that many patterns don't outgrow the size of a generated method."""
    return F.get(F.transform(F.array(text), made), F.lit(0))


def opening(pattern: str) -> str | None:
    """What a pattern that begins with words begins with, up to where anything may follow, without the first word limit."""
    depth = 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if depth == 0 and c == "." and pattern[i + 1 : i + 2] in ("*", "+", "{"):
            pattern = pattern[:i]
            break
    return pattern[2:] if pattern.startswith(r"\b") and starts(pattern) else None


def first_pattern(text: Column, lang: Column, table: Sequence[tuple]) -> Column:
    """D-11, D-12: struct(category, gender) of the first pattern of the text's language that occurs; literal patterns are compiled once.

    All patterns of a language are tried only where a text holds what one of them begins with.
    """
    out = F
    for language in dict.fromkeys(row[0] for row in table):
        own = [row[1:] for row in table if row[0] == language]
        found = reduce(lambda chosen, row: chosen.when(text.rlike(NOCASE + quick(row[0])), F.struct(F.lit(row[1]).alias("category"), F.lit(row[2]).alias("gender"))), own, F)
        first = [opening(pattern) for pattern, _, _ in own]
        fits = lang == language
        if all(first):
            letters = "".join(sorted(set().union(*[starts(pattern) for pattern, _, _ in own])))
            fits &= text.rlike(rf"{NOCASE}(?=[{letters}])\b(?:{'|'.join(dict.fromkeys(first))})")
        out = out.when(fits, found)
    return out


def counter_stereotype(text: Column, lang: Column) -> Column:
    return first_pattern(text, lang, P.COUNTER_STEREOTYPE)


def derogation(text: Column, lang: Column) -> Column:
    """D-12 with D-13: nothing where the phrase is named in order to reject it."""
    rejected = (lang == "sw") & text.rlike(NOCASE + quick(P.DEROGATION_REJECTED))
    return apart(first_pattern(text, lang, P.DEROGATION), lambda found: F.when(found.isNotNull() & ~rejected, found))


def gendered_suffix(text: Column) -> Column:
    """D-14: struct(from, to, suffix, gender, corrected) of the first suffix pattern on an occupation."""
    out = F.lit(None)
    for suffix, pattern, gender in reversed(P.SUFFIXES):
        noun = F.regexp_extract(text, NOCASE + pattern, 1)
        word = F.lower(noun)
        occupation = word.rlike("^(?:" + "|".join(P.OCCUPATION_BEGINNINGS) + ")")
        occurs = text.rlike(NOCASE + r"\s" + r"\s+".join(suffix.split()) + r"\b")
        fits = occurs & (word != "") & ~word.rlike("^[0-9]+$") & ~word.isin(*P.NO_OCCUPATIONS) & occupation
        corrected = F.regexp_replace(F.trim(F.regexp_replace(text, NOCASE + pattern, "$1")), "  +", " ")
        found = F.struct(F.regexp_extract(text, NOCASE + pattern, 0).alias("from"), noun.alias("to"), F.lit(suffix).alias("suffix"), F.lit(gender).alias("gender"), corrected.alias("corrected"))
        out = F.when(fits, found).otherwise(out)
    any_suffix = text.rlike(NOCASE + r"\s(?:" + "|".join(r"\s+".join(suffix.split()) for suffix, _, _ in P.SUFFIXES) + r")\b")
    return F.when(any_suffix & ~text.rlike(NOCASE + quick(P.PROGRESS)), out)


def listed_conditions(avoid_when: Column) -> Column:
    """D-06: the known conditions of a cell, in its order."""
    known = F.array(*[F.lit(c) for c in P.CONTEXTS])
    return F.filter(F.transform(F.split(F.coalesce(avoid_when, F.lit("")), r"\|"), lambda c: F.lower(F.trim(c))), lambda c: F.array_contains(known, c))


def around(text: Column, term: Column) -> Column:
    """The text within REACH characters of the term's occurrences; what lies between is cut out.

    No context pattern of a term spans more than REACH (a run of white space or a name beyond 64 characters aside),
    and none can match across a cut or from its edge to a term, so that those with a term match here as in the text.
    """
    pattern = F.concat(F.lit(NOCASE), literal(term))
    cut = lambda p: F.when(F.length(p) <= 2 * REACH, p).otherwise(F.concat(F.substring(p, 1, REACH), F.lit("\n\x00\n"), F.substring(p, -REACH, REACH)))
    kept = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, hit: F.concat(cut(p), F.coalesce(hit, F.lit(""))))
    return F.array_join(kept, "")


def blocking_context(text: Column, term: Column, avoid_when: Column, strict_case: bool = False, near: Column | None = None) -> Column:
    """D-04 to D-10: the first condition that blocks a correction, or null.

    ``term`` differs between rows, so these patterns are columns: use it on matched rules only, sorted by
    rule, as Spark compiles a pattern again where it differs from the row's before. Patterns with a term
    read ``near`` (``around`` the term; the text where not given). Conditions
    are those of ``avoid_when`` in its order, or the default three where none of it is known. All patterns
    ignore case, so that a capital stands for any letter; with ``strict_case`` those of names and organizations don't.
    """
    listed = listed_conditions(avoid_when)
    conditions = F.when(F.size(listed) > 0, listed).otherwise(F.array(*[F.lit(c) for c in P.DEFAULT_CONDITIONS]))
    q = literal(term)
    filled = lambda p: reduce(lambda a, b: F.concat(a, q, b), [F.lit(x) for x in p.split("{term}")])
    near = text if near is None else near
    place = lambda p: near if "{term}" in p else text
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)

    def hit(c: str, ps: Sequence[str]) -> Column:
        """Patterns whose words the text must hold are tried where it holds any of them: those words are one pattern, compiled once."""
        flags = CASED if strict_case and c in ("proper_noun", "organization") else NOCASE
        found = lambda p: F.regexp_instr(place(p), F.concat(F.lit(flags), filled(quick(p)))) > 0
        cued = [p for p in ps if "{term}" in p and cue(p)]
        tests = [found(p) for p in ps if p not in cued]
        if cued:
            first = "".join(sorted(set().union(*[starts(cue(p)) for p in cued])))
            tests.append(near.rlike(f"{flags}(?=[{first}])(?:{'|'.join(dict.fromkeys(map(cue, cued)))})") & any_of([found(p) for p in cued]))
        return any_of(tests)

    hits = {c: hit(c, ps) for c, ps in P.CONTEXTS.items()}
    hits["biographical"] = hits["biographical"] | (F.regexp_instr(near, filled(P.NAME_BEFORE)) > 0) | (F.regexp_instr(near, filled(P.NAME_AFTER)) > 0)
    # a choice, not a map: of all conditions only the listed one is evaluated
    listed_hit = lambda c: reduce(lambda chosen, kv: chosen.when(c == kv[0], kv[1]), hits.items(), F)
    first = F.get(F.filter(conditions, listed_hit), F.lit(0))
    own_name = any_of([F.contains(F.lower(F.regexp_extract(text, p, 0)), F.lower(term)) for p in P.FAMILY_NAMES])
    nouns = F.transform(F.regexp_extract_all(text, F.lit(NOCASE + r"\b(\w+)\s+(?:" + "|".join(P.POSSESSIVES) + r")\b"), F.lit(1)), F.lower)
    things, people = (F.array(*[F.lit(w) for w in own]) for own in (P.THINGS, P.PEOPLE))
    decisive = F.get(F.filter(nouns, lambda n: F.array_contains(things, n) | F.array_contains(people, n)), F.lit(0))
    possessive = F.lower(term).isin(*P.POSSESSIVES) & ~F.coalesce(F.array_contains(people, decisive), F.lit(False))
    return F.when(possessive, "statistical").otherwise(F.coalesce(first, F.when(own_name, "proper_noun")))


def gated_matches(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """D-04, D-17: matched rules with what blocks them; rules without ``avoid_when`` and ``constraints`` aren't gated."""
    columns = [*lexicon.columns, *[c for c in ("avoid_when", "constraints") if c not in lexicon.columns]]
    rules = lexicon.select("*", *[F.lit("").alias(c) for c in columns if c not in lexicon.columns])
    found = matches(docs, rules).where("biased <> neutral_primary").join(docs.select("doc_id", "text"), "doc_id").sortWithinPartitions("rule_no")
    gated = (F.coalesce(F.col("avoid_when"), F.lit("")) != "") | (F.coalesce(F.col("constraints"), F.lit("")) != "")
    found = found.withColumn("near", F.when(gated, around(F.col("text"), F.col("biased"))))
    blocked = apart(F.struct("text", "near"), lambda x: blocking_context(x["text"], F.col("biased"), F.col("avoid_when"), near=x["near"]))
    return found.withColumn("blocked_by", F.when(gated, blocked)).drop("text", "near")


def cascade(docs: DataFrame, lexicon: DataFrame, scores: DataFrame | None = None, threshold: float = 0.75) -> DataFrame:
    """D-16, D-20: counter-stereotype, derogation, suffix, lexicon with context gate, then a score table.

    The lexicon join sees only texts that the patterns haven't settled.
    """
    text, lang = F.col("text"), F.col("lang")
    first = docs.withColumn("counter", apart(text, lambda t: counter_stereotype(t, lang))).withColumn("derog", F.when(F.col("counter").isNull(), apart(text, lambda t: derogation(t, lang))))
    first = first.withColumn("suffix", F.when(F.col("counter").isNull() & F.col("derog").isNull() & (lang == "sw"), apart(text, gendered_suffix)))
    # saved: all patterns run once over a text, and texts that they settle go no further
    is_open = F.col("counter").isNull() & F.col("derog").isNull() & F.col("suffix").isNull()
    first = saved(first.select("doc_id", F.when(is_open, text).alias("open_text"), "counter", "derog", "suffix"))
    open_ = first.where("open_text is not null").select("doc_id", F.col("open_text").alias("text"))
    found = gated_matches(open_, lexicon)
    live, replace = F.col("blocked_by").isNull(), F.col("severity") != "warn"
    child = F.col("biased").rlike(NOCASE + P.CHILD_TERM)
    edits = found.join(open_.select("doc_id", F.col("text").rlike(NOCASE + P.CHILD_OF_SOMEONE).alias("own_child")), "doc_id").where(~(child & F.col("own_child")))
    by_doc = edits.groupBy("doc_id").agg(
        F.count_if(live & replace).alias("n_replace"), F.count_if(live & ~replace).alias("n_warn"), F.count_if(~live).alias("n_skipped"),
        F.min_by(F.when(live & replace, F.col("stereotype_category")), F.when(live & replace, F.col("rule_no"))).alias("lex_category"),
    )
    out = first.join(by_doc, "doc_id", "left").na.fill(0, ["n_replace", "n_warn", "n_skipped"])
    score = F.lit(None).cast("double")
    if scores is not None:
        out = out.join(scores.select("doc_id", F.col("score").alias("_score")), "doc_id", "left")
        score = F.when((F.col("n_replace") == 0) & (F.col("n_warn") == 0) & (F.col("_score") >= threshold), F.col("_score"))
    settled = F.when(F.col("counter").isNotNull(), "counter-stereotype").when(F.col("derog").isNotNull(), "derogation").when(F.col("suffix").isNotNull(), "suffix").when(F.col("n_replace") > 0, "stereotype").otherwise("neutral")
    confidence = reduce(lambda a, kv: a.when(F.col("settled") == kv[0], kv[1]), CONFIDENCE.items(), F)
    out = out.withColumn("settled", settled).withColumn("ml_score", F.when(F.col("settled") == "neutral", score))
    return out.select(
        "doc_id", "settled", "n_replace", (F.col("n_warn") + F.when(F.col("ml_score").isNotNull(), 1).otherwise(0)).alias("n_warn"), "n_skipped",
        F.col("settled").isin("derogation", "suffix", "stereotype").alias("has_bias"),
        F.when(F.col("settled") == "suffix", "stereotype").otherwise(F.col("settled")).alias("bias_label"),
        F.coalesce("counter.category", "derog.category", F.when(F.col("suffix").isNotNull(), "profession"), "lex_category").alias("category"),
        F.coalesce("counter.gender", "derog.gender", "suffix.gender").alias("gender"),
        F.coalesce("ml_score", confidence).alias("confidence"),
    )


def noun_class(noun: Column) -> Column:
    """D-18: class of a noun by its beginning; null if none fits."""
    return class_of_form(F.lower(F.trim(noun)))


def class_of_form(n: Column) -> Column:
    """D-18 for a noun in lower case, without blanks around it."""
    person = F.startswith(n, F.lit(P.PERSON_BEGINNING)) & reduce(lambda a, b: a | b, [F.contains(n, F.lit(s)) for s in P.PERSON_STEMS])
    out = F.when(person, "1/2")
    for name, beginnings in P.NOUN_CLASSES:
        out = out.when(reduce(lambda a, b: a | b, [F.startswith(n, F.lit(b)) for b in beginnings]), name)
    return out


def noun_profile(text: Column) -> Column:
    """D-19: struct(m_wa, others, total) of the text's classed nouns. A word is lower-cased once and classed where its first letter fits."""
    firsts = sorted({P.PERSON_BEGINNING, *[b[0] for _, beginnings in P.NOUN_CLASSES for b in beginnings]})
    words = F.filter(stripped_tokens(text), lambda w: F.length(w) >= 3)
    forms = F.transform(words, lambda w: F.struct(w.alias("noun"), F.lower(F.trim(w)).alias("form")))
    likely = F.filter(forms, lambda x: F.substring(x["form"], 1, 1).isin(firsts))
    classed = F.filter(F.transform(likely, lambda x: F.struct(x["noun"].alias("noun"), class_of_form(x["form"]).alias("cls"))), lambda x: x["cls"].isNotNull())

    def made(found: Column) -> Column:
        people = F.transform(F.filter(found, lambda x: x["cls"] == "1/2"), lambda x: x["noun"])
        return F.struct(people.alias("m_wa"), F.size(people).alias("m_wa_count"), F.filter(found, lambda x: x["cls"] != "1/2").alias("others"), F.size(found).alias("total"))

    return apart(classed, made)


def keyword_detector(text: Column, lang: Column) -> Column:
    """D-22: any keyword of the text's language as a whole word."""
    words = tokens(text)
    return reduce(lambda a, kv: a.when(lang == kv[0], F.arrays_overlap(words, F.array(*[F.lit(k) for k in kv[1]]))), P.KEYWORDS.items(), F).otherwise(False)


def substring_detector(text: Column, terms: Sequence[str]) -> Column:
    """D-21, D-23: the terms that occur as substrings, ignoring case."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(text), t))


def keyword_score(text: Column, terms: Sequence[str]) -> Column:
    """D-24: 0.4 for each term that occurs, 1 at most; biased above 0.7."""
    return F.least(0.4 * F.size(substring_detector(text, terms)), F.lit(1.0))


def hybrid(rules: Column, model: Column) -> Column:
    """D-25, J-11: struct(has_bias, confidence, agreement) of two detectors' decisions."""
    confidence = 0.7 * F.when(rules, 1.0).otherwise(0.0) + 0.3 * F.when(model, 0.8).otherwise(0.2)
    return F.struct((rules | model).alias("has_bias"), F.round(confidence, 6).alias("confidence"), (rules == model).alias("agreement"))


def merged_edits(rules: Column, model: Column) -> Column:
    """J-11: the model's edits join the rules' where no rule edit has the same term, ignoring case."""
    return F.concat(rules, F.filter(model, lambda m: ~F.exists(rules, lambda r: F.lower(r["from"]) == F.lower(m["from"]))))


def applied_once(text: Column, edits: Column) -> Column:
    """D-26: every edit (from, to) applied at its first place in the text so far, ignoring case."""
    def put(acc: Column, e: Column) -> Column:
        at = F.position(F.lower(e["from"]), F.lower(acc))
        return F.when(at > 0, F.overlay(acc, e["to"], at, F.length(e["from"]))).otherwise(acc)

    return F.aggregate(edits, text, put)


def category_suggestion(rows: DataFrame, keywords: DataFrame, key: str = "doc_id", text: str = "text", default: str = "profession") -> DataFrame:
    """D-27: the category with the largest sum of keyword weights; confidence is a tenth of it, 0.95 at most."""
    hits = rows.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")).join(keywords, "word")
    best = hits.groupBy(key, "category").agg(F.sum("weight").alias("w")).groupBy(key).agg(F.max(F.struct("w", F.expr("category"))).alias("b"))
    out = rows.select(key).join(best, key, "left")
    confidence = F.coalesce(F.least(F.col("b.w") / 10.0, F.lit(0.95)), F.lit(0.3))
    return out.select(key, F.coalesce("b.category", F.lit(default)).alias("category"), F.round(confidence, 6).alias("confidence"), (confidence >= 0.9).alias("auto_approved"))
