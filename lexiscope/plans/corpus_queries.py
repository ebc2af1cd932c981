"""Registered queries on terms mined from the documents, and on constructions planted into whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.functions import patterns as P
from lexiscope.operators import detect as X
from lexiscope.operators import lexicon as L
from lexiscope.plans import roles as R
from lexiscope.sources.scratch import saved

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def docs(s: SparkSession, d: str) -> DataFrame:
    return R.table(s, d, "documents")


# lexicons mined from the texts: the first one to five words of every line

LINE_START = r"^\p{L}+(?: \p{L}+){0,4}"


def mined_lexicon(s: SparkSession, d: str) -> DataFrame:
    """Every line's first words, up to five and up to the first other mark, as a rule; saved, as it is read several times."""
    line = docs(s, d).select(F.explode(F.split("text", "\n")).alias("line"))
    terms = line.select(F.lower(F.regexp_extract("line", LINE_START, 0)).alias("biased")).where("biased <> ''").distinct()
    rules = terms.select(F.conv(F.substring(F.md5("biased"), 1, 7), 16, 10).cast("long").alias("rule_no"), "biased", F.concat(F.lit("plain "), "biased").alias("neutral_primary"))
    return saved(rules.withColumn("severity", F.when(F.col("rule_no") % 2 == 0, "replace").otherwise("warn")).withColumn("stereotype_category", F.concat(F.lit("c"), F.col("rule_no") % 5)))


# a mark becomes a token of its own, so that words with a mark between them make no phrase
MINED = rf"""mined AS (
  SELECT *, CASE WHEN rule_no % 2 = 0 THEN 'replace' ELSE 'warn' END AS severity, 'c' || rule_no % 5 AS stereotype_category FROM (
    SELECT biased, ('0x' || substr(md5(biased), 1, 7))::BIGINT AS rule_no FROM (
      SELECT DISTINCT lower(regexp_extract(line, '{LINE_START}')) AS biased FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE biased <> '')),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_ ]', ' # ', 'g'), ' ') AS w FROM documents)),
ahead AS (SELECT doc_id, x, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c, lead(x, 3) OVER o AS d, lead(x, 4) OVER o AS e FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
grams AS (
  SELECT DISTINCT doc_id, unnest([x, x || ' ' || b, x || ' ' || b || ' ' || c, x || ' ' || b || ' ' || c || ' ' || d, x || ' ' || b || ' ' || c || ' ' || d || ' ' || e]) AS biased FROM ahead),
found AS (SELECT doc_id, m.* FROM grams JOIN mined m USING (biased))"""


def _digest(rows: DataFrame) -> DataFrame:
    by_doc = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.md5(F.array_join(F.array_sort(F.collect_list("biased")), "|")).alias("terms"))
    return by_doc


add("J01_mined_lexicon", lambda s, d: _digest(L.matches(docs(s, d), mined_lexicon(s, d))),
    f"WITH {MINED} SELECT doc_id, count(*) AS n_terms, md5(string_agg(biased, '|' ORDER BY biased)) AS terms FROM found GROUP BY 1")
add("D01_mined_lexicon", lambda s, d: L.detection(docs(s, d), mined_lexicon(s, d), edits=False).select("doc_id", "n_replace", "n_warn", "has_bias", "primary_category"),
    f"""WITH {MINED} SELECT doc_id, CAST(count(f.biased) FILTER (WHERE severity <> 'warn') AS INTEGER) AS n_replace, CAST(count(f.biased) FILTER (WHERE severity = 'warn') AS INTEGER) AS n_warn,
  count(f.biased) FILTER (WHERE severity <> 'warn') > 0 AS has_bias, arg_min(stereotype_category, (rule_no, stereotype_category)) FILTER (WHERE severity <> 'warn') AS primary_category
FROM documents LEFT JOIN found f USING (doc_id) GROUP BY 1""")


# context gates: a construction is planted into every document, as a line of its own at a hashed place

#: (biased, severity, avoid_when): terms that occur in the documents or in the constructions.
GATED = (
    ("trash", "replace", "quote|historical"), ("idiot", "replace", "biographical"), ("clown", "replace", "statistical|medical"), ("scum", "replace", "legal | Artistic|unknown"),
    ("worthless", "replace", "organization"), ("moron", "replace", "proper_noun"), ("pathetic", "replace", "counter_stereotype"), ("loser", "replace", "nothing known"),
    ("disgusting", "replace", "historical"), ("stupid", "replace", ""), ("he", "warn", "medical|legal|artistic"), ("of the", "warn", "statistical"),
    ("yake", "replace", "artistic"), ("mama", "replace", "legal"), ("mtoto wa kike", "replace", ""),
)
PLANTED_TERMS = 9
CONSTRUCTIONS = (
    'then "a {t} came" was heard', "«the {t}» again", "someone said that a {t} came", "In 1987 there came a {t}", "historically some {t} came", "they were of old {t}",
    "then Jane Doe came, {t}", "then jane doe came, {t}", "{t} Kamau came", "she became our {t}", "Dr. Otieno, {t}", "45% of it {t}", "a survey found {t}", "some 12 {t}",
    "the hospital found {t}", "after pregnancy came {t}", "the court heard {t}", "a film about {t}", "the female pilot came, {t}", "TAWOMA heard {t}", "that was in passing; {t}",
    "nothing speaks for or against {t}", "{t}", "nyumba yake", "daktari yake", "kitabu na daktari yake", "yake", "kisha Mama Sara alikuja", "kisha mama alikuja", "mahakama na mama",
)
_SW_LINES = (
    "mwanamke huyu ni mhandisi", "baba yake anapika", "huyu ni tu msichana", "si kweli kuwa huyu ni tu msichana", "daktari wa kike alifika", "rafiki wa kike alifika", "mwalimu wa kiume wa kwanza",
    "mtoto wake wa kike na mtoto wa kike", "mtoto wa kike alikuja", "maneno ya kawaida", "msichana ameongoza", "hata mwanamke anaweza",
)


def number(key, salt: str):
    """A number of 28 bits that a row's key gives, in Spark and in SQL alike."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 7), 16, 10).cast("long")


def _number(salt: str) -> str:
    return f"('0x' || substr(md5(doc_id || '{salt}'), 1, 7))::BIGINT"


def _listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def planted(s: SparkSession, d: str, lines=CONSTRUCTIONS) -> DataFrame:
    """Whole documents with one construction each, between two of their lines, and ``line``, which one it is."""
    key, own = F.col("doc_id"), F.split(F.coalesce("text", F.lit("")), "\n")
    term = F.element_at(F.array(*[F.lit(g[0]) for g in GATED[:PLANTED_TERMS]]), (number(key, "term") % PLANTED_TERMS + 1).cast("int"))
    rows = docs(s, d).select("doc_id", "lang", own.alias("own"), (number(key, "line") % len(lines)).cast("int").alias("line"), term.alias("term"))
    rows = rows.withColumn("at", (number(key, "at") % (F.size("own") + 1)).cast("int"))
    text = F.concat(F.slice("own", F.lit(1), F.col("at")), F.array(F.replace(F.get(F.array(*[F.lit(x) for x in lines]), F.col("line")), F.lit("{t}"), F.col("term"))), F.slice("own", F.col("at") + 1, F.size("own")))
    return rows.select("doc_id", "lang", "line", F.array_join(text, "\n").alias("text"))


def _planted(lines=CONSTRUCTIONS) -> str:
    return f"""planted AS (
  SELECT doc_id, lang, line, array_to_string(own[1 : place] || [replace([{_listed(lines)}][line + 1], '{{t}}', term)] || own[place + 1 :], chr(10)) AS text FROM (
    SELECT *, {_number('at')} % (len(own) + 1) AS place FROM (
      SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS own, {_number('line')} % {len(lines)} AS line,
        [{_listed(g[0] for g in GATED[:PLANTED_TERMS])}][{_number('term')} % {PLANTED_TERMS} + 1] AS term FROM documents)))"""


_RULES = ", ".join(f"({i}, '{b}', 'plain {i}', '{sev}', '{R.CATEGORIES[i % len(R.CATEGORIES)]}', '{a}')" for i, (b, sev, a) in enumerate(GATED))
_COLUMNS = "(rule_no, biased, neutral_primary, severity, stereotype_category, avoid_when)"


def gated_lexicon(s: SparkSession) -> DataFrame:
    return s.sql(f"SELECT * FROM VALUES {_RULES} AS t{_COLUMNS}")


def _matches(pattern: str, term: str, column: str, cased: bool = False) -> str:
    """A context pattern as SQL; look-behinds become plain characters, as only an occurrence counts."""
    p = pattern.replace("{term}", term).replace("(?<=[a-z])", "[a-z]").replace("(?<=[a-z.,;:]\\s)", "[a-z.,;:]\\s").replace("'", "''")
    return f"regexp_matches({column}, '{p}'{'' if cased else ", 'i'"})"


def _blocked(term: str, avoid_when: str, column: str = "text") -> str:
    """SQL of the gate for one rule, over the whole text."""
    if not avoid_when:
        return "NULL"
    listed = [c for c in (x.strip().lower() for x in avoid_when.split("|")) if c in P.CONTEXTS] or P.DEFAULT_CONDITIONS
    own = []
    for c in listed:
        tests = [_matches(p, term, column) for p in P.CONTEXTS[c]]
        if c == "biographical":
            tests += [_matches(p, term, column, True) for p in (P.NAME_BEFORE, P.NAME_AFTER)]
        own.append(f"WHEN {' OR '.join(tests)} THEN '{c}'")
    family = " OR ".join(f"contains(lower(regexp_extract({column}, '{p}')), '{term}')" for p in P.FAMILY_NAMES)
    out = f"CASE {' '.join(own)} WHEN {family} THEN 'proper_noun' END"
    if term in P.POSSESSIVES:
        nouns = f"list_transform(regexp_extract_all({column}, '(?i)\\b(\\w+)\\s+(?:{'|'.join(P.POSSESSIVES)})\\b', 1), lambda n: lower(n))"
        decisive = f"list_filter({nouns}, lambda n: n IN ({_listed((*P.THINGS, *P.PEOPLE))}))[1]"
        out = f"CASE WHEN coalesce({decisive} IN ({_listed(P.PEOPLE)}), false) THEN {out} ELSE 'statistical' END"
    return out


def _gates(table: str, rules: str, values: list[tuple[int, str, str]]) -> str:
    """CTEs ``lexicon``, ``hits`` and ``gates`` (doc_id, rule columns, blocked_by) over a table of texts."""
    cases = " ".join(f"WHEN {i} THEN {_blocked(b, a)}" for i, b, a in values)
    return f"""lexicon{_COLUMNS} AS (VALUES {rules}), {R.HITS.replace('documents', table)},
gates AS (SELECT doc_id, rule_no, biased, severity, stereotype_category, text, CASE rule_no {cases} END AS blocked_by FROM hits JOIN (SELECT doc_id, text FROM {table}) USING (doc_id))"""


GATES = f"{_planted()}, {_gates('planted', _RULES, [(i, b, a) for i, (b, _, a) in enumerate(GATED)])}"


def gates(s: SparkSession, d: str) -> DataFrame:
    return X.gated_matches(planted(s, d), gated_lexicon(s))


def _of(*terms: str):
    return lambda s, d: X.gated_matches(planted(s, d), gated_lexicon(s).where(F.col("biased").isin(*terms)))


add("D05_context_families", lambda s, d: gates(s, d).select("doc_id", "rule_no", "blocked_by"), f"WITH {GATES} SELECT doc_id, rule_no, blocked_by FROM gates")
add("D07_name_gate", lambda s, d: _of("idiot", "moron", "loser")(s, d).select("doc_id", "biased", "blocked_by"), f"WITH {GATES} SELECT doc_id, biased, blocked_by FROM gates WHERE biased IN ('idiot', 'moron', 'loser')")
add("D08_possessive_gate", lambda s, d: _of("yake")(s, d).select("doc_id", "blocked_by"), f"WITH {GATES} SELECT doc_id, blocked_by FROM gates WHERE biased = 'yake'")
add("D09_family_names", lambda s, d: _of("mama")(s, d).select("doc_id", "blocked_by"), f"WITH {GATES} SELECT doc_id, blocked_by FROM gates WHERE biased = 'mama'")
add("D10_quick_check", lambda s, d: gates(s, d).groupBy("doc_id").agg((F.count_if(F.col("blocked_by").isNull()) > 0).alias("apply"), F.array_join(F.array_sort(F.collect_set("blocked_by")), ",").alias("reasons")),
    f"WITH {GATES} SELECT doc_id, count(*) FILTER (WHERE blocked_by IS NULL) > 0 AS apply, coalesce(string_agg(DISTINCT blocked_by, ',' ORDER BY blocked_by), '') AS reasons FROM gates GROUP BY 1")
add("D17_skipped_terms", lambda s, d: gates(s, d).groupBy("biased", F.coalesce("blocked_by", F.lit("applied")).alias("outcome")).agg(F.count(F.lit(1)).alias("n")), f"WITH {GATES} SELECT biased, coalesce(blocked_by, 'applied') AS outcome, count(*) AS n FROM gates GROUP BY ALL")


def conditions(s: SparkSession, d: str) -> DataFrame:
    """The conditions that ``avoid_when`` cells name; the cells are the first words of the documents' lines and a name at a hashed place."""
    line = docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    name = F.get(F.array(*[F.lit(c) for c in (" Quote ", "legal", "Proper_Noun", "none", "ORGANIZATION|quote")]), (number(F.col("doc_id"), "name") % 5).cast("int"))
    words = F.replace(F.regexp_extract("line", LINE_START, 0), F.lit(" "), F.lit("|"))
    cell = F.when(F.col("k") % 2 == 0, F.concat_ws("|", words, name)).otherwise(F.concat_ws("|", name, words))
    return line.select("doc_id", "k", F.array_join(X.listed_conditions(cell), ",").alias("conditions"))


_known = ", ".join(f"'{c}'" for c in P.CONTEXTS)
add("D06_avoid_conditions", conditions, f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k, [' Quote ', 'legal', 'Proper_Noun', 'none', 'ORGANIZATION|quote'][{_number('name')} % 5 + 1] AS name FROM documents),
c AS (SELECT doc_id, k, CASE WHEN k % 2 = 0 THEN w || '|' || name ELSE name || '|' || w END AS cell FROM (SELECT *, replace(regexp_extract(line, '{LINE_START}'), ' ', '|') AS w FROM l))
SELECT doc_id, CAST(k AS INTEGER) AS k, array_to_string(list_filter(list_transform(string_split(cell, '|'), lambda c: lower(trim(c))), lambda c: c IN ({_known})), ',') AS conditions FROM c""")

# the cascade, over documents with lines of the second language at hashed places


def swahili(s: SparkSession, d: str) -> DataFrame:
    """Two of three documents count as the second language's; the others keep theirs."""
    return planted(s, d, _SW_LINES).withColumn("lang", F.when(number(F.col("doc_id"), "lang") % 3 < 2, "sw").otherwise(F.col("lang")))


def _found(table) -> str:
    """SQL: the first pattern of a table for the text's language, as struct(category, gender)."""
    return "CASE " + " ".join(f"WHEN lang = '{lang}' AND {_occurs(p.replace(chr(39), chr(39) * 2))} THEN {{'category': {_value(c)}, 'gender': {_value(g)}}}" for lang, p, c, g in table) + " END"


def _occurs(pattern: str) -> str:
    """SQL: a pattern occurs; one that ends in what must not follow occurs after those that are followed by it are taken out."""
    if "(?!" not in pattern:
        return f"regexp_matches(text, '{pattern}', 'i')"
    start, _, end = pattern.partition("(?!")
    return f"regexp_matches(regexp_replace(text, '{start}{end[:-1]}', '', 'gi'), '{start}', 'i')"


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'"


def _suffix() -> str:
    """SQL: the gender of the first suffix on an occupation."""
    out = []
    for _, pattern, gender in P.SUFFIXES:
        noun = f"lower(regexp_extract(text, '{pattern}', 1, 'i'))"
        begins = " OR ".join(f"starts_with({noun}, '{b}')" for b in P.OCCUPATION_BEGINNINGS)
        out.append(f"WHEN {noun} <> '' AND {noun} NOT IN ({_listed(P.NO_OCCUPATIONS)}) AND ({begins}) THEN '{gender}'")
    return f"CASE WHEN NOT regexp_matches(text, '{P.PROGRESS}', 'i') THEN CASE {' '.join(out)} END END"


def _cascade(texts: str, values: list[tuple[int, str, str]], rules: str, scores: str = "SELECT NULL AS doc_id, NULL AS score WHERE false") -> str:
    """SQL of the cascade over ``texts`` (doc_id, lang, text): CTE ``cascaded``."""
    return f"""{texts}, {_gates('texts', rules, values)},
first AS (SELECT *, {_found(P.COUNTER_STEREOTYPE)} AS counter, CASE WHEN NOT (lang = 'sw' AND regexp_matches(text, '{P.DEROGATION_REJECTED}', 'i')) THEN {_found(P.DEROGATION)} END AS derog,
  CASE WHEN lang = 'sw' THEN {_suffix()} END AS suffix FROM texts),
live AS (SELECT * FROM gates WHERE NOT (regexp_matches(biased, '{P.CHILD_TERM}', 'i') AND regexp_matches(text, '{P.CHILD_OF_SOMEONE}', 'i'))),
n AS (SELECT doc_id, count(*) FILTER (WHERE blocked_by IS NULL AND severity <> 'warn') AS n_replace, count(*) FILTER (WHERE blocked_by IS NULL AND severity = 'warn') AS n_warn, count(blocked_by) AS n_skipped,
  arg_min(stereotype_category, rule_no) FILTER (WHERE blocked_by IS NULL AND severity <> 'warn') AS lex FROM live GROUP BY 1),
scores AS ({scores}),
settled AS (
  SELECT f.doc_id, counter, derog, suffix, lex, CASE WHEN counter IS NOT NULL THEN 'counter-stereotype' WHEN derog IS NOT NULL THEN 'derogation' WHEN suffix IS NOT NULL THEN 'suffix' WHEN coalesce(n_replace, 0) > 0 THEN 'stereotype' ELSE 'neutral' END AS settled,
    CASE WHEN counter IS NULL AND derog IS NULL AND suffix IS NULL THEN coalesce(n_replace, 0) ELSE 0 END AS n_replace,
    CASE WHEN counter IS NULL AND derog IS NULL AND suffix IS NULL THEN coalesce(n_warn, 0) ELSE 0 END AS n_warn, CASE WHEN counter IS NULL AND derog IS NULL AND suffix IS NULL THEN coalesce(n_skipped, 0) ELSE 0 END AS n_skipped, score
  FROM first f LEFT JOIN n USING (doc_id) LEFT JOIN scores USING (doc_id)),
cascaded AS (
  SELECT doc_id, settled, n_replace, n_warn + CASE WHEN ml IS NULL THEN 0 ELSE 1 END AS n_warn, n_skipped, settled IN ('derogation', 'suffix', 'stereotype') AS has_bias, CASE settled WHEN 'suffix' THEN 'stereotype' ELSE settled END AS bias_label,
    coalesce(counter.category, derog.category, CASE WHEN suffix IS NOT NULL THEN 'profession' END, CASE WHEN settled IN ('stereotype', 'neutral') THEN lex END) AS category, coalesce(counter.gender, derog.gender, suffix) AS gender,
    coalesce(ml, CASE settled {' '.join(f"WHEN '{k}' THEN {v}" for k, v in X.CONFIDENCE.items())} END) AS confidence
  FROM (SELECT *, CASE WHEN settled = 'neutral' AND n_replace = 0 AND n_warn = 0 AND score >= 0.75 THEN score END AS ml FROM settled))"""


_ALL = [(i, b, a) for i, (b, _, a) in enumerate(GATED)]
SWAHILI = _cascade(f"{_planted(_SW_LINES)}, texts AS (SELECT doc_id, CASE WHEN {_number('lang')} % 3 < 2 THEN 'sw' ELSE lang END AS lang, text, line FROM planted)", _ALL, _RULES)
add("D11_swahili_cascade", lambda s, d: X.cascade(swahili(s, d), gated_lexicon(s)).select("doc_id", "settled", "category", "gender", F.round("confidence", 6).alias("confidence")), f"WITH {SWAHILI} SELECT doc_id, settled, category, gender, CAST(confidence AS DOUBLE) AS confidence FROM cascaded")
add("D15_child_terms", lambda s, d: X.cascade(swahili(s, d).withColumn("lang", F.lit("none")), gated_lexicon(s).where("biased = 'mtoto wa kike'")).select("doc_id", "settled", F.col("n_replace").cast("long").alias("n_replace")),
    f"WITH {SWAHILI.replace('THEN ' + chr(39) + 'sw' + chr(39) + ' ELSE lang END AS lang', 'THEN ' + chr(39) + 'none' + chr(39) + ' ELSE ' + chr(39) + 'none' + chr(39) + ' END AS lang')}, c AS (SELECT doc_id, count(*) AS n FROM live WHERE biased = 'mtoto wa kike' GROUP BY 1) SELECT doc_id, CASE WHEN n > 0 THEN 'stereotype' ELSE 'neutral' END AS settled, coalesce(n, 0) AS n_replace FROM documents LEFT JOIN c USING (doc_id)")
TEXTS = "texts AS (SELECT doc_id, lang, text FROM documents)"
_LABELS = "SELECT doc_id, max(0.5 + toxic * 0.4) AS score FROM labels GROUP BY 1"
model = lambda s, d: R.table(s, d, "labels").groupBy("doc_id").agg(F.max(0.5 + F.col("toxic") * 0.4).alias("score"))
CASCADE = _cascade(TEXTS, _ALL, _RULES, _LABELS)
add("D16_cascade", lambda s, d: X.cascade(docs(s, d), gated_lexicon(s), model(s, d)).withColumn("confidence", F.round("confidence", 6)).withColumns({c: F.col(c).cast("long") for c in ("n_replace", "n_warn", "n_skipped")}),
    f"WITH {CASCADE} SELECT doc_id, settled, n_replace, n_warn, n_skipped, has_bias, bias_label, category, gender, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM cascaded")
add("D20_model_fallback", lambda s, d: X.cascade(docs(s, d), gated_lexicon(s).where("severity = 'replace'"), model(s, d)).select("doc_id", "settled", F.col("n_warn").cast("long").alias("n_warn"), F.round("confidence", 6).alias("confidence")),
    f"WITH {CASCADE.replace('FROM gates WHERE NOT', 'FROM gates WHERE severity = ' + chr(39) + 'replace' + chr(39) + ' AND NOT')} SELECT doc_id, settled, n_warn, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM cascaded")

_four = [(i, b, a) for i, (b, a) in enumerate((r[1], "quote|statistical|legal" if r[0] % 2 == 0 else "biographical") for r in R.lexicon_rows())]
_four_rules = ", ".join(f"({r[0]}, '{r[1]}', '{r[2]}', '{r[3]}', '{r[4]}', '')" for r in R.lexicon_rows())
add("D04_context_gate", lambda s, d: X.gated_matches(docs(s, d), R.lexicon(s).withColumn("avoid_when", F.when(F.col("rule_no") % 2 == 0, "quote|statistical|legal").otherwise("biographical"))).select("doc_id", "rule_no", "blocked_by"),
    f"WITH {TEXTS}, {_gates('texts', _four_rules, _four)} SELECT doc_id, rule_no, blocked_by FROM gates")
