"""Queries on sources, sinks, records and streams, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions import patterns as P
from lexiscope.functions import text as T
from lexiscope.operators import correct as C
from lexiscope.operators import datasets as D
from lexiscope.operators import detect as X
from lexiscope.operators import lexicon as L
from lexiscope.operators import metrics as M
from lexiscope.operators import mining as N
from lexiscope.operators import prepare as G
from lexiscope.operators import quality as Q
from lexiscope.operators import records as E
from lexiscope.operators import validate as V
from lexiscope.plans import metrics_queries
from lexiscope.plans import roles as R
from lexiscope.sources import files as S
from lexiscope.sources.scratch import scratch
from lexiscope.streaming import jobs as J

QUERIES, ORACLES = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


docs = lambda s, d: R.table(s, d, "documents")
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
flat = lambda c="text": F.trim(F.regexp_replace(c, r"[\r\n\t ]+", " "))
_FLAT = r"trim(regexp_replace(text, '[\r\n\t ]+', ' ', 'g'), ' ')"


def written(s, df, kind, **options):
    """``df`` written in a format; the folder."""
    at = scratch(s)
    df.write.format(kind).options(**options).save(at)
    return at


CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}

# sources

lexicon_file = lambda s, d: written(s, docs(s, d).select(F.col("lang").alias("language"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.lit("t"), "doc_id")).alias("biased"), F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("source")).alias("neutral_primary"), F.when(F.col("doc_id") % 2 == 0, "a| b").otherwise("").alias("tags")), "csv", **CSV)


def full_lexicon(s, d):
    cells = {"language": F.col("lang"), "biased": F.concat(F.lit("t"), "doc_id"), "neutral_primary": F.when(F.col("doc_id") % 4 != 0, F.col("source"))}
    return written(s, docs(s, d).select(*[cells.get(c, F.lit(None).cast("string")).alias(c) for c in S.LEXICON]), "csv", **CSV)


add("S01_lexicon_scan", lambda s, d: S.read_lexicon(s, full_lexicon(s, d)).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("neutral_primary") == "").alias("empty"), F.count_if(F.col("severity").isNull()).alias("nulls"), F.count_distinct("rule_no").alias("numbers")),
    "SELECT lang AS language, count(*) AS n, count(*) FILTER (WHERE doc_id % 4 = 0) AS empty, 0 AS nulls, count(*) AS numbers FROM documents GROUP BY lang")
add("S02_typed_lexicon", lambda s, d: S.read_typed_lexicon(s, lexicon_file(s, d)).groupBy("language", "severity", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tags")).cast("long").alias("tags")),
    "SELECT lang AS language, 'replace' AS severity, 'noun' AS pos, count(*) AS n, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS tags FROM documents WHERE doc_id % 9 <> 0 GROUP BY lang")


def versioned(s, d):
    at = scratch(s)
    terms = docs(s, d).select("lang", F.col("lang").alias("language"), F.concat(F.lit("t"), "doc_id").alias("biased"))
    for lang, name in (("en", "lexicon_en_v2.csv"), ("fr", "lexicon_fr.csv")):
        terms.where(F.col("lang") == lang).drop("lang").write.options(**CSV).csv(f"{at}/{name}")
    return S.read_versioned(s, at, "lexicon", "en", {"en": "v2", "fr": "v9"}).unionByName(S.read_versioned(s, at, "lexicon", "fr", {"en": "v2", "fr": "v9"})).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


add("S03_versioned_file", versioned, "SELECT lang AS language, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang")
truth_file = lambda s, d: written(s, R.truth(s, d).select(F.concat(F.lit('"'), "text", F.lit('"')).alias("text"), F.when(F.col("has_bias"), "TRUE").otherwise("false").alias("has_bias"), F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "Occupation").otherwise("unheard-of").alias("bias_category"), F.when(F.col("doc_id") % 2 == 0, "Counter_Stereotype").otherwise("N/A").alias("bias_label"), F.col("doc_id").cast("string").alias("bias_severity")), "csv", **CSV)
add("S04_truth_scan", lambda s, d: S.read_truth(s, truth_file(s, d), ["occupation"], {"bias_label": ["counter-stereotype", "neutral"]}).groupBy("has_bias", "bias_category", "bias_label").agg(F.count(F.lit(1)).alias("n"), F.sum("bias_severity").cast("long").alias("severity"), F.sum(F.length("text")).cast("long").alias("chars")),
    f"WITH {R.TRUTH} SELECT has_bias, CASE doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'occupation' ELSE 'stereotype' END AS bias_category, CASE WHEN doc_id % 2 = 0 THEN 'counter-stereotype' END AS bias_label, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS severity, CAST(sum(length(trim(text, chr(34)))) AS BIGINT) AS chars FROM truth GROUP BY ALL")
add("S06_log_scan", lambda s, d: S.read_log(s, written(s, docs(s, d).select(F.when(F.col("doc_id") % 10 == 0, "{broken").otherwise(F.to_json(F.struct("doc_id", "lang", F.col("n_chars").alias("timestamp")))).alias("value")), "text"), "doc_id long, lang string, timestamp long").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("newest")),
    "SELECT lang, count(*) AS n, max(n_chars) AS newest FROM documents WHERE doc_id % 10 <> 0 GROUP BY lang")
texts_of = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
_TEXTS = f"SELECT count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT {_FLAT} AS t FROM documents) WHERE t <> ''"
_WHOLE = "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE trim(text, ' ') <> ''"
either = lambda s, d: docs(s, d).select(F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("sentence"), F.when(F.col("doc_id") % 2 == 1, F.col("text")).alias("content"))
add("S07_json_texts", lambda s, d: texts_of(S.read_texts(s, written(s, either(s, d), "json"), "jsonl")), _WHOLE)
add("S08_csv_texts", lambda s, d: texts_of(S.read_texts(s, written(s, either(s, d), "csv", **CSV), "csv")), _WHOLE)
add("S15_news_texts", lambda s, d: texts_of(S.read_texts(s, written(s, either(s, d), "json"), "jsonl").unionByName(S.read_texts(s, written(s, docs(s, d).select(flat().alias("value")), "text"), "plain"))), f"SELECT w.n + t.n AS n, w.chars + t.chars AS chars FROM ({_WHOLE}) w, ({_TEXTS}) t")


def conll_texts(s, d):
    words = F.filter(F.split(flat(), " "), lambda w: w != "")
    at = written(s, docs(s, d).select(F.concat(F.array_join(F.transform(words, lambda w: F.concat(w, F.lit(" O"))), "\n"), F.lit("\n")).alias("value")), "text")
    return texts_of(S.read_texts(s, at, "conll"))


add("S10_conll_texts", conll_texts, _TEXTS)


def sniffed(s, d):
    at = scratch(s)
    docs(s, d).select("doc_id", "lang").write.json(f"{at}/a_json")
    docs(s, d).select("doc_id", "lang", "source").write.options(**CSV).csv(f"{at}/b_csv")
    docs(s, d).select(F.concat_ws(" ", "source", F.lit("O")).alias("value")).write.text(f"{at}/c_conll")
    docs(s, d).select(F.concat(F.lit("This is a line of source "), "source").alias("value")).write.text(f"{at}/d_plain")
    return S.sniffed_formats(s, f"{at}/*").select(F.regexp_extract("file", r"/([a-d]_[a-z]+)/", 1).alias("folder"), "kind").distinct()


add("S12_sniffed_formats", sniffed, "SELECT * FROM (VALUES ('a_json', 'json'), ('b_csv', 'csv'), ('c_conll', 'conll'), ('d_plain', 'plain')) t(folder, kind) WHERE (SELECT count(*) FROM documents) > 0")


def tree(s, d):
    at = scratch(s)
    docs(s, d).select("doc_id", "source", F.col("lang").alias("folder")).write.partitionBy("folder").options(**CSV).csv(at)
    back = S.read_tree(s, at)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_id").cast("long")).alias("ids"), F.bool_and(F.col("source_file").endswith(".csv")).alias("named"))


add("S13_file_tree", tree, "SELECT source, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, true AS named FROM documents GROUP BY source")
add("S14_merged_sources", lambda s, d: S.merged_sources({"documents": docs(s, d).select("text"), "benchmark": R.table(s, d, "benchmark").select("text"), "conversations": R.table(s, d, "conversations").select("text", "role")}, "2025-12-03", {"benchmark": "urn:benchmark"}).groupBy("source_file", "source_url").agg(F.count(F.lit(1)).alias("n"), F.count("role").alias("roles"), F.date_format(F.max("collection_date"), "yyyy-MM-dd").alias("collected")),
    "SELECT 'documents' AS source_file, CAST(NULL AS VARCHAR) AS source_url, count(*) AS n, 0 AS roles, '2025-12-03' AS collected FROM documents UNION ALL SELECT 'benchmark', 'urn:benchmark', count(*), 0, '2025-12-03' FROM benchmark UNION ALL SELECT 'conversations', NULL, count(*), count(role), '2025-12-03' FROM conversations")


def entries(s, d):
    """One JSON entry a document, of four shapes, in one file."""
    own = F.col("text")
    one = F.to_json(F.struct(own.alias("sentence"), F.col("lang").alias("note"), F.lit(3).alias("text")))
    many = F.concat(F.lit('{"sentences": ['), F.to_json(F.struct(own.alias("x"))), F.lit(", 7, null, "), F.regexp_replace(F.to_json(F.struct(own.alias("x"))), r'^\{"x":|\}$', ""), F.lit("]}"))
    other = F.to_json(F.struct(F.concat(own, F.lit(". ")).alias("a"), F.col("source").alias("b"), own.alias("c"), F.col("doc_id").alias("d")))
    at = written(s, docs(s, d).select(F.get(F.array(one, many, other, F.lit('{"broken": ')), (F.col("doc_id") % 4).cast("int")).alias("value")), "text")
    return s.read.text(at).withColumnRenamed("value", "entry")


add("S18_candidate_sentences", lambda s, d: S.candidate_sentences(entries(s, d)).select(F.md5("text").alias("digest")),
    """WITH e AS (SELECT CASE doc_id % 4 WHEN 0 THEN json_object('sentence', text, 'note', lang, 'text', 3) WHEN 1 THEN json_object('sentences', json_array(json_object('x', text), 7, NULL, text)) WHEN 2 THEN json_object('a', text || '. ', 'b', source, 'c', text, 'd', doc_id) END AS j FROM documents WHERE text IS NOT NULL),
n AS (SELECT j, list_filter(list_concat([j -> '$.sentence', j -> '$.text', j -> '$.template', j -> '$.sent'], coalesce(CAST(j -> '$.sentences' AS JSON[]), [])), lambda x: json_type(x) = 'VARCHAR') AS named FROM e WHERE j IS NOT NULL),
a AS (SELECT CASE WHEN len(named) > 0 THEN named ELSE list_filter(list_transform(json_keys(j), lambda k: j -> k), lambda x: json_type(x) = 'VARCHAR' AND length(x ->> '$') > 20 AND regexp_matches(trim(x ->> '$'), '[.?!]$')) END AS found FROM n)
SELECT md5(x ->> '$') AS digest FROM (SELECT unnest(found) AS x FROM a)""")
add("S19_first_usable", lambda s, d: S.first_usable(docs(s, d).orderBy("doc_id").select("source", flat().alias("text")), ["source", "text"], 40).select(F.md5("text").alias("digest")), f"SELECT md5(t) AS digest FROM (SELECT doc_id, {_FLAT} AS t FROM documents) WHERE length(t) >= 20 ORDER BY doc_id LIMIT 40")


def nested(s, d):
    one = lambda who, c: F.struct(F.lit(who).alias("annotator"), F.array(F.struct(F.lit("label").alias("from_name"), F.col(c).cast("string").alias("value")), F.struct(F.lit("lang").alias("from_name"), F.lit("en").alias("value"))).alias("result"))
    tasks = R.table(s, d, "labels").select(F.col("doc_id").alias("id"), F.array(one("ann", "toxic"), one("bob", "quality")).alias("annotations"))
    back = s.read.schema(tasks.schema).json(written(s, tasks, "json"))
    return S.flattened_export(back).groupBy("annotator", F.col("choices")["label"].alias("label")).agg(F.count(F.lit(1)).alias("n"))


add("S20_nested_export", nested, "SELECT annotator, label, count(*) AS n FROM (SELECT 'ann' AS annotator, CAST(toxic AS VARCHAR) AS label FROM labels UNION ALL SELECT 'bob', CAST(quality AS VARCHAR) FROM labels) GROUP BY ALL")


def batches(s, d):
    at = scratch(s)
    turns = R.table(s, d, "conversations").select(F.col("conv_id").alias("batch_id"), F.lit("en").alias("language"), F.lit("ann").alias("annotator_id"), "turn", "role")
    S.write_batches(turns, at, ["batch_id", "language", "annotator_id"], "turn")
    back = s.read.schema("batch_id long, language string, annotator_id string, samples array<struct<turn:long,role:string>>").json(at)
    return S.batch_rows(back).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("turn").alias("turns"), F.sum("pos").cast("long").alias("places"))


add("S21_batch_files", batches, "SELECT role, count(*) AS n, CAST(sum(turn) AS BIGINT) AS turns, CAST(sum(p) AS BIGINT) AS places FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS p FROM conversations) GROUP BY role")

# sinks


def truth_sink(s, d):
    at = scratch(s)
    rows = R.samples(s, d).withColumn("has_bias", F.col("has_bias").cast("string")).withColumn("ml_prediction", F.col("ml_prediction").cast("string"))
    S.write_table(S.projected(rows, S.TRUTH_COLUMNS), f"{at}/full")
    S.write_table(S.projected(rows, S.CORE_COLUMNS), f"{at}/core")
    full, core = (S.read_csv(s, f"{at}/{x}") for x in ("full", "core"))
    count = lambda df, name: df.agg(F.lit(name).alias("file"), F.lit(len(df.columns)).alias("columns"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("has_bias") == "true").alias("biased"), F.count("bias_category").alias("categories"), F.sum(F.length("text")).cast("long").alias("chars"))
    return count(full, "full").unionByName(count(core, "core"))


add("S25_truth_sink", truth_sink, f"WITH {R.SAMPLES}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE has_bias) AS biased, count(bias_category) AS categories, CAST(sum(length(text)) AS BIGINT) AS chars FROM samples) SELECT 'full' AS file, 24 AS columns, * FROM c UNION ALL SELECT 'core', 8, * FROM c")
report = lambda s, d: M.metrics_by(R.judged(s, d), [["lang"], []])


def report_sink(s, d):
    at = scratch(s)
    S.write_table(S.report_rows(report(s, d)), at)
    return s.read.option("header", True).csv(at).select("lang", "tp", "fp", "fn", "tn", F.col("precision").rlike(r"^\d\.\d{3}$").alias("three_digits"))


add("S26_report_sink", report_sink, f"WITH {R.JUDGED} SELECT coalesce(lang, 'OVERALL') AS lang, CAST(tp AS VARCHAR) AS tp, CAST(fp AS VARCHAR) AS fp, CAST(fn AS VARCHAR) AS fn, CAST(tn AS VARCHAR) AS tn, true AS three_digits FROM (SELECT lang, {R.CELLS} FROM judged GROUP BY GROUPING SETS ((lang), ()))")


def text_sink(s, d):
    at = written(s, S.text_report(S.lineage(docs(s, d), "documents", "unknown")), "text")
    return s.read.text(at)


add("S27_text_report", text_sink, "SELECT unnest(['samples: ' || count(*), 'languages: ' || count(DISTINCT lang), 'characters: ' || CAST(sum(length(text)) AS BIGINT), 'source: documents', 'license: unknown']) AS value FROM documents")
add("S24_lineage_record", lambda s, d: S.lineage(docs(s, d), "documents", "unknown"), "SELECT count(*) AS samples, count(DISTINCT lang) AS languages, CAST(sum(length(text)) AS BIGINT) AS characters, 'documents' AS source, 'unknown' AS license FROM documents")


def latest(s, d):
    cells = report(s, d).select("lang", "tp")
    reports = [cells.withColumn("source_file", F.lit(x)) for x in ("report_1.csv", "report_2.csv")]
    return S.latest_report(reports[0].unionByName(reports[1])).select("source_file", "lang", "tp")


add("S29_latest_report", latest, f"WITH {R.JUDGED} SELECT 'report_2.csv' AS source_file, 'OVERALL' AS lang, count(*) FILTER (WHERE has_bias AND predicted) AS tp FROM judged")
add("S29_rule_counts", lambda s, d: S.rule_counts(S.read_lexicon(s, full_lexicon(s, d))), "SELECT lang AS language, count(*) AS rules FROM documents GROUP BY lang")


def disagreement_sink(s, d):
    at = scratch(s)
    rows = R.samples(s, d).where("ml_prediction <> has_bias").withColumn("has_bias", F.col("has_bias").cast("string"))
    S.write_table(S.projected(rows, S.DISAGREEMENT_COLUMNS), at)
    back = S.read_csv(s, at)
    return back.groupBy("annotator_id", "confidence").agg(F.count(F.lit(1)).alias("n"), F.lit(len(back.columns)).alias("columns"), F.sum(F.length("text")).cast("long").alias("chars"))


add("S31_disagreement_sink", disagreement_sink, f"WITH {R.SAMPLES} SELECT annotator_id, confidence, count(*) AS n, 7 AS columns, CAST(sum(length(text)) AS BIGINT) AS chars FROM samples WHERE ml_prediction <> has_bias GROUP BY ALL")


def annotator_files(s, d):
    at = scratch(s)
    rows = R.ratings(s, d)
    S.write_table(rows, f"{at}/rows", by=["annotator"])
    S.annotator_summary(rows).write.json(f"{at}/summary")
    back = s.read.option("header", True).csv(f"{at}/rows").groupBy("annotator").agg(F.count(F.lit(1)).alias("n"))
    return back.join(F.broadcast(s.read.schema("tasks_total long, tasks_with_2_annotations long, annotators string").json(f"{at}/summary")))


add("S32_annotator_files", annotator_files, f"WITH {R.RATINGS} SELECT annotator, count(*) AS n, (SELECT count(DISTINCT doc_id) FROM ratings) AS tasks_total, (SELECT count(DISTINCT doc_id) FROM ratings) AS tasks_with_2_annotations, 'a,b,c' AS annotators FROM ratings GROUP BY annotator")

# records
add("P14_strict_labels", lambda s, d: E.strict_labels(docs(s, d).select(F.when(F.col("doc_id") % 5 != 0, F.col("text")).otherwise(" ").alias("text"), F.when(F.col("doc_id") % 3 == 0, "True").when(F.col("doc_id") % 3 == 1, "false ").otherwise("maybe").alias("has_bias"))).groupBy("valid", F.col("y").cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT valid, CASE WHEN valid THEN CAST(CAST(doc_id % 3 = 0 AS INT) AS VARCHAR) END AS y, count(*) AS n FROM (SELECT doc_id, doc_id % 5 <> 0 AND trim(text, ' ') <> '' AND doc_id % 3 <> 2 AS valid FROM documents) GROUP BY ALL")
add("P19_category_groups", lambda s, d: R.samples(s, d).select("doc_id", E.category_group(F.col("bias_category")).alias("grp")), f"WITH {R.SAMPLES} SELECT doc_id, CASE WHEN bias_category IS NOT NULL THEN 'female_referent' ELSE 'neutral_referent' END AS grp FROM samples")
add("P21_in_quotes", lambda s, d: docs(s, d).select("doc_id", T.in_quotes(F.col("text"), F.lit("the")).alias("quoted")), """SELECT doc_id, regexp_matches(text, '"[^"]*the[^"]*"', 'i') OR regexp_matches(text, '''[^'']*the[^'']*''', 'i') AS quoted FROM documents""")
add("P23_attribution", lambda s, d: E.attributed(docs(s, d).select("doc_id", "text", F.col("source").alias("data_source"), F.when(F.col("doc_id") % 2 == 0, "seen").otherwise("").alias("notes")), {"src0": ("Zero", "urn:0"), "web": ("Web", "urn:w")}, [("http", "web")]).select("doc_id", "source_name", "source_url", "notes"),
    "WITH t AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'Zero' WHEN contains(lower(text), 'http') THEN 'Web' END AS source_name FROM documents) SELECT doc_id, source_name, CASE source_name WHEN 'Zero' THEN 'urn:0' WHEN 'Web' THEN 'urn:w' END AS source_url, concat_ws('; ', CASE WHEN doc_id % 2 = 0 THEN 'seen' END, 'source: ' || source_name) AS notes FROM t")
add("J02_paired", lambda s, d: E.paired(R.truth(s, d).select("doc_id", "has_bias"), R.judged(s, d).select("doc_id", "predicted"), "doc_id"), f"WITH {R.JUDGED} SELECT doc_id, has_bias, predicted FROM judged")
two_sides = lambda s, d: R.samples(s, d).select("doc_id", F.col("bias_category").alias("cat_a"), F.when(F.col("doc_id") % 4 != 0, F.col("bias_category")).otherwise("other").alias("cat_b"), F.col("demographic_group").alias("grp_a"), F.when(F.col("doc_id") % 5 != 0, F.upper("demographic_group")).otherwise("neutral").alias("grp_b"))
_k = "WITH x AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT field, count(*) AS n, sum(CAST(a = b AS INT)) AS same FROM x GROUP BY field), m AS (SELECT field, label, sum(x) * sum(y) AS c FROM (SELECT field, a AS label, 1 AS x, 0 AS y FROM x UNION ALL SELECT field, b, 0, 1 FROM x) GROUP BY ALL), e AS (SELECT field, sum(c) AS c FROM m GROUP BY field) SELECT field, n, round(CASE WHEN c / n / n >= 1 THEN 1 ELSE (same / n - c / n / n) / (1 - c / n / n) END, 4) AS kappa FROM n JOIN e USING (field) WHERE n >= 2"
add("A17_kappa_by_column", lambda s, d: E.kappa_by_column(two_sides(s, d), ["cat", "grp"]),
    f"WITH {R.SAMPLES}, p AS (SELECT 'cat' AS field, bias_category AS a, CASE WHEN doc_id % 4 <> 0 THEN bias_category ELSE 'other' END AS b FROM samples UNION ALL SELECT 'grp', demographic_group, CASE WHEN doc_id % 5 <> 0 THEN demographic_group ELSE 'neutral' END FROM samples), {_k[5:]}")
add("A19_disagreements", lambda s, d: E.disagreements(R.judged(s, d), "has_bias", "predicted", ["doc_id", "lang"]), f"WITH {R.JUDGED} SELECT doc_id, lang, has_bias, predicted FROM judged WHERE has_bias <> predicted")
add("A24_review_bundle", lambda s, d: E.review_bundle(R.judged(s, d), R.ratings(s, d), "a", "b"),
    f"""WITH {R.RATINGS}, m AS (SELECT count(*) AS samples, round(avg(CAST(predicted = has_bias AS INT)), 6) AS hmar, round(coalesce(avg(CASE WHEN has_bias THEN CAST(predicted = has_bias AS INT) END), 0), 6) AS bias_detected, round(coalesce(avg(CASE WHEN NOT has_bias THEN CAST(predicted = has_bias AS INT) END), 0), 6) AS no_bias FROM judged),
c AS (SELECT count(*) AS n, avg(CAST(has_bias = predicted AS INT)) AS po, avg(CAST(has_bias AS INT)) AS pa, avg(CAST(predicted AS INT)) AS pb FROM judged), k AS (SELECT round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) >= 1 THEN 0 ELSE greatest(0, (po - pa * pb - (1 - pa) * (1 - pb)) / (1 - pa * pb - (1 - pa) * (1 - pb))) END, 6) AS kappa FROM c),
i AS (SELECT doc_id, count(*) FILTER (WHERE label) AS n1, count(*) FILTER (WHERE NOT label) AS n0 FROM ratings GROUP BY doc_id), t AS (SELECT sum(n1 * n0) / sum((n1 + n0) * (n1 + n0 - 1) / 2) AS d_o, sum(n1) / sum(n1 + n0) AS p FROM i), a AS (SELECT round(greatest(0, least(1, 1 - d_o / (2 * p * (1 - p)))), 6) AS alpha FROM t)
SELECT samples, hmar, bias_detected, no_bias, kappa, alpha, 3 AS annotators, hmar >= 0.8 AS hmar_ok, kappa >= 0.7 AS kappa_ok, alpha >= 0.8 AS alpha_ok FROM m, k, a""")
add("A31_multi_batch_report", lambda s, d: E.multi_batch_report(Q.quality_score(R.samples(s, d), "annotator_id", ["text", "confidence"], ["ts", "doc_id"])),
    f"""WITH r AS (SELECT count(*) AS batches, round(coalesce(avg(score), 0), 4) AS mean_score, count(*) FILTER (WHERE NOT confidence_ok) AS failed_confidence, count(*) FILTER (WHERE NOT bias_ok) AS failed_bias,
  count(*) FILTER (WHERE NOT schema_ok) AS failed_schema, count(*) FILTER (WHERE NOT consistent_ok) AS failed_consistent, count(*) FILTER (WHERE fatigue) AS failed_fatigue FROM ({metrics_queries.ORACLES['A30_quality_score']}))
SELECT *, CASE WHEN mean_score >= 80 THEN 'Excellent' WHEN mean_score >= 60 THEN 'Good' WHEN mean_score >= 40 THEN 'Fair' ELSE 'Poor' END AS assessment, mean_score >= 60 AS passes FROM r""")
add("A46_field_report", lambda s, d: E.field_report(R.samples(s, d), ["bias_category", "expected_correction", "lang"], ["lang", "confidence"]),
    f"WITH {R.SAMPLES} SELECT * FROM (SELECT unnest(['bias_category', 'expected_correction', 'lang']) AS field, CAST(NULL AS VARCHAR) AS value, unnest([count(bias_category), count(expected_correction), count(lang)]) AS n, round(100 * unnest([count(bias_category), count(expected_correction), count(lang)]) / count(*), 4) AS percent FROM samples) UNION ALL SELECT 'lang', lang, count(*), round(100 * count(*) / sum(count(*)) OVER (), 4) FROM samples GROUP BY lang UNION ALL SELECT 'confidence', confidence, count(*), round(100 * count(*) / sum(count(*)) OVER (), 4) FROM samples GROUP BY confidence")
migrated = lambda s, d: R.truth(s, d).select(F.when(F.col("has_bias"), "stereotype").otherwise("neutral").alias("bias_label"), F.when(F.col("doc_id") % 4 == 0, "irony").otherwise("").alias("device"), F.when(F.col("doc_id") % 3 == 0, "profession").alias("stereotype_category"))
add("A47_migration_statistics", lambda s, d: E.migration_statistics(migrated(s, d)),
    f"WITH {R.TRUTH}, t AS (SELECT CASE WHEN has_bias THEN 'stereotype' ELSE 'neutral' END AS l, doc_id FROM truth) SELECT * FROM (SELECT 'total_rows' AS statistic, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM t UNION ALL SELECT 'bias_label', l, count(*) FROM t GROUP BY l UNION ALL SELECT 'device', 'irony', count(*) FROM t WHERE doc_id % 4 = 0 UNION ALL SELECT 'needs_manual_review', NULL, count(*) FROM t WHERE l <> 'neutral' AND doc_id % 3 <> 0) WHERE n > 0")
_md = lambda k, seed: f"md5(CAST({k} AS VARCHAR) || '-{seed}')"
add("M08_split_summary", lambda s, d: E.split_summary(D.stratified_split(R.truth(s, d).select("doc_id", "has_bias"), "has_bias", "doc_id", 0.15)),
    f"WITH {R.TRUTH}, p AS (SELECT has_bias, CASE WHEN row_number() OVER (PARTITION BY has_bias ORDER BY {_md('doc_id', 42)}) <= greatest(1, floor(count(*) OVER (PARTITION BY has_bias) * 0.15)) THEN 'val' ELSE 'train' END AS split FROM truth) SELECT split, has_bias, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY split), 4) AS percent FROM p GROUP BY split, has_bias")
add("M10_oversample_after_split", lambda s, d: D.oversampled(D.stratified_split(R.truth(s, d).select("doc_id", "has_bias"), "has_bias", "doc_id", 0.2).where("split = 'train'"), F.col("has_bias"), "doc_id", 0.25).groupBy("has_bias").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {R.TRUTH}, p AS (SELECT has_bias, row_number() OVER (PARTITION BY has_bias ORDER BY {_md('doc_id', 42)}) > greatest(1, floor(count(*) OVER (PARTITION BY has_bias) * 0.2)) AS train FROM truth), c AS (SELECT count(*) FILTER (WHERE has_bias) AS few, count(*) FILTER (WHERE NOT has_bias) AS many FROM p WHERE train) SELECT has_bias, CASE WHEN has_bias THEN greatest(few, CAST(floor(many * 0.25 / 0.75) AS BIGINT)) ELSE many END AS n FROM c, (VALUES (true), (false)) v(has_bias)")
add("M13_annotation_rows", lambda s, d: E.annotation_rows(docs(s, d).select("doc_id", "source", "text", T.terms_found(F.col("text"), ["he", "idiot", "the"]).alias("terms")).where(F.size("terms") > 0), ["doc_id"], "2025-12-03").select("id", "source_ref", "topic", "notes", "language", "qa_status", F.md5("text").alias("digest")),
    f"WITH t AS (SELECT doc_id, source, text, list_filter(['he', 'idiot', 'the'], lambda x: list_contains({TOK}, x)) AS w FROM documents) SELECT 'SW-NEWS-' || lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), 5, '0') AS id, source AS source_ref, array_to_string(w, ',') AS topic, 'Occupation terms: ' || array_to_string(w, ', ') AS notes, 'sw' AS language, 'needs_review' AS qa_status, md5(text) AS digest FROM t WHERE len(w) > 0")
add("M04_verse_rows", lambda s, d: E.annotation_rows(R.table(s, d, "conversations").select("conv_id", "turn", F.col("role").alias("source"), "text", F.array(F.lit("verse")).alias("terms")), ["conv_id", "turn", "source"], "2025-12-03", prefix="KI-", cells={"language": "ki", "domain": "religious_text", "device": "scripture_quote"}).groupBy("source_ref", "language", "domain", "device").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")),
    "SELECT role AS source_ref, 'ki' AS language, 'religious_text' AS domain, 'scripture_quote' AS device, count(*) AS n, min(id) AS first_id FROM (SELECT role, 'KI-' || lpad(CAST(row_number() OVER (ORDER BY conv_id, turn, role) AS VARCHAR), 5, '0') AS id FROM conversations) GROUP BY role")
add("M03_inferred_labels", lambda s, d: docs(s, d).select("doc_id", E.inferred_label(F.col("text"), ["idiot", "trash"], ["elle"]).alias("label")), "SELECT doc_id, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'trash') THEN 'derogation' WHEN contains(lower(text), 'elle') THEN 'counter-stereotype' ELSE 'stereotype' END AS label FROM documents")
add("T08_example_sentences", lambda s, d: E.example_sentences(N.mined_sentences(docs(s, d), ["idiot", "he"]), ["doc_id", "pos"], 25, "EX-").select("id", "doc_id", F.col("pos").cast("long").alias("pos")),
    r"""WITH sent AS (SELECT doc_id, unnest(p) AS sentence, unnest(range(len(p))) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 40 AND 200) AS p FROM documents)), f AS (SELECT doc_id, pos FROM sent WHERE list_has_any(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+'), ['idiot', 'he']) ORDER BY doc_id, pos LIMIT 25) SELECT 'EX-' || lpad(CAST(row_number() OVER (ORDER BY doc_id, pos) AS VARCHAR), 4, '0') AS id, doc_id, pos FROM f""")
add("F06_pronoun_forms", lambda s, d: docs(s, d).select("doc_id", F.md5(E.without_pronoun(F.concat(F.lit("Yeye ni x, yeye anafanya "), "text"))).alias("digest")), "SELECT doc_id, md5(replace(replace(replace(replace('Yeye ni x, yeye anafanya ' || text, 'Yeye ni', 'Ni'), 'yeye ni', 'ni'), 'Yeye anafanya', 'Anafanya'), 'yeye anafanya', 'anafanya')) AS digest FROM documents")
add("F02_letter_tokens", lambda s, d: docs(s, d).select("doc_id", F.size(T.letter_tokens(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(T.letter_tokens(F.col("text")), " ")).alias("digest")), r"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}''’]+') AS w FROM documents)")
add("F03_stripped_tokens", lambda s, d: docs(s, d).select("doc_id", F.size(T.stripped_tokens(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(T.stripped_tokens(F.col("text")), " ")).alias("digest")), r"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(text, ' '), '\s+'), lambda x: trim(x, '.,!?;:')), lambda x: x <> '') AS w FROM documents)")
add("F05_capitalized", lambda s, d: docs(s, d).select("doc_id", T.capitalized(F.concat_ws(" ", F.upper("lang"), "source")).alias("form")), "SELECT doc_id, upper(x[1]) || lower(x[2:]) AS form FROM (SELECT doc_id, concat_ws(' ', upper(lang), source) AS x FROM documents)")
_KINDS = ("email", "url", "ssn", "credit_card", "id_number")
add("F08_pii_found", lambda s, d: docs(s, d).select("doc_id", T.pii_found(F.col("text")).alias("m")).select("doc_id", *[F.array_join(F.col("m")[k], "|").alias(k) for k in _KINDS]), "SELECT doc_id, " + ", ".join(f"array_to_string(regexp_extract_all(text, '{T.PII[k]}'), '|') AS {k}" for k in _KINDS) + " FROM documents")
add("F10_durations", lambda s, d: R.table(s, d, "events").groupBy("user_id").agg(F.round(E.minutes_between(F.min("ts"), F.max("ts")), 6).alias("minutes"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("last")), "SELECT user_id, round((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60.0, 6) AS minutes, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last FROM events GROUP BY user_id")
add("F14_json_cells", lambda s, d: docs(s, d).select("doc_id", F.from_json(F.to_json(F.struct("lang", "n_chars")), "lang string, n_chars long").alias("j")).select("doc_id", "j.lang", "j.n_chars"), "SELECT doc_id, lang, n_chars FROM documents")
add("F15_stamped", lambda s, d: E.stamped(docs(s, d).select("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("audit_id") == 36).alias("ids"), F.count("created_at").alias("stamps")), "SELECT count(*) AS n, count(*) AS ids, count(*) AS stamps FROM documents")

# corrections
flagged = lambda s, d: docs(s, d).select("doc_id", F.lower("text").alias("text")).withColumn("spans", F.filter(T.tokens(F.col("text")), lambda w: w.isin("idiot", "trash")))
plain = lambda s: R.lexicon(s).where("severity <> 'warn'").withColumn("neutral_primary", F.concat(F.lit("person"), "rule_no"))
_numbers = {t: i for i, t, _, _, _ in R.lexicon_rows()}
_span = "text"
for _t in ("trash", "idiot"):
    _span = rf"regexp_replace({_span}, '\b{_t}\b', 'person{_numbers[_t]}', 'g')"
add("C04_span_mode", lambda s, d: E.span_corrected(flagged(s, d), plain(s)).select("doc_id", F.md5("rewrite").alias("digest"), F.col("n_edits").cast("long").alias("n_edits")), f"SELECT doc_id, md5({_span}) AS digest, len(list_filter({TOK}, lambda w: w IN ('idiot', 'trash'))) AS n_edits FROM (SELECT doc_id, lower(text) AS text FROM documents)")
add("C06_edit_records", lambda s, d: E.edit_records(L.matches(docs(s, d), R.lexicon(s)).where("biased <> neutral_primary")), f"WITH {R.LEXICON}, {R.HITS} SELECT doc_id, biased AS \"from\", neutral_primary AS \"to\", severity, 'occupation/role' AS tags, stereotype_category, '''' || biased || ''' is gender-biased (occupation/role); use gender-neutral ''' || neutral_primary || '''' AS reason FROM hits")


def reasons(s, d):
    found = L.detection(docs(s, d), R.lexicon(s))
    names = lambda c: F.coalesce(F.transform(c, lambda e: e["from"]), F.array().cast("array<string>"))
    source = F.when(F.col("doc_id") % 7 == 0, "preserved").when(F.col("doc_id") % 7 == 1, "ml").otherwise("rules")
    return found.select("doc_id", E.outcome_reason(source, names("replace_edits"), names("warn_edits")).alias("reason"))


_quoted = lambda w: f"string_agg('''' || biased || '''', ', ' ORDER BY rule_no) FILTER (WHERE severity {w} 'warn')"
add("C06_reasons", reasons, f"""WITH {R.LEXICON}, {R.HITS}, r AS (SELECT d.doc_id, count(*) FILTER (WHERE severity <> 'warn') AS n, {_quoted('<>')} AS t, {_quoted('=')} AS w FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '{E.REASON_PRESERVED}' WHEN doc_id % 7 = 1 THEN '{E.REASON_MODEL}' WHEN n > 0 THEN n || ' biased term(s) corrected: ' || t || '.' WHEN w IS NOT NULL THEN 'Bias terms detected (' || w || ') {E.REASON_SKIPPED}' ELSE '{E.REASON_NONE}' END AS reason FROM r""")
add("C09_model_candidates", lambda s, d: C.with_candidates(L.detection(docs(s, d), R.lexicon(s)).select("doc_id", F.col("n_replace").alias("n_edits")).join(docs(s, d).select("doc_id", "text", F.col("text").alias("rewrite")), "doc_id"), docs(s, d).where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("better "), "lang").alias("best"))).select("doc_id", F.md5("rewrite").alias("digest"), "from_model"),
    f"WITH {R.LEXICON}, {R.HITS}, n AS (SELECT doc_id, count(*) AS n FROM hits WHERE severity <> 'warn' GROUP BY 1) SELECT doc_id, CASE WHEN n IS NULL AND doc_id % 3 = 0 AND lang IS NOT NULL THEN md5('better ' || lang) ELSE md5(text) END AS digest, n IS NULL AND doc_id % 3 = 0 AND lang IS NOT NULL AS from_model FROM documents LEFT JOIN n USING (doc_id)")
add("C11_batch_requests", lambda s, d: docs(s, d).groupBy(F.floor(F.col("doc_id") / 150).alias("request")).agg(F.count(F.lit(1)).alias("items")).withColumn("accepted", F.col("items").between(1, 100)), "SELECT CAST(floor(doc_id / 150) AS BIGINT) AS request, count(*) AS items, count(*) BETWEEN 1 AND 100 AS accepted FROM documents GROUP BY 1")
edits_of = lambda s, d: L.detection(docs(s, d), plain(s)).select("doc_id", F.transform("replace_edits", lambda e: F.struct(e["from"].alias("from"), e["to"].alias("to"))).alias("edits")).join(docs(s, d).select("doc_id", F.lower("text").alias("text")), "doc_id")
add("D23_word_baseline", lambda s, d: docs(s, d).select("doc_id", (F.size(X.substring_detector(F.col("text"), [*R.REPLACE_TERMS, "he "])) > 0).alias("has_bias")), "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{t}')" for t in (*R.REPLACE_TERMS, "he ")) + " AS has_bias FROM documents")
add("D26_first_occurrence", lambda s, d: edits_of(s, d).select("doc_id", F.md5(F.coalesce(X.applied_once(F.col("text"), F.col("edits")), F.col("text"))).alias("digest")),
    f"""WITH {R.LEXICON}, {R.HITS}, f AS (SELECT doc_id, list(biased || '|person' || rule_no ORDER BY rule_no) AS edits FROM hits WHERE severity <> 'warn' GROUP BY 1)
SELECT doc_id, md5(list_reduce(list_concat([lower(text)], coalesce(edits, [])), lambda t, e: CASE WHEN strpos(t, split_part(e, '|', 1)) > 0
  THEN substring(t, 1, strpos(t, split_part(e, '|', 1)) - 1) || split_part(e, '|', 2) || substring(t, strpos(t, split_part(e, '|', 1)) + length(split_part(e, '|', 1))) ELSE t END)) AS digest FROM documents LEFT JOIN f USING (doc_id)""")
plug = lambda terms: lambda df: df.select("doc_id", X.keyword_score(F.col("text"), terms).alias("score")).withColumn("has_bias", F.col("score") > 0.7)
add("X06_plug_in_detectors", lambda s, d: M.run_detectors(docs(s, d), {"few": plug(["idiot", "trash"]), "more": plug(["idiot", "trash", "he", "the"])}).groupBy("model", "has_bias").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score")),
    "WITH s AS (SELECT m.model, least(0.4 * len(list_filter(m.t, lambda x: contains(lower(text), x))), 1) AS s FROM documents, (VALUES ('few', ['idiot', 'trash']), ('more', ['idiot', 'trash', 'he', 'the'])) m(model, t)) SELECT model, s > 0.7 AS has_bias, count(*) AS n, round(avg(s), 6) AS mean_score FROM s GROUP BY ALL")


def verses(s, d):
    """One folder a language; its files are renamed to book_chapter.txt."""
    at = scratch(s)
    docs(s, d).select("lang", flat().alias("value")).write.partitionBy("lang").text(f"{at}/raw")
    path = s._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(s._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{at}/books"))
    for folder in [x.getPath() for x in fs.listStatus(path(f"{at}/raw")) if x.isDirectory()]:
        for i, part in enumerate(x.getPath() for x in fs.listStatus(folder)):
            if part.getName().startswith("part-"):
                fs.rename(part, path(f"{at}/books/{folder.getName().removeprefix('lang=')}_{i + 1}.txt"))
    back = S.read_verses(s, f"{at}/books/*.txt")
    return back.groupBy("book").agg(F.count(F.lit(1)).alias("verses"), F.sum(F.length("text")).cast("long").alias("chars"))


add("S16_verses", verses, f"SELECT lang AS book, count(*) AS verses, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT lang, {_FLAT} AS t FROM documents) WHERE length(t) >= 10 GROUP BY lang")

# validation
_HEADERS = {"en": ("severity", "tags"), "fr": ("pos",), "de": ("severity", "tags", "pos"), "es": ()}


def headed(s, d):
    """The documents' rules as a folder of CSV files a language, each language's without some columns."""
    at = scratch(s)
    rows = docs(s, d).select("lang", F.col("lang").alias("language"), F.col("text").alias("biased"), F.col("source").alias("neutral_primary"), F.lit("warn").alias("severity"), F.lit("a").alias("tags"), F.lit("noun").alias("pos"))
    for lang, gone in _HEADERS.items():
        S.write_table(rows.where(F.col("lang") == lang).drop("lang", *gone), f"{at}/lang={lang}")
    return V.header_reports(S.read_headers(s, at), ("language", "biased", "neutral_primary", "severity"), ("tags", "pos"))


_gone = ", ".join(f"('{lang}', '{'error' if c == 'severity' else 'warning'}', '{c}')" for lang, own in _HEADERS.items() for c in own)
add("V01_header_issues", lambda s, d: headed(s, d).groupBy("lang", "level", "column").agg(F.count(F.lit(1)).alias("reports"), F.sum("records").cast("long").alias("records")).select("lang", "level", "column", (F.col("reports") > 0).alias("reported"), "records"),
    f'SELECT lang, level, "column", true AS reported, count(*) AS records FROM documents JOIN (VALUES {_gone}) g(lang, level, "column") USING (lang) GROUP BY ALL')
add("V09_suggestions", lambda s, d: G.suggestions(docs(s, d).select("doc_id", F.concat_ws(" ", F.when(F.col("doc_id") % 3 == 0, "daktari").when(F.col("doc_id") % 3 == 1, "ciana"), "lang").alias("text"), F.lit(None).cast("string").alias("stereotype_category"), F.when(F.col("doc_id") % 2 == 0, "stereotype").otherwise("neutral").alias("bias_label"), F.when(F.col("source") == "src0", "religious_text").alias("domain"), F.lit("").alias("device"))).select("doc_id", "suggested_category", "suggested_device"),
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'profession' WHEN 1 THEN 'family_role' END END AS suggested_category, CASE WHEN source = 'src0' THEN 'scripture_quote' END AS suggested_device FROM documents")
def sparse_rows(s, d):
    """Samples as JSON lines, in which a row has only the columns that it has values for."""
    return s.read.text(written(s, R.samples(s, d).select(F.to_json(F.struct("doc_id", "text", "bias_category", "expected_correction")).alias("value")), "text"))


add("U05_missing_columns", lambda s, d: V.absent_columns(sparse_rows(s, d), "doc_id", ["bias_category", "expected_correction"]).select(F.col("doc_id").cast("long"), F.array_join("absent", ",").alias("missing")), f"WITH {R.SAMPLES} SELECT doc_id, concat_ws(',', CASE WHEN bias_category IS NULL THEN 'bias_category' END, CASE WHEN expected_correction IS NULL THEN 'expected_correction' END) AS missing FROM samples WHERE bias_category IS NULL OR expected_correction IS NULL")

# streams


def stream_of(s, df, at):
    df.write.parquet(at)
    return J.read(s, at, df.schema)


def joined_reviews(s, d):
    at = scratch(s)
    events = R.table(s, d, "events").select(F.col("event_id").alias("audit_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    left = stream_of(s, events.select("audit_id", "ts"), f"{at}/l")
    right = stream_of(s, events.select("audit_id", F.col("audit_id").alias("review_id"), F.col("event_type").alias("action"), (F.col("ts") + F.expr("interval 1 minute")).alias("ts")), f"{at}/r")
    made = J.joined_reviews(left, right, "36500 days")
    J.run(made, f"{at}/out", f"{at}/cp").awaitTermination()
    return s.read.schema(made.schema).parquet(f"{at}/out").groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("audit_id").alias("ids"))


add("ST03_joined_reviews", joined_reviews, "SELECT event_type AS action, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")


def resumed(s, d):
    """ST-06: a second run over more files adds only what the first has not done."""
    at = scratch(s)
    events = R.table(s, d, "events").select("event_id", "event_type")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{at}/in")
        J.run(J.read(s, f"{at}/in", events.schema), f"{at}/out", f"{at}/cp").awaitTermination()
    return s.read.schema(events.schema).parquet(f"{at}/out")


add("ST06_resumed", resumed, "SELECT event_id, event_type FROM events")


def refreshed(s, d):
    """ST-08: every batch reads the rules as they are now; here they change between two runs."""
    at = scratch(s)
    events = R.table(s, d, "events").select("event_id", F.col("event_type").alias("text"))
    out = f"{at}/out"

    def each(batch, number):
        rules = [(r["term"], r["to"]) for r in s.read.parquet(f"{at}/rules").collect()]
        J.audit_records(batch, rules).select("event_id", "rewrite").write.mode("append").parquet(out)

    for part, to in ((0, "press"), (1, "tap")):
        s.createDataFrame([("click", to)], "term string, to string").write.mode("overwrite").parquet(f"{at}/rules")
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{at}/in")
        J.run(J.read(s, f"{at}/in", events.schema), "", f"{at}/cp", each=each).awaitTermination()
    return s.read.schema("event_id long, rewrite string").parquet(out)


add("ST08_refreshed_rules", refreshed, "SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'press' ELSE 'tap' END ELSE event_type END AS rewrite FROM events")
