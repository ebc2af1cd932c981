"""Queries on text functions, mining, datasets and validation, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiscope.functions import patterns as P
from lexiscope.functions import text as T
from lexiscope.operators import correct as C
from lexiscope.operators import datasets as D
from lexiscope.operators import detect as X
from lexiscope.operators import mining as N
from lexiscope.operators import validate as V
from lexiscope.operators.lexicon import detection
from lexiscope.plans import roles as R

QUERIES, ORACLES = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


docs = lambda s, d: R.table(s, d, "documents")
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
CONV = r"conversations"

add("F01_tokens", lambda s, d: docs(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(T.tokens(F.col("text")), " ")).alias("digest")), f"SELECT doc_id, len({TOK}) AS n, md5(array_to_string({TOK}, ' ')) AS digest FROM documents")
add("F12_bigrams", lambda s, d: docs(s, d).select(F.explode(T.ngrams(T.tokens(F.col("text")), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 20"),
    f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT {TOK} AS w FROM documents)) GROUP BY gram HAVING count(*) >= 20")
add("P02_eval_form", lambda s, d: docs(s, d).select("doc_id", F.md5(T.eval_form(F.col("text"))).alias("digest")), r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]', ' ', 'g'), ' +', ' ', 'g'))) AS digest FROM documents")
add("P03_quality_filters", lambda s, d: R.table(s, d, "conversations").select("conv_id", "turn", T.quality_prose(F.col("text")).alias("prose"), T.quality_tweet(F.col("text")).alias("tweet"), T.quality_web(F.col("text")).alias("web"), T.quality_line(F.col("text")).alias("line"), T.quality_social(F.col("text"), ["the", "le", "der", "el"]).alias("social")),
    f"""SELECT conv_id, turn, length(text) BETWEEN 50 AND 400 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / greatest(length(text), 1) >= 0.6 AND NOT regexp_matches(text, 'http|@|#') AS prose,
length(text) BETWEEN 20 AND 280 AND regexp_matches(text, '\\p{{L}}') AND NOT starts_with(text, 'RT') AND len(regexp_extract_all(text, '#')) <= 3 AND len(regexp_extract_all(text, 'http')) <= 1 AS tweet,
regexp_matches(text, '\\p{{L}}') AND len(regexp_extract_all(text, '[.,!?;:]')) / greatest(length(text), 1) <= 0.15 AS web, length(text) BETWEEN 20 AND 500 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') AS line,
length(text) BETWEEN 30 AND 280 AND list_has_any({TOK}, ['the', 'le', 'der', 'el']) AND len(regexp_extract_all(text, 'https?://')) <= 2 AND len(regexp_extract_all(text, '#')) <= 5 AND len(regexp_extract_all(text, '@')) <= 3 AS social FROM conversations""")
_SENT = "sent AS (SELECT doc_id, unnest(p) AS sentence, unnest(range(len(p))) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 40 AND 200) AS p FROM documents))"
add("P08_sentences", lambda s, d: docs(s, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("sentence").alias("digest")), f"WITH {_SENT} SELECT doc_id, pos, md5(sentence) AS digest FROM sent")
add("P09_keyword_filter", lambda s, d: docs(s, d).where(T.has_keyword(F.col("text"), ["trash", "loser", "http"])).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'trash') OR contains(lower(text), 'loser') OR contains(lower(text), 'http')")
add("P10_terms_found", lambda s, d: docs(s, d).select("doc_id", F.array_join(T.terms_found(F.col("text"), ["he", "idiot", "the", "trash"]), ",").alias("terms")), f"SELECT doc_id, array_to_string(list_filter(['he', 'idiot', 'the', 'trash'], lambda t: list_contains(w, t)), ',') AS terms FROM (SELECT doc_id, {TOK} AS w FROM documents)")
add("P11_needs_work", lambda s, d: R.samples(s, d).select("doc_id", (F.col("has_bias") & F.col("expected_correction").isNull()).alias("needs_annotation"), (F.col("has_bias") & F.col("bias_category").isNull()).alias("needs_category")), f"WITH {R.SAMPLES} SELECT doc_id, has_bias AND expected_correction IS NULL AS needs_annotation, has_bias AND bias_category IS NULL AS needs_category FROM samples")
add("P13_training_rows", lambda s, d: R.truth(s, d).where(F.trim(F.col("text")) != "").select("doc_id", F.col("has_bias").cast("int").alias("y")), f"WITH {R.TRUTH} SELECT doc_id, CAST(has_bias AS INT) AS y FROM truth WHERE trim(text) <> ''")
add("P15_valid_requests", lambda s, d: docs(s, d).select("doc_id", F.when(~F.col("lang").isin("en", "fr"), "language").when(~F.length("text").between(1, 5000), "length").otherwise("valid").alias("outcome")), "SELECT doc_id, CASE WHEN lang NOT IN ('en', 'fr') THEN 'language' WHEN length(text) NOT BETWEEN 1 AND 5000 THEN 'length' ELSE 'valid' END AS outcome FROM documents")
_any = lambda ws: " OR ".join(f"contains(t, ' {w} ')" for w in ws)
_g = P.GROUPS["en"]
add("P16_groups", lambda s, d: docs(s, d).select("doc_id", T.group_of(F.col("text"), *P.GROUPS["en"]).alias("grp")),
    f"""SELECT doc_id, CASE WHEN m AND NOT f THEN 'male_referent' WHEN f AND NOT m THEN 'female_referent' WHEN n AND NOT m AND NOT f THEN 'neutral_referent' ELSE 'unknown' END AS grp
FROM (SELECT doc_id, {_any(_g[0])} AS m, {_any(_g[1])} AS f, {_any(_g[2])} AS n FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents))""")
add("P17_marker_class", lambda s, d: docs(s, d).select("doc_id", T.marker_class(F.col("text"), {"female": ["elle", "sich"], "male": ["aux ", "der "]}).alias("cls")), "SELECT doc_id, CASE WHEN f AND m THEN 'mixed' WHEN f THEN 'female' WHEN m THEN 'male' ELSE 'neutral' END AS cls FROM (SELECT doc_id, contains(lower(text), 'elle') OR contains(lower(text), 'sich') AS f, contains(lower(text), 'aux ') OR contains(lower(text), 'der ') AS m FROM documents)")
add("P18_target_gender", lambda s, d: docs(s, d).select("doc_id", T.target_of(F.col("text")).alias("gender")), f"SELECT doc_id, CASE WHEN m AND f THEN 'mixed' WHEN m THEN 'male' WHEN f THEN 'female' ELSE 'neutral' END AS gender FROM (SELECT doc_id, list_has_any({TOK}, ['he', 'him', 'his']) AS m, list_has_any({TOK}, ['she', 'her', 'hers']) AS f FROM documents)")
add("P20_entities", lambda s, d: R.table(s, d, "conversations").select("conv_id", "turn", F.size(T.entities(F.col("text"))).alias("n_entities")))
add("P22_domain_map", lambda s, d: docs(s, d).select("doc_id", T.mapped(F.col("source"), {"src0": "media", "src1": "education"}, F.lit("other")).alias("domain")), "SELECT doc_id, CASE source WHEN 'src0' THEN 'media' WHEN 'src1' THEN 'education' ELSE 'other' END AS domain FROM documents")
_pii = lambda k: f"len(regexp_extract_all(text, '{T.PII[k]}'))"
add("A37_pii_statistics", lambda s, d: docs(s, d).select("lang", *[F.regexp_count(F.col("text"), F.lit(T.PII[k])).alias(k) for k in ("email", "url", "ssn", "credit_card", "id_number")]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).cast("long").alias(k) for k in ("email", "url", "ssn", "credit_card", "id_number")]),
    "SELECT lang, count(*) AS n, " + ", ".join(f"CAST(sum({_pii(k)}) AS BIGINT) AS {k}" for k in ("email", "url", "ssn", "credit_card", "id_number")) + " FROM documents GROUP BY lang")
_red = "text"
for _k, _p in T.PII.items():
    _red = f"regexp_replace({_red}, '{_p}', '[{_k.upper()}]', 'g')"
add("F09_redaction", lambda s, d: docs(s, d).select("doc_id", "text", T.redacted(F.col("text")).alias("r")).select("doc_id", F.md5("r").alias("digest"), (F.col("r") != F.col("text")).alias("pii_removed")), f"SELECT doc_id, md5({_red}) AS digest, {_red} <> text AS pii_removed FROM documents")
add("F07_social_form", lambda s, d: docs(s, d).select("doc_id", F.md5(T.social_form(F.col("text"))).alias("digest")), rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{T.PII['email']}', '[EMAIL]', 'g'), 'https?://\S+', '[URL]', 'g'), '(?:\+254|\b0)[17]\d{{8}}\b', '[PHONE]', 'g'), '@[A-Za-z0-9_]+', '[USER]', 'g')) AS digest FROM documents")
add("P01_clean_text", lambda s, d: docs(s, d).select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("digest")))

# mining
add("A41_term_frequency", lambda s, d: N.term_frequency(docs(s, d), F.length("term") >= 4).where("n >= 5"), f"SELECT term, count(*) AS n FROM (SELECT unnest({TOK}) AS term FROM documents) WHERE length(term) >= 4 GROUP BY term HAVING count(*) >= 5")
add("A42_term_contexts", lambda s, d: N.term_contexts(docs(s, d), ["the", "he", "idiot", "trash"], F.col("lang"), ["en", "fr", "de", "es"]),
    f"SELECT term, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'es') AS es FROM (SELECT lang, unnest(list_distinct({TOK})) AS term FROM documents) WHERE term IN ('the', 'he', 'idiot', 'trash') GROUP BY term")
add("A44_ngram_mining", lambda s, d: N.mined_ngrams(docs(s, d), ["idiot", "trash"], [2, 3], 2),
    f"""WITH w AS (SELECT doc_id, {TOK} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i : i + 1], ' '))) AS phrase FROM w WHERE list_has_any(w, ['idiot', 'trash']) UNION ALL
SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) FROM w WHERE list_has_any(w, ['idiot', 'trash']))
SELECT phrase, count(*) AS n, min(doc_id) AS first_doc FROM g WHERE list_has_any(string_split(phrase, ' '), ['idiot', 'trash']) GROUP BY phrase HAVING count(*) >= 2""")
add("A45_document_frequency", lambda s, d: N.document_frequency(docs(s, d)).where("df >= 10").select("term", "df", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples")),
    f"SELECT term, count(*) AS df, array_to_string(list_sort(array_agg(doc_id))[1:5], ',') AS examples FROM (SELECT doc_id, unnest(list_distinct({TOK})) AS term FROM documents) GROUP BY term HAVING count(*) >= 10")
add("T01_top_terms", lambda s, d: N.top_terms(N.term_frequency(docs(s, d)), 30), f"SELECT term, count(*) AS n FROM (SELECT unnest({TOK}) AS term FROM documents) WHERE length(term) BETWEEN 4 AND 15 GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 30")
add("T03_frequency_tiers", lambda s, d: N.frequency_tiers(N.term_frequency(docs(s, d)).where("n >= 3"), ["the"], ["idiot"]).groupBy("tier", "reason").agg(F.count(F.lit(1)).alias("terms")),
    f"""WITH c AS (SELECT term, count(*) AS n FROM (SELECT unnest({TOK}) AS term FROM documents) GROUP BY term HAVING count(*) >= 3)
SELECT CASE WHEN term = 'the' THEN 'excluded' WHEN term = 'idiot' OR n >= 20 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN term = 'the' THEN 'in the exclusion list' WHEN term = 'idiot' THEN 'known term' WHEN n >= 20 THEN 'frequent' WHEN n >= 5 THEN 'occurs several times' ELSE 'rare' END AS reason, count(*) AS terms FROM c GROUP BY ALL""")
add("M18_mined_sentences", lambda s, d: N.mined_sentences(docs(s, d), ["idiot", "trash", "he"]).select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("terms", ",").alias("terms")),
    rf"WITH {_SENT} SELECT doc_id, pos, terms FROM (SELECT doc_id, pos, array_to_string(list_filter(['idiot', 'trash', 'he'], lambda t: list_contains(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+'), t)), ',') AS terms FROM sent) WHERE terms <> ''")
add("W09_context_windows", lambda s, d: N.context_windows(docs(s, d), ["idiot", "he"]).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("window").alias("digest")),
    f"SELECT doc_id, pos - 1 AS pos, md5(array_to_string(w[pos : pos + 9], ' ')) AS digest FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT doc_id, {TOK} AS w FROM documents)) WHERE w[pos] IN ('idiot', 'he')")

# datasets
half = lambda s, d: docs(s, d).where("doc_id % 2 = 0")
add("J03_overlap_join", lambda s, d: R.ratings(s, d).where("annotator = 'a'").select("doc_id", F.col("label").alias("x")).join(R.ratings(s, d).where("annotator = 'c'").select("doc_id", F.col("label").alias("y")), "doc_id"), f"WITH {R.RATINGS} SELECT doc_id, a.label AS x, c.label AS y FROM ratings a JOIN ratings c USING (doc_id) WHERE a.annotator = 'a' AND c.annotator = 'c'")
add("J06_patch_merge", lambda s, d: D.patched(docs(s, d).select("doc_id", "lang", "source"), R.truth(s, d).select("doc_id", F.when(F.col("has_bias"), "xx").alias("lang"), F.lit("patched").alias("source")), "doc_id", ["lang"]), f"WITH {R.TRUTH} SELECT d.doc_id, CASE WHEN t.has_bias THEN 'xx' ELSE d.lang END AS lang, d.source FROM documents d LEFT JOIN truth t USING (doc_id)")
add("J07_unseen_texts", lambda s, d: D.unseen(docs(s, d).where("source <> 'src0'"), docs(s, d).where("source = 'src0'")).select("doc_id"), "SELECT doc_id FROM documents WHERE source <> 'src0' AND lower(trim(text, ' ')) NOT IN (SELECT lower(trim(text, ' ')) FROM documents WHERE source = 'src0')")
add("J08_fixed_ids", lambda s, d: docs(s, d).join(R.table(s, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
add("J09_review_audit_join", lambda s, d: R.reviews(s, d).join(docs(s, d).select(F.col("doc_id").alias("audit_id"), "lang"), "audit_id").groupBy("lang", "action").agg(F.count(F.lit(1)).alias("n")), f"WITH {R.REVIEWS} SELECT lang, action, count(*) AS n FROM reviews JOIN documents ON audit_id = doc_id GROUP BY ALL")
names = lambda s, d, t, c: sorted(r[0] for r in R.table(s, d, t).select(c).limit(100).collect())
add("J10_templates", lambda s, d: D.templates(N.term_frequency(docs(s, d)).where("n >= 20").select(F.col("term").alias("biased"), F.concat(F.lit("neutral "), "term").alias("neutral_primary")), names(s, d, "region", "r_name"), names(s, d, "nation", "n_name")).select("text", "expected_correction"),
    f"WITH t AS (SELECT term FROM (SELECT unnest({TOK}) AS term FROM documents) GROUP BY term HAVING count(*) >= 20) SELECT 'The ' || term || ' ' || r_name || ' ' || n_name || '.' AS text, 'The neutral ' || term || ' ' || r_name || ' ' || n_name || '.' AS expected_correction FROM t, region, nation")
add("M15_variants", lambda s, d: D.variants(docs(s, d).select(F.concat_ws(" ", "lang", "source").alias("biased")).distinct().unionByName(docs(s, d).select(F.col("source").alias("biased")).distinct())).select("biased", "variant"),
    "WITH t AS (SELECT DISTINCT lang || ' ' || source AS biased, upper(lang[1]) || lang[2:] || ' ' || upper(source[1]) || source[2:] AS title FROM documents), u AS (SELECT DISTINCT source AS biased FROM documents) SELECT biased, biased AS variant FROM t UNION SELECT biased, title FROM t UNION SELECT biased, biased FROM u UNION SELECT biased, upper(biased[1]) || biased[2:] FROM u UNION SELECT biased, 'the ' || biased FROM u")
add("U01_union_sources", lambda s, d: docs(s, d).select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("origin")).unionByName(R.table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), allowMissingColumns=True).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")), "SELECT origin, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT text, 'documents' AS origin FROM documents UNION ALL SELECT text, NULL FROM benchmark) GROUP BY origin")
add("U03_intersect_ids", lambda s, d: docs(s, d).where("lang = 'en'").select("doc_id").intersect(R.table(s, d, "labels").select("doc_id")), "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels")
add("W03_sequential_ids", lambda s, d: D.numbered(docs(s, d).select("doc_id", "source"), ["source", "doc_id"], 1000), "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) + 1000 AS new_id FROM documents")
add("W04_first_of_key", lambda s, d: D.first_of_key(docs(s, d).select("doc_id", "text", "lang"), D.text_key("text"), ["doc_id"]).select("doc_id", "lang"), "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text, ' ')) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
add("W05_assignment", lambda s, d: D.assigned(docs(s, d).select("doc_id"), ["ann", "bob", "cem"], ["doc_id"]), "SELECT doc_id, ['ann', 'bob', 'cem'][ntile(3) OVER (ORDER BY doc_id)] AS annotator FROM documents")
_md = lambda k, seed: f"md5(CAST({k} AS VARCHAR) || '-{seed}')"
add("W06_sample_per_key", lambda s, d: D.capped_by_key(docs(s, d).select("doc_id", "source"), "source", 5, [D.seeded("doc_id", 7)]), f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_md('doc_id', 7)}) AS r FROM documents) WHERE r <= 5")
add("W08_share_of_total", lambda s, d: docs(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4)), "SELECT source, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY source")
add("W10_metric_progression", lambda s, d: progression(s, d), f"WITH {R.REVIEWS}, m AS (SELECT date_trunc('day', ts) AS day, round(avg(CAST(action IN ('approve', 'approve_with_edit') AS INT)), 6) AS rate FROM reviews GROUP BY 1) SELECT strftime(day, '%Y-%m-%d') AS day, rate, round(rate - lag(rate) OVER (ORDER BY day), 6) AS delta FROM m")


def progression(s, d):
    """W-10: the acceptance rate by day and its change."""
    by_day = R.reviews(s, d).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg(F.col("action").isin("approve", "approve_with_edit").cast("int")), 6).alias("rate"))
    return by_day.withColumn("delta", F.round(F.col("rate") - F.lag("rate").over(Window.orderBy("day")), 6)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


add("M06_stratified_split", lambda s, d: D.stratified_split(R.truth(s, d).select("doc_id", "has_bias"), "has_bias", "doc_id", 0.15), f"WITH {R.TRUTH} SELECT doc_id, has_bias, CASE WHEN row_number() OVER (PARTITION BY has_bias ORDER BY {_md('doc_id', 42)}) <= greatest(1, floor(count(*) OVER (PARTITION BY has_bias) * 0.15)) THEN 'val' ELSE 'train' END AS split FROM truth")
add("M07_oversample", lambda s, d: D.oversampled(R.truth(s, d).select("doc_id", "has_bias"), F.col("has_bias"), "doc_id", 0.25).groupBy("has_bias").agg(F.count(F.lit(1)).alias("n")), f"WITH {R.TRUTH}, c AS (SELECT count(*) FILTER (WHERE has_bias) AS few, count(*) FILTER (WHERE NOT has_bias) AS many FROM truth) SELECT has_bias, CASE WHEN has_bias THEN greatest(few, CAST(floor(many * 0.25 / 0.75) AS BIGINT)) ELSE many END AS n FROM c, (VALUES (true), (false)) v(has_bias)")
add("M09_undersample", lambda s, d: D.undersampled(R.truth(s, d).select("doc_id", "has_bias"), F.col("has_bias"), "doc_id", 4), f"WITH {R.TRUTH} SELECT doc_id, has_bias FROM (SELECT *, row_number() OVER (PARTITION BY has_bias ORDER BY {_md('doc_id', 42)}) AS r, count(*) FILTER (WHERE has_bias) OVER () AS few FROM truth) WHERE has_bias OR r <= 4 * few")
add("T05_priority_fill", lambda s, d: D.priority_fill(docs(s, d).select("doc_id", "lang"), F.when(F.col("lang") == "es", 0).otherwise(1), ["doc_id"], 150), "SELECT doc_id, lang FROM documents ORDER BY CASE WHEN lang = 'es' THEN 0 ELSE 1 END, doc_id LIMIT 150")
add("T06_page_of_rows", lambda s, d: docs(s, d).select("doc_id").orderBy("doc_id").offset(100).limit(50), "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
add("T07_overlap_set", lambda s, d: docs(s, d).select("doc_id").orderBy("doc_id").limit(max(5, docs(s, d).count() // 10)), "SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= greatest(5, count(*) OVER () // 10)")
add("T10_seeded_shuffle", lambda s, d: docs(s, d).select("doc_id", D.seeded("doc_id", 42).alias("place")), f"SELECT doc_id, {_md('doc_id', 42)} AS place FROM documents")
_RENAME, _REMAP = {"doc_id": "id", "lang": "language", "source": "source_type"}, {"source_type": {"src0": "media", "src1": "web_public"}}
add("M01_migration", lambda s, d: D.migrated(docs(s, d).select("doc_id", "lang", "source", "n_chars"), _RENAME, _REMAP, {"qa_status": "needs_review"}, ["id", "language", "source_type", "qa_status", "notes"]), "SELECT doc_id AS id, lang AS language, CASE source WHEN 'src0' THEN 'media' WHEN 'src1' THEN 'web_public' ELSE source END AS source_type, 'needs_review' AS qa_status, CAST(NULL AS VARCHAR) AS notes, n_chars FROM documents")

# validation
lex_rows = lambda s, d: docs(s, d).select(F.col("doc_id").alias("row_no"), F.col("source").alias("file"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text")).alias("biased"), F.when(F.col("doc_id") % 5 == 0, F.col("text")).when(F.col("doc_id") % 7 == 0, "").otherwise("x").alias("neutral_primary"), F.when(F.col("doc_id") % 10 == 0, "warn").otherwise("replace").alias("severity"), F.lit("").alias("tags"), F.when(F.col("doc_id") % 3 == 0, "ex").otherwise("").alias("example_biased"), F.when(F.col("doc_id") % 6 == 0, "ex").otherwise("").alias("example_neutral"), F.when(F.col("doc_id") % 4 == 0, "stereotype").alias("bias_label"), F.lit("profession").alias("stereotype_category"))
_LEX = """lx AS (SELECT doc_id AS row_no, source AS file, trim(CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END, ' ') AS b, trim(CASE WHEN doc_id % 5 = 0 THEN text WHEN doc_id % 7 = 0 THEN '' ELSE 'x' END, ' ') AS n,
  CASE WHEN doc_id % 10 = 0 THEN 'warning' ELSE 'error' END AS soft, CASE WHEN doc_id % 3 = 0 THEN 'ex' ELSE '' END AS eb, CASE WHEN doc_id % 6 = 0 THEN 'ex' ELSE '' END AS en, doc_id % 4 <> 0 AS nolabel FROM documents),
iss AS (SELECT row_no, file, 'IDENTICAL_TERMS' AS issue, soft AS level FROM lx WHERE b <> '' AND b = n UNION ALL SELECT row_no, file, 'MISSING_NEUTRAL', 'warning' FROM lx WHERE b <> '' AND n = '' UNION ALL SELECT row_no, file, 'IDENTICAL_EXAMPLES', soft FROM lx WHERE b <> '' AND eb <> '' AND eb = en
 UNION ALL SELECT row_no, file, 'MISSING_EXAMPLE_NEUTRAL', 'warning' FROM lx WHERE b <> '' AND eb <> '' AND en = '' UNION ALL SELECT row_no, file, 'MISSING_BIAS_LABEL', 'info' FROM lx WHERE b <> '' AND nolabel)"""
add("V02_lexicon_issues", lambda s, d: V.issues(lex_rows(s, d), "row_no", V.lexicon_checks()), f"WITH {_LEX} SELECT row_no, issue, level FROM iss")
add("V03_lexicon_report", lambda s, d: V.report(lex_rows(s, d), V.issues(lex_rows(s, d), "row_no", V.lexicon_checks()), "row_no", "file"),
    f"WITH {_LEX}, e AS (SELECT row_no, count(*) FILTER (WHERE level = 'error') AS e, count(*) FILTER (WHERE level = 'warning') AS w, count(*) FILTER (WHERE level = 'info') AS i FROM iss GROUP BY row_no) SELECT file, count(*) AS n, count(*) FILTER (WHERE coalesce(e, 0) = 0) AS n_valid, CAST(coalesce(sum(e), 0) AS BIGINT) AS errors, CAST(coalesce(sum(w), 0) AS BIGINT) AS warnings, CAST(coalesce(sum(i), 0) AS BIGINT) AS infos, coalesce(sum(e), 0) = 0 AS valid FROM lx LEFT JOIN e USING (row_no) GROUP BY file")
_levels, _groups = ("very_low", "low", "medium", "high", "very_high"), ("male", "female", "neutral")
checks = lambda: V.sample_checks(_levels, _groups)
_SI = f"""{R.SAMPLES}, si AS (SELECT doc_id, 'CATEGORY_MISSING' AS issue FROM samples WHERE has_bias AND bias_category IS NULL UNION ALL SELECT doc_id, 'CORRECTION_MISSING' FROM samples WHERE has_bias AND expected_correction IS NULL UNION ALL SELECT doc_id, 'TEXT_EMPTY' FROM samples WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT doc_id, 'CONFIDENCE_INVALID' FROM samples WHERE confidence NOT IN {_levels} UNION ALL SELECT doc_id, 'FAIRNESS_OUT_OF_RANGE' FROM samples WHERE NOT fairness_score BETWEEN 0 AND 1)"""
add("V04_sample_issues", lambda s, d: V.issues(R.samples(s, d), "doc_id", checks()), f"WITH {_SI} SELECT doc_id, issue, 'error' AS level FROM si")
add("V05_batch_report", lambda s, d: V.batch_report(R.samples(s, d).withColumn("batch", F.concat_ws("-", "annotator_id", "lang")), V.issues(R.samples(s, d), "doc_id", checks()), "doc_id", "batch"),
    f"WITH {_SI} SELECT annotator_id || '-' || lang AS batch, count(*) AS n, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM si)) AS n_valid, count(DISTINCT annotator_id) AS annotators, count(DISTINCT lang) AS languages, count(DISTINCT annotator_id) = 1 AS single_annotator, count(DISTINCT lang) = 1 AS single_language FROM samples GROUP BY 1")
add("V10_file_report", lambda s, d: V.file_report(R.samples(s, d), V.issues(R.samples(s, d), "doc_id", checks()), "doc_id", "annotator_id", 20),
    f"WITH {_SI}, b AS (SELECT annotator_id, count(*) AS n, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM si)) AS n_valid FROM samples GROUP BY 1) SELECT *, round(100 * n_valid / n, 4) AS compliance, n >= 20 AS enough FROM b")

# detectors
_first = lambda table, langs: "CASE " + " ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}', 'is') THEN '{c}:{g}'" for lg, p, c, g in table if lg in langs) + " END"
flat = lambda x: F.when(x.isNotNull(), F.concat_ws(":", x["category"], x["gender"]))
one_line = lambda: F.regexp_replace("text", "\n", " ")
add("D11_counter_stereotype", lambda s, d: docs(s, d).select("doc_id", flat(X.counter_stereotype(one_line(), F.lit("en"))).alias("found")), f"SELECT doc_id, {_first(P.COUNTER_STEREOTYPE, ('en',))} AS found FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)")
add("D12_derogation", lambda s, d: docs(s, d).select("doc_id", flat(X.derogation(one_line(), F.lit("en"))).alias("found")), f"SELECT doc_id, {_first(P.DEROGATION, ('en',))} AS found FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)")
_nc = "CASE WHEN starts_with(n, 'm') AND (contains(n, 'limu') OR contains(n, 'kulima') OR contains(n, 'andishi') OR contains(n, 'fanya')) THEN '1/2' WHEN starts_with(n, 'w') THEN '1/2' WHEN starts_with(n, 'ma') THEN '5/6' WHEN starts_with(n, 'ki') OR starts_with(n, 'ch') OR starts_with(n, 'vi') OR starts_with(n, 'vy') THEN '7/8' WHEN starts_with(n, 'n') THEN '9/10' END"
add("D18_noun_classes", lambda s, d: docs(s, d).select(F.explode(T.tokens(F.col("text"))).alias("n")).select(X.noun_class(F.col("n")).alias("cls"), "n").where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("n").alias("nouns")), f"SELECT cls, count(*) AS uses, count(DISTINCT n) AS nouns FROM (SELECT n, {_nc} AS cls FROM (SELECT unnest({TOK}) AS n FROM documents)) WHERE cls IS NOT NULL GROUP BY cls")
add("D19_noun_profile", lambda s, d: docs(s, d).select("doc_id", X.noun_profile(F.col("text")).alias("p")).select("doc_id", F.col("p.m_wa_count").cast("long").alias("m_wa_count"), F.col("p.total").cast("long").alias("total")),
    rf"SELECT doc_id, len(list_filter(c, lambda x: x = '1/2')) AS m_wa_count, len(c) AS total FROM (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(trim(text, ' '), '\s+'), lambda x: trim(x, '.,!?;:')), lambda x: length(x) >= 3), lambda w: {_nc.replace('(n,', '(lower(w),')}), lambda x: x IS NOT NULL) AS c FROM documents)")
_kw = ", ".join(f"'{k}'" for k in P.KEYWORDS["en"])
add("D22_keyword_detector", lambda s, d: docs(s, d).select("doc_id", X.keyword_detector(F.col("text"), F.col("lang")).alias("has_bias")), f"SELECT doc_id, lang = 'en' AND list_has_any({TOK}, [{_kw}]) AS has_bias FROM documents")
add("D21_substring_detector", lambda s, d: docs(s, d).select("doc_id", F.array_join(X.substring_detector(F.col("text"), ["trash", "idiot", "moron"]), ",").alias("terms")), "SELECT doc_id, array_to_string(list_filter(['trash', 'idiot', 'moron'], lambda t: contains(lower(text), t)), ',') AS terms FROM documents")
add("D24_keyword_score", lambda s, d: docs(s, d).select("doc_id", F.round(X.keyword_score(F.col("text"), ["trash", "idiot", "moron"]), 6).alias("score")), "SELECT doc_id, round(least(0.4 * len(list_filter(['trash', 'idiot', 'moron'], lambda t: contains(lower(text), t))), 1), 6) AS score FROM documents")
add("D25_hybrid", lambda s, d: R.judged(s, d).select("doc_id", X.hybrid(F.col("predicted"), F.col("quality") == 0).alias("h")).select("doc_id", "h.*"), f"WITH {R.JUDGED} SELECT doc_id, predicted OR quality = 0 AS has_bias, round(0.7 * CAST(predicted AS INT) + 0.3 * CASE WHEN quality = 0 THEN 0.8 ELSE 0.2 END, 6) AS confidence, predicted = (quality = 0) AS agreement FROM judged")
add("D27_category_suggestion", lambda s, d: X.category_suggestion(docs(s, d), s.sql("SELECT * FROM VALUES ('idiot', 'capability', 3.0), ('trash', 'leadership', 5.0), ('he', 'family_role', 1.0), ('moron', 'capability', 4.0) AS t(word, category, weight)")),
    f"""WITH k(word, category, weight) AS (VALUES ('idiot', 'capability', 3.0), ('trash', 'leadership', 5.0), ('he', 'family_role', 1.0), ('moron', 'capability', 4.0)), h AS (SELECT doc_id, unnest(list_distinct({TOK})) AS word FROM documents), s AS (SELECT doc_id, category, sum(weight) AS w FROM h JOIN k USING (word) GROUP BY ALL),
b AS (SELECT doc_id, category, w FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, category DESC) = 1) SELECT doc_id, coalesce(category, 'profession') AS category, round(CAST(coalesce(least(w / 10.0, 0.95), 0.3) AS DOUBLE), 6) AS confidence, coalesce(least(w / 10.0, 0.95), 0.3) >= 0.9 AS auto_approved FROM documents LEFT JOIN b USING (doc_id)""")

# corrections
plain = lambda s: R.lexicon(s).where("severity <> 'warn'")
_corr = "text"
for _t in R.REPLACE_TERMS:
    _corr = rf"regexp_replace({_corr}, '\b{_t}\b', 'neutral {_t}', 'g')"
add("C05_corrections", lambda s, d: C.rewritten(docs(s, d), plain(s), True).select("doc_id", F.md5(F.lower("rewrite")).alias("digest")), f"SELECT doc_id, md5({_corr}) AS digest FROM (SELECT doc_id, lower(text) AS text FROM documents)")
add("C02_warn_marks", lambda s, d: C.rewritten(docs(s, d), R.lexicon(s)).select("doc_id", "n_edits", F.md5("rewrite").alias("digest")))
scored = lambda s, d: C.preservation(C.rewritten(docs(s, d), plain(s)))
add("C16_preservation", lambda s, d: scored(s, d).select("doc_id", *[F.round(c, 6).alias(c) for c in (*C.WEIGHTS, "composite")]))
_ov = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
_corr_ci = "text"
for _t in R.REPLACE_TERMS:
    _corr_ci = rf"regexp_replace({_corr_ci}, '\b{_t}\b', 'neutral {_t}', 'gi')"
add("C14_token_overlap", lambda s, d: scored(s, d).select("doc_id", F.round("overlap", 6).alias("overlap")), f"SELECT doc_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS overlap FROM (SELECT doc_id, {_ov.format('text')} AS a, {_ov.format('rw')} AS b FROM (SELECT doc_id, text, {_corr_ci} AS rw FROM documents))")
add("C10_rewrite_record", lambda s, d: C.rewrite_record(C.gated_rewrite(scored(s, d))).select("doc_id", "source", "confidence", "needs_review", "has_bias_detected", "reason", "semantic_score"))
add("C08_verdicts", lambda s, d: C.with_verdicts(detection(docs(s, d), R.lexicon(s)), R.table(s, d, "labels").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("toxic") == 1).alias("verdict"))),
    f"""WITH {R.LEXICON}, {R.HITS}, n AS (SELECT d.doc_id, count(*) FILTER (WHERE severity <> 'warn') AS r, count(*) FILTER (WHERE severity = 'warn') AS w FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY 1), v AS (SELECT n.*, CASE WHEN r = 0 AND w > 0 AND doc_id % 3 <> 0 THEN toxic = 1 END AS v FROM n LEFT JOIN labels USING (doc_id))
SELECT doc_id, CAST(CASE WHEN v THEN w ELSE r END AS INTEGER) AS n_replace, CAST(CASE WHEN v IS NOT NULL THEN 0 ELSE w END AS INTEGER) AS n_warn, CASE WHEN v THEN 'disambiguated' WHEN r > 0 THEN 'rules' ELSE 'none' END AS source FROM v""")


def effect(s, d, by=None):
    rows = C.preservation(C.rewritten(docs(s, d), plain(s).withColumn("neutral_primary", F.concat(F.lit("person"), "rule_no"))))
    before = detection(docs(s, d), plain(s)).select("doc_id", F.col("has_bias").alias("before"))
    after = detection(rows.select("doc_id", F.col("rewrite").alias("text")), plain(s)).select("doc_id", F.col("has_bias").alias("after"))
    joined = rows.join(before, "doc_id").join(after, "doc_id").join(R.truth(s, d).select("doc_id", "lang", "has_bias"), "doc_id")
    return C.effectiveness(joined, by)


add("A38_effectiveness", lambda s, d: effect(s, d))
add("A39_effectiveness_by_language", lambda s, d: effect(s, d, ["lang"]))
