"""Queries on sources, streams, the classifier and further dataset work, with DuckDB forms where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.functions import udtf
from lexiscope.operators import classify
from lexiscope.operators import correct as C
from lexiscope.operators import datasets as D
from lexiscope.operators import detect as X
from lexiscope.operators import lexicon as L
from lexiscope.operators import mining as N
from lexiscope.operators import prepare as P
from lexiscope.operators import quality as Q
from lexiscope.operators import validate as V
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


def round_trip(kind):
    """Digests of all columns of the rows that come back from a file format."""

    def query(s, d):
        at = scratch(s)
        rows = docs(s, d).select("doc_id", "lang", "source", "n_chars", "text")
        S.write_table(rows, at, kind=kind, by=["lang"])
        schema = "doc_id long, source string, n_chars long, text string, lang string"
        back = S.read_csv(s, at).withColumn("doc_id", F.col("doc_id").cast("long")) if kind == "csv" else s.read.format(kind).schema(schema).load(at)
        digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "n_chars", "text", "lang")]))
        return back.select("doc_id", digest.alias("digest"))

    return query


_TRIP = "SELECT doc_id, md5(concat_ws('|', coalesce(source, ''), coalesce(CAST(n_chars AS VARCHAR), ''), coalesce(text, ''), coalesce(lang, ''))) AS digest FROM documents"
for kind in ("json", "parquet", "csv"):
    add(f"S24_round_trip_{kind}", round_trip(kind), _TRIP)


def plain_lines(s, d):
    at = scratch(s)
    docs(s, d).select("text").write.text(at)
    return S.read_texts(s, at, "plain").agg(F.count(F.lit(1)).alias("lines"))


add("S09_plain_lines", plain_lines, "SELECT count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l, ' ') <> ''")


def corpus_sink(s, d):
    at = scratch(s)
    S.write_corpus(docs(s, d).select("doc_id", "lang"), at, "corpus", ["doc_id"])
    return s.read.schema("id string, doc_id long, lang string").json(at)


add("S23_corpus_sink", corpus_sink, "SELECT 'corpus_' || lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), 6, '0') AS id, doc_id, lang FROM documents")


def conll(s, d):
    at = scratch(s)
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    tagged = F.array_join(F.transform(words, lambda w: F.concat(w, F.lit(" "), F.when(w.rlike("^[A-Z]"), "B-PER").otherwise("O"))), "\n")
    docs(s, d).select(F.concat(tagged, F.lit("\n")).alias("value")).write.option("compression", "gzip").text(at)
    return at


_BIO = r"bio AS (SELECT doc_id, w, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'B-PER' ELSE 'O' END AS tag FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM documents))"
add("S11_bio_scan", lambda s, d: S.read_bio(s, conll(s, d)).groupBy("tag").agg(F.count(F.lit(1)).alias("n")), f"WITH {_BIO} SELECT tag, count(*) AS n FROM bio GROUP BY tag")
add("A43_person_terms", lambda s, d: P.person_terms(S.read_bio(s, conll(s, d))), f"WITH {_BIO} SELECT lower(w) AS term, count(*) AS n FROM bio WHERE tag = 'O' AND doc_id IN (SELECT doc_id FROM bio WHERE tag = 'B-PER') GROUP BY 1")
add("S17_sentence_pairs", lambda s, d: S.benchmark_sentences(docs(s, d).select(F.col("text").alias("sent_more"), F.col("lang").alias("sent_less"), F.when(F.col("doc_id") % 2 == 0, "gender").otherwise("age").alias("bias_type")), "pairs").groupBy("has_bias").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars")),
    "SELECT true AS has_bias, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT false, count(*), CAST(sum(length(lang)) AS BIGINT) FROM documents WHERE doc_id % 2 = 0")
batch = lambda s, d: S.unannotated(docs(s, d), "ann", ["doc_id"]).withColumn("batch_id", F.substring("text", 1, 1))
add("S22_batches", lambda s, d: D.ranked(batch(s, d), F.col("batch_id"), "doc_id", 1).withColumn("pos", F.col("_r") - 1).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").cast("long").alias("last")),
    "SELECT text[1] AS batch_id, count(*) AS n, count(*) - 1 AS last FROM documents GROUP BY 1")
add("S28_registry_append", lambda s, d: S.appended_registry(docs(s, d).where("source = 'src1'").select(F.col("lang").alias("tag")), docs(s, d).select(F.col("lang").alias("tag"), "doc_id").unionByName(docs(s, d).select(F.col("source").alias("tag"), "doc_id"))),
    "SELECT tag, doc_id FROM (SELECT lang AS tag, doc_id FROM documents UNION ALL SELECT source, doc_id FROM documents) WHERE tag NOT IN (SELECT lang FROM documents WHERE source = 'src1')")

# further dataset work
add("M02_heuristic_annotation", lambda s, d: P.heuristic_annotation(R.truth(s, d), ["he ", "aux"], ["she", "elle"]).groupBy("target_gender", "bias_label", "explicitness").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {R.TRUTH}, t AS (SELECT has_bias, contains(lower(text), 'he ') OR contains(lower(text), 'aux') AS m, contains(lower(text), 'she') OR contains(lower(text), 'elle') AS f FROM truth)
SELECT CASE WHEN m AND f THEN 'mixed' WHEN m THEN 'male' WHEN f THEN 'female' ELSE 'neutral' END AS target_gender, CASE WHEN has_bias THEN 'stereotype' ELSE 'neutral' END AS bias_label, CASE WHEN has_bias AND (m OR f) THEN 'explicit' WHEN has_bias THEN 'implicit' END AS explicitness, count(*) AS n FROM t GROUP BY ALL""")
add("M05_merged_sentences", lambda s, d: P.merged_sentences(R.table(s, d, "benchmark"), docs(s, d), ["idiot", "trash"], 5000).select("doc_id", F.col("pos").cast("long").alias("pos"), "new_id"),
    rf"""WITH sent AS (SELECT doc_id, unnest(p) AS sentence, unnest(range(len(p))) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 40 AND 200) AS p FROM documents)),
f AS (SELECT * FROM sent WHERE list_has_any(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+'), ['idiot', 'trash']) AND lower(trim(sentence, ' ')) NOT IN (SELECT lower(trim(text, ' ')) FROM benchmark) QUALIFY row_number() OVER (PARTITION BY lower(trim(sentence, ' ')) ORDER BY doc_id, pos) = 1)
SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) + 5000 AS new_id FROM f""")
add("M11_augmentation", lambda s, d: P.augmented(docs(s, d).select("doc_id", "text"), {"the": "a", "idiot": "person"}).select("doc_id", F.md5("augmented").alias("digest"), (F.col("augmented") != F.col("text")).alias("changed")))
add("M12_annotation_sample", lambda s, d: P.annotation_sample(docs(s, d), ["idiot", "trash", "he"], 60),
    f"""WITH h AS (SELECT doc_id, unnest(list_filter(['idiot', 'trash', 'he'], lambda t: list_contains({TOK}, t))) AS term, md5(CAST(doc_id AS VARCHAR) || '-42') AS k FROM documents), q AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY term ORDER BY k) <= 20), f AS (SELECT doc_id, min(term) AS term FROM q GROUP BY 1)
SELECT doc_id, term FROM (SELECT d.doc_id, f.term FROM documents d LEFT JOIN f USING (doc_id)) ORDER BY term IS NULL, md5(CAST(doc_id AS VARCHAR) || '-42') LIMIT 60""")
add("M16_mined_lexicon", lambda s, d: P.mined_lexicon(docs(s, d), ["idiot", "trash"], {"idiot": "person", "trash": "waste"}, (2,)),
    f"""WITH w AS (SELECT {TOK} AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM w WHERE list_has_any(w, ['idiot', 'trash'])), c AS (SELECT p, count(*) AS n FROM g WHERE list_has_any(string_split(p, ' '), ['idiot', 'trash']) GROUP BY p HAVING count(*) >= 2)
SELECT p AS biased, array_to_string(list_transform(string_split(p, ' '), lambda x: CASE x WHEN 'idiot' THEN 'person' WHEN 'trash' THEN 'waste' ELSE x END), ' ') AS neutral_primary, n FROM c""")
add("M17_new_rules", lambda s, d: P.new_rules(N.term_frequency(docs(s, d)).where("n >= 50").select(F.col("term").alias("biased")), R.lexicon(s)), f"WITH {R.LEXICON} SELECT term AS biased FROM (SELECT term FROM (SELECT unnest({TOK}) AS term FROM documents) GROUP BY term HAVING count(*) >= 50) WHERE term NOT IN (SELECT biased FROM lexicon)")
add("M19_bias_patterns", lambda s, d: P.bias_patterns(docs(s, d), ["idiot", "clown", "the"], ["he", "elle"]).select("doc_id", F.array_join("roles", ",").alias("roles"), F.array_join("gendered", ",").alias("gendered")),
    f"SELECT doc_id, array_to_string(r, ',') AS roles, array_to_string(g, ',') AS gendered FROM (SELECT doc_id, list_filter(['idiot', 'clown', 'the'], lambda t: list_contains(w, t)) AS r, list_filter(['he', 'elle'], lambda t: list_contains(w, t)) AS g FROM (SELECT doc_id, {TOK} AS w FROM documents)) WHERE len(r) > 0 AND len(g) > 0")
add("A35_source_distribution", lambda s, d: Q.dataset_profile(docs(s, d), ["source"]), "SELECT 'source' AS field, source AS value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY source")
_long = "text"
for _t in R.REPLACE_TERMS:
    _long = rf"regexp_replace({_long}, '\b{_t}\b', 'neutral {_t}', 'gi')"
add("A51_length_ratio", lambda s, d: P.rewrite_ratios(C.rewritten(docs(s, d), R.lexicon(s).where("severity <> 'warn'"))), f"SELECT round(avg(r), 6) AS mean_ratio, round(avg(CAST(r BETWEEN 0.8 AND 1.2 AS INT)), 6) AS within FROM (SELECT length({_long}) / greatest(length(text), 1) AS r FROM documents)")
add("T04_severity_mix", lambda s, d: D.severity_mix(N.term_frequency(docs(s, d)).withColumn("severity", F.when(F.length("term") % 3 == 0, "warn").otherwise("replace")), 60, 0.25, [F.desc("n"), F.col("term")]).groupBy("severity").agg(F.count(F.lit(1)).alias("k"), F.sum("n").cast("long").alias("n")),
    f"""WITH c AS (SELECT term, count(*) AS n, CASE WHEN length(term) % 3 = 0 THEN 'warn' ELSE 'replace' END AS severity FROM (SELECT unnest({TOK}) AS term FROM documents) GROUP BY term), r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY n DESC, term) AS r FROM c),
p AS (SELECT * FROM r ORDER BY CASE WHEN severity = 'warn' AND r <= 15 THEN 0 WHEN severity <> 'warn' THEN 1 ELSE 2 END, n DESC, term LIMIT 60) SELECT severity, count(*) AS k, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY severity""")
add("W07_per_article_cap", lambda s, d: D.capped_by_key(N.mined_sentences(docs(s, d), ["idiot", "he"]), "doc_id", 3, [F.col("pos")]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
    r"""WITH sent AS (SELECT doc_id, unnest(p) AS sentence FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 40 AND 200) AS p FROM documents))
SELECT doc_id, least(count(*), 3) AS n FROM sent WHERE list_has_any(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+'), ['idiot', 'he']) GROUP BY doc_id""")
add("V08_review_issues", lambda s, d: V.issues(docs(s, d).select("doc_id", "text", "lang", F.when(F.col("doc_id") % 2 == 0, "stereotype").otherwise("neutral").alias("bias_label"), F.when(F.col("doc_id") % 4 == 0, "explicit").alias("explicitness"), F.lit(None).cast("string").alias("stereotype_category"), F.when(F.col("source") == "src0", "religious_text").alias("domain"), F.lit("scripture_quote").alias("device"), F.lit("safe").alias("safety_flag")), "doc_id", V.review_checks(["text"], {"lang": ["en", "fr", "de"]})),
    """SELECT doc_id, 'INVALID_LANG' AS issue, 'error' AS level FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, 'EXPLICITNESS_REQUIRED', 'error' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'CATEGORY_RECOMMENDED', 'warning' FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'FLAG_NOT_SENSITIVE', 'error' FROM documents WHERE source = 'src0' UNION ALL SELECT doc_id, 'MISSING_TEXT', 'error' FROM documents WHERE text = ''""")
add("V07_defaults", lambda s, d: V.with_defaults(R.samples(s, d).select("doc_id", "bias_category"), {"bias_category": "none", "version": "1.0"}), f"WITH {R.SAMPLES} SELECT doc_id, coalesce(bias_category, 'none') AS bias_category, '1.0' AS version FROM samples")
add("F16_severity", lambda s, d: docs(s, d).select("doc_id", P.severity_of(F.col("text")).alias("severity")), "SELECT doc_id, CASE WHEN regexp_matches(' ' || text || ' ', ' nĩ wa | no mũhaka | ti | ndangĩ ') THEN 'warn' ELSE 'replace' END AS severity FROM documents")
add("J11_merged_edits", lambda s, d: merged(s, d), f"WITH {R.LEXICON}, {R.HITS} SELECT d.doc_id, count(h.doc_id) FILTER (WHERE severity <> 'warn') + CASE WHEN count(h.doc_id) FILTER (WHERE biased = 'idiot') > 0 THEN 0 ELSE 1 END + 1 AS n FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY d.doc_id")


def merged(s, d):
    found = L.detection(docs(s, d), R.lexicon(s))
    rules = F.transform(F.coalesce("replace_edits", F.array().cast("array<struct<rule_no:int,from:string,to:string,severity:string,stereotype_category:string>>")), lambda e: F.struct(e["from"].alias("from"), e["to"].alias("to")))
    model = F.array(F.struct(F.lit("IDIOT").alias("from"), F.lit("person").alias("to")), F.struct(F.lit("other").alias("from"), F.lit("x").alias("to")))
    return found.select("doc_id", F.size(X.merged_edits(rules, model)).cast("long").alias("n"))


add("ML01_classifier_scores", lambda s, d: classify.trained_scores(R.truth(s, d)))


def matched_spans(s, d):
    udtf.register(s)
    docs(s, d).createOrReplaceTempView("lexiscope_docs")
    return s.sql("SELECT d.doc_id, m.term, m.start, m.stop FROM lexiscope_docs d, LATERAL explode_matches(d.text, array('idiot', 'trash')) m")


add("X05_explode_matches", matched_spans)

# streams over the tables, run to their end; each gives the batch's rows

def streamed(job, mode="complete"):
    """Runs ``job`` over all files of the events. In complete mode the last batch holds the whole result."""

    def query(s, d):
        at = scratch(s)
        stream = J.read(s, f"{d}/events.parquet*", R.table(s, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
        made = job(stream)
        if mode == "append":
            J.run(made, f"{at}/out", f"{at}/cp").awaitTermination()
        else:
            keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out")
            J.run(made, "", f"{at}/cp", mode, each=keep).awaitTermination()
        return s.read.schema(made.schema).parquet(f"{at}/out")

    return query


def lateness(s, d):
    """A watermark delay that covers all stored events: files are read in any order of their times."""
    span = R.table(s, d, "events").agg(F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))).first()[0]
    return f"{(span or 0) + 86_400} seconds"


accepted = lambda e: e.select("ts", F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "purchase", "approve_with_edit").otherwise("reject").alias("action"))
windows = streamed(lambda e: J.windowed_actions(accepted(e)))
add("ST02_windowed_actions", lambda s, d: windows(s, d).withColumn("start", F.date_format("start", "yyyy-MM-dd")), "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, count(*) AS n, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS accepted, round(count(*) FILTER (WHERE event_type IN ('click', 'purchase')) / count(*), 6) AS rate FROM events GROUP BY 1")
add("ST07_running_confusion", streamed(lambda e: J.running_confusion(e.select(F.col("event_type").alias("lang"), (F.col("value") > 50).alias("has_bias"), (F.col("event_id") % 2 == 0).alias("predicted")))),
    "SELECT event_type AS lang, count(*) FILTER (WHERE value > 50 AND event_id % 2 = 0) AS tp, count(*) FILTER (WHERE NOT value > 50 AND event_id % 2 = 0) AS fp, count(*) FILTER (WHERE value > 50 AND event_id % 2 <> 0) AS fn, count(*) FILTER (WHERE NOT value > 50 AND event_id % 2 <> 0) AS tn FROM events GROUP BY 1")
add("ST01_audit_records", streamed(lambda e: J.audit_records(e.select("event_id", F.concat(F.col("event_type"), F.lit(" by "), F.col("user_id").cast("string")).alias("text")), [("click", "press")]).select("event_id", "rewrite", "has_bias_detected"), "append"),
    "SELECT event_id, replace(event_type, 'click', 'press') || ' by ' || user_id AS rewrite, event_type = 'click' AS has_bias_detected FROM events")
add("ST04_sessions", lambda s, d: streamed(lambda e: J.sessions(e.withColumnRenamed("user_id", "reviewer"), late=lateness(s, d)))(s, d).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")),  # complete mode: open sessions as well
    """WITH e AS (SELECT user_id AS reviewer, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY reviewer ORDER BY ts) AS g FROM e)
SELECT reviewer, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(count(*) / ((floor(epoch(max(ts) + INTERVAL 30 MINUTE)) - floor(epoch(min(ts)))) / 60), 6) AS per_minute FROM g GROUP BY reviewer, g""")
add("ST05_fresh_texts", lambda s, d: streamed(lambda e: J.fresh_texts(e.select("ts", F.col("props").alias("text")), late=lateness(s, d)), "append")(s, d).select(F.lower(F.trim("text")).alias("key")), "SELECT DISTINCT lower(trim(props, ' ')) AS key FROM events")
