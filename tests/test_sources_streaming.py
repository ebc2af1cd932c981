"""Sources read what they should, and streams give the batch's rows."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiscope.operators import prepare as P
from lexiscope.plans import catalog
from lexiscope.sources import files as S
from lexiscope.streaming import jobs as J


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_lexicons(spark, tmp_path):
    path = put(tmp_path / "lexicon_en.csv", "language,biased,neutral_primary,severity,tags\nen,chairman,chair,,a|b\nen,,x,warn,\n")
    typed = S.read_typed_lexicon(spark, path).collect()
    assert len(typed) == 1 and typed[0]["severity"] == "" and typed[0]["pos"] == "noun" and typed[0]["tags"] == ["a", "b"]
    full = put(tmp_path / "full.csv", ",".join(S.LEXICON) + "\n" + ",".join(["en", "a b", "c"] + [""] * 18) + "\n" + ",".join(["en", "d", "e"] + [""] * 18) + "\n")
    assert [(r["rule_no"], r["biased"], r["tags"]) for r in S.read_lexicon(spark, full).orderBy("rule_no").collect()] == [(0, "a b", ""), (1, "d", "")]
    assert S.versioned_name("gt", "en", {"en": "v2"}) == ["gt_en_v2.csv", "gt_en.csv"]


def test_truth(spark, tmp_path):
    path = put(tmp_path / "gt.csv", 'text,has_bias,bias_category,expected_correction,target_gender,bias_severity,cohen_kappa,pii_removed\n"a, b",TRUE,occupation,x,family_role,2,0.5,yes\nc,false,,,NEEDS_ANNOTATION,z,bad,no\nd,true,weird,,,1,,1\n')
    got = S.read_truth(spark, path, ["occupation", "none"], {"target_gender": ["family-role", "male"]}).collect()
    assert [(r["text"], r["has_bias"], r["bias_category"], r["target_gender"], r["bias_severity"], r["cohen_kappa"], r["pii_removed"]) for r in got] == [("a, b", True, "occupation", "family-role", 2, 0.5, True), ("c", False, "none", None, None, None, False), ("d", True, "stereotype", None, 1, None, True)]


def test_texts_and_tags(spark, tmp_path):
    conll = put(tmp_path / "a.conll", "Jane B-PER\nran O\n\nHe O\nsat O\n")
    assert sorted(r["text"] for r in S.read_texts(spark, conll, "conll").collect()) == ["He sat", "Jane ran"]
    assert S.read_bio(spark, conll).where("tag = 'B-PER'").first()["token"] == "Jane"
    js = put(tmp_path / "a.jsonl", json.dumps({"sentence": "s1", "x": 1}) + "\n" + json.dumps({"text": "t2"}) + "\n")
    assert sorted(r["text"] for r in S.read_texts(spark, js, "jsonl").collect()) == ["s1", "t2"]
    plain = put(tmp_path / "a.txt", "one\n\n two \n")
    assert sorted(r["text"] for r in S.read_texts(spark, plain, "plain").collect()) == ["one", "two"]
    kinds = {r["file"].rsplit("/", 1)[1]: r["kind"] for r in S.sniffed_formats(spark, f"{tmp_path}/a.*").collect()}
    assert kinds == {"a.conll": "conll", "a.jsonl": "json", "a.txt": "plain"}


def test_verses_and_exports(spark, tmp_path):
    put(tmp_path / "ruth_2.txt", "the first verse\nshort\nthe second verse\n")
    assert [(r["book"], r["chapter"], r["verse"]) for r in S.read_verses(spark, f"{tmp_path}/*.txt").orderBy("verse").collect()] == [("ruth", "2", 1), ("ruth", "2", 2)]
    tasks = spark.createDataFrame([(1, [("ann", [("bias", "yes"), ("note", "x")]), ("bob", [("bias", "no")])])], "id int, annotations array<struct<annotator:string,result:array<struct<from_name:string,value:string>>>>")
    assert {(r["annotator"], r["choices"]["bias"]) for r in S.flattened_export(tasks).collect()} == {("ann", "yes"), ("bob", "no")}
    S.write_corpus(spark.createDataFrame([("a",), ("b",)], "text string"), f"{tmp_path}/out", "src", ["text"])
    assert sorted(r["id"] for r in spark.read.json(f"{tmp_path}/out").collect()) == ["src_000001", "src_000002"]
    registry = spark.createDataFrame([("v1", 0.5)], "tag string, f1 double")
    assert S.appended_registry(registry, spark.createDataFrame([("v1", 0.6), ("v2", 0.7)], "tag string, f1 double")).first()["tag"] == "v2"


def events(spark, folder, n=300):
    rows = spark.range(n).select("id", (F.col("id") % 7).alias("audit_id"), (F.col("id") % 3).alias("reviewer"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 900).alias("ts"), F.when(F.col("id") % 4 == 0, "reject").otherwise("approve").alias("action"), F.concat(F.lit("He text "), (F.col("id") % 50).cast("string")).alias("text"), (F.col("id") % 2 == 0).alias("has_bias"), (F.col("id") % 3 == 0).alias("predicted"), F.lit("en").alias("lang")).withColumn("review_id", F.col("id"))
    rows.write.parquet(folder)
    return spark.read.parquet(folder)


def result(spark, job, tmp_path, name, mode="append", **more):
    J.run(job, f"{tmp_path}/{name}", f"{tmp_path}/{name}-cp", mode, **more).awaitTermination(120)
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_streams_equal_batches(spark, tmp_path):
    batch = events(spark, f"{tmp_path}/in")
    stream = lambda: J.read(spark, f"{tmp_path}/in", batch.schema.simpleString()[7:-1].replace(":", " "))
    audit = result(spark, J.audit_records(stream(), [("he", "they")]), tmp_path, "audit")
    assert audit.count() == 300 and audit.where("rewrite like 'They text %' and has_bias_detected").count() == 300
    J.run(J.audit_records(stream(), [("he", "they")]), f"{tmp_path}/audit", f"{tmp_path}/audit-cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 300  # a restart has nothing left to do

    last = batch.agg(F.max("ts")).first()[0]
    got = result(spark, J.windowed_actions(stream()), tmp_path, "win").where(F.col("start") + F.expr("interval 1 day 1 hour") <= F.lit(last))
    want = J.windowed_actions(batch).where(F.col("start") + F.expr("interval 1 day 1 hour") <= F.lit(last))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 0
    assert result(spark, J.fresh_texts(stream()), tmp_path, "fresh").select("text").distinct().count() == 50
    sessions = result(spark, J.sessions(stream(), gap="1 hour"), tmp_path, "sess")
    assert sessions.count() <= J.sessions(batch, gap="1 hour").count()

    seen = []
    J.run(J.running_confusion(stream()), "", f"{tmp_path}/conf-cp", "complete", each=lambda df, _: seen.append(df.first().asDict())).awaitTermination(120)
    assert seen[-1] == J.running_confusion(batch).first().asDict()


def test_stream_join(spark, tmp_path):
    batch = events(spark, f"{tmp_path}/r")
    batch.select("audit_id", "ts").where("id < 7").write.parquet(f"{tmp_path}/w")
    left, right = spark.read.parquet(f"{tmp_path}/w"), batch
    want = J.joined_reviews(left, right).count()
    schema = lambda df: df.schema.simpleString()[7:-1].replace(":", " ")
    job = J.joined_reviews(J.read(spark, f"{tmp_path}/w", schema(left)), J.read(spark, f"{tmp_path}/r", schema(right)))
    assert result(spark, job, tmp_path, "join").count() == want > 0


def test_whole_texts_are_counted(spark, tmp_path):
    texts = ["aa " * 11 + "bb Jane cc Tom " + "dd " * 500, "ee\tff\n gg", "", "Ann hh"]
    rows = [(i, t, "en", "src0") for i, t in enumerate(texts)] + [(5, " " * 12 + "term", "en", "src0")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [t.split() for _, t, _, _ in rows]
    named = lambda w: "A" <= w[0] <= "Z"
    tags = Counter("B-PER" if named(w) else "O" for ws in words for w in ws)
    assert {r["tag"]: r["n"] for r in catalog.queries()["S11_bio_scan"](spark, str(tmp_path)).collect()} == tags
    terms = Counter(w.lower() for ws in words if any(map(named, ws)) for w in ws if not named(w))
    assert {r["term"]: r["n"] for r in catalog.queries()["A43_person_terms"](spark, str(tmp_path)).collect()} == terms
    tagged = S.read_bio(spark, put(tmp_path / "b.conll", "Jane B-PER\nran O\n\nPER x y\nhe O\n\nsat  O\nBo I-PER\n"))
    both = [sorted((r["term"], r["n"]) for r in P.person_terms(t).collect()) for t in (tagged, tagged.drop("person"))]
    assert both[0] == both[1] == [("ran", 1), ("sat", 1)]
    issues = catalog.queries()["V02_lexicon_issues"](spark, str(tmp_path)).collect()
    assert (5, "IDENTICAL_TERMS") in {(r["row_no"], r["issue"]) for r in issues}
    assert catalog.queries()["V03_lexicon_report"](spark, str(tmp_path)).first()["n_valid"] == 4  # all but document 5


def test_streams_over_many_files(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.xxhash64("event_id"), F.lit(30 * 86_400)))
    kind = F.element_at(F.array(*map(F.lit, ("click", "purchase", "view"))), (F.col("event_id") % 3 + 1).cast("int"))
    rows = spark.range(660).withColumnRenamed("id", "event_id").select("event_id", at.alias("ts"), (F.col("event_id") % 4).alias("user_id"), kind.alias("event_type"), (F.col("event_id") % 100).cast("double").alias("value"), F.concat(F.lit("text "), (F.col("event_id") % 90).cast("string")).alias("props"))
    rows.repartition(220).write.parquet(f"{tmp_path}/events.parquet")
    batch = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert len(batch.inputFiles()) > 200  # three batches
    got = {n: catalog.queries()[n](spark, str(tmp_path)) for n in ("ST02_windowed_actions", "ST04_sessions", "ST05_fresh_texts", "ST07_running_confusion")}
    same = lambda n, want: sorted(map(str, got[n].collect())) == sorted(map(str, want.collect()))
    actions = batch.select("ts", F.when(F.col("event_type") == "view", "reject").otherwise("approve").alias("action"))
    assert same("ST02_windowed_actions", J.windowed_actions(actions).withColumn("start", F.date_format("start", "yyyy-MM-dd")))
    assert same("ST04_sessions", J.sessions(batch.withColumnRenamed("user_id", "reviewer")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))
    assert same("ST07_running_confusion", J.running_confusion(batch.select(F.col("event_type").alias("lang"), (F.col("value") > 50).alias("has_bias"), (F.col("event_id") % 2 == 0).alias("predicted"))))
    assert sorted(r["key"] for r in got["ST05_fresh_texts"].collect()) == sorted(f"text {i}" for i in range(90))


@pytest.mark.parametrize("split", [64, 1 << 27])
def test_csv_cells_with_line_ends(spark, tmp_path, split):
    """Also where a file is split within records, with CR LF, with a header in every file."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        cells = [(str(i), "text " * (i % 7) + ('two\n"lines", ' * (i % 5)), "x\n\n\ny" if i % 3 else None) for i in range(60)]
        spark.createDataFrame(cells, "a string, `b.c` string, d string").repartition(3).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(str(tmp_path / "t"))
        back = S.read_csv(spark, str(tmp_path / "t"))
        assert back.columns == ["a", "b.c", "d"]
        assert sorted(tuple(r) for r in back.collect()) == sorted((a, b or None, d) for a, b, d in cells)
        (tmp_path / "crlf.csv").write_bytes(b'text,has_bias\r\n"one\r\ntwo",TRUE\r\nthree,false\r\n')
        assert [r["text"].split() for r in S.read_texts(spark, str(tmp_path / "crlf.csv"), "csv").orderBy("text").collect()] == [["one", "two"], ["three"]]
        (tmp_path / "truth.csv").write_text('text,has_bias,bias_category\n"a ""b"",\nc",TRUE,Occupation\n')
        assert [(r["text"], r["has_bias"]) for r in S.read_truth(spark, str(tmp_path / "truth.csv"), ["occupation"]).collect()] == [('a "b",\nc', True)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("split", [16, 1 << 27])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_blank_line_ends_a_sentence(spark, tmp_path, split, end):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = ["", "Jane B-PER", "ran O", " \t", "He O", "sat  O", "", "", "x y z", "Bo I-PER"]
        for name in ("a", "b"):
            (tmp_path / name).write_bytes((end.join(lines) + (end if name == "a" else "")).encode())
        assert sorted(r["text"] for r in S.read_texts(spark, str(tmp_path), "conll").collect()) == sorted(["Jane ran", "He sat", "x Bo"] * 2)
        rows = S.read_bio(spark, str(tmp_path)).collect()
        assert sorted((r["pos"], r["token"], r["tag"], r["person"]) for r in rows) == sorted([(0, "Jane", "B-PER", True), (1, "ran", "O", True), (0, "He", "O", False), (1, "sat", "O", False), (1, "Bo", "I-PER", True)] * 2)
        assert len({r["sentence"] for r in rows}) == 6
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("split", [7, 64, 1 << 27])
def test_sentences_of_any_blocks_without_shuffling_lines(spark, tmp_path, split):
    """As lines cut by blank ones in one pass; only edges of blocks go through an exchange, and no line meets a join."""
    import random

    rng = random.Random(split)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        want = []
        for name in range(6):
            lines = [rng.choice(["", " ", "a O", "Jane B-PER", " long" * 9 + " O"]) for _ in range(rng.choice([0, 1, 40]))]
            (tmp_path / f"f{name}").write_text("\n".join(lines))
            runs = "\n".join(x.strip() for x in lines).split("\n\n")
            want += [(f"f{name}", [x for x in run.split("\n") if x]) for run in runs if run.strip()]
        rows = S.read_sentences(spark, str(tmp_path))
        got = [(r["file"].rsplit("/")[-1], r["lines"]) for r in rows.orderBy("file", "sentence").collect()]
        assert got == want and rows.groupBy("file", "sentence").count().where("count > 1").count() == 0
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and rows._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") + plan.count("Aggregate") <= 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
