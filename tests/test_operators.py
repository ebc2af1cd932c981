"""Hand-checked cases of the library's operators."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexiscope.functions import patterns as P
from lexiscope.functions import text as T
from lexiscope.operators import agreement as A
from lexiscope.operators import correct as C
from lexiscope.operators import datasets as D
from lexiscope.operators import detect as X
from lexiscope.operators import lexicon as L
from lexiscope.operators import metrics as M
from lexiscope.operators import quality as Q
from lexiscope.operators import validate as V


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def pairs(spark, a, b):
    return spark.createDataFrame(list(zip(a, b, strict=True)), "x boolean, y boolean")


T_, F_ = True, False


def test_fairness_of_known_lists(spark):
    rows = spark.createDataFrame([(p, g, True) for p, g in zip([T_, T_, F_, F_, T_], "MMFFM", strict=True)], "predicted boolean, g string, has_bias boolean")
    assert M.fairness(rows, "g").first()["demographic_parity"] == 1.0
    rows = spark.createDataFrame([(p, g, True) for p, g in zip([T_, T_, F_, T_], "MMFF", strict=True)], "predicted boolean, g string, has_bias boolean")
    assert M.fairness(rows, "g").first()["equal_opportunity"] == 0.5
    assert M.fairness(rows.where("g = 'M'"), "g").first()["demographic_parity"] == 0.0


def test_agreement_of_known_lists(spark):
    rows = pairs(spark, [T_, T_, F_, T_, F_], [T_, F_, F_, T_, T_])
    assert rows.agg(M.agreement_rate(F.col("x"), F.col("y"))).first()[0] == pytest.approx(0.6)


@pytest.mark.parametrize(("a", "b", "floored", "plain", "certain"), [([T_, T_], [T_, T_], 0.0, 1.0, 1.0), ([T_, F_], [T_, F_], 1.0, 1.0, 1.0), ([T_, F_], [F_, T_], 0.0, -1.0, -1.0)])
def test_kappa_edges(spark, a, b, floored, plain, certain):
    got = A.binary_kappa(pairs(spark, a, b), "x", "y").first()
    assert (got["kappa_floored"], got["kappa"], got["kappa_certain_one"]) == (floored, plain, certain)


def test_alpha_edges(spark):
    ratings = lambda rows: spark.createDataFrame(rows, "doc_id int, annotator string, label boolean")
    same = ratings([(i, a, i % 2 == 0) for i in range(6) for a in "abc"])
    assert A.alpha(same).first()["alpha"] == 1.0
    unanimous = ratings([(i, a, True) for i in range(3) for a in "ab"])
    assert (A.alpha(unanimous).first()["alpha"], A.alpha(unanimous).first()["alpha_clamped"]) == (1.0, 0.0)
    assert A.alpha(ratings([(1, "a", True), (2, "b", None)])).first()["items"] == 0


def test_fatigue_and_consistency(spark):
    rows = [(i, "s", i % 2 == 0, 1000 + i * 60 if i < 15 else 1000 + 15 * 60 + (i - 15) * 120) for i in range(31)]
    df = spark.createDataFrame(rows, "doc_id int, annotator_id string, has_bias boolean, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert Q.fatigue(df, "annotator_id").first()["fatigue"]
    assert not Q.fatigue(df.where("doc_id < 25").withColumn("ts", F.timestamp_seconds(F.col("doc_id") * 60)), "annotator_id").first()["fatigue"]
    assert Q.consistency(df, "annotator_id", ["ts"]).first()["sd"] == 0.0


@pytest.mark.parametrize(("found", "to", "want"), [("CHAIRMAN", "chair", "CHAIR"), ("Chairman", "chair person", "Chair person"), ("chairman", "Chair", "Chair"), ("Mayor", "the MAYOR", "The mayor")])
def test_case_is_kept(spark, found, to, want):
    assert one(spark, T.like_case(F.col("a"), F.col("b")), a=found, b=to) == want


@pytest.mark.parametrize(
    ("text", "term", "to", "warn", "want"),
    [
        ("Le président et PRÉSIDENT.", "président", "président·e", False, "Le président·e et PRÉSIDENT·E."),
        ("He he said the", "he", "they", True, "He [consider They] he [consider They] said the"),
        ("nothing here", "he", "they", False, "nothing here"),
        ("a (b) c", "b", "x$1\\", False, "a (x$1\\) c"),
    ],
)
def test_replacement_in_one_pass(spark, text, term, to, warn, want):
    assert one(spark, C.replaced(F.col("t"), F.col("a"), F.col("b"), warn), t=text, a=term, b=to) == want


def test_windows_over_parts_of_one_annotator(spark):
    """Parts of any size give what one window over all rows gives, also where parts are shorter than a window."""
    import random

    rng = random.Random(4)
    rows = [(i, "hot" if i % 10 else f"a{i % 3}", rng.randrange(1000), rng.random() < 0.3) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id int, annotator_id string, t int, has_bias boolean").withColumn("ts", F.timestamp_seconds("t"))
    own = {n: sorted(map(tuple, Q.consistency(df, "annotator_id", ["ts", "doc_id"], part_rows=n).collect())) for n in (4, 9, 64, 1 << 20)}
    assert all(x == own[4] for x in own.values())
    for name, n, windows, mean, sd, _ in own[4]:
        bits = [float(b) for _, a, t, b in sorted(rows, key=lambda r: (r[2], r[0])) if a == name]
        rates = [sum(bits[k : k + 10]) / 10 for k in range(len(bits) - 9)]
        assert (n, windows) == (len(bits), len(rates)) and mean == pytest.approx(sum(rates) / len(rates), abs=1e-6)
        assert sd == pytest.approx((sum((x - sum(rates) / len(rates)) ** 2 for x in rates) / len(rates)) ** 0.5, abs=1e-6)


def test_golden_sentences(spark):
    lex = spark.createDataFrame([(0, "chairman", "chair", "replace", "profession"), (1, "same", "same", "replace", "profession"), (2, "old boy", "alumnus", "warn", "profession")], "rule_no int, biased string, neutral_primary string, severity string, stereotype_category string")
    docs = spark.createDataFrame([(1, "The chairman will lead the meeting."), (2, "The engineer arrived on time."), (3, "An OLD BOY of the same school"), (4, "an old, boy"), (5, None)], "doc_id int, text string")
    got = {r["doc_id"]: (r["has_bias"], r["n_warn"]) for r in L.detection(docs, lex).collect()}
    assert got == {1: (True, 0), 2: (False, 0), 3: (False, 1), 4: (False, 0), 5: (False, 0)}
    assert {r["doc_id"]: r["rewrite"] for r in C.rewritten(docs.where("doc_id < 3"), lex).collect()} == {1: "The chair will lead the meeting.", 2: "The engineer arrived on time."}


def test_equi_join_equals_theta_join(spark):
    lex = spark.createDataFrame([(i, t, "x", "replace", "c") for i, t in enumerate(["a", "b c", "é", "d-e"])], "rule_no int, biased string, neutral_primary string, severity string, stereotype_category string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "b  c", "B C", "éa É", "d-e", "d e", "ab c"])], "doc_id int, text string")
    theta = docs.join(lex, F.regexp_like("text", L.word_pattern(F.col("biased")))).select("doc_id", "rule_no")
    assert set(map(tuple, L.matches(docs, lex).select("doc_id", "rule_no").collect())) == set(map(tuple, theta.collect()))


def test_all_forms_of_the_lexicon_join_agree(spark):
    terms = ["a", "b c", "é", "d-e", "a b c", "c b", "B C", "", None, "++", "x++ y!", "  b", "a\u0301 b", "b, c", "of", "of of of", "ß s"]
    lex = spark.createDataFrame([(i, t, "x", "replace", "c") for i, t in enumerate(terms)], "rule_no int, biased string, neutral_primary string, severity string, stereotype_category string")
    texts = ["a b c", "b  c", "B C", "éa É", "d-e", "d e", "ab c", "x++ y!z", "x++ y! z", "b, c", "of of", "of of of of", "a\u0301 b", "b c\u0301", "", None, "++", "\nb c\n", "ẞ S ß s", "c b c b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    forms = [sorted(map(tuple, L.matches(docs, lex, small=n, lexicon_bytes=b).select("doc_id", "rule_no").collect())) for n, b in ((64, 0), (0, 1 << 20), (0, 0))]
    assert forms[0] == forms[1] == forms[2] and len(forms[0]) > 20


@pytest.mark.parametrize(
    ("text", "term", "avoid", "want"),
    [
        ('He said "the chairman spoke" today', "chairman", "quote", "quote"),
        ("In 1990 the chairman spoke", "chairman", "historical", "historical"),
        ("In 1990 the chairman spoke", "chairman", "legal", None),
        ("the chairman spoke", "chairman", "", "proper_noun"),
        ("Ofisi yake ni kubwa", "yake", "", "statistical"),
        ("Daktari wake ni mzuri", "wake", "medical", "medical"),
        ("Daktari wake ni mzuri", "wake", "artistic", None),
        ("Mama Amina alifika", "mama", "legal", "proper_noun"),
        ("45% of every chairman", "chairman", "nonsense|statistical", "statistical"),
    ],
)
def test_context_gate(spark, text, term, avoid, want):
    assert one(spark, X.blocking_context(F.col("t"), F.col("m"), F.col("a")), t=text, m=term, a=avoid) == want


def test_gate_reads_the_same_around_a_term_as_in_a_text(spark):
    import random

    rng = random.Random(5)
    some = ['"', "said", "was", "1987", "45%", "Jane Doe", "court", "film", "TAWOMA", "Dr.", "ACME", "the", "idiot", "Idiots", "\n", "aforesaid", "x" * 40, "é"]
    texts = [(i, " ".join(rng.choices(some[:-2], k=rng.randint(3, 14)) + rng.choices(["lorem", "ipsum", *some[-2:]], k=rng.randint(0, 300)) + rng.choices(some, k=rng.randint(0, 9)))) for i in range(300)]
    df = spark.createDataFrame(texts, "i int, t string").withColumn("near", X.around(F.col("t"), F.lit("idiot")))
    conditions = [*X.P.CONTEXTS]
    gates = [[X.blocking_context(F.col("t"), F.lit("idiot"), F.lit(c), near=n) for c in conditions] for n in (F.col("t"), F.col("near"))]
    for mine, own in zip(*gates, strict=True):
        assert df.where(~mine.eqNullSafe(own)).count() == 0
    assert df.where("length(near) < length(t)").count() > 100


def test_context_gate_with_case(spark):
    strict = X.blocking_context(F.col("t"), F.col("m"), F.lit(""), strict_case=True)
    assert one(spark, strict, t="the chairman spoke", m="chairman") is None
    assert one(spark, strict, t="the chairman Smith spoke", m="chairman") == "proper_noun"


def test_pattern_detectors(spark):
    assert one(spark, X.counter_stereotype(F.col("t"), F.lit("en")), t="The father is a great caregiver")["gender"] == "male"
    assert one(spark, X.derogation(F.col("t"), F.lit("en")), t="She is just a woman")["category"] == "capability"
    assert one(spark, X.derogation(F.col("t"), F.lit("sw")), t="si kweli kuwa mwanamke hawezi kuongoza") is None
    assert one(spark, X.derogation(F.col("t"), F.lit("sw")), t="mwanamke hawezi kuongoza")["gender"] == "female"
    found = one(spark, X.gendered_suffix(F.col("t")), t="Daktari wa kike alifika")
    assert (found["from"], found["corrected"]) == ("Daktari wa kike", "Daktari alifika")
    assert one(spark, X.gendered_suffix(F.col("t")), t="mtoto wa kike alifika") is None
    assert one(spark, X.noun_class(F.col("t")), t="Mwalimu") == "1/2" and one(spark, X.noun_class(F.col("t")), t="kitabu") == "7/8"


def test_cascade(spark):
    lex = spark.createDataFrame([(0, "chairman", "chair", "replace", "profession", "quote")], "rule_no int, biased string, neutral_primary string, severity string, stereotype_category string, avoid_when string")
    docs = spark.createDataFrame([(1, "The chairman left", "en"), (2, 'He said "chairman" twice', "en"), (3, "She is just a girl", "en"), (4, "My husband cooks; clean house", "en"), (5, "rubani wa kike", "sw"), (6, "plain", "en")], "doc_id int, text string, lang string")
    scores = spark.createDataFrame([(6, 0.9), (1, 0.99)], "doc_id int, score double")
    got = {r["doc_id"]: (r["bias_label"], r["has_bias"], r["confidence"], r["n_skipped"]) for r in X.cascade(docs, lex, scores).collect()}
    assert got == {1: ("stereotype", True, 0.85, 0), 2: ("neutral", False, 0.7, 1), 3: ("derogation", True, 0.9, 0), 4: ("counter-stereotype", False, 0.85, 0), 5: ("stereotype", True, 0.95, 0), 6: ("neutral", False, 0.9, 0)}


def test_redaction_leaves_no_match(spark):
    text = "Mail a.b@c.org or call (555) 123-4567, card 1234-5678-9012-3456, see https://x.org/y Dr. Jane Roe"
    out = one(spark, T.redacted(F.col("t")), t=text)
    assert out == "Mail [EMAIL] or call [PHONE_US], card [CREDIT_CARD], see [URL] [NAME]"
    assert all(not v for v in one(spark, T.pii_found(F.col("t")), t=out).values())
    assert one(spark, T.social_form(F.col("t")), t="a@b.com @you 0712345678") == "[EMAIL] [USER] [PHONE]"


def test_scores_of_rewrites(spark):
    df = spark.createDataFrame([("a b c", "a b c"), ("a b c d", "a x c d"), ("", "a")], "text string, rewrite string")
    got = {r["rewrite"]: r for r in C.preservation(df).collect()}
    assert got["a b c"]["composite"] == pytest.approx(1.0)
    changed = got["a x c d"]
    assert (changed["rouge_l"], changed["edit"], changed["bleu"]) == pytest.approx((0.75, 0.75, (0.75 + 1 / 3) / 2)) and changed["overlap"] == pytest.approx(0.6)
    assert got["a"]["bleu"] == 0.0 and got["a"]["edit"] == 0.0


def test_sets_and_splits(spark):
    rows = spark.createDataFrame([(i, f" Text {i % 3}", "ab"[i % 2]) for i in range(11)], "doc_id int, text string, k string")
    assert sorted(r["doc_id"] for r in D.first_of_key(rows, D.text_key("text"), ["doc_id"]).collect()) == [0, 1, 2]
    assert [r["new_id"] for r in D.numbered(rows, ["doc_id"], 5).orderBy("doc_id").collect()] == list(range(6, 17))
    blocks = [r["annotator"] for r in D.assigned(rows, ["x", "y", "z"], ["doc_id"]).orderBy("doc_id").collect()]
    assert blocks == ["x"] * 4 + ["y"] * 4 + ["z"] * 3
    split = D.stratified_split(rows, "k", "doc_id", 0.2).where("split = 'val'").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in split} == {"a": 1, "b": 1}
    over = D.oversampled(rows, F.col("doc_id") < 2, "doc_id", 0.5)
    assert over.where("doc_id < 2").count() == 9 and over.where("doc_id >= 2").count() == 9
    up = spark.createDataFrame([(1, "new", None), (2, None, "z")], "doc_id int, text string, k string")
    assert {r["doc_id"]: (r["text"], r["k"]) for r in D.patched(rows, up, "doc_id", ["text", "k"]).where("doc_id in (1, 2)").collect()} == {1: ("new", "b"), 2: (" Text 2", "z")}


def test_validation_rows(spark):
    cols = "row_no int, biased string, neutral_primary string, severity string, tags string, example_biased string, example_neutral string, bias_label string, stereotype_category string"
    lex = spark.createDataFrame([(1, "a", "a", "replace", "", "x", "x", "s", "c"), (2, "a", "a", "warn", "", None, "y", None, ""), (3, "he", "they", "replace", "", "he ran", "they ran", "s", "c"), (4, "", "", "", "", "", "", "", "")], cols)
    got = {(r["row_no"], r["issue"], r["level"]) for r in V.issues(lex, "row_no", V.lexicon_checks()).collect()}
    assert got == {(1, "IDENTICAL_TERMS", "error"), (1, "IDENTICAL_EXAMPLES", "error"), (2, "IDENTICAL_TERMS", "warning"), (2, "MISSING_EXAMPLE_BIASED", "warning"), (2, "MISSING_BIAS_LABEL", "info"), (2, "MISSING_STEREOTYPE_CATEGORY", "info"), (3, "SIMILAR_EXAMPLES", "warning")}
    assert V.header_issues(["language", "biased"])[0] == ("error", "neutral_primary")


def test_ranks_without_one_task(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 10 < 9, "b").alias("label"))
    got = D.ranked(rows, F.col("label"), "id", 3).collect()
    for label in ("a", "b", None):
        own = [r for r in got if r["label"] == label]
        order = sorted(own, key=lambda r: hashlib.md5(f"{r['id']}-3".encode()).hexdigest())
        assert [r["_r"] for r in order] == list(range(1, len(own) + 1)) and {r["_all"] for r in own} == {len(own)}
    few = F.col("label") == "a"
    for made in (D.stratified_split(rows, "label", "id", 0.15), D.oversampled(rows, few, "id", 0.3), D.undersampled(rows, few, "id", 4)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        ranks = [x for x in plan.splitlines() if "row_number" in x and "Window" in x]
        assert ranks and all("_b#" in x for x in ranks)


def test_batches_are_not_collected(spark, tmp_path):
    from lexiscope.plans import catalog

    spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "b"), (4, ""), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog.queries()["S22_batches"](spark, str(tmp_path))
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["batch_id"], r["n"], r["last"]) for r in made.collect()} == {("a", 2, 1), ("b", 1, 0), ("", 1, 0), (None, 1, 0)}


def test_numbered_keeps_every_row(spark):
    """Wide rows over many partitions that adaptive execution coalesces: each number once, in order."""
    from lexiscope.operators.datasets import numbered

    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        rows = spark.range(0, 40_000, 1, 16).select(((F.col("id") * 7919) % 40_000).alias("k"), F.repeat(F.lit("wide"), 190).alias("text"))
        got = numbered(rows, ["k"], 10).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("new_id").alias("d"), F.count_if(F.col("new_id") != F.col("k") + 11).alias("wrong")).first()
        assert (got["n"], got["d"], got["wrong"]) == (40_000, 40_000, 0)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_literal_holds_its_own_end_mark(spark):
    from lexiscope.functions.text import literal

    row = spark.range(1).select(F.regexp_like(F.lit("a\\Eb.c"), literal(F.lit("a\\Eb."))).alias("yes"), F.regexp_like(F.lit("axb"), literal(F.lit("a.b"))).alias("no")).first()
    assert row["yes"] and not row["no"]


def test_counter_stereotype_contexts_in_order():
    from lexiscope.functions import patterns as P

    own = P.CONTEXTS["counter_stereotype"]
    assert "mhandisi" in own[0] and "haki" in own[5]


def test_span_mode_takes_one_rule_a_span(spark):
    from lexiscope.operators import records as E

    lex = spark.createDataFrame([(0, "idiot", "person", "replace"), (1, "trash", "waste", "replace")], "rule_no int, biased string, neutral_primary string, severity string")
    rows = spark.createDataFrame([(1, "Idiot and trash", ["trash idiot"]), (2, "trash", []), (3, "idiot", None)], "doc_id long, text string, spans array<string>")
    got = {r["doc_id"]: (r["rewrite"], r["n_edits"]) for r in E.span_corrected(rows, lex).collect()}
    assert got == {1: ("Person and trash", 1), 2: ("trash", 0), 3: ("idiot", 0)}


def test_paired_wants_equal_keys(spark):
    import pytest

    from lexiscope.operators import records as E

    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(4).withColumn("y", F.lit(1))
    with pytest.raises(ValueError):
        E.paired(a, b, "id")


def test_edit_distance_equals_the_table():
    import random

    rng = random.Random(4)
    for _ in range(300):
        x, y = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
        assert C.edit_distance(x, y) == row[-1]


@pytest.mark.parametrize("text", ["on 5551833 or 1833 lywh it was disgusting", "disgusting since 1833", "disgusting since Mwaka 1833"])
def test_a_pattern_whose_first_group_may_be_absent(spark, text):
    assert one(spark, X.blocking_context(F.col("t"), F.col("a"), F.col("c")), t=text, a="disgusting", c="historical") == "historical"
    assert X.starts(r"\b(a|b)?c") == {"a", "b", "c"} and X.starts(r"\b(a\s)?(b|c)?\d") == {"a", "b", "c", r"\d"}
    assert all(X.quick(p) == p for p in (r"\b(a|b)*c", r"\b(a){0,2}c", r"\bc?d", r"\b(a)?[bc]", r"\b((a|b)c|d)"))


def test_scores_of_long_rewrites_take_no_quadratic_time(spark):
    import time

    words = [f"w{i % 7000}" for i in range(20_000)]
    changed = ["neutral " + w if i % 500 == 0 else w for i, w in enumerate(words)]
    rows = spark.createDataFrame([(1, " ".join(words), " ".join(changed)), (2, "a b a c", "a b b c"), (3, "a", "b"), (4, "a b", "")], "doc_id int, text string, rewrite string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in C.preservation(rows).collect()}
    assert time.perf_counter() - began < 20
    assert got[1]["rouge_l"] == pytest.approx(40_000 / 40_040) and got[1]["edit"] == pytest.approx(1 - 40 / 20_040)
    assert (got[2]["bleu"], got[3]["bleu"], got[4]["bleu"]) == pytest.approx(((1 + 1 / 3) / 2, 0.0, 0.0))
    assert C.lcs_length(list("abcab"), list("abxab")) == 4 and C.lcs_length(list("aaa"), list("aa")) == 2 and C.edit_distance(list("aba"), list("ababa")) == 2


def test_cues_and_openings_are_needed_by_their_patterns(spark):
    """A text without a pattern's cue holds no match; only listed conditions are evaluated; a language's patterns wait for an opening."""
    cues = {p: X.cue(p) for ps in P.CONTEXTS.values() for p in ps if "{term}" in p}
    assert cues[r"{term}.{0,50}\b(alisema|anasema|said|says)\b"] == r"\b(alisema|anasema|said|says)\b"
    assert cues[r"\b(mwaka\s+)?\d{4}\b.{0,50}{term}"] == r"\b(mwaka\s+)?\d{4}\b" and cues[r"\b[A-Z]{2,6}\b.{0,20}{term}"] is None
    assert X.opening(r"\b(a|b)\b.{0,30}\bc") == r"(a|b)\b" and X.opening(r"\b(a.b|c)x") == "(a.b|c)x" and X.opening("a.*b") is None
    texts = [("in 5551833 or 1833 he", "historical", "historical"), ("a survey of he", "legal|statistical", "statistical"), ("he, 45.5%", "statistical", "statistical"), ("he in SAID", "legal|quote", "quote"), ("court; song", "legal|artistic", None)]
    for text, avoid, want in texts:
        assert one(spark, X.blocking_context(F.col("t"), F.col("a"), F.col("c")), t=text, a="he", c=avoid) == want
    found = lambda f, text, lang: one(spark, f(F.col("t"), F.col("l")), t=text, l=lang)
    assert found(X.derogation, "yeye ni tu msichana", "sw")["category"] == "capability" and found(X.derogation, "si kweli kuwa ni tu msichana", "sw") is None
    assert found(X.derogation, "yeye ni tu msichana", "en") is None and found(X.derogation, "They CRY like", "en")["gender"] == "female"
    assert found(X.counter_stereotype, "Baba anapika", "sw")["gender"] == "male" and found(X.counter_stereotype, "Ababa anapika", "sw") is None


def test_profile_of_nouns_equals_their_classes(spark):
    text = "Mwalimu, watoto MAJI\u00a0 Kitabu kitabu! mkulima Nyumba nyu ni wa \u212aitabu Vyombo xyz mtu"
    words = [r["w"] for r in spark.range(1).select(F.explode(T.stripped_tokens(F.lit(text))).alias("w")).where("length(w) >= 3").collect()]
    classes = [one(spark, X.noun_class(F.col("n")), n=w) for w in words]
    got = one(spark, X.noun_profile(F.col("t")), t=text)
    assert got["m_wa"] == [w for w, c in zip(words, classes, strict=True) if c == "1/2"] and got["total"] == sum(c is not None for c in classes)
    assert [tuple(x) for x in got["others"]] == [(w, c) for w, c in zip(words, classes, strict=True) if c not in (None, "1/2")] and len(got["others"]) > 4
    assert spark.range(1).select(X.noun_profile(F.lit(None).cast("string")).alias("p")).select("p.total").first()[0] is None
    plan = spark.createDataFrame([("a",)], "t string").select(X.noun_profile(F.col("t")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # the classed words are found once


def test_only_texts_that_may_change_are_normalised(spark):
    import re
    import unicodedata

    settled = re.compile(f"[{re.sub(r'x.([0-9a-f]+).', lambda m: chr(92) + 'U' + m[1].rjust(8, '0'), T.settled_characters()).replace(chr(92) * 2, chr(92))}]")
    own = [chr(c) for c in range(0x3000) if settled.match(chr(c))]
    assert {"a", "\u00e9", "\u017e"} <= set(own) and not {"\u00a0", "\u0301", "\ufb01", "\u2026", "\u00bd"} & set(own)
    assert all(unicodedata.is_normalized("NFKC", a + b) for a in own for b in own[::7])
    texts = ["plain  text ", "caf\u00e9 na\u00efve", "cafe\u0301", "\u00bd\u00a0x", "\ufb01n", "\U0001d400 b", " \n ", "", None, "a\u2026"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.clean_text(F.col("t")).alias("c"), F.col("t").rlike(T.UNSETTLED).alias("odd"))
    got = {r["i"]: r for r in rows.collect()}
    assert [got[i]["c"] for i in range(10)] == ["plain text", "caf\u00e9 na\u00efve", "caf\u00e9", "1\u20442 x", "fin", "A b", None, None, None, "a..."]
    assert [i for i in range(10) if got[i]["odd"]] == [2, 3, 4, 5, 9]


def test_a_large_lexicon_of_terms_that_begin_alike(spark):
    """No text meets all rules that begin with its words; runs whose checksum has a bit but that are no term are left out."""
    lex = spark.range(3000).select(F.col("id").alias("rule_no"), F.concat(F.lit("of the w"), "id").alias("biased"), F.lit("x").alias("neutral_primary"), F.lit("replace").alias("severity"), F.lit("c").alias("stereotype_category"))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("Of the W"), "id", F.lit(", of the w"), F.col("id") + 2900, F.lit(" of, the w1")).alias("text"))
    got = sorted(map(tuple, L.matches(docs, lex, small=0, lexicon_bytes=0).select("doc_id", "rule_no").collect()))
    assert got == sorted({(i, i) for i in range(400)} | {(i, i + 2900) for i in range(100)})
    bits = L.bitmap_of(spark.createDataFrame([("of the",), ("é",)], "core string"), 1024)
    assert L.grams("x of the é the of", 3, bits) == {"of the", "é"} and L.grams("́of the", 3, bits) == set()
    assert {"of the", "é", "of"} <= L.grams("of the é", 1 << 20, b"\xff") and L.grams("", 3, bits) == set()


LEXICON_SCHEMA = "rule_no int, biased string, neutral_primary string, severity string, stereotype_category string"


@pytest.mark.parametrize("pairs", [1, 7, 1 << 18])
def test_detection_without_edit_lists_counts_the_same(spark, monkeypatch, pairs):
    """Counts by batches of texts, of any size, equal those of edit lists, in every form of the lexicon join."""
    monkeypatch.setattr(L, "PAIRS", pairs)
    terms = ["a", "b c", "\u00e9", "d-e", "a b c", "c b", "B C", "", None, "++", "x++ y!", "  b", "a\u0301 b", "b, c", "of", "of of of", "\u00df s", "Of"]
    rows = [(None if t == "c b" else 90 - i, t, "of" if t == "of" else "x", [None, "warn", "replace", "replace"][i % 4], None if i % 5 == 0 else f"c{i % 3}") for i, t in enumerate(terms)]
    lex = spark.createDataFrame(rows, LEXICON_SCHEMA)
    texts = ["a b c", "b  c", "B C", "\u00e9a \u00c9", "d-e", "d e", "ab c", "x++ y!z", "x++ y! z", "b, c", "of of", "of of of of", "a\u0301 b", "b c\u0301", "", None, "++", "\nb c\n", "\u1e9e S \u00df s", "c b c b"]
    docs = spark.createDataFrame([(f"d{i % 17}", t) for i, t in enumerate(texts)] + [(None, "a b c")], "doc_id string, text string").repartition(3)
    columns = ("doc_id", "n_replace", "n_warn", "has_bias", "primary_category")
    want = sorted(map(str, L.detection(docs, lex).select(*columns).collect()))
    assert len(want) == 21 and sum("has_bias=True" in r for r in want) > 8
    for small, size in ((64, 0), (0, 1 << 20), (0, 2000), (0, 0)):
        got = L.detection(docs, lex, edits=False, small=small, lexicon_bytes=size).select(*columns)
        assert got.schema == L.detection(docs, lex).select(*columns).schema and sorted(map(str, got.collect())) == want


@pytest.mark.parametrize("size", [1 << 30, 0])
def test_a_term_is_passed_on_once_for_many_texts(spark, size):
    """What is shuffled to meet the rules has a row for each term of a batch of texts, not one for each term of each text."""
    lex = spark.range(200).select(F.col("id").alias("rule_no"), F.concat(F.lit("of the w"), "id").alias("biased"), F.lit("x").alias("neutral_primary"), F.lit("replace").alias("severity"), F.lit("c").alias("stereotype_category"))
    text = " ".join(f"of the w{i}" for i in range(200))
    docs = spark.range(0, 500, 1, 2).select(F.col("id").alias("doc_id"), F.lit(text).alias("m_text"))
    met = L.term_matches(docs, lex, size).select("rule_no", F.size("m_docs").alias("n")).collect()
    assert len(met) == 2 * 200 and sum(r["n"] for r in met) == 500 * 200


def test_detection_by_a_lexicon_of_single_words_only(spark):
    lex = spark.createDataFrame([(i, t, "x", k, f"c{i}") for i, (t, k) in enumerate([("the", "warn"), ("Cat", "replace"), ("dog", "replace"), ("the", "replace")])], LEXICON_SCHEMA)
    docs = spark.createDataFrame([(1, "The cat, the dog"), (2, "a dog and a dog"), (3, "none"), (4, "THE")], "doc_id long, text string")
    got = L.detection(docs, lex, edits=False, small=0).select("doc_id", "n_replace", "n_warn", "has_bias", "primary_category")
    assert sorted(map(tuple, got.collect())) == [(1, 3, 1, True, "c1"), (2, 1, 0, True, "c2"), (3, 0, 0, False, None), (4, 1, 1, True, "c3")]
    assert L.matches(docs, lex.where("false"), small=-1).count() == 0
