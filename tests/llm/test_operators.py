"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiscope.llm import alignment, components, decontaminate, fingerprints, html_extract, langid, lexical, mixing, neardup, secrets, sharding, tokens, topk, toxicity
from lexiscope.llm.common import saved
from lexiscope.llm.html_blocks import leaves

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# language ID


def test_language_id(spark):
    rng = random.Random(1)
    vocab = {"en": ["the", "and", "house", "water"], "de": ["der", "und", "haus", "wasser"]}
    rows = [(i, " ".join(rng.choice(vocab[l]) for _ in range(12)), l, None, 0) for i, l in enumerate(["en", "de"] * 30)]
    docs = frame(spark, rows)
    model = langid.fit(docs)
    cases = [(1, "the house"), (2, "der hause"), (3, None), (4, ""), (5, "123 !! ½ ② Ⅷ"), (6, "hauses " * 30_000), (7, "the house")]
    got = {r["doc_id"]: r["s"] for r in frame(spark, cases, "doc_id long, text string").select("doc_id", langid.identify(F.col("text"), model, spark).alias("s")).collect()}
    assert (got[1]["lang"], got[2]["lang"], got[6]["lang"]) == ("en", "de", "de")
    assert all(got[i]["lang"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5))
    assert got[1] == got[7] and 0 <= got[1]["score"] <= 1


def test_language_id_without_labels(spark):
    model = langid.fit(frame(spark, []))
    assert langid.Scorer(model).score("the house") == ("und", 0.0)


def test_backoff_takes_longest_known_grams():
    tables = [({"abc": 0}, np.array([[1.0, -1.0]]))] + [({}, np.zeros((0, 2)))] * 2 + [({"abd": 0}, np.array([[-1.0, 1.0]])), ({}, np.zeros((0, 2))), ({"a": 0}, np.array([[5.0, -5.0]]))]
    scorer = langid.Scorer({"langs": ["x", "y"], "tables": tables})
    assert scorer.word("abc").tolist() == [1.0, -1.0]
    assert scorer.word("zabd").tolist() == pytest.approx([-(0.7**3), 0.7**3])
    assert scorer.word("qqq").tolist() == [0, 0]


# exact top-k


def brute_top(q, c, k):
    out = {}
    for qi, qv in q:
        scored = sorted(((-sum(x * y for x, y in zip(qv, cv, strict=True)), ci) for ci, cv in c if ci != qi and len(cv) == len(qv)))
        out[qi] = [(ci, -s) for s, ci in scored[:k]]
    return out


@pytest.mark.parametrize("blocks", [(3, 7), (512, 16384)])
def test_top_k_equals_brute_force(spark, blocks):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-3, 4) for _ in range(20)]) for i in range(120)] + [(200 + i, [1] * 20) for i in range(30)]
    vectors = frame(spark, rows, "id long, v array<long>")
    got = topk.top_k(vectors.where("id % 10 = 0"), vectors, 5, *blocks).collect()
    want = brute_top([r for r in rows if r[0] % 10 == 0], rows, 5)
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert mine == want


def test_top_k_skips_bad_vectors(spark):
    rows = [(0, [0.5, 0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [-0.001, 0.25])]
    v = frame(spark, rows, "id long, e array<float>").select("id", topk.scaled(F.col("e")).alias("v"))
    assert {r["id"]: r["v"] for r in v.collect() if r["v"] is not None} == {0: [128, 128], 6: [-1, 64]}
    got = topk.top_k(v.where("id = 0"), v, 5).collect()
    assert [(r["vec_id"], r["score"], r["rank"]) for r in got] == [(6, 128 * -1 + 128 * 64, 1)]
    assert topk.top_k(v.limit(0), v, 5).count() == 0


# toxicity


def test_transducers():
    fade = toxicity.FADE
    tape = [("N", 0.0), (".", 0.0), ("I", 2.0)]
    assert list(toxicity.patterns(tape)) == [("n", 2.0 * fade)]
    assert list(toxicity.patterns([("Y", 0.0), (".", 0.0), ("I", 2.0)])) == [("y", 2.0 * fade)]
    assert list(toxicity.patterns([("I", 2.0), ("Y", 0.0)])) == [("y", 2.0)]
    assert list(toxicity.patterns([("R", 0.0), (".", 0.0), ("I", 2.0)])) == [("r", 2.0)]
    assert list(toxicity.patterns([("Q", 0.0), ("I", 2.0), ("Q", 0.0), ("I", 1.0)])) == [("r", 2.0), ("I", 1.0)]
    assert list(toxicity.patterns([("T", 2.0), (".", 0.0), ("Y", 0.0)])) == [("t", 2.0 * fade)]
    assert list(toxicity.patterns([("T", 2.0), (".", 0.0)])) == []
    assert list(toxicity.patterns([("N", 0.0), (",", 0.0), ("I", 2.0)])) == [("I", 2.0)]
    rng = random.Random(2)
    for _ in range(200):
        tape = [(rng.choice(toxicity.SYMBOLS[:8]), rng.random()) for _ in range(rng.randrange(12))]
        one_by_one = toxicity.TARGETED.run(toxicity.REPORTED.run(toxicity.NEGATION.run(tape)))
        assert [s for s, _ in toxicity.FORWARD.run(tape)] == [s for s, _ in one_by_one]
        assert [w for _, w in toxicity.FORWARD.run(tape)] == pytest.approx([w for _, w in one_by_one])


def test_toxicity_learns_stems_and_scores(spark):
    rng = random.Random(3)
    bad = [f"grumz{s}" for s in ("en", "ta", "or", "il", "um")]
    docs, labels = [], []
    for i in range(240):
        own = words(rng, 40).split()
        if i % 4 == 0:
            own[rng.randrange(40)] = rng.choice(bad)
        docs.append((i, " ".join(own), None, None, 0))
        labels.append((i, None, int(i % 4 == 0)))
    labels += [(5, 1, None), (None, 1, 1)]
    df, lab = frame(spark, docs), frame(spark, labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(df, lab))
    assert any(s.startswith("grumz") and s.endswith("*") for s in model["stems"])
    cases = [(1, "w1 w2 grumzxyz w3"), (2, "w1 w2 w3"), (3, None), (4, ""), (5, "w1 " * 50_000 + "grumzxyz"), (6, "w1 w2 grumzxyz w3")]
    got = {r["doc_id"]: r["s"] for r in frame(spark, cases, "doc_id long, text string").select("doc_id", toxicity.toxicity(F.col("text"), model, spark).alias("s")).collect()}
    assert got[1] >= 0.5 and got[5] >= 0.5 and got[1] == got[6]
    assert got[2] < 0.5 and got[3] == got[4] == got[2]


def test_toxicity_without_labels(spark):
    empty = frame(spark, [], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(frame(spark, [(1, "x", None, None, 0)]), empty))
    assert model["stems"] == {} and toxicity.Grammar(**{"stems": {}, "coefficients": model["coefficients"]}).score("x") < 0.5


# HTML


def test_leaves_of_rough_markup():
    page = '<html><head><title>T</title></head><body><!-- a <p>no</p> --><div class="ad">A&amp;B</div><article><h1>Hi</h1><p>One <b>two\n three<p>Four &lt;x&gt; &am<script>var a="</p>";</script><style>p{}</style></article><ul><li>x<li>y</ul>tail'
    assert [x.text for x in leaves(page)] == ["A&B", "Hi", "One two three", "Four <x> &am", "x", "y", "tail"]
    assert leaves(None) == [] and leaves("") == [] and leaves("<p") == [] and leaves("just text")[0].text == "just text"


@pytest.mark.parametrize(
    "before",
    [
        "<script>for(i=0;i<n;i++){f(i)}</script>",
        "<SCRIPT type=x>var a='<!--';if(a<b)f(\"it's\")</Script >",
        "<script><!-- document.write('<script src=x></script>') //--></script>",
        "<script>var a='<!--<script>'</script>",
        "<style>a:after{content:'<!--'}</style>",
        "<noscript><!-- x</noscript><iframe><p <</iframe>",
        "<head><script>for(i=0;i<n;i++){f(i)}</script></head>",
        "<head><title>T <b</title><meta charset=x>",
        "<head><title>T</title><link href=x><body class=y>",
        "<head><title>T</head><body>",
        "<head><template><p>no</head><body>",
        "<svg><title>T</svg>",
        "<canvas><script>a<b</script></canvas>",
    ],
)
def test_html_after_raw_text(before):
    page = f"<html>{before}<p>One</p><p>Two <b>three</b></p><script>g(a<b)</script><p>Four</p>"
    assert [x.text for x in leaves(page)] == ["One", "Two three", "Four"]


def test_inline_elements_and_quotes():
    texts = lambda page: [x.text for x in leaves(page)]
    assert texts("<p>a <img src=x> b</p>") == ["a b"] and texts("<p>a <svg><g>t</g></svg> b</p>") == ["a b"]
    assert texts("<p>a <script>f(1<2)</script> b</p>") == ["a b"] and texts("<p>a <my-tag>b</my-tag> c</p>") == ["a b c"]
    assert texts("<p>5<x it's here</p><p>z's</p><p>c</p>") == ["5", "z's", "c"]
    assert texts("<p>a <button>Go</button> b</p>") == ["a b", "Go"] and texts('<a title="x>y">t</a>') == ["t"]
    assert texts("<svg><svg>a</svg>b</svg><p>c</p><object>d<object>e</object>f</object>g") == ["c", "g"]
    assert texts("<p>a&nbsp; b</p>") == ["a b"]


def test_html_textarea_and_head_text():
    assert [x.text for x in leaves("<form><textarea><!-- <p>x</textarea></form><p>One</p>")] == ["<!-- <p>x", "One"]
    assert [x.text for x in leaves("<textarea><p>One</p><textarea><p>Two</p>")] == ["One", "Two"]
    assert [x.text for x in leaves("<head><title>T</title>Hello<p>One")] == ["Hello", "One"]
    assert [x.text for x in leaves("<head><script>x<y</head><body><p>One")] == ["One"]
    assert [x.text for x in leaves("<p>One</p><script>var a = 1; <p>no</p>")] == ["One"]


def test_extraction_accuracy(spark):
    rng = np.random.default_rng(4)
    texts = [words(random.Random(i), 80) for i in range(30)]
    pages = frame(spark, [(i, f"<html><body><nav><a href=x>{texts[i][:20]}</a></nav><article><p>{texts[i]}</p></article><footer>f</footer></body></html>") for i in range(30)] + [(90, None), (91, "")], "page_id long, html string")
    params = html_extract.fit(pages)
    got = {r["page_id"]: r["t"] for r in pages.select("page_id", html_extract.main_text(F.col("html"), params).alias("t")).collect()}
    assert all(got[i] == texts[i] for i in range(30)) and got[90] == "" and got[91] == ""
    net, features = html_extract.BiLstm(params), html_extract.Features()
    right = total = 0
    for _ in range(60):
        markup, main = html_extract.laid_out(rng, texts)
        page = leaves(markup)
        y = [x.text.split()[0] in main for x in page]
        for x in page:
            x.parts = [x.text.partition(" ")[2] or x.text]
        s = net.label([features.rows(page)])[0] >= 0.5
        right += int((s == np.array(y)).sum())
        total += len(y)
    assert right / total > 0.97


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    net = html_extract.BiLstm()
    x, mask = rng.normal(size=(4, 2, html_extract.WIDTH)), np.ones((4, 2))
    mask[3, 1] = 0
    y = rng.integers(0, 2, (4, 2)).astype(float)
    loss = lambda: -float(((y * np.log(s := net.scores(x, mask)[0]) + (1 - y) * np.log(1 - s)) * mask).sum() / mask.sum())
    grad = net.gradients(x, y, mask)
    for k in grad:
        at = tuple(rng.integers(0, n) for n in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        up = loss()
        net.p[k][at] = old - 1e-5
        down = loss()
        net.p[k][at] = old
        assert grad[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


# sharding


def test_sharding(spark):
    rows = [(i, None if i % 9 == 0 else "x" * (i % 50), "en", None, i) for i in range(500)] + [(7, "same", None, None, None)] * 40 + [(None, None, None, None, None)] * 5
    docs = frame(spark, rows).withColumn("rows", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    out = sharding.shuffled_shards(docs, 24, bucket_bytes=2000)
    got = out.select("doc_id", "text", "shard", "slot", "bucket").collect()
    assert len(got) == len(rows) and out.columns == [*docs.columns, "shard", "slot"]
    places = {(r["shard"], r["slot"]) for r in got}
    counts = [sum(p[0] == s for p in places) for s in range(24)]
    assert len(places) == len(rows) and max(counts) - min(counts) <= 1
    assert all((s, k) in places for s in range(24) for k in range(counts[s]))
    seen = lambda df: sorted(map(str, sharding.shuffled_shards(df, 24, bucket_bytes=2000).select("doc_id", "shard", "slot").collect()))
    assert seen(docs) == sorted(str(r) for r in out.select("doc_id", "shard", "slot").collect())
    few = docs.where("text is null or text <> 'same'").where("doc_id is not null")
    assert seen(few) == seen(few.repartition(3))
    assert sharding.shuffled_shards(frame(spark, []), 24).count() == 0
    clash = sharding.shuffled_shards(docs.withColumn("slot", F.lit(1)), 24)
    assert clash.columns[-2:] == ["shard", "slot_"] and clash.count() == len(rows)


def test_sharding_spreads_equal_rows(spark, tmp_path):
    frame(spark, [(1, "same text", None, None, 0)] * 3000 + [(i, f"t{i}", None, None, 0) for i in range(300)]).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = sharding.shuffled_shards(docs, 7, bucket_bytes=3000).select("doc_id", "shard", "slot", F.spark_partition_id().alias("p")).collect()
    assert len({(r["shard"], r["slot"]) for r in out}) == 3300
    held = [sum(r["p"] == p for r in out if r["doc_id"] == 1) for p in {r["p"] for r in out}]
    assert max(held) < 400


def test_sharding_writes(spark, tmp_path):
    docs = frame(spark, [(i, f"t{i}", None, None, 0) for i in range(50)])
    sharding.write_shards(sharding.shuffled_shards(docs, 4), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


# mixing


def test_targets_share_and_cap(spark):
    sizes = frame(spark, [("sa", 100), ("sb", 1000), ("sc", 50), ("n", 10)], "skey string, source_size long")
    got = {r["skey"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    want, left, budget = {}, {"sa": (5, 100), "sb": (2, 1000), "sc": (1, 50), "n": (5, 10)}, 1.5 * 1160
    while left:
        share = budget / sum(w for w, _ in left.values())
        full = {k: 2.0 * s for k, (w, s) in left.items() if share * w > 2 * s}
        if not full:
            want |= {k: share * w for k, (w, _) in left.items()}
            break
        want |= full
        budget -= sum(full.values())
        left = {k: v for k, v in left.items() if k not in full}
    assert got == pytest.approx(want)


def test_splitting_tree_keeps_totals(spark):
    quotas = frame(spark, [("sa", 1000), ("sb", 37), ("sc", 0), ("n", 500)], "skey string, quota long")
    got = {r["skey"]: r["cum"] for r in mixing.splitting_tree(quotas, 24, 5).collect()}
    assert {k: (v[0], v[-1], len(v)) for k, v in got.items()} == {"sa": (0, 1000, 25), "sb": (0, 37, 25), "sc": (0, 0, 25), "n": (0, 500, 25)}
    per_shard = [sum(v[j + 1] - v[j] for v in got.values()) for j in range(24)]
    assert max(per_shard) - min(per_shard) <= 1
    assert all(v[j + 1] >= v[j] for v in got.values() for j in range(24))


def test_hypergeometric_distribution(spark):
    u = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    one = lambda x: F.lit(x).cast("long")
    got = u.select(mixing.hypergeometric(F.col("u"), one(50), one(20), one(10)).alias("x")).groupBy("x").count().collect()
    from math import comb

    for r in got:
        p = comb(20, r["x"]) * comb(30, 10 - r["x"]) / comb(50, 10)
        assert r["count"] / 20_000 == pytest.approx(p, abs=2e-4)
    edge = spark.range(1).select(mixing.hypergeometric(F.lit(0.4), one(5), one(5), one(3)).alias("a"), mixing.hypergeometric(F.lit(0.4), one(0), one(0), one(0)).alias("b"), mixing.hypergeometric(F.lit(0.4), one(9), one(0), one(4)).alias("c")).first()
    assert tuple(edge) == (3, 0, 0)


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(1, 60)), None, rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(300)] + [(900, None, None, "a", 0), (901, "", None, None, 0), (902, " \n\t ", None, "z", 0)] + [(7, "one two three", None, "b", 0)] * 3
    docs = frame(spark, rows).withColumn("size", mixing.word_count(F.col("text"))).withColumn("at", F.lit(0)).withColumn("skey", F.lit("x"))
    out = mixing.mixed(docs)
    got = out.select("doc_id", "source", "size", "source_size", "target", "taken", "at", "skey").collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    assert all(s[0] == s[3] and abs(s[1] - s[2]) <= 0.02 * s[3] + 1 for s in by.values())
    assert by["z"][:3] == [0, 0, 0.0]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(3)).select("doc_id", "source", "size", "source_size", "target", "taken", "at", "skey").collect()))
    mixture = mixing.mixture(docs).select("doc_id", "text", "shard").collect()
    assert sum(len(r["text"].split()) for r in mixture) == sum(r["taken"] for r in got)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1] or "")
    assert all(any(r["text"].strip() in t for t in texts[r["doc_id"]]) for r in mixture) and {r["shard"] for r in mixture} <= set(range(24))
    assert mixing.mixed(docs.limit(0)).count() == 0
    clash = docs.withColumn("target", F.lit(1)).withColumn("piece", F.lit(2)).withColumn("r", F.lit(3)).withColumn("shard", F.lit(4))
    assert mixing.mixed(clash).columns == [*clash.columns, "source_size", "target_", "pieces", "taken"]
    assert mixing.mixture(clash).columns == [*clash.columns, "shard_", "shard_key"] and mixing.mixture(clash).count() == len(mixture)


def test_mixing_takes_what_the_shards_draw(spark):
    """The quotas of the tree, recomputed from all blocks: each shard takes as many blocks of a source as its quota says."""
    rng = random.Random(9)
    docs = frame(spark, [(i, words(rng, rng.randrange(1, 40)), None, "ab"[i % 3 == 0], 0) for i in range(200)]).withColumn("size", mixing.word_count(F.col("text")))
    out = mixing.mixed(docs, n_shards=5).select("doc_id", "source", "size", "source_size", "target", "pieces", "taken").collect()
    drawn, words_of = {}, {}
    for r in out:
        assert r["taken"] == sum(p["n"] for p in r["pieces"])
        for p in r["pieces"]:
            drawn.setdefault((r["source"], p["shard"]), set()).add((p["epoch"], p["block"]))
            words_of[r["source"], p["epoch"], p["block"]] = words_of.get((r["source"], p["epoch"], p["block"]), 0) + p["n"]
    blocks, quotas = {}, {}
    for r in out:
        block = max(1, min(mixing.BLOCK_WORDS, r["source_size"] // mixing.MIN_BLOCKS))
        blocks[r["source"]] = -(-r["source_size"] // block)
        epochs = int(r["target"] / r["source_size"] + 1e-9)
        quotas[r["source"]] = epochs * blocks[r["source"]] + round((r["target"] - epochs * r["source_size"]) / block)
    keys = frame(spark, [("s" + k, q) for k, q in quotas.items()], "skey string, quota long")
    cum = {r["skey"][1:]: r["cum"] for r in mixing.splitting_tree(keys, 5, 41).collect()}
    for source, own in cum.items():
        for j in range(5):
            assert len(drawn.get((source, j), ())) == own[j + 1] - own[j]
        taken = [x for j in range(5) for x in drawn.get((source, j), ())]
        assert len(taken) == len(set(taken)) == quotas[source]
        assert {b for e, b in taken if e == 0} == set(range(blocks[source])) or quotas[source] < blocks[source]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permuted_is_a_permutation(spark, n):
    got = [r["p"] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 100 or sum(a == b for a, b in enumerate(got)) < 20)


def test_mixing_spreads_equal_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "SUB_ROWS", 50)
    frame(spark, [(1, "a b c", None, "s", 0)] * 400 + [(i, "x y", None, "t", 0) for i in range(50)]).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d")).withColumn("size", mixing.word_count(F.col("text")))
    got = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s")).collect()
    assert all(abs(r["t"] - r["g"]) <= 0.02 * r["s"] + 1 for r in got)


# decontamination

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items):
    norm = lambda t: LETTERS.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    own, hit, found = norm(text), set(), set()
    for item, t in items:
        w = norm(t)
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(own), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(i, words(rng, n, 30)) for i, n in enumerate([1, 3, 5, 6, 7, 12, 13, 14, 40, 60, 0])] + [(50, None), (51, "!!"), (8, "another text of one id " + words(rng, 20, 30)), (60, "The SAME Passage " + words(rng, 15, 30))]
    docs = []
    for i in range(150):
        own = words(rng, rng.randrange(0, 80), 30).split()
        if i % 3 == 0:
            src = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(src) + 1)
            at = rng.randrange(len(own) + 1)
            own[at:at] = src[a : a + rng.randrange(8, 30)]
        docs.append((i, " ".join(own).upper() if i % 5 == 0 else " ".join(own)))
    docs += [(500, None), (501, ""), (502, items[9][1]), (502, items[9][1]), (None, items[8][1]), (503, " ".join([items[9][1]] * 300))]
    df, bench = frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        rows, hits = decontaminate.find_hits(df, bench, broadcast_bytes=limit)
        got = hits.select("id", "n_words", decontaminate.hit_words(F.col("spans")).alias("n"), F.array_sort("items").alias("items")).collect()
        every = {(i, brute_hits(t, items)[0]): brute_hits(t, items) for i, t in docs}
        assert sorted(map(str, ((r["id"], r["n_words"]) for r in rows.collect()))) == sorted(str((i, brute_hits(t, items)[0])) for i, t in docs)
        assert {(r["id"], r["n_words"]): (r["n_words"], r["n"], r["items"]) for r in got} == {k: v for k, v in every.items() if v[1]}
        assert len(got) == sum(v[1] > 0 for v in every.values())
    kept = {r["doc_id"] for r in decontaminate.decontaminated(df, bench).collect()}
    assert kept == {i for i, t in docs if not (brute_hits(t, items)[1] > 0 and 20 * brute_hits(t, items)[1] >= brute_hits(t, items)[0])}


def test_decontamination_edges(spark):
    df, none = frame(spark, [(1, "a b c")], "doc_id long, text string").withColumn("item", F.lit(1)), frame(spark, [], "item_id long, text string")
    assert decontaminate.decontaminated(df, none).count() == 1
    assert [x.count() for x in decontaminate.find_hits(df.limit(0), none)] == [0, 0]
    clashing = frame(spark, [(1, "a b c"), (1, "a b c"), (None, "x y")], "doc_id long, text string").withColumn("hit_id", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("words", F.lit(3))
    kept = decontaminate.decontaminated(clashing, frame(spark, [(1, "b c")], "item_id long, text string"))
    assert kept.columns == clashing.columns and [r["doc_id"] for r in kept.collect()] == [None]


def test_decontamination_of_long_texts_is_linear(spark):
    import time

    rng = random.Random(7)
    item = words(rng, 40)
    took = []
    for n in (20_000, 160_000):
        df = frame(spark, [(1, words(rng, n) + " " + item)], "doc_id long, text string")
        began = time.perf_counter()
        hits = decontaminate.find_hits(df, frame(spark, [(1, item)], "item_id long, text string"))[1].collect()
        took.append(time.perf_counter() - began)
        assert len(hits) == 1 and hits[0]["n_words"] == n + 40
    assert took[1] < 8 * took[0] + 2
    cut = decontaminate.decontaminated(frame(spark, [(1, "one. two, three four")], "doc_id long, text string"), frame(spark, [(1, "two three")], "item_id long, text string"), remove_spans=True)
    assert cut.first()["text"] == "one four"


# secrets


def test_base_spans_follow_the_contract():
    key, hexa = "AKIA" + "A1B2C3D4E5F6G7H8", "0123456789abcdef01234567"
    text = f"é password='hunter22' x API_KEY: abc token=abcdef {key} {hexa} {hexa[:23]} ſecret=abcdefg"
    got = secrets.base_spans(text)
    assert [(secrets.KINDS[k], text[s:e]) for s, k, e in got] == [("assign", "password='hunter22"), ("assign", "token=abcdef"), ("access", key), ("hex", hexa)]
    assert secrets.base_spans("") == [] and secrets.shown([(0, 0, 3), (0, 2, 3)]) == "assign:0:3,hex:0:3"


def test_battery_tells_random_from_writing():
    rng = random.Random(7)
    draws = lambda kind, n: "".join(rng.choice(secrets.ALPHABETS[kind]) for _ in range(n))
    found = sum(bool(secrets.random_spans(f"some text {draws('base62', 40)} and more", [])) for _ in range(200))
    assert found > 150
    writing = ["internationalization-and-localization", "get_user_by_identifier_2", "AbstractSingletonProxyFactoryBean", "a" * 200 + "1", "1234567890123456"]
    assert not any(secrets.random_spans(w, []) for w in writing)
    assert secrets.discoveries({}, {}) == {}


def test_discoveries_equal_benjamini_hochberg():
    """By group: middle and spread of the group, weights by length, one threshold over all."""
    rng = random.Random(17)
    model = secrets.writing(secrets.neighbours(["plain writing of the usual kind"] * 50))
    tests = []
    for i in range(6000):
        n, kind = rng.choice([18, 26, 36, 60]), rng.choice(["base62", "lower36", "hex"])
        tests.append((0, n, kind, secrets.length_class(n), secrets.bin_of(rng.gauss(1.0, 1.5) + (9 if i % 20 == 0 else 0))))
    found = secrets.counted(tests)
    groups, limits = secrets.fitted_groups(found, model), secrets.discoveries(found, model)
    assert len(groups) == 12 and all(0.7 < m < 1.5 and 1.2 < w < 2.0 for m, w in groups.values())
    mean = sum(e for _, e, *_ in tests) / len(tests)
    weighted = [secrets.normal_tail((k / secrets.STEPS - secrets.ZERO - groups[g, c][0]) / groups[g, c][1]) * mean / e for _, e, g, c, k in tests]
    ranked = sorted(weighted)
    cut = max((w for r, w in enumerate(ranked, 1) if w <= secrets.FALSE_DISCOVERY * r / len(ranked)), default=-1)
    ours = [k >= limits.get((g, c), secrets.BINS) for _, _, g, c, k in tests]
    assert ours == [w <= cut for w in weighted] and 200 < sum(ours) < 330


def planted_runs(n_slugs, n_secrets, length, kind):
    rng = random.Random(23)
    syllables = "in ter nal re fe rence mo del sys tem net work ta ble or der cus to mer view edit list".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    slugs = ["-".join(word() for _ in range(rng.randint(3, 7))) + rng.choice(["", f"-{rng.randint(1, 99999)}"]) for _ in range(n_slugs)]
    return slugs, ["".join(rng.choice(secrets.ALPHABETS[kind]) for _ in range(length)) for _ in range(n_secrets)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize(("length", "kind", "least"), [(24, "base62", 0.9), (32, "base62", 0.9), (32, "base64", 0.9), (32, "HEX", 0.9), (48, "base32", 0.9), (40, "lower36", 0.9)])
def test_secrets_among_slugs_in_documents(spark, length, kind, least):
    """2,000 slugs and 20 values planted into whole documents: nearly all values are found, at most one slug in a hundred."""
    slugs, values = planted_runs(2000, 20, length, kind)
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(1000).collect()
    rows = []
    for i, r in enumerate(texts):
        own = [*slugs[i * 2 : i * 2 + 2], *(values[i // 50 : i // 50 + 1] if i % 50 == 0 else [])]
        rows.append((i, "\n".join([r["text"], *(f"see {x} here" for x in own), r["text"]])))
    docs = frame(spark, rows, "doc_id long, text string")
    out = docs.select("text", secrets.scan(F.col("text"), secrets.Scanner(docs)).alias("s")).collect()
    hit = {r["text"][int(x.split(":")[1]) : int(x.split(":")[2])] for r in out for x in r["s"]["spans"].split(",") if x.startswith("random")}
    assert sum(v in hit for v in values) >= least * len(values)
    assert sum(any(h in x for h in hit) for x in slugs) <= 20


def test_verdict_on_base_values(spark):
    _, values = planted_runs(0, 40, 40, "hex")
    rows = [(i, f"token={v} and more writing of the plain kind, {i}") for i, v in enumerate(values)] + [(100 + i, "password=correct-horse-battery-staple") for i in range(60)]
    docs = frame(spark, rows, "doc_id long, text string")
    out = docs.select("doc_id", secrets.scan(F.col("text"), secrets.Scanner(docs)).alias("s")).select("doc_id", "s.*").collect()
    assert sum(r["n_base_random"] for r in out if r["doc_id"] < 100) >= 36 and all(set(r["base_encodings"].split(",")) <= {"", "hex", "lower36"} for r in out)
    assert sum(r["n_base_random"] for r in out if r["doc_id"] >= 100) <= 1
    assert secrets.Scanner(docs.limit(0)).limits == {}


@pytest.mark.parametrize("form", ["AUTH={}", "client_id={}&x", "sig={}==", "https://host.example/v1/user-data/{}", "https://host.example/some_path/a-b/{}/edit", "a/long/path/of/words/that/is/writing/{}", "sk-live_key/{}", "some-service-name+with_words-{}"])
def test_secret_values_in_runs(form):
    rng = random.Random(7)
    draws = ["".join(rng.choice(secrets.ALPHABETS["base62"]) for _ in range(48)) for _ in range(50)]
    found = 0
    for d in draws:
        text = f"see {form.format(d)} there"
        at = text.index(d)
        spans = secrets.random_spans(text, [])
        found += any(s <= at and at + 48 <= e for s, _, e in spans)
    assert found >= 45
    assert not secrets.random_spans(f"see {form.format('internationalization_of_the_words')} there", [])


def test_secret_parts_beside_base_spans():
    rng = random.Random(8)
    value = "".join(rng.choice(secrets.ALPHABETS["base62"]) for _ in range(48))
    text = f"AKIA{'A1' * 10}/{value}"
    base = secrets.base_spans(text)
    assert secrets.random_spans(text, base) == [(25, 3, 73)]
    text = f"sig={value} and {value[:40]}/x"
    assert all(s >= 0 and text[s:e] for s, _, e in secrets.random_spans(text, []))
    spans = secrets.random_spans(text, [])
    assert all(a[2] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_secret_scan_column(spark):
    rows = [(1, None), (2, ""), (3, "secret: abcdefgh"), (3, "secret: abcdefgh"), (4, "x " * 100_000 + "token=abcdef")]
    out = frame(spark, rows, "doc_id long, text string").select("doc_id", "text", secrets.scan(F.col("text"), secrets.Scanner(frame(spark, rows, "doc_id long, text string"))).alias("s")).select("doc_id", "s.*", secrets.masked(F.col("text"), F.col("s.spans")).alias("masked")).collect()
    got = {r["doc_id"]: r for r in out}
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["spans"] == "" and got[2]["n_assign"] == 0
    assert got[3]["spans"] == "assign:0:16" and got[3]["masked"] == "*" * 16 and got[4]["spans"] == "assign:200000:200012"


# token counts


def test_token_counts_equal_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(8)
    bits = ["a", "b ", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "'s", "1", "!", " ", "\x0b", "　", "漢", "😀", "́", " x", "\r\n"]
    texts = [None, "", "word " * 20_000, "x" * 30_000] + ["".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(3000)]
    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [len(library.encode(t, add_special_tokens=False)) if t else 0 for t in texts]
    assert tokens.Counter(path).count(texts) == want
    df = frame(spark, list(enumerate(texts[:50])), "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in df.select("doc_id", tokens.token_count(F.col("text"), path).alias("n")).collect()}
    assert got == dict(enumerate(want[:50]))
    pieces = public.path("piece_bpe_32k.model")
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=pieces)
    assert tokens.Counter(pieces).count(["Hello world", None, ""]) == [len(own.encode("Hello world")), 0, 0]


# near-duplicates


def brute_components(docs, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_docs(rng, groups, size):
    docs = []
    for g in range(groups):
        base = words(rng, 120, 10_000).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"c{rng.randrange(10**6)}"
            docs.append(" ".join(own))
    return docs


@pytest.mark.parametrize("rows, limit", [(512, None), (10, None), (10, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, rows, limit):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
    if limit is not None:
        monkeypatch.setattr(neardup, "BROADCAST_BYTES", limit)
    rng = random.Random(9)
    texts = near_docs(rng, 4, 45) + [words(rng, 60, 10_000) for _ in range(40)] + ["a b c", "A  b\nc", "a b", "", None, "  ", "x y z w v"] + ["same text of five words"] * 6
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    for percent in (80, 85):
        df = frame(spark, docs, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("root", F.lit("x"))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, percent).collect()}
        assert got == brute_components(docs, percent)


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(frame(spark, []), 85).count() == 0
    df = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B c d e f")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 85).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]


def test_near_duplicates_in_a_chain(spark, monkeypatch):
    """Neighbours are similar, no document is similar to the others at large: all are one component."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    rng = random.Random(13)
    stream = words(rng, 1700, 10**6).split()
    docs = [(i, " ".join(stream[4 * i : 4 * i + 100])) for i in range(400)]
    got = neardup.near_duplicates(frame(spark, docs, "doc_id long, text string"), 80).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 400


def test_near_duplicates_of_one_id_with_several_texts(spark):
    docs = [(3, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "q r s t u v w x"), (7, "q r s t u v w x"), (9, "k l m n o p")]
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, docs, "doc_id long, text string"), 85).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]


def test_components(spark):
    rng = random.Random(10)
    chain = [(i, i + 1) for i in range(60)]
    rng.shuffle(chain)
    edges = chain + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (300, 300)] + [(5000, i) for i in range(4000, 4700)]
    got = {r["node"]: r["root"] for r in components.components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200} | {i: 4000 for i in [*range(4000, 4700), 5000]}


def test_matches_for_is_safe():
    from math import comb

    for s in (0.8, 0.85, 0.95):
        t = neardup.matches_for(s)
        assert sum(comb(64, k) * s**k * (1 - s) ** (64 - k) for k in range(t)) < neardup.MISS


# lexical search


def brute_search(docs, items, k):
    import math
    from collections import Counter

    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, Counter(x), len(x)) for i, x in own if x]
    n_docs, n_all = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c, n in own:
            m = 75 + 25 * n * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            scores += [(-score, i)] if score > 0 else []
        out += [(item, r, i, -x) for r, (x, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("coordinates", [1, 7, 512])
def test_lexical_search_equals_brute_force(spark, monkeypatch, coordinates):
    """With few coordinates nearly all terms share one, so that bounds are loose; ties, odd rows and small blocks."""
    monkeypatch.setattr(lexical, "COORDINATES", coordinates)
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 64)
    monkeypatch.setattr(lexical, "VOCABULARY_BYTES", 30_000)
    rng = random.Random(3)
    docs = [(i, words(rng, rng.randrange(0, 40), 150)) for i in range(600)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(2000, None), (2001, ""), (2002, "! ?"), (2003, "É 中文 w1 " * 3000), (2004, "W1 w1")]
    items = [(i, words(rng, rng.randrange(1, 9), 150)) for i in range(25)] + [(50, docs[5][1]), (51, None), (52, "nothing of it"), (53, "w1 w1 É 中文"), (53, "w1 w1 É 中文")]
    d = frame(spark, docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("n", F.lit(2)).repartition(5)
    q = frame(spark, items, "item_id long, text string").withColumn("rank", F.lit(1))
    assert sorted(map(tuple, lexical.search(d, q, 4).collect())) == brute_search(docs, items, 4)
    assert lexical.search(d.where("false"), q).count() == 0 and lexical.search(d, q.where("false")).count() == 0


# fingerprints


def test_next_documents_over_buckets(spark):
    """One bucket or many, repeated rows, ids with several texts, null ids, a single row, no row."""
    rng = random.Random(5)
    rows = [(rng.randrange(300), words(rng, rng.randrange(1, 30))) for _ in range(500)] + [(7, "same text " * 9)] * 2300 + [(None, "no id"), (None, None), (301, None), (301, None), (302, "é中😀" * 40)]
    docs = frame(spark, rows, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("bucket", F.lit(2)).repartition(4)
    one, many = (sorted(map(tuple, fingerprints.fingerprinted(docs, bucket_bytes=b).collect()), key=str) for b in (1 << 30, 900))
    assert one == many and len(one) == len(rows)
    assert sorted(str((r[0], r[1])) for r in one) == sorted(str((i, len(t or ""))) for i, t in rows)
    by_row = {}
    for r in one:
        by_row.setdefault((r[0], r[3]), set()).add(r)
    assert all(len(x) == 1 for x in by_row.values())
    alone = fingerprints.fingerprinted(docs.where("doc_id = 302")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(("é中😀" * 20 + "é中😀" * 20).encode()).hexdigest()
    assert fingerprints.fingerprinted(docs.where("false")).count() == 0


def test_edits_are_located(spark):
    before = "# one\nfirst line here\n\nsecond part\nwith two lines\n\nthird"
    after = before.replace("two lines", "three lines") + "\nmore"
    pairs = frame(spark, [(1, before, after), (2, before, before), (3, None, "x"), (4, "", None), (5, "a\n" * 3000, "a\n" * 2999 + "b")], "k long, a string, b string")
    got = {}
    for r in fingerprints.located_edits(pairs, "k", "a", "b").collect():
        got.setdefault(r["k"], []).append((after if r["k"] == 1 else "a\n" * 2999 + "b" if r["k"] == 5 else "x")[r["start"] : r["end"]])
    assert {k: sorted(v) for k, v in got.items()} == {1: ["more", "third\n", "with three lines\n\n"], 3: ["x"], 5: ["b"]}
    trees = pairs.select("k", (fingerprints.root(fingerprints.tree(F.coalesce("a", F.lit("")))) == fingerprints.root(fingerprints.tree(F.coalesce("b", F.lit(""))))).alias("same"))
    assert {r["k"]: r["same"] for r in trees.collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_trees_keep_every_character(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices(["\n", "\n\n", " ", "a", "word ", "# ", "é", "中", "😀", ". ", "\r\n", "x" * 120], k=rng.randrange(60))) for _ in range(200)]
    df = frame(spark, list(enumerate(texts)), "k long, t string").withColumn("s", fingerprints.tree(F.col("t")))
    total = F.aggregate(F.flatten(F.transform("s", lambda s: F.transform(s["paragraphs"], lambda p: p["length"]))), F.lit(0), lambda n, x: n + x)
    assert df.where((total != F.length("t")) | (fingerprints.characters(fingerprints.all_pieces(F.col("s"))) != F.length("t"))).count() == 0


# alignment


def test_scores_by_join_equal_those_by_broadcast(spark):
    public = pytest.importorskip("public_tokenizers")
    a, b = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
    rng = random.Random(4)
    rows = [(i, words(rng, 20)) for i in range(60)] + [(100, None), (101, ""), (102, "a\u2581b"), (103, " " * 900 + "é中😀 <|endoftext|> </s>\n\t\x00" + "a" * 900)] + [(104, "same thing")] * 700
    aligned = saved(alignment.alignments(frame(spark, rows, "doc_id long, text string").withColumn("pairs", F.lit(1)), a, b), "t")
    counts = alignment.pair_counts(aligned, alignment.pair_base(b))
    both = [sorted(map(tuple, alignment.link_scores(aligned, counts, limit).collect()), key=str) for limit in (1 << 20, 0)]
    assert both[0] == both[1] and len(both[0]) == len(rows)
    assert all(r[1:5] == (0, 0, 0, 0) and r[5] is None for r in both[0] if r[0] in (100, 101, 102))
    assert alignment.link_scores(aligned.where("false"), counts).count() == 0


def test_rank_library_equals_the_vocabulary_library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own, side = Tokenizer.from_file(public.path("byte_bpe_50k.json")), alignment.Side(public.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rng = random.Random(2)
    some = ["<|endoftext|>", "'s", "'RE", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "é", "é", "中文", "😀", "½", "12345", "word", "Wörter", "_-", "...", "\x00", "\u200d", "\u0085"]
    texts = ["".join(rng.choices(some, k=rng.randrange(1, 30))) for _ in range(3000)]
    assert side.encode(texts) == [e.ids for e in own.encode_batch([" " + t for t in texts], add_special_tokens=False)]


# vectors beyond 64 bits, and names of columns


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e18, 1e18]), (1, [1e18, 1.0]), (2, [-1e18, 0.0]), (3, [1.0, 1.0]), (4, [1e300, 0.0])]
    v = frame(spark, rows, "id long, e array<double>").select("id", topk.scaled(F.col("e")).alias("v"))
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(v.where("id = 0"), v, 4).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 2**63 - 1), (4, 2**63 - 1), (2, -(2**63))]


def test_any_column_names(spark):
    docs = frame(spark, [(i, f"w{i} x y", "s") for i in range(40)], "doc_id long, text string, source string").withColumn("a.b", F.col("doc_id")).withColumn("c`d", F.array(F.lit("z")))
    sharded = sharding.shuffled_shards(docs, 3)
    assert sharded.columns == [*docs.columns, "shard", "slot"] and sharded.where("`a.b` = doc_id").count() == 40
    mixture = mixing.mixture(docs.withColumn("size", F.lit(3)))
    assert mixture.columns[:5] == docs.columns and mixture.where("`a.b` = doc_id").count() >= 40


def test_a_mixture_row_is_a_beginning(spark):
    """At most one row a document and pass, each a text's first words; most are whole."""
    rng = random.Random(6)
    docs = frame(spark, [(i, words(rng, rng.randrange(1, 400)), f"s{i % 3}") for i in range(400)], "doc_id long, text string, source string").withColumn("size", mixing.word_count(F.col("text")))
    taken = mixing.mixture(docs).select("doc_id", F.col("text").alias("part")).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r["text"].startswith(r["part"]) for r in taken) and sum(r["text"] == r["part"] for r in taken) > 0.5 * len(taken)
    most = {}
    for r in taken:
        most[r["doc_id"]] = most.get(r["doc_id"], 0) + 1
    assert max(most.values()) <= 3
