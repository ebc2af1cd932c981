"""The pipeline's stages on a small planted corpus, judged one by one, and the registered queries."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from lexiscope.llm import registry
from tests.llm.test_operators import DOCS, brute_components, brute_hits, words


def planted(spark, tmp_path):
    rng = random.Random(11)
    bench = [(i, words(rng, 30)) for i in range(5)]
    rows = []
    for i in range(260):
        own = words(rng, 60, 5000).split()
        if i % 5 == 0:
            own[rng.randrange(60)] = rng.choice(["grumzen", "grumzta", "grumzor", "grumzil"])
        if i % 40 == 1:
            own[10:10] = bench[i % 5][1].split()
        rows.append((i, " ".join(own), "en", f"src{i % 4}", 0))
    rows += [(1000 + i, rows[2][1], "en", "src0", 0) for i in range(8)] + [(2000, None, None, None, None), (2001, "", None, "src1", 0)]
    labels = [(r[0], 1, int("grumz" in (r[1] or ""))) for r in rows if r[0] < 260]
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, bench


def test_stages(spark, tmp_path):
    d, rows, bench = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        before, docs = docs, spark.read.parquet(f"{d}/{name}")
        ids = lambda df: sorted(str(r[0]) for r in df.select("doc_id").collect())
        if name == "toxicity":
            assert ids(docs) == ids(before.where(~F.coalesce(F.col("text"), F.lit("")).contains("grumz")))
        if name == "near_duplicates":
            want = brute_components([(r[0], r[1]) for r in before.select("doc_id", "text").collect()], 80)
            assert ids(docs) == sorted(str(i) for i, (_, c) in want.items() if i == c)
        if name == "decontamination":
            bad = [r[0] for r in before.select("doc_id", "text").collect() if (h := brute_hits(r[1], bench))[1] > 0 and 20 * h[1] >= h[0]]
            assert bad and ids(docs) == sorted(set(ids(before)) - {str(i) for i in bad})
        if name == "mixing":
            assert docs.where("n_chars <> length(text)").count() == 0
            assert set(ids(docs)) <= set(ids(before))
        kept.append(docs.count())
    assert kept[3] == kept[4] and docs.select("shard", "slot").distinct().count() == kept[4]


def test_registry_names():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
