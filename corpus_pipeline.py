"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

toxicity -> near-duplicates -> benchmark decontamination -> mixing to target weights -> sharding.

Every stage but the last returns the columns of ``documents``; rows that a stage keeps keep all their
values. The mixing stage may return a document several times (sources that are raised) and cuts
the text of a document that is taken in part to the words taken, with ``n_chars`` to match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import column, free_name, saved, table
from lexiscope.llm.decontaminate import decontaminated
from lexiscope.llm.mixing import mixture, word_count
from lexiscope.llm.neardup import near_duplicates
from lexiscope.llm.q_toxicity import learned
from lexiscope.llm.sharding import shuffled_shards
from lexiscope.llm.toxicity import toxicity

#: Hundredths of their union that two near-duplicates share at least.
NEAR_PERCENT = 80
N_SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below one half, by a grammar learned from ``labels``."""
    model = learned(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity(docs["text"], model, spark) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the smallest id; rows without id stay.

    Of rows that share id and text one stays; rows of one id with other texts stay or go together.
    """
    gone_id = free_name(docs, "gone_id")
    found = near_duplicates(docs, NEAR_PERCENT)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct()
    left = docs.join(gone, docs["doc_id"] == F.col(gone_id), "left_anti")
    again = saved(left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias(gone_id)), "pipeline-again")
    if again.isEmpty():
        return left
    same = left.join(again, left["doc_id"] == F.col(gone_id), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, left["doc_id"] == F.col(gone_id), "left_anti").unionByName(same)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which at least five in a hundred words lie in windows of ``benchmark``, removed."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the sources' targets take, as rows of documents, shard by shard in shuffled order."""
    size = free_name(docs, "mix_size")
    rows = mixture(docs.withColumn(size, word_count(docs["text"])), size=size)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*[column(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shuffled order over the shards, with ``shard`` and ``slot`` (``shard_``, ``slot_`` where those exist)."""
    return shuffled_shards(docs, N_SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Learned and seeded stages have no SQL form.
ORACLE_SQL = None
