"""Query op13: alignment of two tokenizers over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.alignment import alignments, link_scores, pair_base, pair_counts
from lexiscope.llm.common import saved, table

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; every text is encoded once, by both sides."""
    import public_tokenizers  # here, so that the other queries do without it

    docs = table(spark, sf_dir, "documents")
    a, b = public_tokenizers.path(A), public_tokenizers.path(B)
    aligned = saved(alignments(docs, a, b, digest=True), "align")
    scored = link_scores(aligned, pair_counts(aligned, pair_base(b)))
    out = scored.withColumn("groups_sha256", F.coalesce("groups", F.lit("")))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict[str, str] = {}
