"""Structured Streaming over the same transforms (ST-01 to ST-08).

Every job takes a streaming frame and returns one; ``run`` starts it with a checkpoint, so that a
restarted job goes on where it stopped (ST-06).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiscope.operators.correct import replaced
from lexiscope.operators.metrics import confusion


def read(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def audit_records(texts: DataFrame, rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """ST-01: stateless detection and rewriting; ``rules`` (term, replacement) are literals of the plan."""
    out, hits = F.col(text), F.lit(0)
    for term, to in rules:
        hits = hits + F.regexp_count(F.col(text), F.lit(rf"(?iuU)\b\Q{term}\E\b"))
        out = replaced(out, F.lit(term), F.lit(to))
    return texts.withColumn("rewrite", out).withColumn("n_hits", hits).withColumn("has_bias_detected", F.col("n_hits") > 0)


def windowed_actions(reviews: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """ST-02: counts and acceptance rate by tumbling or sliding window."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    accepted = F.col("action").isin("approve", "approve_with_edit")
    return reviews.withWatermark(ts, late).groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(accepted).alias("accepted")).select(F.col("w.start").alias("start"), "n", "accepted", F.round(F.col("accepted") / F.col("n"), 6).alias("rate"))


def joined_reviews(rewrites: DataFrame, reviews: DataFrame, late: str = "1 hour", within: str = "1 day") -> DataFrame:
    """ST-03: reviews with their rewrites; both sides' state is bounded by watermarks and the time range."""
    left = rewrites.select(F.col("audit_id").alias("a_id"), F.col("ts").alias("a_ts")).withWatermark("a_ts", late)
    right = reviews.select("audit_id", "review_id", "action", "ts").withWatermark("ts", late)
    return right.join(left, F.expr(f"audit_id = a_id and ts >= a_ts and ts <= a_ts + interval {within}")).select("review_id", "audit_id", "action", "a_ts", "ts")


def sessions(events: DataFrame, who: str = "reviewer", gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """ST-04: sessions of every reviewer with rows per minute."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), who).agg(F.count(F.lit(1)).alias("n"))
    minutes = (F.unix_timestamp("s.end") - F.unix_timestamp("s.start")) / 60
    return s.select(who, F.col("s.start").alias("start"), "n", F.round(F.col("n") / minutes, 6).alias("per_minute"))


def fresh_texts(texts: DataFrame, text: str = "text", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """ST-05: each text key once within the watermark."""
    return texts.withColumn("key", F.lower(F.trim(text))).withWatermark(ts, late).dropDuplicatesWithinWatermark(["key"]).drop("key")


def running_confusion(rows: DataFrame, by: str = "lang") -> DataFrame:
    """ST-07: confusion counts so far."""
    return rows.groupBy(by).agg(*confusion("has_bias", "predicted"))


def run(job: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet", each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts a job over what is there now. ``each`` sees every batch, e.g. to read the lexicon afresh (ST-08)."""
    writer = job.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(each).start() if each else writer.format(kind).option("path", path).start()
