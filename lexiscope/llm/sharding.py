"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters records uniformly into memory-sized buckets by a seeded hash of their key and
their text. Records that are equal in both and together fill more than a quarter of a bucket are
scattered by their running number as well, so that no bucket holds them all. Pass 2 holds one bucket
per task, puts it into a defined order and runs Spark's Fisher-Yates ``shuffle`` over it. Buckets
follow each other in the shuffled sequence, so position p belongs to shard ``p mod n`` at slot
``p div n``: shard sizes in rows differ by one at most.

Both passes are repeatable: a lost executor's tasks give the same permutation again, because the
bucket is the partition number, its rows are ordered before the shuffle and the seed is fixed. The
running numbers repeat for frames read from files; save other frames first.

Cases: a null key or text hashes as null and is a record like others; empty and very long texts are
records (a bucket holds at least one record, whatever its size); rows that are equal in key
and text are interchangeable and each keep a slot; ties in the hash go by the running number; an empty
table gives an empty result; extra columns of any type travel along, and an added column whose name is
taken gets the next free name (``shard_``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiscope.llm.common import BROADCAST_BYTES, column, free_name, saved

#: Bytes of records per bucket. One bucket is held in memory by one task.
BUCKET_BYTES = 16 << 20
#: Buckets per group in the two-level running count.
GROUP = 1024
#: Bytes of one row (bucket, first) in memory, generously.
OFFSET_BYTES = 64


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 8 for its id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def held_bytes(df: DataFrame) -> Column:
    """Bytes of a whole row in memory, about: contents of strings, binaries and nested values, and 8 for each column."""
    flat = [F.octet_length(column(c)) for c, t in df.dtypes if t in ("string", "binary")]
    nested = [F.octet_length(F.to_json(F.struct(column(c)))) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return sum((F.coalesce(x, F.lit(0)).cast("long") for x in flat + nested), F.lit(8 * len(df.columns)).cast("long"))


def shuffled_shards(
    df: DataFrame,
    n_shards: int,
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = 20240607,
    shard: str = "shard",
    slot: str = "slot",
) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0)."""
    shard = free_name(df, shard)
    slot = free_name(df.withColumn(shard, F.lit(0)), slot)
    payload = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row")
    key_hash = F.xxhash64(F.lit(seed), *[F.col(c) for c in key], F.xxhash64(F.col(text)))

    # how much there is, and which equal records fill more than a quarter of a bucket: four a bucket at most
    groups = saved(df.select(key_hash.alias("h"), held_bytes(df).alias("b")).groupBy("h").agg(F.sum("b").alias("b")), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()["b"]
    n_buckets = max(1, -(-int(total) // bucket_bytes))
    hot = groups.where(F.col("b") * 4 > bucket_bytes).select(F.col("h").alias("hot_h"))
    if 4 * n_buckets * OFFSET_BYTES <= BROADCAST_BYTES:
        hot = F.broadcast(hot)
    own = F.monotonically_increasing_id()
    scattered = df.select(payload, key_hash.alias("h"), own.alias("own")).join(hot, F.col("h") == F.col("hot_h"), "left")
    spread = F.when(F.col("hot_h").isNull(), F.col("h")).otherwise(F.xxhash64("h", "own"))
    scattered = scattered.select("row", spread.alias("h")).withColumn("bucket", F.pmod("h", F.lit(n_buckets)).cast("int"))

    # Pass 1: one partition per bucket. Pass 2: Fisher-Yates within each.
    held = scattered.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket").agg(F.collect_list(F.struct("h", "row")).alias("rows"))
    by_hash = lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)
    mixed = held.select("bucket", F.shuffle(F.array_sort("rows", by_hash), seed).alias("rows"))
    placed = mixed.select("bucket", F.posexplode("rows").alias("at", "item"))

    offsets = bucket_offsets(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    if n_buckets * OFFSET_BYTES <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    at = F.col("first") + F.col("at")
    return placed.join(offsets, "bucket").select(
        *[F.col(f"item.row.c{i}").alias(c) for i, c in enumerate(df.columns)],
        F.pmod(at, F.lit(n_shards)).cast("int").alias(shard),
        ((at - F.pmod(at, F.lit(n_shards))) / n_shards).cast("long").alias(slot),
    )


def bucket_offsets(counts: DataFrame) -> DataFrame:
    """(bucket, n) to (bucket, first): rows in the buckets before. Running counts in two levels."""
    grouped = counts.withColumn("g", F.floor(F.col("bucket") / GROUP))
    before = W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    groups = grouped.groupBy("g").agg(F.sum("n").alias("gn")).select("g", F.coalesce(F.sum("gn").over(before), F.lit(0)).alias("g_first"))
    inside = W.partitionBy("g").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return (
        grouped.withColumn("b_first", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(groups, "g")
        .select("bucket", (F.col("g_first") + F.col("b_first")).alias("first"))
    )


def write_shards(sharded: DataFrame, path: str, n_shards: int, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard, rows in slot order within each file."""
    (
        sharded.repartition(n_shards, shard)
        .sortWithinPartitions(shard, slot)
        .write.partitionBy(shard)
        .parquet(path)
    )
