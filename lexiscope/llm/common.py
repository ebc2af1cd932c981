"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound in bytes for any side that an operator marks for broadcast.
BROADCAST_BYTES = 64 << 20
#: White space of the word contracts, as a character class body.
ASCII_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; in local mode one of our own where unset."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexiscope-"))
        found = context.getCheckpointDir()
    return found


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lexiscope/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there."""
    path = path or scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def join_by_count(left: DataFrame, right: DataFrame, key: str, n: str, rows: int, hot: int = 500, row_bytes: int = 128) -> DataFrame:
    """``left`` inner-joined with ``right``, which has one row per key and in ``n`` how many rows of ``left`` the key has.

    Keys of many rows are few (at most ``rows`` by their least count, which is chosen so that they fit into
    BROADCAST_BYTES): theirs are broadcast, and no task gets all rows of such a key. The rest is an equi join.
    """
    is_hot = F.col(n) > max(hot, rows * row_bytes // BROADCAST_BYTES)
    more = [c for c in right.columns if c not in (key, n)]
    side = right.where(is_hot).select(F.col(key), F.struct(F.lit(True).alias("yes"), *more).alias("hot_row"))
    tagged = left.join(F.broadcast(side), key, "left")
    rest = tagged.where("hot_row is null").drop("hot_row").join(right.where(~is_hot).drop(n), key)
    found = tagged.where("hot_row is not null").select(*left.columns, *[F.col(f"hot_row.{c}").alias(c) for c in more])
    return found.unionByName(rest.select(*left.columns, *more))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def column(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def bernoulli(key: Column, rate: float | Column, seed: int) -> Column:
    """True for about ``rate`` of the keys, always for the same ones."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < F.lit(float(1 << 30)) * rate


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))
