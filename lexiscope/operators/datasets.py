"""Dataset preparation: keys, splits, samples, merges (J-06 to J-08, U-*, W-03 to W-07, T-*, M-06 to M-15, M-20)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiscope.sources.scratch import saved


def text_key(text: str | Column) -> Column:
    return F.lower(F.trim(text))


def seeded(key: str | Column, seed: int) -> Column:
    """A repeatable random order that other engines can compute as well."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(str(seed))))


def first_of_key(rows: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """W-04, U-02: the first row of every key. An aggregate, so that a hot key is combined before the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    kept = rows.groupBy(key.alias("_key")).agg(F.min_by(whole, F.struct(*[F.col(c) for c in order])).alias("_row"))
    return kept.select("_row.*")


def unseen(rows: DataFrame, existing: DataFrame, text: str = "text") -> DataFrame:
    """J-07, U-04: rows whose text key isn't in ``existing``."""
    keys = existing.select(text_key(text).alias("_key")).distinct()
    return rows.join(keys, text_key(rows[text]) == F.col("_key"), "left_anti")


def patched(target: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """J-06: listed columns overwritten by the update's non-null values."""
    u = updates.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(u, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def numbered(rows: DataFrame, order: Sequence[str], start: int | Column = 0, name: str = "new_id") -> DataFrame:
    """W-03, S-23: gapless numbers from ``start`` + 1 in the given order, without one task for all rows.

    The range partitions are written once with each row's place, so that counts and numbers come from the same
    partitions; a row's number is its place in its partition after the rows of the partitions before.
    """
    parts = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = saved(parts.withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    first = start if isinstance(start, Column) else F.lit(start)
    return placed.join(offsets, part == F.col("_p")).withColumn(name, (F.col("_before") + place + 1 + first).cast("long")).drop("_p", "_m", "_before")


def ranked(rows: DataFrame, by: Column, key: str, seed: int) -> DataFrame:
    """Rows with their place ``_r`` in the seeded order among the ``_all`` rows of their stratum ``by``.

    A stratum is dealt into 4,096 parts by its leading digits, so no task holds a whole one; a row's place is
    that in its part after the counts of the parts before.
    """
    placed = rows.withColumn("_k", F.struct(by.alias("by"))).withColumn("_o", seeded(key, seed)).withColumn("_b", F.substring("_o", 1, 3))
    parts, before = W.partitionBy("_k"), W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n")).select("_k", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(parts).alias("_all"))
    own = F.row_number().over(W.partitionBy("_k", "_b").orderBy("_o"))
    return placed.withColumn("_own", own).join(counts, ["_k", "_b"]).withColumn("_r", F.col("_before") + F.col("_own")).drop("_k", "_o", "_b", "_own", "_before")


def assigned(rows: DataFrame, annotators: Sequence[str], order: Sequence[str], name: str = "annotator") -> DataFrame:
    """W-05, M-20: contiguous blocks of rows to annotators; the first ones get one more."""
    k = len(annotators)
    n = numbered(rows, order, name="_no")
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    size, more = F.floor(F.col("_total") / k), F.pmod(F.col("_total"), F.lit(k))
    at, long_rows = F.col("_no") - 1, (F.floor(F.col("_total") / k) + 1) * F.pmod(F.col("_total"), F.lit(k))
    block = F.when(at < long_rows, F.floor(at / (size + 1))).otherwise(more + F.floor((at - long_rows) / F.greatest(size, F.lit(1))))
    names = F.array(*[F.lit(a) for a in annotators])
    return n.join(F.broadcast(total)).withColumn(name, F.element_at(names, (block + 1).cast("int"))).drop("_no", "_total")


def capped_by_key(rows: DataFrame, key: str, most: int, order: Sequence[Column]) -> DataFrame:
    """W-06, W-07: at most ``most`` rows of every key; Spark limits each group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def stratified_split(rows: DataFrame, label: str, key: str, share: float, seed: int = 42, name: str = "split") -> DataFrame:
    """M-06: max(1, int(n * share)) validation rows of every stratum, by seeded rank."""
    val = F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_all") * share))
    return ranked(rows, F.col(label), key, seed).withColumn(name, F.when(val, "val").otherwise("train")).select(*rows.columns, name)


def oversampled(rows: DataFrame, minority: Column, key: str, ratio: float) -> DataFrame:
    """M-07, M-10: minority rows repeated until they make ``ratio`` of all: int(major * ratio / (1 - ratio)) rows."""
    counts = rows.agg(F.count_if(minority).alias("_few"), F.count_if(~minority).alias("_many"))
    goal = F.greatest(F.col("_few"), F.floor(F.col("_many") * ratio / (1 - ratio)).cast("long"))
    few = ranked(rows.where(minority), F.lit(True), key, 1).drop("_all").join(F.broadcast(counts))
    times = F.floor(goal / F.col("_few")) + F.when(F.col("_r") <= F.pmod(goal, F.col("_few")), 1).otherwise(0)
    copies = few.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long")))).drop("_r", "_few", "_many")
    return rows.where(~minority).withColumn("copy", F.lit(1).cast("long")).unionByName(copies)


def undersampled(rows: DataFrame, minority: Column, key: str, times: int, seed: int = 42) -> DataFrame:
    """M-09: all minority rows and ``times`` as many others, by seeded rank."""
    n = rows.agg(F.count_if(minority).alias("_few"))
    others = rows.where(~minority)
    kept = ranked(others.select(key), F.lit(False), key, seed).join(F.broadcast(n)).where(F.col("_r") <= F.col("_few") * times).select(key)
    return rows.where(minority).unionByName(others.join(kept, key, "left_semi"))


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """T-10: a repeatable random order."""
    return rows.orderBy(seeded(key, seed), key)


def priority_fill(rows: DataFrame, priority: Column, order: Sequence[str], n: int) -> DataFrame:
    """T-05: the first n rows by priority, then order."""
    return rows.orderBy(priority, *order).limit(n)


def severity_mix(rows: DataFrame, n: int, warn_share: float, order: Sequence[Column]) -> DataFrame:
    """T-04: up to round(n * share) warn rows, filled with the others, then with what is left."""
    rank = F.row_number().over(W.partitionBy("severity").orderBy(*order))
    want = round(n * warn_share)
    tier = F.when((F.col("severity") == "warn") & (F.col("_r") <= want), 0).when(F.col("severity") != "warn", 1).otherwise(2)
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).orderBy(tier, *order).limit(n).drop("_r")


def variants(lexicon: DataFrame, term: str = "biased") -> DataFrame:
    """M-15: a term as it is, capitalised, and after "the"; phrases in title case."""
    t = F.col(term)
    cap = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 20))
    title = F.array_join(F.transform(F.split(t, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " ")
    forms = F.when(F.contains(t, F.lit(" ")), F.array(t, title)).otherwise(F.array(t, cap, F.concat(F.lit("the "), t)))
    return lexicon.withColumn("variant", F.explode(F.array_distinct(forms)))


def templates(terms: DataFrame, verbs: Sequence[str], objects: Sequence[str], pattern: str = "The {term} {verb} {object}.", most: int = 10_000) -> DataFrame:
    """J-10, M-14: every term with every verb and object of two short lists (``most`` pairs), as sentences with corrections."""
    if len(verbs) * len(objects) > most:
        raise ValueError(f"more than {most} pairs of verb and object")
    grid = terms.withColumn("verb", F.explode(F.array(*[F.lit(v) for v in verbs]))).withColumn("object", F.explode(F.array(*[F.lit(o) for o in objects])))
    fill = lambda term: F.replace(F.replace(F.replace(F.lit(pattern), F.lit("{term}"), term), F.lit("{verb}"), F.col("verb")), F.lit("{object}"), F.col("object"))
    return grid.withColumn("text", fill(F.col("biased"))).withColumn("expected_correction", fill(F.col("neutral_primary")))


def migrated(rows: DataFrame, renames: Mapping[str, str], remaps: Mapping[str, Mapping[str, str]], defaults: Mapping[str, str], canonical: Sequence[str]) -> DataFrame:
    """M-01: renames (only onto free names), value maps, defaults for absent or blank cells, canonical columns first."""
    from lexiscope.functions.text import mapped

    for old, new in renames.items():
        if old in rows.columns and new not in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    missing = [c for c in canonical if c not in rows.columns]
    rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])
    filled = {c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(d)) for c, d in defaults.items()}
    rows = rows.withColumns({c: v for c, v in filled.items() if c in rows.columns})
    rows = rows.withColumns({c: mapped(F.coalesce(F.col(c), F.lit("")), table) for c, table in remaps.items() if c in rows.columns})
    return rows.select(*canonical, *[c for c in rows.columns if c not in canonical])
