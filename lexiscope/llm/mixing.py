"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: sources in code-point order (null last) get weights in turn; each target stops at
   ``cap`` times its source's size and the excess goes to the others by weight.
2. Blocks: the documents of a source, in a seeded order, form one sequence of words that is cut
   into equal blocks. A source's quota is a whole number of blocks over one or more epochs.
3. Splitting tree: the quotas of all sources are split between the two halves of the output
   shards by an exact multivariate-hypergeometric draw (source after source, each conditional on
   the ones before), then each half again, down to single shards. Totals hold exactly.
4. Draw: each epoch puts the source's blocks into a permutation of its own (a seeded swap-or-not
   shuffle, computed for each block by itself). Shard after shard takes the quota that the tree gave
   it from the permuted blocks, so that draws are disjoint. What a document gives is the sum over the
   shards that took a part of it. Each shard's rows are then put into a shuffled local order.

Only DataFrame functions are used. What is held per source (a row with its quotas) is the only
thing gathered: a tree node holds one array with an entry per source. Documents are never grouped
by source; running sums go over (source, sub-bucket) and then over sub-bucket totals, so that a
source with most rows spreads over many tasks. Rows that are equal in key, source and size and more than
SUB_ROWS go by their running number (which repeats for frames read from files).

Cases: a null source is a source of its own, last in order; null or empty texts have size 0 and
are never taken; a very long text lies in many blocks and may give a part of its words; a source of
size 0 has target 0; an empty table gives an empty result; equal rows are interchangeable, and ties in the
seeded order go by size; other columns travel along unchanged, and an added column whose name is taken
gets the next free name (``target_``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiscope.llm.common import ASCII_SPACE, BROADCAST_BYTES, column, saved

WORD = f"[^{ASCII_SPACE}]+"
WORD_WITH_GAP = f"[{ASCII_SPACE}]*[^{ASCII_SPACE}]+"
#: Words of a block: this many, fewer for small sources (at least MIN_BLOCKS blocks each), more for
#: very large ones (at most MAX_BLOCKS blocks each).
BLOCK_WORDS, MIN_BLOCKS, MAX_BLOCKS = 2048, 1000, 100_000
#: Rows per (source, sub-bucket) group, about.
SUB_ROWS = 4096
#: Rounds of the swap-or-not shuffle; shards' chunks in the local order.
ROUNDS, CHUNKS = 20, 64
ADDED = ("source_size", "target", "pieces", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null, and in the order of the sources with null last when sorted after ``null_rank``."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(skey, source_size) to (skey, source_size, target): capped shares of ``share`` times all sizes."""
    rank = F.row_number().over(W.orderBy(F.col("skey") == "n", "skey"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    whole = W.partitionBy()
    by_ratio = W.orderBy("ratio", "skey").rowsBetween(W.unboundedPreceding, -1)
    return (
        sizes.withColumn("w", turn)
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("w"))
        .withColumn("left", share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)))
        .withColumn("capped", F.col("left") > F.col("ratio") * F.col("w_left"))
        # the first source that isn't capped has what is left for all from there on
        .withColumn("first", F.min(F.when(~F.col("capped"), F.struct("ratio", "skey", (F.col("left") / F.col("w_left")).alias("level")))).over(whole))
        .withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("first.level") * F.col("w")))
        .select("skey", "source_size", F.least("target", "most").alias("target"))
    )


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def hypergeometric(u: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` from ``population`` are among the ``marked``, for a uniform ``u``.

    Inverse of the distribution over its mean and ten standard deviations to either side, from the
    ratios of neighbouring probabilities; what lies beyond is below 1e-20.
    """

    def spread(v: Column) -> Column:
        n, k, m = F.greatest(v["n"], F.lit(1)).cast("double"), v["k"].cast("double"), v["m"].cast("double")
        mean = m * k / n
        width = 10 * F.sqrt(F.greatest(mean * (n - k) / n * (n - m) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0))) + 2
        lo = F.greatest(F.lit(0), v["m"] - (v["n"] - v["k"]), F.floor(mean - width).cast("long"))
        hi = F.least(v["m"], v["k"], F.ceil(mean + width).cast("long"))
        return F.struct(v["n"].alias("n"), v["k"].alias("k"), v["m"].alias("m"), v["u"].alias("u"), lo.alias("lo"), hi.alias("hi"))

    def inverse(v: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("upto"), F.lit(None).cast("long").alias("x"))

        def step(acc: Column, x: Column, goal: Column) -> Column:
            ratio = (v["k"] - x) * (v["m"] - x) / ((x + 1).cast("double") * F.greatest(v["n"] - v["k"] - v["m"] + x + 1, F.lit(1)))
            found = F.coalesce(acc["x"], F.when(acc["upto"] + acc["p"] >= goal, x))
            return F.struct((acc["p"] * ratio).alias("p"), (acc["upto"] + acc["p"]).alias("upto"), found.alias("x"))

        values = F.sequence(v["lo"], v["hi"])
        mass = F.aggregate(values, start, lambda acc, x: step(acc, x, F.lit(float("inf"))), lambda acc: acc["upto"])
        return F.coalesce(let(v["u"] * mass, lambda goal: F.aggregate(values, start, lambda acc, x: step(acc, x, goal), lambda acc: acc["x"])), v["hi"])

    return let(let(F.struct(u.alias("u"), population.alias("n"), marked.alias("k"), drawn.alias("m")), spread), inverse)


def splitting_tree(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(skey, quota) to (skey, cum): cum[j] is how many blocks of the source the shards before j take."""
    total = F.sum("quota").over(W.partitionBy())
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), "skey", F.col("quota").alias("k"), total.alias("total"))
    capacity = lambda j: F.floor(F.col("total") * j / n_shards).cast("long")
    width = n_shards
    while width > 1:
        mid = (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)).cast("int")
        node = nodes.groupBy("lo", "hi", "total").agg(F.array_sort(F.collect_list(F.struct("skey", "k"))).alias("of"), F.sum("k").alias("n"))
        node = node.withColumn("mid", mid).withColumn("m", capacity(F.col("mid")) - capacity(F.col("lo")))

        def draw(acc: Column, s: Column) -> Column:
            u = (F.pmod(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), s["skey"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            after = lambda x: F.struct((acc["n"] - s["k"]).alias("n"), (acc["m"] - x).alias("m"), F.concat(acc["out"], F.array(x)).alias("out"))
            return let(hypergeometric(u, acc["n"], s["k"], acc["m"]), after)

        none = F.struct(F.col("n"), F.col("m"), F.array().cast("array<long>").alias("out"))
        left = F.aggregate("of", none, draw, lambda acc: acc["out"])
        node = node.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, left))
        part = lambda lo, hi, s, k: F.struct(lo.alias("lo"), hi.alias("hi"), s["skey"].alias("skey"), k.alias("k"))
        halves = F.zip_with("of", "left", lambda s, x: F.array(part(F.col("lo"), F.col("mid"), s, x), part(F.col("mid"), F.col("hi"), s, s["k"] - x)))
        alone = F.transform("of", lambda s: F.array(part(F.col("lo"), F.col("hi"), s, s["k"])))
        nodes = node.select("total", F.inline(F.flatten(F.coalesce(halves, alone))))
        width = -(-width // 2)
    leaves = nodes.groupBy("skey").agg(F.array_sort(F.collect_list(F.struct("lo", "k"))).alias("leaves"))
    running = F.aggregate("leaves", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["k"])))
    return leaves.select("skey", running.alias("cum"))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x among 0 to n - 1 in a pseudorandom permutation that ``key`` chooses.

    Swap-or-not: a round pairs x with (k - x) mod n, and both change places if the pair's bit is set.
    """

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(*key, r) - at, n)
        return let(other, lambda o: F.when(F.pmod(F.xxhash64(*key, r, F.greatest(at, o)), F.lit(2)) == 1, o).otherwise(at))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def planned(
    df: DataFrame,
    size: str = "size",
    source: str = "source",
    key: Sequence[str] = ("doc_id",),
    n_shards: int = 24,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 41,
) -> DataFrame:
    """(r, size, source_size, target, pieces, taken); r holds the columns of ``df`` as c0, c1 and so on.

    ``pieces`` are what the shards take: epoch, block, shard, first word and number of words.
    """
    order = F.xxhash64(F.lit(seed), *[F.col(c) for c in key], F.col(size), source_key(F.col(source)))
    keyed = df.select(
        F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("r"),
        source_key(F.col(source)).alias("skey"),
        F.col(size).cast("long").alias("size"),
        order.alias("h"),
        F.monotonically_increasing_id().alias("own"),
    )
    by_hash = df.groupBy(order.alias("hot_h")).agg(F.count(F.lit(1)).alias("n"))
    hot = saved(by_hash.where(F.col("n") > SUB_ROWS).select("hot_h"), "mix-hot")
    n_rows = df.count()
    hot = F.broadcast(hot) if n_rows // SUB_ROWS * 64 <= BROADCAST_BYTES else hot
    n_sub = max(1, -(-n_rows // SUB_ROWS))
    keyed = keyed.join(hot, F.col("h") == F.col("hot_h"), "left")
    keyed = keyed.withColumn("h", F.when(F.col("hot_h").isNull(), F.col("h")).otherwise(F.xxhash64("h", "own"))).drop("hot_h", "own")
    keyed = keyed.withColumn("sub", F.pmod("h", F.lit(n_sub)).cast("int"))

    # what is known of each (source, sub-bucket), then of each source
    subs = saved(keyed.groupBy("skey", "sub").agg(F.sum("size").alias("sub_size")), "mix-subs")
    targets = source_targets(subs.groupBy("skey").agg(F.sum("sub_size").alias("source_size")), weights, share, cap)
    s = F.col("source_size")
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(s / MIN_BLOCKS)), F.ceil(s / MAX_BLOCKS)).cast("long")
    epochs = F.when(s > 0, F.floor(F.col("target") / s + 1e-9)).otherwise(0).cast("long")
    quotas = (
        targets.withColumn("block", block)
        .withColumn("n_blocks", F.ceil(s / F.col("block")).cast("long"))
        .withColumn("epochs", epochs)
        .withColumn("quota", F.col("epochs") * F.col("n_blocks") + F.round((F.col("target") - F.col("epochs") * s) / F.col("block")).cast("long"))
    )
    quotas = saved(quotas, "mix-quotas")
    tree = splitting_tree(quotas.select("skey", "quota"), n_shards, seed)
    plan = saved(quotas.drop("quota", "epochs").join(tree, "skey"), "mix-plan")
    before = W.partitionBy("skey").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = subs.select("skey", "sub", F.coalesce(F.sum("sub_size").over(before), F.lit(0)).alias("sub_first"))

    # words of the source before each document, then the drawn blocks that it lies in
    inside = W.partitionBy("skey", "sub").orderBy("h", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["skey", "sub"]).join(plan, "skey")
    placed = placed.withColumn("at", F.col("at") + F.col("sub_first"))
    every = F.element_at("cum", -1)

    def piece(epoch: int, b: Column) -> Column:
        place = F.col("n_blocks") * epoch + permuted(b, F.col("n_blocks"), F.lit(seed), F.lit(epoch), F.col("skey"))
        first = F.greatest(F.lit(0), b * F.col("block") - F.col("at"))
        last = F.least(F.col("size"), (b + 1) * F.col("block") - F.col("at"))
        shard = let(place, lambda drawn: F.when(drawn < every, F.size(F.filter("cum", lambda c: c <= drawn)) - 1))
        shard = F.when(F.col("n_blocks") * epoch < every, shard)
        return F.struct(F.lit(epoch).alias("epoch"), b.alias("block"), shard.alias("shard"), first.alias("first"), (last - first).alias("n"))

    passes = range(int(cap) + 1)
    lo = F.floor(F.col("at") / F.col("block")).cast("long")
    hi = F.floor((F.col("at") + F.col("size") - 1) / F.col("block")).cast("long")
    pieces = F.flatten(F.transform(F.sequence(lo, hi), lambda b: F.array(*[piece(e, b) for e in passes])))
    kind = "array<struct<epoch:int,block:bigint,shard:int,first:bigint,n:bigint>>"
    pieces = F.when(F.col("size") > 0, F.filter(pieces, lambda p: p["shard"].isNotNull()).cast(kind)).otherwise(F.array().cast(kind))
    total = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    return placed.select("r", "size", "source_size", "target", pieces.alias("pieces")).withColumn("taken", total)


def free_names(columns: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The wanted names, each with underscores appended until no column before has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mixed(df: DataFrame, **options) -> DataFrame:
    """``df`` with source_size, target, pieces and taken (words that all shards take); options as in ``planned``."""
    added = [F.col(c).alias(n) for c, n in zip(ADDED, free_names(df.columns, ADDED), strict=True)]
    return planned(df, **options).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(df.columns)], *added)


def shown_shares(pieces: Column) -> Column:
    """Words by shard as ``shard:words``, in the shards' order, comma-joined."""
    shards = F.array_sort(F.array_distinct(F.transform(pieces, lambda p: p["shard"])))
    words = lambda s: F.aggregate(F.filter(pieces, lambda p: p["shard"] == s), F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    return F.array_join(F.transform(shards, lambda s: F.concat_ws(":", s.cast("string"), words(s).cast("string"))), ",")


def mixture(df: DataFrame, text: str = "text", size: str = "size", seed: int = 41, **options) -> DataFrame:
    """The mixture itself: the columns of ``df``, a row per pass that takes of a document, with ``shard`` and ``shard_key``.

    A pass that takes all of a document gives its whole text unchanged. Where the drawn blocks end within a
    document, its row holds as many words as they drew, from its start on, with the white space before each of
    them: at most one row a document and pass, and no text with gaps. The row goes to the shard of its first drawn block.
    The rows of a shard stand in the shuffled order of ``shard_key`` within each of its CHUNKS.
    """
    passes = F.transform(F.sequence(F.lit(0), F.lit(int(options.get("cap", 2.0)))), lambda e: F.filter("pieces", lambda p: p["epoch"] == e))
    words = lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    one = F.transform(F.filter(passes, lambda own: F.size(own) > 0), lambda own: F.struct(own[0]["epoch"].alias("epoch"), own[0]["shard"].alias("shard"), words(own).alias("n")))
    # outer: an inferred filter on the array would compute it twice
    taken = planned(df, size=size, seed=seed, **options).select("r", "size", F.explode_outer(one).alias("piece")).where("piece is not null")
    own = F.col(f"r.c{df.columns.index(text)}")
    cut = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(WORD_WITH_GAP), F.lit(0)), F.lit(1), F.col("piece.n").cast("int")), "")
    new_text = F.when(F.col("piece.n") == F.col("size"), own).otherwise(cut)
    rows = taken.select("r", new_text.alias("new_text"), F.col("piece.shard").alias("shard"), F.xxhash64(F.lit(seed), F.col("piece.epoch"), own).alias("shard_key"))
    rows = rows.repartition("shard", F.pmod("shard_key", F.lit(CHUNKS))).sortWithinPartitions("shard", "shard_key")
    shard, shard_key = free_names(df.columns, ("shard", "shard_key"))
    kept = [F.col("new_text" if c == text else f"r.c{i}").alias(c) for i, c in enumerate(df.columns)]
    return rows.select(*kept, F.col("shard").alias(shard), F.col("shard_key").alias(shard_key))


def write_mixture(rows: DataFrame, path: str, n_shards: int) -> None:
    """One folder per shard; ``shard_key`` puts the rows of a file into shuffled order."""
    rows.repartition(n_shards, "shard").sortWithinPartitions("shard", "shard_key").drop("shard_key").write.partitionBy("shard").parquet(path)
