"""Benchmark decontamination over word windows, in DataFrame functions only.

A window is ``width`` consecutive normalised words of a benchmark item (a shorter item is one
window). Any occurrence of a window of L words covers L - q + 1 neighbouring grams of q words, and
so exactly one gram that starts at a multiple of L - q + 1. It is therefore enough to look up the
grams at those starts of a text: the set of all grams of all windows is hashed and broadcast (behind
a check of its size; beyond it Spark joins by shuffle), and the text is scanned once. Only (text,
place, gram) goes through the lookup. What met a gram is gathered by text, joined back to the words
of the texts concerned, and each hit is verified word by word for every window around it before it
counts, so that the work is linear in a text's length.

Cases: a null or wordless text or item has no words, no windows and no hits; windows at either end
of a text count; very long texts are scanned whole; repeated rows each get their own result, equal for
equal (id, text), null ids included; an item that occurs twice in the benchmark counts once per item id,
and ties between items (one window in several) count for each; empty tables give an empty result or no
hits; extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import BROADCAST_BYTES, free_name, lower_ascii, saved

WIDTH = 13
#: Words of a looked-up gram.
GRAM = 6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a gram's row in memory beside its item's words, generously.
GRAM_BYTES = 128


def words_of(text: Column) -> Column:
    """Normalised words of a text; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_grams(benchmark: DataFrame, item_id: str, text: str, width: int, gram: int) -> DataFrame:
    """(item, words, len, at, g): every gram g of q words at ``at`` in an item; len is its windows' length."""
    items = benchmark.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    items = items.dropDuplicates(["item", "words"]).withColumn("len", F.least(F.lit(width), F.size("words")))
    q = F.least(F.lit(gram), F.col("len"))
    own = F.coalesce(*[F.when(q == k, gram_hash(F.col("at"), k)) for k in range(1, min(gram, width) + 1)])
    return items.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - q))).withColumn("g", own)


def gram_hash(at: Column, q: int) -> Column:
    """Hash of the q words from ``at`` on of the column ``words``; single elements, as ``slice`` reads the whole array."""
    return F.xxhash64(*[F.get("words", at + k) for k in range(q)])


def looked_grams(length: int, q: int) -> Column:
    """The grams of q words at every start that windows of ``length`` words need, of the column ``words``."""
    starts = F.sequence(F.lit(0), F.size("words") - q, F.lit(length - q + 1))
    look = lambda p: F.struct(p.alias("at"), F.lit(length).alias("len"), gram_hash(p, q).alias("g"))
    return F.when(F.size("words") >= q, F.transform(starts, look)).otherwise(F.array().cast("array<struct<at:int,len:int,g:bigint>>"))


def find_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two frames: (id, text_hash, n_words) of every row, and (id, text_hash, n_words, spans, items) of every (id, text) with hits.

    ``spans`` are hit word spans [first, end). The second frame is broadcast where its size allows.
    """
    grams = saved(item_grams(benchmark, item_id, item_text, width, gram), "hit-grams")
    lengths = [(r["len"], r["n"], r["b"]) for r in grams.groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.array_join("words", " "))).alias("b")).collect()]
    fits = sum(n * GRAM_BYTES + 4 * b for _, n, b in lengths) <= broadcast_bytes
    side = grams.select("item", F.col("words").alias("item_words"), F.col("len").alias("item_len"), F.col("at").alias("item_at"), F.col("g").alias("item_g"))
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    base = keyed.select("id", "text_hash", words_of(F.col("text")).alias("words"))

    # a row without gram for every text, then one per looked-up start; at most ``width`` lengths exist
    starts = [F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("g")))]
    for length, _, _ in sorted(lengths):
        starts.append(looked_grams(length, min(gram, length)))
    looked = base.select("id", "text_hash", F.size("words").alias("n_words"), F.concat(*starts).alias("starts"))
    # outer: Spark would else infer a filter on the array, push it down and compute the words anew for every gram
    looked = looked.select("id", "text_hash", "n_words", F.inline_outer("starts"))
    same_gram = (F.col("g") == F.col("item_g")) & (F.col("len") == F.col("item_len"))
    if fits:
        met = looked.join(F.broadcast(side), same_gram, "left").where((F.col("at") < 0) | F.col("item_at").isNotNull())
    else:
        met = looked.where("at < 0").unionByName(looked.where("at >= 0").join(side, same_gram), allowMissingColumns=True)
    met = saved(met.select("id", "text_hash", "n_words", "at", "len", "item", "item_words", "item_at"), "hit-met")
    rows = met.where("at < 0").select("id", "text_hash", "n_words")
    of_item = met.where("at >= 0").groupBy("id", "text_hash", "item", "item_words", "len").agg(F.max("n_words").alias("n_words"), F.collect_set(F.struct("at", "item_at")).alias("places"))
    by_text = of_item.groupBy("id", "text_hash").agg(F.max("n_words").alias("n_words"), F.collect_list(F.struct("item", "item_words", "len", "places")).alias("met"))
    by_text = saved(by_text, "hit-texts")
    met_bytes = F.aggregate("met", F.lit(64), lambda acc, m: acc + 64 + 32 * F.size(m["item_words"]) + 32 * F.size(m["places"]))
    texts = one_side(by_text, met_bytes, broadcast_bytes)

    # windows around a met gram, verified word by word; equal (id, text) give one row
    concerned = keyed.withColumnsRenamed({"id": "own_id", "text_hash": "own_hash"})
    joined = concerned.join(texts, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")))
    found = joined.select("id", "text_hash", "n_words", "met", words_of(F.col("text")).alias("words"))
    found = found.select("id", "text_hash", "n_words", F.inline_outer(F.transform("met", lambda m: F.struct(m["item"].alias("item"), verified(m, gram).alias("spans")))))
    found = found.where(F.size("spans") > 0).groupBy("id", "text_hash")
    out = found.agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.collect_set("item").alias("items"))
    out = saved(out, "hit-found")
    return rows, one_side(out, F.lit(64) + 32 * F.size("spans") + 64 * F.size("items"), broadcast_bytes)


def one_side(df: DataFrame, row_bytes: Column, limit: int) -> DataFrame:
    """``df``, marked for broadcast if its rows' bytes sum up to at most ``limit``."""
    total = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if total <= limit else df


def verified(m: Column, gram: int) -> Column:
    """Spans [first, end) of the column ``words`` that windows of a met item cover, around the places of its met grams."""
    length, q = m["len"], F.least(F.lit(gram), m["len"])

    def span(p: Column) -> Column:
        shift = p["at"] - p["item_at"]
        lo = F.greatest(F.lit(0), p["at"] + q - length, shift)
        hi = F.least(p["at"], F.size("words") - length, shift + F.size(m["item_words"]) - length)
        same = lambda w: F.forall(F.sequence(F.lit(0), length - 1), lambda k: F.get("words", w + k) == F.get(m["item_words"], w - shift + k))
        windows = F.when(lo <= hi, F.filter(F.sequence(lo, hi), same))
        return F.struct(F.array_min(windows).alias("first"), (F.array_max(windows) + length).alias("end"))

    return F.filter(F.transform(m["places"], span), lambda s: s["first"].isNotNull())


def hit_words(spans: Column) -> Column:
    """Words covered by spans that may overlap."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["first"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """Five in a hundred of the words are hit, and at least one."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", remove_spans: bool = False) -> DataFrame:
    """``docs`` without contaminated rows; with ``remove_spans`` all rows stay and lose the hit words instead."""
    id_, hash_, hits_ = (free_name(docs, n) for n in ("hit_id", "hit_hash", "hit_spans"))
    _, hits = find_hits(docs, benchmark, doc_id, text, item_id, item_text)
    if not remove_spans:
        hits = saved(hits.where(is_contaminated(hit_words(F.col("spans")), F.col("n_words"))).select("id", "text_hash", F.lit(None).alias("spans")), "hit-gone")
        hits = one_side(hits, F.lit(64), BROADCAST_BYTES)
    hits = hits.select(F.col("id").alias(id_), F.col("text_hash").alias(hash_), F.col("spans").alias(hits_))
    on = docs[doc_id].eqNullSafe(F.col(id_)) & F.xxhash64(docs[text]).eqNullSafe(F.col(hash_))
    if not remove_spans:
        return docs.join(hits, on, "left_anti")
    joined = docs.join(hits, on, "left")
    gaps = F.regexp_extract_all(text, F.lit("[^0-9A-Za-z\\x80-\\x{10FFFF}]*[0-9A-Za-z\\x80-\\x{10FFFF}]+"), F.lit(0))
    gone = F.flatten(F.transform(hits_, lambda s: F.sequence(s["first"], s["end"] - 1)))
    places = F.array_except(F.sequence(F.lit(0), F.size(gaps) - 1), gone)
    kept = F.array_join(F.transform(places, lambda i: F.get(gaps, i)), "")
    return joined.withColumn(text, F.when(F.col(hits_).isNull(), F.col(text)).otherwise(kept)).drop(id_, hash_, hits_)
