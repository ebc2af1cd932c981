"""Merkle trees over sections and paragraphs of texts, in DataFrame functions only.

A text is cut into sections (after blank lines and before headings), those into paragraphs (lines), without
losing a character. A paragraph's node is the SHA-256 of its text, a section's that of its paragraphs' nodes,
the root's that of its sections' nodes: equal roots mean equal texts, and where roots differ only differing
branches need to be followed (``located_edits``). Under a paragraph hang its pieces, cut where the content says
so: after a word with one of some endings, so that an edit moves no piece far from it. A piece is one number, its
hash and its length; two trees' likeness is twice the characters of their common pieces over the
characters of both, a repeated piece counting once.

``with_next`` puts the next row in an order beside each row without one task for all: range bounds of the keys
deal rows into buckets of about equal rows, each bucket also gets the first row of the one after it, and a
window looks ahead within a bucket. Texts are shuffled once.

Cases: a null text is an empty one, a single section and paragraph without pieces; two texts without pieces have
likeness 1; very long texts are cut whole; rows that share id and text are one document and get equal
rows, however many they are (they are combined before any shuffle); ids that several texts share are
ordered by hash as well; null ids come last; a single document is followed by itself; an empty table gives
an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiscope.llm.common import BROADCAST_BYTES, join_by_count, saved

#: A section begins after a blank line and before a heading, a paragraph after a line end.
SECTION = r"(?<=\n[ \t\r]{0,9}\n)(?=[^\n])|(?<=\n)(?=#{1,6} )"
PARAGRAPH = r"(?<=\n)(?=[^\n])"
#: A piece: 12 to 96 characters up to a word's end in one of these, else 96 characters.
PIECE = r"(?s).{12,96}?(?:[.!?;:,dgkmnrxz]\s+|\z)|.{1,96}"
#: A piece's number: 36 bits of its hash, then 12 that hold its length.
HASH, LENGTH = (1 << 36) - 1, (1 << 12) - 1
#: Bytes of a bucket, about, and the most buckets there are.
BUCKET_BYTES, BUCKETS = 32 << 20, 100_000


def pieces(paragraph: Column) -> Column:
    """The numbers of a paragraph's pieces, in order."""
    number = lambda x: F.shiftleft(F.xxhash64(x).bitwiseAND(F.lit(HASH)), 12).bitwiseOR(F.length(x).cast("long"))
    return F.transform(F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(0)), number)


def tree(text: Column) -> Column:
    """Sections of a text: (node, paragraphs: (node, length, pieces)), the nodes in hex."""
    paragraph = lambda p: F.struct(F.sha2(p, 256).alias("node"), F.length(p).alias("length"), pieces(p).alias("pieces"))
    leaves = F.transform(F.split(text, SECTION), lambda s: F.transform(F.split(s, PARAGRAPH), paragraph))
    return F.transform(leaves, lambda ps: F.struct(F.sha2(F.array_join(F.transform(ps, lambda p: p["node"]), ""), 256).alias("node"), ps.alias("paragraphs")))


def root(sections: Column) -> Column:
    """The root's node of a ``tree``."""
    return F.sha2(F.array_join(F.transform(sections, lambda s: s["node"]), ""), 256)


def all_pieces(sections: Column) -> Column:
    """The pieces of a ``tree``, in order."""
    return F.flatten(F.flatten(F.transform(sections, lambda s: F.transform(s["paragraphs"], lambda p: p["pieces"]))))


def shown(root_node: Column, sections: Column) -> Column:
    """A tree as text: root:section(paragraph.piece-piece,paragraph.piece)..., all nodes but the root's cut to 12 hex digits."""
    short = lambda node: F.substring(node, 1, 12)
    paragraph = lambda p: F.concat(short(p["node"]), F.lit("."), F.array_join(F.transform(p["pieces"], lambda x: F.lower(F.hex(x))), "-"))
    section = lambda s: F.concat(short(s["node"]), F.lit("("), F.array_join(F.transform(s["paragraphs"], paragraph), ","), F.lit(")"))
    return F.concat(root_node, F.lit(":"), F.array_join(F.transform(sections, section), ""))


def characters(some: Column) -> Column:
    """Characters of pieces."""
    return F.aggregate(some, F.lit(0).cast("long"), lambda n, x: n + x.bitwiseAND(F.lit(LENGTH).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """Likeness, 0 to 1, of two arrays of distinct pieces."""
    both = characters(a) + characters(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * characters(F.array_intersect(a, b)) / both)


def first_difference(a: Column, b: Column) -> Column:
    """Characters before the first piece that differs between two arrays of all pieces; of the shorter text where none does."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.eqNullSafe(y).alias("same"), x.bitwiseAND(F.lit(LENGTH).cast("long")).alias("n")))
    start = F.struct(F.lit(True).alias("open"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct((acc["open"] & x["same"]).alias("open"), (acc["n"] + F.when(acc["open"] & x["same"], x["n"]).otherwise(0)).alias("n"))
    return F.aggregate(pairs, start, step, lambda acc: acc["n"])


def located_edits(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, section, paragraph, start, end): paragraphs of the text ``after`` under branches that the text ``before`` lacks.

    ``start`` and ``end`` are code points. Sections that both have are dropped whole, then paragraphs; ``key`` is unique.
    """
    own = pairs.select(F.col(key).alias("key"), tree(F.coalesce(before, F.lit(""))).alias("b"), tree(F.coalesce(after, F.lit(""))).alias("a"))
    own = saved(own.where(root(F.col("a")) != root(F.col("b"))), "fingerprint-pairs")
    sections = own.select("key", F.posexplode("a").alias("section", "s"))
    rows = sections.select("key", "section", F.col("s.node").alias("s_node"), F.posexplode("s.paragraphs").alias("paragraph", "p"))
    end = F.sum("p.length").over(W.partitionBy("key").orderBy("section", "paragraph"))
    rows = rows.select("key", "section", "s_node", "paragraph", F.col("p.node").alias("p_node"), (end - F.col("p.length")).alias("start"), end.alias("end"))
    known = own.select("key", F.explode("b").alias("s"))
    rows = rows.join(known.select("key", F.col("s.node").alias("s_node")).distinct(), ["key", "s_node"], "left_anti")
    paragraphs = known.select("key", F.explode("s.paragraphs").alias("p")).select("key", F.col("p.node").alias("p_node")).distinct()
    return rows.join(paragraphs, ["key", "p_node"], "left_anti").select(F.col("key").alias(key), "section", "paragraph", "start", "end")


def bucket_bounds(keys: DataFrame, n: int) -> list[str]:
    """The first keys (id, hash) of about ``n`` ranges in descending order, as JSON; one row per range comes back."""
    ranges = keys.repartitionByRange(n, F.col("id").desc_nulls_last(), F.col("hash").desc())
    firsts = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("id", "hash")).alias("k")).orderBy(F.col("k").desc())
    return [r["j"] for r in firsts.select(F.to_json("k").alias("j")).collect()]


def bucket_of(key: Column, bounds: Column, n: int) -> Column:
    """The last of ``n`` descending bounds that is not below the key."""

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"] + 1, 1)
        within = F.get(bounds, mid) >= key
        return F.struct(F.when(within, mid).otherwise(acc["lo"]).alias("lo"), F.when(within, acc["hi"]).otherwise(F.greatest(acc["lo"], mid - 1)).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(n)) + 1)))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi")), step, lambda acc: acc["lo"])


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(id, hash, text, next_text) of every distinct (id, text), and (id, hash, copies) of those that several rows share.

    The next document is that of the next smaller id; after the last comes the first.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    keys = rows.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("copies"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    keys = saved(keys, "fingerprint-keys")
    shared = keys.where("copies > 1").select("id", "hash", "copies")
    total = keys.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.count(F.when(F.col("copies") > 1, 1)).alias("shared")).first()
    n = min(BUCKETS, max(1, -(-total["b"] // bucket_bytes)))
    if not total["n"]:
        return rows.withColumn("next_text", F.col("text")).where("false"), shared
    if total["shared"]:
        # one row for all copies, combined before the shuffle
        marked = rows.join(sized(shared.select(F.col("id").alias("i"), F.col("hash").alias("h"), F.lit(True).alias("is_shared")), total["shared"] * 64), F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left").drop("i", "h")
        once = marked.where("is_shared").groupBy("id", "hash").agg(F.any_value("text").alias("text"))
        rows = marked.where("is_shared is null").select("id", "hash", "text").unionByName(once)
    first = bucket_bounds(keys.select("id", "hash"), n)
    n = len(first)
    bounds = F.from_json(F.lit(f"[{','.join(first)}]"), f"array<struct<id:{rows.schema['id'].dataType.simpleString()},hash:bigint>>")
    dealt = rows.select("id", "hash", "text", bucket_of(F.struct("id", "hash"), bounds, n).alias("bucket"))
    is_first = F.get(bounds, F.col("bucket")) == F.struct("id", "hash")
    places = [F.struct(F.col("bucket"), F.lit(False).alias("ahead")), F.when(is_first, F.struct(F.pmod(F.col("bucket") - 1, F.lit(n)).alias("bucket"), F.lit(True).alias("ahead")))]
    dealt = dealt.select("id", "hash", "text", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("place"))
    dealt = dealt.select("id", "hash", "text", "place.bucket", "place.ahead").repartition(n, "bucket")
    order = W.partitionBy("bucket").orderBy(F.col("ahead"), F.col("id").desc_nulls_last(), F.col("hash").desc())
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("not ahead").select("id", "hash", "text", "next_text"), shared


def sized(side: DataFrame, size: int) -> DataFrame:
    """``side``, marked for broadcast if its bytes fit."""
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


def repeated(results: DataFrame, shared: DataFrame, row_bytes: Column) -> DataFrame:
    """``results`` (id, hash, ...) of distinct documents, with a row for every copy of those in ``shared``."""
    total = shared.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    if not total["n"]:
        return results
    # the further copies as rows: at most 1,000 of each at a time, so that many copies are spread
    parts = shared.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 2) / 1000)))).repartition("id", "hash", "part")
    more = parts.withColumn("k", F.explode(F.sequence(F.col("part") * 1000 + 1, F.least(F.col("copies") - 1, F.col("part") * 1000 + 1000)))).select(F.struct("id", "hash").alias("key"))
    saved_results = saved(results, "fingerprint-results")
    keyed = sized(shared.select(F.struct("id", "hash").alias("of"), "copies"), total["n"] * 64)
    of_shared = saved_results.withColumn("key", F.struct("id", "hash")).join(keyed, F.col("key") == F.col("of")).drop("of")
    size = of_shared.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).first()["b"]
    if size <= BROADCAST_BYTES:
        copies = more.join(F.broadcast(of_shared.drop("copies")), "key")
    else:
        copies = join_by_count(more, of_shared, "key", "copies", total["rows"], row_bytes=max(128, size // total["n"]))
    return saved_results.unionByName(copies.drop("key"))


def edited(text: Column, next_text: Column) -> Column:
    """A text whose last floor(n / 2) code points are replaced by as many of the next text's first, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edit_start) of every row.

    ``edit_start``: code points before the first piece in which the edited text differs.
    """
    followed, shared = with_next(docs, doc_id, text, bucket_bytes)
    own = followed.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    own = own.select("id", "hash", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), tree(F.col("text")).alias("own"), tree(F.col("edited_text")).alias("edit"), tree(F.col("next_text")).alias("next"))
    own = own.select("id", "hash", "n_chars", "edited_sha256", shown(root(F.col("own")), F.col("own")).alias("fingerprint"), shown(root(F.col("edit")), F.col("edit")).alias("edited_fingerprint"), all_pieces(F.col("own")).alias("own"), all_pieces(F.col("edit")).alias("edit"), F.array_distinct(all_pieces(F.col("next"))).alias("next"))
    own = own.withColumn("edit_start", first_difference(F.col("own"), F.col("edit"))).withColumn("own", F.array_distinct("own")).withColumn("edit", F.array_distinct("edit"))
    out = own.select("id", "hash", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"), "edit_start")
    return repeated(out, shared, 256 + F.octet_length("fingerprint") + F.octet_length("edited_fingerprint")).drop("hash")
