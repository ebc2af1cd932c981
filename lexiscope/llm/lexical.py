"""Ranked lexical search with hashed max-sketches: bounds first, exact scores from the highest bound down.

1. One pass over the documents counts every text's terms and its occurrences of the queries' terms (the
   queries are a stated set, read in blocks whose vocabulary has a size bound) and writes one narrow row per
   document. Document frequencies and lengths come from that table.
2. A document's impacts (what one occurrence of a term in a query adds to its score) fold into a sketch of
   ``COORDINATES`` numbers: each term has a hashed coordinate, and a coordinate keeps the highest of its
   terms' impacts. A query looks up its terms' coordinates; their sum, repeats included, is never below the score.
   For a block of documents the lookups of all queries are one matrix product, exact in doubles.
3. Per block and query the documents are rescored exactly from their impacts in order of descending bound, until
   the next bound is below the k-th best score found so far. A task carries these thresholds from block to block;
   all tasks start from those of a first pass over a share of the documents, whose k-th best can only be too low.
4. Each task gives its k best per query; the k best of all are ranked in two steps, so that no task gets all.

Cases: a null or wordless text has no terms, isn't counted and is never found; a null or wordless query
finds nothing; very long texts are read whole; equal scores rank by ascending document id, null ids last;
repeated rows are documents of their own; rows of one id and text are one query, an id with several texts
has a ranking for each; empty tables give an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from lexiscope.llm.common import BROADCAST_BYTES, saved

#: Coordinates of a sketch.
COORDINATES = 512
#: Documents of a block, and how many of them are rescored at once.
BLOCK_ROWS, STEP_ROWS = 2048, 32
#: Bytes of vocabulary and of query-by-coordinate counts that a block of queries may take.
VOCABULARY_BYTES = 32 << 20
#: Bytes of a term in a vocabulary in memory beside its text.
TERM_BYTES = 200
#: One document in this many takes part in the first pass for thresholds.
PILOT = 64
#: Every byte that isn't part of a term becomes a blank, A to Z become lower case.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
POSTED = "doc_id {id}, n long, terms array<int>, tfs array<int>"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return text.translate(TERMS).split()


class Queries:
    """A block of queries: term numbers, hashed coordinates, and how often each query holds each."""

    def __init__(self, ids: list, texts: list[bytes | None]) -> None:
        self.ids = ids
        own = [terms_of(t or b"") for t in texts]
        self.number = {t: k for k, t in enumerate(sorted({t for terms in own for t in terms}))}
        self.coordinate = np.array([xxhash.xxh64_intdigest(t) % COORDINATES for t in self.number], dtype=np.int64)
        #: per query: distinct term numbers and their repeats
        self.terms = [np.unique([self.number[t] for t in terms], return_counts=True) if terms else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for terms in own]

    def lookups(self) -> np.ndarray:
        """Coordinate by query: how often a query looks a coordinate up, once for each of its terms there and each repeat."""
        out = np.zeros((COORDINATES, len(self.ids)))
        for k, (terms, times) in enumerate(self.terms):
            np.add.at(out, (self.coordinate[terms], k), times)
        return out


def query_blocks(queries: DataFrame, item_id: str, text: str) -> Iterator[Queries]:
    """The queries in blocks whose vocabulary is bounded; they come one after the other to the driver."""
    ids, texts, held = [], [], 0
    for r in queries.select(F.col(item_id).alias("i"), F.col(text).cast("binary").alias("t")).distinct().orderBy("i", "t").toLocalIterator():
        own = len(r["t"] or b"") // 2 * (TERM_BYTES // 8) + 8 * COORDINATES
        if ids and held + own > VOCABULARY_BYTES:
            yield Queries(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(r["i"])
        texts.append(bytes(r["t"]) if r["t"] is not None else None)
        held += own
    if ids:
        yield Queries(ids, texts)


def posted(docs: DataFrame, queries: Queries, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with terms: n terms in all, and the queries' terms it holds."""
    source = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    number = docs.sparkSession.sparkContext.broadcast(queries.number)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = number.value.get
        for batch in batches:
            n, terms, tfs, sizes = [], [], [], [0]
            for t in batch.column(1):
                words = terms_of(t.as_py())
                known = np.array([k for k in map(find, words) if k is not None], dtype=np.int32)
                known, times = np.unique(known, return_counts=True)
                n.append(len(words))
                terms.append(known)
                tfs.append(times)
                sizes.append(sizes[-1] + len(known))
            offsets = pa.array(sizes, pa.int32())
            columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32) if x else [], pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *columns], names=["doc_id", "n", "terms", "tfs"])

    return source.mapInArrow(own, POSTED.format(id=source.schema["doc_id"].dataType.simpleString())).where("n > 0")


def weights(posts: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of every term number, the number of documents N and of all their terms L; at most one row per term comes back."""
    total = posts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = posts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    out = np.zeros(n_terms, dtype=np.int64)
    for r in df:
        out[r["term"]] = math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * r["df"] + 1)))
    return out, total["n"], total["l"]


def best(posts: DataFrame, queries: Queries, weight: np.ndarray, n_docs: int, n_all: int, k: int, floor: np.ndarray | None = None) -> DataFrame:
    """(q, doc_id, score): each task's k best documents of every query (by number), all at least ``floor``."""
    known = posts.sparkSession.sparkContext.broadcast((queries.terms, queries.coordinate, queries.lookups(), weight, floor))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, coordinate, lookups, weight, floor = known.value
        counts = [np.zeros(len(weight), dtype=np.int64) for _ in terms] if len(terms) * len(weight) <= 1 << 22 else None
        if counts:
            for c, (own_terms, times) in zip(counts, terms, strict=True):
                c[own_terms] = times
        least = np.ones(len(terms), dtype=np.int64) if floor is None else np.maximum(floor, 1)
        found: list[list[tuple]] = [[] for _ in terms]
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(lo, BLOCK_ROWS)
                rescored(block, terms, counts, coordinate, lookups, weight, n_docs, n_all, k, least, found)
        rows = [(q, i, s) for q, own_found in enumerate(found) for s, i in own_found]
        if rows:
            q, ids, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, id_type), pa.array(scores, pa.int64())], names=["q", "doc_id", "score"])

    id_type = to_arrow_type(posts.schema["doc_id"].dataType)
    return posts.mapInArrow(own, f"q int, doc_id {posts.schema['doc_id'].dataType.simpleString()}, score long")


def rescored(block: pa.RecordBatch, terms: list, counts: list | None, coordinate: np.ndarray, lookups: np.ndarray, weight: np.ndarray, n_docs: int, n_all: int, k: int, least: np.ndarray, found: list[list[tuple]]) -> None:
    """Merges a block's documents into ``found``, the best (score, id) of each query, and raises the thresholds in ``least``."""
    ids, n = block.column(0).to_pylist(), block.column(1).to_numpy()
    sizes = block.column(2).value_lengths().to_numpy().astype(np.int64)
    term, tf = (block.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
    m = 100 - 25 + (25 * n * n_docs) // n_all
    impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes)))
    # fold: the highest impact of each coordinate
    width = len(lookups)
    sketch = np.zeros(len(ids) * width)
    np.maximum.at(sketch, np.repeat(np.arange(len(ids)) * width, sizes) + coordinate[term], impact.astype(np.float64))
    bounds = sketch.reshape(len(ids), width) @ lookups
    stop = np.cumsum(sizes)
    hopeful = np.flatnonzero((bounds >= least).any(axis=0))
    for q in hopeful:
        rows = np.flatnonzero(bounds[:, q] >= least[q])
        rows = rows[np.argsort(-bounds[rows, q], kind="stable")]
        if counts is not None:
            times = counts[q]
        else:
            times = np.zeros(len(weight), dtype=np.int64)
            times[terms[q][0]] = terms[q][1]
        for lo in range(0, len(rows), STEP_ROWS):
            step = rows[lo : lo + STEP_ROWS]
            if bounds[step[0], q] < least[q]:
                break
            step = step[bounds[step, q] >= least[q]]
            at = np.concatenate([np.arange(stop[r] - sizes[r], stop[r]) for r in step])
            total = np.concatenate([[0], np.cumsum(times[term[at]] * impact[at])])
            score = np.diff(total[np.concatenate([[0], np.cumsum(sizes[step])])])
            good = np.flatnonzero(score >= least[q])
            if len(good):
                merged = found[q] + [(int(score[g]), ids[step[g]]) for g in good]
                merged.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                found[q] = merged[:k]
                if len(found[q]) == k:
                    least[q] = max(least[q], found[q][-1][0])


def ranked(rows: DataFrame, by: str | list[str], k: int) -> DataFrame:
    """``rows`` with their rank among those of ``by``, the first k: first within parts, so that no task gets all of a query."""
    order: list[Column] = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    keys = [by] if isinstance(by, str) else by
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    some = rows.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy(*keys, "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("part", "rank").withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every query, all if fewer score above 0."""
    spark, parts = docs.sparkSession, []
    kind = queries.schema[item_id].dataType.simpleString()
    for block in query_blocks(queries, item_id, item_text):
        posts = saved(posted(docs, block, doc_id, text), "search-posts")
        weight, n_docs, n_all = weights(posts, len(block.number))
        if not n_all:
            continue
        # thresholds: the k-th best of a share of the documents; one row per query comes back
        pilot = ranked(best(posts.where(F.pmod(F.xxhash64("doc_id"), F.lit(PILOT)) == 0), block, weight, n_docs, n_all, k), "q", k)
        floor = np.zeros(len(block.ids), dtype=np.int64)
        for r in pilot.where(F.col("rank") == k).select("q", "score").collect():
            floor[r["q"]] = r["score"]
        found = ranked(best(posts, block, weight, n_docs, n_all, k, floor), "q", k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"q int, item_id {kind}")
        parts.append(saved(found.join(F.broadcast(names) if len(block.ids) * 64 <= BROADCAST_BYTES else names, "q").select("item_id", "doc_id", "score", "rank"), "search-found"))
    if not parts:
        empty = docs.select(F.col(doc_id).alias("doc_id")).where("false")
        return empty.select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.select("item_id", "rank", "doc_id", "score")
