"""Exact top-k search by columnar branch-and-bound on integer vectors.

Queries and candidates are dealt into bounded blocks, and every pair of blocks meets in one task. The task
holds the candidates in vertical layout (a row per dimension, by descending query-independent mass)
and accumulates inner products dimension block by dimension block. After each block a candidate's
score is at most its partial sum plus the product of the remaining norms (Cauchy-Schwarz); candidates
whose bound is below the k-th best score so far are dropped and the survivors are compacted. What a
task returns is the k best per query; a window over those picks the final k.

Sums are exact: they are taken in float64 while the largest possible sum of a block pair is below
2^53, and in Python integers beyond; scores beyond 64 bits become the largest of their sign. Ties go to the smaller id: a candidate is dropped only if its bound
is *below* the threshold, never at it. Candidates are read by descending norm, so that the threshold is
high from the first slab on.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do null
ids; a query with fewer than k candidates gives all; repeated query rows ask once (rows that share an id
but not the vector ask one question by all of these vectors); repeated candidate rows are candidates
each, and rows with the query's id are left out of its result; vectors of another length than the
query's are no candidates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a query block and of a candidate block that meet in one task.
QUERY_ROWS, CANDIDATE_ROWS = 512, 16_384
#: Candidates per vertical slab within a task, and dimensions per accumulation step.
SLAB, STEP = 2048, 16
#: Scores and components beyond 64 bits become the largest of their sign.
LARGEST = (1 << 63) - 1
RESULT = "query_id long, vec_id long, score long"


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as long; null for a vector that takes no part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad), ints)


def best_of_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """The k best (query, candidate, score) of a block pair."""
    order = np.argsort(-(np.abs(c.astype(float)).sum(axis=0) * np.abs(q.astype(float)).sum(axis=0)), kind="stable")
    by_norm = np.argsort(-(c.astype(float) ** 2).sum(axis=1), kind="stable")
    cid, c = cid[by_norm], c[by_norm]
    fq, fc = q[:, order].astype(np.float64), np.ascontiguousarray(c[:, order].T, dtype=np.float64)
    exact = float(np.abs(fq).sum(axis=1).max(initial=0)) * float(np.abs(fc).max(initial=0)) < 2**53
    q, columns = (fq, fc) if exact else (q[:, order].astype(object), c[:, order].T.astype(object))  # a row per dimension
    edges = list(range(0, len(order), STEP)) + [len(order)]
    rest_q = [np.sqrt((fq[:, e:] ** 2).sum(axis=1)) for e in edges]
    slabs = []
    for at in range(0, len(cid), SLAB):
        part = columns[:, at : at + SLAB]
        slabs.append((cid[at : at + SLAB], part, [np.sqrt((fc[e:, at : at + SLAB] ** 2).sum(axis=0)) for e in edges]))
    for i in range(len(qid)):
        top_score, top_id = np.empty(0, dtype=q.dtype), np.empty(0, dtype=np.int64)
        for ids, part, rest_c in slabs:
            floor = float(top_score[-1]) if len(top_score) == k else 0.0
            alive = np.flatnonzero(ids != qid[i])
            sums = np.zeros(len(alive), dtype=q.dtype)
            for s in range(len(edges) - 1):
                sums = sums + q[i, edges[s] : edges[s + 1]] @ part[edges[s] : edges[s + 1], alive]
                rest = rest_q[s + 1][i] * rest_c[s + 1][alive] * (1 + 1e-9) + 1e-6
                keep = np.asarray(sums + rest >= floor - abs(floor) * 1e-12 if len(top_score) == k else np.ones(len(alive)), dtype=bool)
                alive, sums = alive[keep], sums[keep]
                if not len(alive):
                    break
            if len(alive):
                sums = sums if exact else np.minimum(np.maximum(sums, -LARGEST - 1), LARGEST)
                score, own = np.concatenate([top_score, sums]), np.concatenate([top_id, ids[alive]])
                first = np.lexsort((own, -score))[:k]
                top_score, top_id = score[first], own[first]
        for v, x in zip(top_id.tolist(), top_score.tolist(), strict=True):
            yield int(qid[i]), v, int(x)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) from two frames (id, v: array of long)."""
    queries, candidates = (x.where("v is not null and id is not null").select("id", "v") for x in (queries, candidates))
    queries = queries.dropDuplicates(["id", "v"])
    n_q = max(1, -(-queries.count() // query_rows))
    n_c = max(1, -(-candidates.count() // candidate_rows))
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(n)).cast("int")
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", block(n_q, 1)).withColumn("cb", cells(n_c))
    right = candidates.withColumn("cb", block(n_c, 2)).withColumn("qb", cells(n_q))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for length in sorted(set(q["v"].map(len))):
            one, two = q[q["v"].map(len) == length], c[c["v"].map(len) == length]
            if len(two):
                sides = (x for part in (one, two) for x in (part["id"].to_numpy(dtype=np.int64), np.stack(part["v"].to_list())))
                out += best_of_block(*sides, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    met = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(cell, RESULT)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
