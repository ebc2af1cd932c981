"""Alignment of two tokenizers' tokens by interval coalescing, in Arrow functions.

Both tokenizers see a blank and the text: A encodes exactly that, B adds the blank itself. The tokens of
a chunk of texts, laid end to end on one line of bytes, become intervals. All A and B intervals are sorted by
start (``lexsort``), and the running maximum of their ends (``maximum.accumulate``) tells where a group breaks:
where a start reaches it, as it does at every text's end. Within a group every A token is linked to every
B token. Ids that repeat in a large group are counted, not expanded, so that long runs of one token stay small.

The links of the corpus: every document writes its distinct id pairs with their multiplicities once; Spark
counts the documents of each pair (combined before the shuffle). A table of counts within ``BROADCAST_BYTES``
is sent to the workers as sorted arrays; beyond that pairs and counts are joined by shuffle, the pairs of very
many documents by broadcast.

A byte-level vocabulary is encoded by the rank library where its merges are in the order of its ids, as
it then gives the same ids several times faster; other vocabularies by their own library.

Cases: null and empty texts, and texts that either side doesn't give back byte for byte (U+2581, for B), have no
tokens, zero counts and no groups; whole texts are encoded, whatever their length; special strings in a
text are plain text; repeated rows get equal results and each counts as a document; ties for an A
id's highest count are all highest; an empty table gives an empty result; other columns, whatever
their names, play no part.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import BROADCAST_BYTES, join_by_count, saved

#: Characters of texts that are aligned together, about.
CHUNK_CHARS = 500_000
#: Links of a group beyond which its repeated ids are counted before they are linked.
LARGE_GROUP = 1 << 12
#: Bytes in memory of one pair of the table of counts: pair, count and whether it is the highest.
PAIR_BYTES = 24
#: How the byte-level pre-tokenizer cuts a text, for the rank library (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of a list of texts with a blank before each, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            own.encode_special_tokens = True
            alphabet = byte_alphabet()
            entries = [own.id_to_token(i) or "" for i in range(own.get_vocab_size(with_added_tokens=True))]
            self.bytes = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries]
            ranks = self.ranks(path, entries)
            if ranks is None:
                self.encode = lambda texts: [e.ids for e in own.encode_batch([" " + t for t in texts], add_special_tokens=False)]
            else:
                import tiktoken

                fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
                self.encode = lambda texts: [fast.encode_ordinary(" " + t) for t in texts]
        else:
            from sentencepiece import SentencePieceProcessor

            own = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: own.encode(texts, num_threads=1)
            self.bytes = []
            for i in range(own.get_piece_size()):
                piece = own.id_to_piece(i)
                self.bytes.append(bytes([int(piece[3:-1], 16)]) if own.is_byte(i) else piece.replace("▁", " ").encode())
        self.size = len(self.bytes)
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)

    def ranks(self, path: str, entries: list[str]) -> dict[bytes, int] | None:
        """Bytes of every mergeable entry with its id, if the file is plain byte-level BPE whose merges follow the order of ids."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        cuts = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True) and spec.get("normalizer") is None
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        if not plain or not cuts or [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
            return None
        return {self.bytes[i]: i for i in range(256 + len(merged))}

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Ids of all texts end to end, how many each has, and whether each is given back byte for byte."""
        ids = self.encode(texts)
        same = [b"".join([self.bytes[i] for i in x]) == f" {t}".encode() for x, t in zip(ids, texts, strict=True)]
        ids = [x if ok else [] for x, ok in zip(ids, same, strict=True)]
        n = np.array([len(x) for x in ids], dtype=np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int64, n.sum()), n, same


def coalesced(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of intervals by start, and each sorted one's group: a new one begins where a start reaches all ends before."""
    order = np.lexsort((end, start))
    furthest = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), dtype=np.int64)
    breaks[1:] = start[order][1:] >= furthest[:-1]
    return order, np.cumsum(breaks)


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + n[i] - 1, one after the other."""
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) - np.repeat(total - n, n) + np.repeat(first, n)


class Digits:
    """Decimal ids with a separator after each, many at once."""

    def __init__(self, n: int) -> None:
        shown = [str(i).encode() for i in range(n)]
        self.lengths = np.array([len(x) for x in shown], dtype=np.int64)
        self.width = int(self.lengths.max()) + 1
        self.table = np.frombuffer(b"".join(x.ljust(self.width) for x in shown), dtype=np.uint8).reshape(n, self.width)

    def joined(self, ids: np.ndarray, separators: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All ids with their separators, and how many bytes each takes with it."""
        out, n = self.table[ids], self.lengths[ids]
        out[np.arange(len(ids)), n] = separators
        return out[np.arange(self.width) <= n[:, None]].tobytes(), n + 1


class Aligner:
    """Both sides, for one worker."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = Side(a_path), Side(b_path)
        self.digits = Digits(max(self.a.size, self.b.size))

    def rows(self, texts: list[str | None]) -> Iterator[tuple]:
        """Per text: n_a, n_b, n_groups, n_links, groups in bytes, distinct pairs and their links."""
        at = 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and (held < CHUNK_CHARS or upto == at):
                held += len(texts[upto] or "")
                upto += 1
            yield from self.chunk(texts[at:upto])
            at = upto

    def chunk(self, texts: list[str | None]) -> Iterator[tuple]:
        own = [k for k, t in enumerate(texts) if t]
        (a, n_a, same_a), (b, n_b, same_b) = (side.flat([texts[k] for k in own]) for side in (self.a, self.b))
        good = np.array([x and y for x, y in zip(same_a, same_b, strict=True)], dtype=bool)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        found = dict(zip([k for k, ok in zip(own, good, strict=True) if ok], self.aligned(a, n_a[good], b, n_b[good]), strict=True))
        none = (0, 0, 0, 0, None, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        return (found.get(k, none) for k in range(len(texts)))

    def aligned(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> Iterator[tuple]:
        """Results of texts whose ids lie end to end in ``a`` and ``b``, n_a[k] and n_b[k] of the k-th."""
        if not len(n_a):
            return iter(())
        end_a, end_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        start_a, start_b = end_a - self.a.lengths[a], end_b - self.b.lengths[b]
        order, sorted_group = coalesced(np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b]))
        group = np.empty(len(order), dtype=np.int64)
        group[order] = sorted_group
        g_a, g_b = group[: len(a)], group[len(a) :]
        n = int(sorted_group[-1]) + 1
        in_a, in_b = np.bincount(g_a, minlength=n), np.bincount(g_b, minlength=n)
        doc = np.empty(n, dtype=np.int64)
        doc[g_a] = np.repeat(np.arange(len(n_a)), n_a)

        # text: a group's A ids, then its B ids
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        at_a, at_b = np.arange(len(a)) + (upto_b - in_b)[g_a], np.arange(len(b)) + upto_a[g_b]
        ids, seps = np.empty(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
        ids[at_a], ids[at_b] = a, b
        seps[at_a[upto_a - 1]], seps[at_b[upto_b - 1]] = ord("|"), ord(";")
        shown, sizes = self.digits.joined(ids, seps)
        stops = np.cumsum(sizes)[np.cumsum(n_a + n_b) - 1].tolist()

        key, links = self.linked(a, g_a, b, g_b, in_a, in_b, doc)
        all_pairs = self.a.size * self.b.size
        n_groups, n_links = np.bincount(doc, minlength=len(n_a)), np.zeros(len(n_a), dtype=np.int64)
        np.add.at(n_links, doc, in_a * in_b)
        pair_stops = np.searchsorted(key // all_pairs, np.arange(len(n_a)), side="right").tolist()
        pair = key % all_pairs
        return ((x, y, g, m, shown[lo : hi - 1], pair[p:q], links[p:q]) for x, y, g, m, lo, hi, p, q in zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), [0, *stops], stops, [0, *pair_stops], pair_stops, strict=False))

    def linked(self, a: np.ndarray, g_a: np.ndarray, b: np.ndarray, g_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, A id, B id) in one number each, sorted, and how often each is linked."""
        small = in_a * in_b <= LARGE_GROUP
        first_b = np.cumsum(in_b) - in_b
        own = small[g_a]
        x, g = a[own], g_a[own]
        y = b[ranges(first_b[g], in_b[g])]
        keys = [(np.repeat(doc[g] * self.a.size + x, in_b[g])) * self.b.size + y]
        times = [np.ones(len(y), dtype=np.int64)]
        for k in np.flatnonzero(~small):
            (u, m), (v, w) = np.unique(a[g_a == k], return_counts=True), np.unique(b[g_b == k], return_counts=True)
            keys.append(((doc[k] * self.a.size + u)[:, None] * self.b.size + v[None, :]).ravel())
            times.append(np.outer(m, w).ravel())
        key, weight = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[at], np.add.reduceat(weight[order], at)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], pa.int64()).cast(kind))


def pair_base(b_path: str) -> int:
    """A linked pair is A's id times this, plus B's id."""
    return Side(b_path).size


def alignments(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, links) of every row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in ids, or with ``digest`` its SHA-256 in hex; null for rows without tokens.
    ``pairs`` are the distinct linked ids (``pair_base``), ``links`` how often each is linked.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    narrow = Side(a_path).size * pair_base(b_path) < 1 << 31

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = list(aligner.rows(part.column(1).to_pylist()))
                groups = [r[4] and (hashlib.sha256(r[4]).hexdigest() if digest else r[4].decode()) for r in rows]
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                pairs, links = lists([r[5] for r in rows], pa.int32() if narrow else pa.int64()), lists([r[6] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(groups, pa.string()), pairs, links], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])

    kind = "int" if narrow else "long"
    return source.mapInArrow(own, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<{kind}>, links array<long>")


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """(pair, n, most): documents of every linked id pair, and the highest such number of its A id."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = saved(counts.withColumn("a", F.floor(F.col("pair") / F.lit(base))), "align-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(best, "a").select("pair", "n", "most")


def link_scores(aligned: DataFrame, counts: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``aligned`` (written already, as it is read twice) with n_best and count_sum instead of pairs and links."""
    counts = saved(counts, "align-best")
    n_pairs = counts.count()
    kept = [c for c in aligned.columns if c not in ("pairs", "links")]
    if n_pairs * PAIR_BYTES > broadcast_bytes:
        return joined_scores(aligned, counts, n_pairs, kept)
    table = counts.toPandas().sort_values("pair")
    known = aligned.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(), table["n"].to_numpy(), (table["n"] == table["most"]).to_numpy()))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, is_best = known.value
        for batch in batches:
            lists_ = batch.column(batch.schema.get_field_index("pairs"))
            times = batch.column(batch.schema.get_field_index("links")).flatten().to_numpy()
            at = np.searchsorted(pairs, lists_.flatten().to_numpy())
            sums = []
            for values in (times * is_best[at], times * n[at]):
                total = np.concatenate([[0], np.cumsum(values)])
                stops = np.cumsum(lists_.value_lengths().to_numpy())
                sums.append(pa.array(np.diff(total[np.concatenate([[0], stops])]).astype(np.int64)))
            rest = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*rest, *sums], names=[*kept, "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)
    return aligned.mapInArrow(own, f"{schema}, n_best long, count_sum long")


def joined_scores(aligned: DataFrame, counts: DataFrame, n_pairs: int, kept: list[str]) -> DataFrame:
    """The same by joins, for more pairs than a worker should hold."""
    rows = saved(aligned.withColumn("row", F.monotonically_increasing_id()), "align-rows")
    links = rows.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("links").alias("times"))))
    # a pair's documents bound its rows, and pairs of at least x documents are at most links / x
    n_links = rows.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0)).alias("n")).first()["n"]
    met = join_by_count(links, counts.withColumn("rows", F.col("n")), "pair", "rows", n_links)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.join(sums, "row", "left")
    return out.select(*kept, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])
