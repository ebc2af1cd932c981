"""Near-duplicate classes by a signature-coordinate inverted join.

1. Every text becomes its set of hashed word shingles. Texts with equal sets form one class, and only
   one document per class goes on, with a MinHash signature whose coordinates are tokens
   (coordinate number and value in one integer).
2. Documents are posted under their tokens. Two documents are candidates if they share at least
   ``matches`` of the K tokens; this number follows from the wanted similarity so that a pair at
   that similarity is missed with a chance below MISS. A document of which fewer tokens occur in
   other documents can't have a partner and leaves (repeated, as that makes more tokens unique).
3. Prefix rule: with tokens sorted by frequency, rarest first, two documents that share ``matches``
   tokens share one among their first K - matches + 1. Only those are merged; frequent tokens, such
   as those of a passage that many documents hold, are skipped.
4. Documents that share prefix tokens form clusters. Within a cluster, collisions are counted over
   whole signatures, pairs below ``matches`` are left, and the others are confirmed on full shingle
   sets, best first, unless both ends are in one component already: what a task returns is a
   spanning forest, never all pairs.
5. Clusters larger than a block are dealt into blocks, each with the cluster's first document, and every
   document also meets the first document of each of its prefix tokens, so that chains and stars are
   linked in linear work. Only documents outside the cluster's largest component so far
   meet all blocks, pair of blocks by pair of blocks: no cluster is held by one task and no pair is lost.
6. Components of all links; the smallest id names each. Tokens and hubs of very many documents are
   joined by broadcast (they are few), so that no task gets all posts of one.

Cases: documents without words (null, empty or blank text) have an empty set and are linked with
nothing; texts with fewer words than a shingle are one shingle; very long texts are read whole; ties at
the threshold are links; repeated rows are copies of each other; a row without id takes no part and keeps
a null component; rows with one id and several texts count as one node; an empty table gives an empty
result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiscope.llm.common import ASCII_SPACE, BROADCAST_BYTES, join_by_count, saved
from lexiscope.llm.components import components

WORD = re.compile(f"[^{ASCII_SPACE}]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SHINGLE, COORDINATES, MISS = 5, 64, 1e-5
#: Shingles and documents of a block, about.
BLOCK_SHINGLES, BLOCK_ROWS = 1_000_000, 512
CACHE_WORDS = 100_000
_RNG = np.random.default_rng(20240611)
_A = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_COORDINATE = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(57)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def matches_for(similarity: float, k: int = COORDINATES, miss: float = MISS) -> int:
    """The largest t for which a pair at ``similarity`` has fewer than t of k equal coordinates with a chance below ``miss``."""
    below = 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below >= miss:
            return max(1, t)
    return k


class Shingler:
    """Shingle sets and signatures in one worker; remembers hashed words."""

    def __init__(self, width: int = SHINGLE) -> None:
        self.width, self.hashes = width, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        words = WORD.findall(text.translate(LOWER)) if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.hashes
        if len(known) > CACHE_WORDS:
            known.clear()
        h = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            v = known.get(w)
            if v is None:
                v = known[w] = xxhash.xxh3_64_intdigest(w)
            h[i] = v
        width = min(self.width, len(words))
        out = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = (out ^ h[k : k + len(out)]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)

    @staticmethod
    def signature(shingles: np.ndarray) -> np.ndarray:
        """Tokens of the K coordinates, as signed 64-bit integers."""
        least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 2048):
            least = np.minimum(least, (shingles[None, at : at + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
        return ((least >> np.uint64(7)) | _COORDINATE).view(np.int64)


def described(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, tokens) of every document; k1 and k2 identify the shingle set."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for b in batches:
            rows = []
            for t in b["text"]:
                s = shingler.shingles(t if isinstance(t, str) else None)
                if len(s):
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    rows.append((len(s), int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True), shingler.signature(s)))
                else:
                    rows.append((0, 0, 0, None))
            yield pd.DataFrame(rows, columns=["n_shingles", "k1", "k2", "tokens"]).assign(doc_id=b["doc_id"].to_numpy())[["doc_id", "n_shingles", "k1", "k2", "tokens"]]

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.where("doc_id is not null").mapInPandas(own, "doc_id long, n_shingles long, k1 long, k2 long, tokens array<long>")


def posted(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    return docs.select("node", F.explode(tokens).alias("token"))


def with_partners(posts: DataFrame, matches: int, rows: int) -> DataFrame:
    """(node, token, freq): posts under tokens of several documents, for nodes that have enough of those."""
    freq = posts.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    shared = join_by_count(posts, freq.withColumn("n", F.col("freq")), "token", "n", rows)
    return shared.withColumn("c", F.count(F.lit(1)).over(W.partitionBy("node"))).where(F.col("c") >= matches).drop("c")


class Forest:
    """Union-find; the root of a component is its least member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def link(nodes: np.ndarray, labels: np.ndarray, texts: list[str], left: np.ndarray | None, width: int, percent: int, matches: int, shingler: Shingler) -> Iterator[tuple[int, int]]:
    """Edges (label, least label) that join the components of the labels. ``left``: rows that meet all others; None: all."""
    forest = Forest()
    sets = [shingler.shingles(t) for t in texts]
    tokens = np.stack([shingler.signature(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    names = labels.tolist()
    for i in range(len(nodes)) if left is None else np.flatnonzero(left):
        lo = i + 1 if left is None else 0
        if lo >= len(nodes):
            break
        counts = (tokens[lo:] == tokens[i]).sum(axis=1)
        fit = 100 * np.minimum(sizes[lo:], sizes[i]) >= percent * np.maximum(sizes[lo:], sizes[i])
        near = np.flatnonzero((counts >= matches) & fit)
        for j in (near[np.argsort(-counts[near], kind="stable")] + lo).tolist():
            if forest.find(names[i]) != forest.find(names[j]) and similar(sets[i], sets[j], percent):
                forest.join(names[i], names[j])
    for x in set(names):
        if (root := forest.find(x)) != x:
            yield x, root


def same_id_links(all_docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (id, class) of ids that have several rows with words; None without such ids."""
    again = saved(all_docs.where("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "dup-again")
    if again.isEmpty():
        return None
    own = all_docs.where("n_shingles > 0").join(again, "doc_id", "left_semi").select("doc_id", "k1", "k2").distinct()
    return own.join(classes.select("k1", "k2", "node"), ["k1", "k2"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def hub_links(texts: DataFrame, met: DataFrame, members: DataFrame, width: int, percent: int, matches: int) -> DataFrame:
    """Confirmed links (a, b) of large clusters' documents with the first documents of their prefix tokens.

    A hub's partners are dealt into cells of about BLOCK_ROWS rows and BLOCK_SHINGLES shingles, each with the hub.
    """
    pairs = met.join(members.where("blocks > 1").select("node", "n"), "node")
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("rows"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    sizes = saved(sizes, "dup-hub-sizes")
    dealt = join_by_count(pairs, sizes, "hub", "rows", pairs.count())
    at = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts")).cast("int")
    needs = dealt.select(F.col("node").alias("doc_id"), "hub", at.alias("part"))
    needs = needs.unionByName(sizes.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))

    def star(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("doc_id", kind="stable")
        ids = b["doc_id"].to_numpy(dtype=np.int64)
        out = link(ids, ids, b["text"].tolist(), ids == b["hub"].to_numpy(dtype=np.int64), width, percent, matches, Shingler(width))
        return pd.DataFrame(list(out), columns=["a", "b"], dtype="int64")

    return texts.select("doc_id", "text").join(needs, "doc_id").groupBy("hub", "part").applyInPandas(star, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; links are pairs with ``percent`` of their union shared."""
    matches = matches_for(percent / 100)
    all_docs = saved(described(docs, doc_id, text, width), "dup-docs")
    classes = all_docs.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("members"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    classes = saved(classes, "dup-classes")

    # posts, then fewer posts of fewer documents, then prefixes
    n_posts = COORDINATES * classes.count()
    posts = saved(with_partners(posted(classes), matches, n_posts), "dup-posts")
    posts = with_partners(posts.select("node", "token"), matches, n_posts)
    rank = F.row_number().over(W.partitionBy("node").orderBy("freq", "token"))
    prefix = posts.withColumn("r", rank).withColumn("c", F.count(F.lit(1)).over(W.partitionBy("node"))).where(F.col("r") <= F.col("c") - matches + 1)
    prefix = saved(prefix.select("node", "token"), "dup-prefix")
    hubs = prefix.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = saved(join_by_count(prefix, hubs, "token", "n", n_posts).where("node <> hub").select("node", "hub").distinct(), "dup-met")
    coarse = components(met.select(F.col("node").alias("a"), F.col("hub").alias("b")))

    # clusters and their blocks
    sized = coarse.join(classes.select("node", "n"), "node")
    clusters = sized.groupBy("root").agg(F.sum("n").alias("cn"), F.count(F.lit(1)).alias("rows"))
    blocks = F.greatest(F.ceil(F.col("cn") / BLOCK_SHINGLES), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int")
    clusters = clusters.select("root", "rows", blocks.alias("blocks"))
    members = saved(join_by_count(sized, clusters, "root", "rows", n_posts).select("node", "root", "blocks", "n"), "dup-members")
    known = members.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("blocks"), F.lit(0)).alias("blocks")).first()
    side = members.select(F.col("node").alias("doc_id"), "root", "blocks")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    texts = texts.join(F.broadcast(side) if known["rows"] * 64 <= BROADCAST_BYTES else side, "doc_id")
    n_bins = max(1, -(-int(known["n"]) // BLOCK_SHINGLES))
    scatter = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), n).cast("int")
    small = texts.where("blocks = 1").withColumn("cell", F.struct(F.pmod(F.xxhash64("root"), F.lit(n_bins)).cast("long").alias("c"), F.lit(-1).alias("i")))
    cells = small
    if known["blocks"] > 1:
        large = texts.where("blocks > 1")
        each = F.when(F.col("doc_id") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(scatter(F.col("blocks"), 3)))
        cells = small.unionByName(large.withColumn("cell", F.explode(F.transform(each, lambda i: F.struct(F.col("root").alias("c"), i.alias("i"))))))

    def within(b: pd.DataFrame) -> pd.DataFrame:
        shingler, out = Shingler(width), []
        for _, own in b.groupby("root", sort=True):
            own = own.sort_values("doc_id", kind="stable")
            ids = own["doc_id"].to_numpy(dtype=np.int64)
            out += link(ids, ids, own["text"].tolist(), None, width, percent, matches, shingler)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = saved(cells.groupBy("cell").applyInPandas(within, "a long, b long"), "dup-links")
    same = same_id_links(all_docs, classes)
    if known["blocks"] > 1:
        links = links.unionByName(saved(hub_links(texts, met, members, width, percent, matches), "dup-hubs"))
    if known["blocks"] > 1 or same is not None:
        links = links if same is None else links.unionByName(same)
        labels = components(links).where("node <> root").select("node", F.col("root").alias("label"))
    else:
        labels = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    if known["blocks"] > 1:
        # documents outside their cluster's largest component so far, against all blocks; large clusters are few
        few = lambda df: F.broadcast(df) if known["rows"] // BLOCK_ROWS * 64 <= BROADCAST_BYTES else df
        named = members.where("blocks > 1").join(labels, "node", "left").select("node", "root", F.coalesce("label", "node").alias("label"))
        named = saved(named, "dup-named")
        main = named.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        big = texts.where("blocks > 1").join(named.select(F.col("node").alias("doc_id"), "label"), "doc_id").join(few(main), "root")
        big = saved(big, "dup-large")
        loose = big.where("label <> main")
        parts = few(loose.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts")))
        kind = "root long, i int, j int, doc_id long, label long, text string, side boolean"
        ones = loose.join(parts, "root").select("root", scatter(F.col("parts"), 5).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "doc_id", "label", "text", F.lit(True).alias("side"))
        others = big.join(parts, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), scatter(F.col("blocks"), 3).alias("j"), "doc_id", "label", "text", F.lit(False).alias("side"))

        def across(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values(["side", "doc_id"], kind="stable")
            out = link(b["doc_id"].to_numpy(dtype=np.int64), b["label"].to_numpy(dtype=np.int64), b["text"].tolist(), b["side"].to_numpy(dtype=bool), width, percent, matches, Shingler(width))
            return pd.DataFrame(list(out), columns=["a", "b"], dtype="int64")

        more = ones.unionByName(others).select(*[x.split()[0] for x in kind.split(", ")]).groupBy("root", "i", "j").applyInPandas(across, "a long, b long")
        every = components(links.unionByName(more))
        labels = every.where("node <> root").select("node", F.col("root").alias("label"))

    # classes that have more than one member or a link, back to all documents
    named = classes.join(labels, "node", "left").where("members > 1 or label is not null").select("k1", "k2", F.coalesce("label", "node").alias("label"))
    out = all_docs.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    lost = docs.where(F.col(doc_id).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(lost).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
