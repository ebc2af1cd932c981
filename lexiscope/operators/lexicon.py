"""Lexicon matching and detection (J-01, D-01 to D-03, D-17)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.text import literal, tokens

RULE_COLUMNS = ("rule_no", "biased", "neutral_primary", "severity", "stereotype_category")

#: Terms up to which a lexicon becomes literals, and bytes up to which it becomes a trie on every worker.
SMALL_TERMS, LEXICON_BYTES = 64, 64 << 20
#: Bytes of a term in a trie beside its text, generously.
TERM_BYTES = 400
#: Bytes of the bitmap, at most, that keeps runs of words out of the join with a larger lexicon, and of a part of it.
BITMAP_BYTES, BLOCK_BYTES = 64 << 20, 1 << 16
#: Pairs of text and term after which a task passes its terms on, and characters of texts that are searched at once (one text at least).
PAIRS, CHARACTERS = 1 << 18, 1 << 20
#: Odd numbers for hashes of 64 bits: a place's factor and its inverse, and one to mix bits.
FACTOR, INVERSE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), np.uint64(0xBF58476D1CE4E5B9)
#: The words of ``tokens`` in Python, and words and what stands between them in turn.
WORD, WORD_OR_NOT = re.compile(r"\w+"), re.compile(r"\w+|\W+")


def word_pattern(term: Column) -> Column:
    """Matches the term as whole words, ignoring case, in Unicode."""
    return F.concat(F.lit(r"(?iuU)\b"), literal(term), F.lit(r"\b"))


def matches(docs: DataFrame, lexicon: DataFrame, doc_id: str = "doc_id", text: str = "text", small: int = SMALL_TERMS, lexicon_bytes: int = LEXICON_BYTES) -> DataFrame:
    """J-01: (doc_id, rule columns) for every rule whose term occurs in a text as whole words, ignoring case.

    The theta join never compares texts with rules one by one. A lexicon of few terms becomes literals: texts keep
    what of their tokens it holds before anything is exploded, phrases are patterns compiled once. A larger one, up to
    ``lexicon_bytes``, becomes a trie of words that Arrow functions walk along each text. Beyond that runs of a text's words
    meet the terms by an equi join. The lexicon is read more than once: save it if it is costly.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("m_text"))
    if (terms := few_terms(lexicon, small)) is not None:
        return literal_matches(source, lexicon, terms)
    met = term_matches(source, lexicon, lexicon_bytes)
    rows = spread(met.where("m_bare"), lexicon)
    return rows.unionByName(odd_matches(met, source, lexicon)) if has_odd(lexicon) else rows


def few_terms(lexicon: DataFrame, small: int) -> list[str] | None:
    """The distinct terms of a lexicon of at most ``small`` rules."""
    few = [r["biased"] for r in lexicon.select("biased").limit(small + 1).collect()]
    return sorted({t for t in few if t}) if len(few) <= small else None


def literal_matches(source: DataFrame, lexicon: DataFrame, terms: list[str]) -> DataFrame:
    """Rules of a few terms, known here, in texts (doc_id, m_text)."""
    words = tokens(F.col("biased"))
    rules = lexicon.withColumn("m_key", F.when(F.size(words) == 1, F.get(words, F.lit(0))).when(F.size(words) > 1, F.concat(F.lit(" "), "biased")))
    found = [[w for w in WORD.findall(t.lower())] for t in terms]
    single = sorted({w[0] for w in found if len(w) == 1})
    phrases = [t for t, w in zip(terms, found, strict=True) if len(w) > 1]
    hits = [F.array_intersect(tokens(F.col("m_text")), F.array(*[F.lit(w) for w in single]))] if single else []
    if phrases:
        quoted = lambda t: r"(?iuU)\b\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E\b"
        hits.append(F.filter(F.array(*[F.when(F.col("m_text").rlike(quoted(t)), F.lit(f" {t}")) for t in phrases]), lambda t: t.isNotNull()))
    if not hits:
        return source.where("false").join(rules, F.lit(True)).select("doc_id", *lexicon.columns)
    # outer: Spark would else infer a filter on the array and compute it twice
    met = source.select("doc_id", F.explode_outer(F.concat(*hits) if len(hits) > 1 else hits[0]).alias("m_key"))
    return met.join(rules, "m_key").select("doc_id", *lexicon.columns)


def trie_of(terms: list[str]) -> dict:
    """Nested words and what stands between them, in turn; a term's last node holds it under None."""
    root: dict = {}
    for term in terms:
        words = list(WORD.finditer(term.lower()))
        node = root
        for k, m in enumerate(words):
            if k:
                node = node.setdefault(m.string[words[k - 1].end() : m.start()], {})
            node = node.setdefault(m[0], {})
        if words:
            node.setdefault(None, []).append(term)
    return root


def walked(text: str, root: dict) -> set[str]:
    """Terms of the trie in a lower-cased text."""
    parts = WORD_OR_NOT.findall(text)
    found: set[str] = set()
    for i, part in enumerate(parts):
        node = root.get(part)
        j = i + 1
        while node is not None:
            if None in node:
                if j == i + 1 or (i == 0 or not is_mark(parts[i - 1][-1])) and (j == len(parts) or not is_mark(parts[j][0])):
                    found.update(node[None])
            if j == len(parts):
                break
            node = node.get(parts[j])
            j += 1
    return found


def is_mark(character: str) -> bool:
    """Characters beside a phrase that patterns take as part of its word, though tokens don't."""
    return unicodedata.category(character)[0] == "M" or character in "\u200c\u200d"


def is_bare(term: Column) -> Column:
    """A term whose ends are words; any other is verified in the text again."""
    return F.coalesce(term.rlike(r"^[\p{L}\p{N}_].*[\p{L}\p{N}_]$") | (F.size(tokens(term)) == 1), F.lit(False))


def has_odd(lexicon: DataFrame) -> bool:
    return not lexicon.where(~is_bare(F.col("biased")) & (F.col("biased") != "")).isEmpty()


def spread(met: DataFrame, lexicon: DataFrame) -> DataFrame:
    """A row (doc_id, rule columns) for each text of each rule of ``term_matches``."""
    return met.select(F.explode("m_docs").alias("doc_id"), *lexicon.columns)


def odd_matches(met: DataFrame, source: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rules whose ends aren't words in the texts that have their words in a row, where a pattern finds them."""
    odd = spread(met.where("not m_bare"), lexicon).join(source, "doc_id").where(F.regexp_instr("m_text", word_pattern(F.col("biased"))) > 0)
    return odd.select("doc_id", *lexicon.columns)


def term_matches(source: DataFrame, lexicon: DataFrame, lexicon_bytes: int) -> DataFrame:
    """(m_batch, m_docs, m_bare, rule columns): rules and the texts (doc_id, m_text) of a batch that have their words in a row."""
    size = lexicon.agg(F.sum(F.octet_length("biased") + TERM_BYTES).alias("b")).first()["b"] or 0
    met, key = trie_terms(source, lexicon) if size <= lexicon_bytes else run_terms(source, lexicon)
    rules = lexicon.withColumn("m_bare", is_bare(F.col("biased"))).withColumn("m_key", key)
    return met.join(rules, F.col("m_term") == F.col("m_key")).select("m_batch", "m_docs", "m_bare", *lexicon.columns)


def by_term(source: DataFrame, finder: Callable[[], Callable[[list], Iterator[tuple[int, str]]]]) -> DataFrame:
    """(m_batch, m_term, m_docs): terms in lower-cased texts, each once for a batch of texts, with the texts that have it.

    So a frequent term's text and rule are shuffled once a batch, not once a text. ``finder`` makes a worker's function
    from texts to (place, term), the places of one term ascending.
    """
    kind, most_pairs = source.schema["doc_id"].dataType.simpleString(), PAIRS

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        number = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        found: dict[str, list[int]] = {}
        before = pairs = 0

        def passed() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, found.values())], dtype=np.int32)
            places = np.fromiter(chain.from_iterable(found.values()), np.int64, ends[-1])
            docs = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(ids).take(pa.array(places)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), number)), pa.array(list(found), pa.string()), docs], names=["m_batch", "m_term", "m_docs"])

        for batch in batches:
            for part in text_parts(batch):
                ids.append(part.column(0))
                for place, term in find(part.column(1).to_pylist()):
                    place += before
                    places = found.get(term)
                    if places is None:
                        found[term] = [place]
                    elif places[-1] != place:
                        places.append(place)
                    else:
                        continue
                    pairs += 1
                before += len(part)
                if pairs >= most_pairs:
                    yield passed()
                    ids, found, before, pairs, number = [], {}, 0, 0, number + 1
        if found:
            yield passed()

    return source.select("doc_id", F.lower("m_text").alias("m_text")).mapInArrow(own, f"m_batch long, m_term string, m_docs array<{kind}>")


def text_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, texts of about ``CHARACTERS`` at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + CHARACTERS, "right")))
        yield batch.slice(start, end - start)
        start = end


def trie_terms(source: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, Column]:
    """Terms in texts by a trie of all terms, which the workers get once, and what of a rule meets them."""
    terms = [r["biased"] for r in lexicon.where(F.col("biased").isNotNull()).select("biased").distinct().collect()]
    known = source.sparkSession.sparkContext.broadcast(terms)

    def finder():
        root = trie_of(known.value)
        return lambda texts: ((k, term) for k, text in enumerate(texts) if text for term in walked(text, root))

    return by_term(source, finder), F.col("biased")


@cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is of a word, and whether it is a mark (``is_mark``)."""
    word, every = np.zeros(0x110000, bool), "".join(map(chr, range(0x110000)))
    for m in WORD.finditer(every):
        word[m.start() : m.end()] = True
    mark = np.fromiter((c[0] == "M" for c in map(unicodedata.category, every)), bool, len(every))
    mark[[0x200C, 0x200D]] = True
    return word, mark


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Words:
    """The words of some texts: what they are in one string, where they start and end there, and which text they are of."""

    def __init__(self, texts: list[str | None]):
        self.texts = "\n" + "\n".join(t or "" for t in texts) + "\n"
        self.codes = code_points(self.texts)
        edges = np.flatnonzero(np.diff(classes()[0][self.codes])) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.text_of = np.searchsorted(np.cumsum([1, *(len(t or "") + 1 for t in texts)]), self.starts, "right") - 1


def hashed(codes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from starts and ends to hashes of what stands between them, by a running sum over the code points."""
    mixed = codes * MIX
    mixed ^= mixed >> np.uint64(31)
    powers = lambda base, n: np.cumprod(np.append(np.uint64(1), np.full(n, base)))
    sums, back = np.append(np.uint64(0), np.cumsum(mixed * MIX * powers(FACTOR, len(codes))[:-1])), powers(INVERSE, len(codes))

    def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = (sums[ends] - sums[starts]) * back[starts]
        out ^= out >> np.uint64(32)
        out *= MIX
        return out ^ (out >> np.uint64(29))

    return of


def bit_of(hashes: np.ndarray, size: int, second: bool) -> np.ndarray:
    """The first or second place of each hash among the bits of ``size`` bytes."""
    return ((hashes >> np.uint64(29)) * FACTOR if second else hashes) % np.uint64(8 * size)


def bitmap_of(cores: DataFrame, size: int) -> bytes:
    """Two bits for the hash of each ``core``, among those of ``size`` bytes; made in parts, which the driver puts together."""
    block = min(size, BLOCK_BYTES)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(0).to_pylist()
            ends = np.cumsum([0, *map(len, terms)])
            hashes = hashed(code_points("".join(terms)))(ends[:-1], ends[1:])
            both = np.unique(np.concatenate([bit_of(hashes, size, second) for second in (False, True)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both // (8 * block)), pa.array(both % (8 * block), pa.int32())], names=["block", "p"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            own, p = (c.to_numpy() for c in batch.columns)
            order = np.argsort(own, kind="stable")
            numbers, starts = np.unique(own[order], return_index=True)
            for n, at in zip(numbers.tolist(), np.split(order, starts[1:]), strict=True):
                np.bitwise_or.at(made.setdefault(n, np.zeros(block, np.uint8)), p[at] >> 3, np.left_shift(1, p[at] & 7).astype(np.uint8))
        for n, bits in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([bits.tobytes()])], names=["block", "bits"])

    parts = cores.select("core").mapInArrow(places, "block long, p int").repartition("block").mapInArrow(blocks, "block long, bits binary")
    out = bytearray(size)
    for row in parts.collect():
        out[row["block"] * block : (row["block"] + 1) * block] = row["bits"]
    return bytes(out)


def runs_met(texts: list[str | None], most: int, bits: bytes) -> Iterator[tuple[int, str]]:
    """(place of the text, run): runs of one to ``most`` words of lower-cased texts, with what stands between them, whose bits are there."""
    words = Words(texts)
    hash_of, filled, mark = hashed(words.codes), np.frombuffer(bits, np.uint8), classes()[1]
    for k in range(1, most + 1):
        n = max(len(words.starts) - k + 1, 0)
        at = np.flatnonzero(words.text_of[:n] == words.text_of[k - 1 :])
        if not len(at):
            return
        hashes = hash_of(words.starts[at], words.ends[at + k - 1])
        for second in (False, True):
            own = bit_of(hashes, len(bits), second)
            has = filled[own >> np.uint64(3)] >> (own & np.uint64(7)).astype(np.uint8) & 1 == 1
            at, hashes = at[has], hashes[has]
        starts, ends = words.starts[at], words.ends[at + k - 1]
        free = ~(mark[words.codes[starts - 1]] | mark[words.codes[ends]]) if k > 1 else slice(None)
        for place, start, end in zip(words.text_of[at][free].tolist(), starts[free].tolist(), ends[free].tolist(), strict=True):
            yield place, words.texts[start:end]


def grams(text: str, most: int, bits: bytes) -> set[str]:
    """The runs of one lower-cased text."""
    return {run for _, run in runs_met([text], most, bits)}


def run_terms(source: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, Column]:
    """Runs of words in texts that may be terms, and what of a rule meets them.

    A bitmap of the terms' hashes, bounded in bytes, keeps most runs that are no term out of the join.
    """
    core = F.nullif(F.regexp_extract(F.lower("biased"), r"(?s)[\p{L}\p{N}_](?:.*[\p{L}\p{N}_])?", 0), F.lit(""))
    rules = lexicon.select("biased", core.alias("core")).where("core is not null")
    facts = rules.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(tokens(F.col("biased")))).alias("most")).first()
    size = min(BITMAP_BYTES, 1 << max(10, (4 * facts["n"]).bit_length()))
    known = source.sparkSession.sparkContext.broadcast(bitmap_of(rules, size))
    most = facts["most"] or 0

    def finder():
        bits = known.value
        return lambda texts: runs_met(texts, most, bits)

    return by_term(source, finder), core


def detection(docs: DataFrame, lexicon: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: bool = True, small: int = SMALL_TERMS, lexicon_bytes: int = LEXICON_BYTES) -> DataFrame:
    """D-01 to D-03: per document its replace and warn edits in rule order, has_bias and primary category.

    Without ``edits`` the same, but for the lists of edits: then no row for each match is shuffled.
    """
    if not edits:
        by_doc = detected(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("m_text")), lexicon, small, lexicon_bytes)
        out = docs.select(F.col(doc_id).alias("doc_id")).join(by_doc, "doc_id", "left")
        return out.withColumn("n_replace", F.coalesce("n_replace", F.lit(0))).withColumn("n_warn", F.coalesce("n_warn", F.lit(0))).withColumn("has_bias", F.col("n_replace") > 0)
    found = matches(docs, lexicon, doc_id, text, small, lexicon_bytes).where("biased <> neutral_primary")
    edit = F.struct("rule_no", F.col("biased").alias("from"), F.col("neutral_primary").alias("to"), "severity", "stereotype_category")
    replace = F.col("severity") != "warn"
    by_doc = found.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(replace, edit))).alias("replace_edits"),
        F.array_sort(F.collect_list(F.when(~replace, edit))).alias("warn_edits"),
        F.min_by(F.when(replace, F.col("stereotype_category")), F.when(replace, F.col("rule_no"))).alias("primary_category"),
    )
    out = docs.select(F.col(doc_id).alias("doc_id")).join(by_doc, "doc_id", "left")
    return out.withColumn("n_replace", F.coalesce(F.size("replace_edits"), F.lit(0))).withColumn("n_warn", F.coalesce(F.size("warn_edits"), F.lit(0))).withColumn("has_bias", F.col("n_replace") > 0)


def detected(source: DataFrame, lexicon: DataFrame, small: int, lexicon_bytes: int) -> DataFrame:
    """(doc_id, primary_category, n_replace, n_warn) of the texts (doc_id, m_text) that have an edit.

    Most matches are of single words. Rules of such, as many as ``lexicon_bytes`` hold, are counted where the texts are
    read; the others meet their rules by batches of texts, and are counted batch by batch.
    """
    replace, columns = F.col("severity") != "warn", ("rule_no", "stereotype_category")
    counts = [is_kind.cast("int").cast("long").alias(c) for is_kind, c in ((replace, "n_replace"), (~replace, "n_warn"))]
    counted = lambda rows, *own: rows.select(*own, *counts, *[F.when(replace, F.col(c)).alias(c) for c in columns])
    first = F.min(F.when(F.col("rule_no").isNotNull(), F.struct(*columns)))
    rules = lexicon.where("biased <> neutral_primary and severity is not null")
    if (terms := few_terms(rules, small)) is not None:
        parts = counted(literal_matches(source, rules, terms), "doc_id")
    else:
        kinds = {f.name: f.dataType.simpleString() for f in (source.schema["doc_id"], *(rules.schema[c] for c in columns))}
        schema = ", ".join((f"doc_id {kinds['doc_id']}, n_replace long, n_warn long", *(f"{c} {kinds[c]}" for c in columns)))
        is_word = held_words(rules, lexicon_bytes)
        words, others = rules.where(is_word), rules.where(~is_word)
        known = counted(words, F.lower("biased").alias("word")).groupBy("word").agg(F.sum("n_replace").alias("n_replace"), F.sum("n_warn").alias("n_warn"), first.alias("first"))
        parts = word_counts(source, known.select("word", "n_replace", "n_warn", "first.*"), schema)
        if not others.isEmpty():
            met = term_matches(source, others, lexicon_bytes)
            parts = parts.unionByName(counted(met.where("m_bare"), "m_batch", "m_docs").groupBy("m_batch").applyInArrow(batch_counts, schema))
            if has_odd(others):
                parts = parts.unionByName(counted(odd_matches(met, source, others), "doc_id"))
    sums = [F.sum(c).cast("int").alias(c) for c in ("n_replace", "n_warn")]
    return parts.groupBy("doc_id").agg(first["stereotype_category"].alias("primary_category"), *sums)


def held_words(lexicon: DataFrame, most_bytes: int) -> Column:
    """Terms of one word, the shorter ones where not all of them fit, that take ``most_bytes`` at most."""
    is_word = F.coalesce(F.lower("biased").rlike(r"^[\p{L}\p{N}_]+\z"), F.lit(False))
    sizes = lexicon.where(is_word).groupBy(F.length("biased").alias("n")).agg(F.sum(F.octet_length("biased") + TERM_BYTES).alias("b")).orderBy("n").collect()
    fit = np.cumsum([r["b"] for r in sizes]) <= most_bytes
    return is_word & (F.length("biased") <= max((r["n"] for r, fits in zip(sizes, fit, strict=True) if fits), default=0))


class Numbers(dict):
    """Numbers of words; -1 for any other."""

    def __missing__(self, word: str) -> int:
        return -1


def word_counts(source: DataFrame, words: DataFrame, schema: str) -> DataFrame:
    """Each text's edits of both kinds, and its first rule that replaces, by words (word, n_replace, n_warn, rule_no, stereotype_category) that the workers get once."""
    known = source.sparkSession.sparkContext.broadcast(words.toArrow())

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = known.value.combine_chunks()
        numbers, order = Numbers((w, i) for i, w in enumerate(rules["word"].to_pylist())), in_rule_order(rules)
        for batch in batches:
            for part in text_parts(batch):
                found = Words(part.column(1).to_pylist())
                spans = zip(found.starts.tolist(), found.ends.tolist(), strict=True)
                rule = np.fromiter((numbers[found.texts[start:end]] for start, end in spans), np.int64, len(found.starts))
                once = np.unique(found.text_of[rule >= 0] * len(rules) + rule[rule >= 0])
                places, text = np.unique(once // max(len(rules), 1), return_inverse=True)
                yield from text_counts(part.column(0).take(pa.array(places)), text, once % max(len(rules), 1), rules, order).to_batches()

    return source.select("doc_id", F.lower("m_text").alias("m_text")).mapInArrow(own, schema)


def batch_counts(rows: pa.Table) -> pa.Table:
    """Each text's edits of both kinds, and its first rule that replaces, by the rules (m_docs, n_replace, n_warn, rule_no, stereotype_category) of a batch."""
    rows = rows.combine_chunks()
    lists = rows["m_docs"].combine_chunks()
    docs = lists.flatten().dictionary_encode("encode")
    return text_counts(docs.dictionary, docs.indices.to_numpy(), np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy()), rows, in_rule_order(rows))


def in_rule_order(rules: pa.Table) -> np.ndarray:
    """The rows of rules by number and category."""
    keys = [("rule_no", "ascending"), ("stereotype_category", "ascending")]
    return pc.sort_indices(rules, sort_keys=keys, null_placement="at_start").to_numpy().astype(np.int64)


def text_counts(docs: pa.Array, doc: np.ndarray, rule: np.ndarray, rules: pa.Table, order: np.ndarray) -> pa.Table:
    """What texts have by pairs of a text and a rule's row; rules that don't replace have no number."""
    none = len(rules)
    rank = np.empty(none, np.int64)
    rank[order] = np.arange(none)
    rank[rules["rule_no"].is_null().to_numpy()] = none
    first = np.full(len(docs), none)
    np.minimum.at(first, doc, rank[rule])
    taken = pa.array(np.append(order, 0)[first], mask=first == none)
    counts = [pa.array(np.bincount(doc, rules[c].to_numpy()[rule], len(docs)).astype(np.int64)) for c in ("n_replace", "n_warn")]
    return pa.table([docs, *counts, rules["rule_no"].take(taken), rules["stereotype_category"].take(taken)], names=["doc_id", "n_replace", "n_warn", "rule_no", "stereotype_category"])
