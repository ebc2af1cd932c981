"""Token counts with the tokenizer libraries, in Arrow functions that return lengths only.

Texts are split at safe boundaries into units (white space with the word after it), and each
distinct unit is encoded once per worker: units go to the library in batches of about equal bytes.
A boundary is safe if a visible character stands before it and a blank, tab or line end after it:
none of the supported pre-tokenizers joins those two, so that counts add up. After any other white
space a unit goes on to the next word. Vocabularies whose counts don't add up get whole texts.

Cases: null and empty texts have 0 tokens; whole texts are counted, whatever their length; special
strings inside a text are handled as the library does by default; repeated rows get equal counts; an
empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text per call of the library, about.
BATCH_BYTES = 1 << 20
#: Distinct units that a worker remembers; then it starts afresh.
CACHE_UNITS = 500_000
#: White space that pre-tokenizers may join with what follows it (class body).
OTHER = "\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿"
UNIT = re.compile(rf"[ \t\n\r]*[^ \t\n\r]+(?:(?<=[{OTHER}])[ \t\n\r]+[^ \t\n\r]*)*|[ \t\n\r]+")


def encoder(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """Lengths of a list of texts, and whether counts of units add up for this vocabulary file."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        kind = type(own.pre_tokenizer).__name__
        return lambda texts: [len(e) for e in own.encode_batch(texts, add_special_tokens=False)], kind == "ByteLevel" and own.normalizer is None
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)], False


def utf8(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Slices of ``texts`` with about equal bytes."""
    batch, held = [], 0
    for t in texts:
        batch.append(t)
        held += utf8(t)
        if held >= limit:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


class Counter:
    """Counts for one worker: the library, and what it said of the units met so far."""

    def __init__(self, path: str) -> None:
        self.lengths, self.splits = encoder(path)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        out, whole = [0] * len(texts), []
        for group in self.rows_by_bytes(texts):
            units = {}
            for i in group:
                if not self.splits:
                    whole.append(i)
                else:
                    units[i] = UNIT.findall(texts[i])
            if len(self.known) > CACHE_UNITS:
                self.known.clear()
            unseen = list({u for own in units.values() for u in own if u not in self.known})
            for batch in by_bytes(unseen):
                self.known.update(zip(batch, self.lengths(batch), strict=True))
            for i, own in units.items():
                out[i] = sum(map(self.known.__getitem__, own))
        at = iter(whole)
        for batch in by_bytes([texts[i] for i in whole]):
            for n in self.lengths(batch):
                out[next(at)] = n
        return out

    @staticmethod
    def rows_by_bytes(texts: list[str | None]) -> Iterator[list[int]]:
        group, held = [], 0
        for i, t in enumerate(texts):
            if t:
                group.append(i)
                held += utf8(t)
                if held >= 4 * BATCH_BYTES:
                    yield group
                    group, held = [], 0
        if group:
            yield group


def token_count(text: Column, path: str) -> Column:
    """Tokens of every text by the vocabulary file at ``path``, which must exist on every machine."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Counter(path)
        for texts in batches:
            yield pa.array(own.count(texts.to_pylist()), pa.int64())

    return count(text)
