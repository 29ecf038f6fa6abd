"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A pre-token starts as one symbol per byte. Its adjacent pairs wait in a heap by rank; the lowest is
popped, merged in the linked list of symbols, and its new neighbours are pushed. The count is the number
of initial symbols minus the merges. That takes n log n steps for a pre-token of n bytes, so a text of
one endless word costs no more than others. Pre-tokens repeat, so their counts are kept in a bounded
cache of each worker process.

Defined results: null text counts as empty, with zero bytes and tokens; repeated rows and null ids are
scored like any other; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenfiles
from .common import nullable_text, ship

#: Pre-tokens of the word-level vocabulary. The alternatives begin with different characters, but for
#: the contractions, which go before other runs of symbols.
PIECES = regex.compile(r"\p{L}+|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+")
#: The same with the faster standard module, for texts in which both agree on every character.
FAST_PIECES = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+")
#: Characters that the two modules put in different classes, and all that were not looked into.
UNSURE = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏΑ-ώА-я]")


def merged_length(symbols: list[str], ranks: dict) -> int:
    """The number of symbols left when no adjacent pair has a rank any more."""
    n = len(symbols)
    if n < 2:
        return n
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue  # one of the two was merged since
        symbols[i], symbols[j] = a + b, ""
        after[i] = k = after[j]
        left -= 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return left


#: Characters of a pre-token that the cache may keep, so that it is bounded by bytes too.
CACHED = 64


@functools.lru_cache(400_000)
def piece_tokens(piece: str, file: str) -> int:
    ranks, alphabet, suffix, _ = tokenfiles.merges(file)
    symbols = [alphabet[b] for b in piece.encode()]
    symbols[-1] += suffix
    return merged_length(symbols, ranks)


@functools.lru_cache(2)
def _specials(file: str):
    return re.compile("|".join(map(re.escape, tokenfiles.merges(file)[3])) or r"(?!)")


def count_tokens(text: str, file: str) -> int:
    """Tokens of a text: composed characters, lower case, white space dropped; special strings are one token each."""
    specials = _specials(file)
    found = 0
    if "<|" in text:
        parts = specials.split(text)
        found = len(parts) - 1
        if found:
            return found + sum(count_tokens(p, file) for p in parts)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case of single characters: no final sigma
    pattern = PIECES if UNSURE.search(text) else FAST_PIECES
    return sum([piece_tokens(p, file) if len(p) <= CACHED else piece_tokens.__wrapped__(p, file) for p in pattern.findall(text.lower())])


def _count(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                "n_tokens": pa.array([count_tokens(t, file) for t in texts.to_pylist()], pa.int64()),
            })

    return run


def token_counts(docs: DataFrame, limit: int = 2048, vocabulary: str = "word_bpe_49k.json", folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row. No shuffle."""
    ship(docs.sparkSession)
    file = tokenfiles.path(vocabulary, folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), nullable_text().alias("text"))
    return rows.mapInArrow(_count(file), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
