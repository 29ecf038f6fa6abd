"""Benchmark decontamination: test items whose word shingles a document contains, by MinHash containment search.

Words are runs of letters and digits of the lower-cased text, shingles are SHINGLE words. Items are partitioned by
their number of distinct shingles into classes that double in size. In a class of items of up to u shingles, an
item's sketch is its ``floor((1 - THRESHOLD) * u) + 1 + SPARE`` shingles of least hash. A document that contains
THRESHOLD of the item lacks at most ``floor((1 - THRESHOLD) * n)`` of its n shingles, so it holds at least the
sketch's size less that number of sketch values: this many hits make a candidate, and none is missed, however long
the document. Candidates are then verified by exact containment of the shingles as text.

Rows of items are numbered, and all search is by that number, so null or repeated item ids are like any other. While
the items are at most INDEX_ITEMS with INDEX_BYTES of text, their index goes to every task, and documents are searched
where they are read, without a shuffle. Beyond that bound the documents' shingle hashes are joined with the sketches,
with the same rows as result; only hashes that a bitmap of the sketches (FILTER_BITS at most) lets pass are shuffled.

Defined results: items and documents of fewer than SHINGLE words match nothing; null texts are empty; rows of equal
texts or ids each give their own matches, as documents and as items; a null item_id is told as null. Only keys, text
and item_id are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, nullable_text, ship, spread_join

SHINGLE, THRESHOLD, SPARE = 5, 0.8, 7
INDEX_ITEMS, INDEX_BYTES = 20_000, 8_000_000
#: Bits of a sketch value that the bitmap looks at, and those of its number of blocks: 32 MB in 256 blocks at most.
FILTER_BITS, FILTER_BLOCKS = 28, 8
WORD = re.compile(r"[^\W_]+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of every shingle of word codes; 0 if a word has code 0."""
    n = len(codes) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(SHINGLE):
        part = codes[i : i + n]
        h += part * _FACTORS[i]
        known &= part != 0
    h ^= h >> np.uint64(31)
    h *= _FACTORS[3]
    h ^= h >> np.uint64(29)
    return np.where(known, h | np.uint64(1), np.uint64(0))


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 7) | 1


def _shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def sketch(words: list[str], threshold: float = THRESHOLD) -> tuple[int, int, np.ndarray]:
    """Distinct shingles, hits that make a candidate, and the sketch."""
    h = np.unique(_hashes(np.array([_code(w) for w in words], np.uint64)))
    n = len(h)
    if not n:
        return 0, 0, h
    upper = 1 << (n - 1).bit_length()
    lacking = math.floor((1 - threshold) * n + 1e-9)
    size = min(n, math.floor((1 - threshold) * upper + 1e-9) + 1 + SPARE)
    return n, size - lacking, h[:size]


class Index:
    """Sketches of a bounded set of items (number, text) as sorted arrays, and their texts for verification."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold, self.codes, self.items = threshold, {}, []
        hashes, owners = [], []
        for number, text in items:
            words = words_of(text)
            n, hits, sketched = sketch(words, threshold)
            if not n:
                continue
            self.codes.update((w, _code(w)) for w in words)
            hashes.append(sketched)
            owners.append(np.full(len(sketched), len(self.items), np.int32))
            self.items.append((number, hits, n, text))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.first = np.unique(h[order], return_index=True)
        self.owners, self.first = np.concatenate([np.zeros(0, np.int32), *owners])[order], np.append(self.first, len(h))

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(number, shingles, shingles found) of the items that the text contains."""
        words = words_of(text)
        if len(words) < SHINGLE or not len(self.hashes):
            return []
        h = _hashes(np.fromiter(map(self.codes.get, words, repeat(0)), np.uint64, len(words)))
        h = np.unique(h[h != 0])
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        met = at[self.hashes[at] == h]
        if not len(met):
            return []
        hits = np.bincount(np.concatenate([self.owners[self.first[i] : self.first[i + 1]] for i in met]))
        there, found = None, []
        for i in np.flatnonzero(hits).tolist():
            number, least, n, item = self.items[i]
            if hits[i] >= least:
                there = there or set(_shingles(words))
                got = contained(item, there)
                if got >= self.threshold * n - 1e-9:
                    found.append((number, n, got))
        return found


def contained(item: str, there: set[str]) -> int:
    """How many of the distinct shingles of an item are there."""
    return len(there.intersection(_shingles(words_of(item))))


def _told(batch: pa.RecordBatch, found: list[tuple], kept: list[str]) -> pa.RecordBatch:
    """The columns ``kept`` of the rows that ``found`` names by position, and what it has of them."""
    at = pa.array([f[0] for f in found], pa.int64())
    columns = [batch.column(c).take(at) for c in kept] + [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3)]
    return pa.record_batch(columns, names=[*kept, "item", "n_shingles", "n_found"])


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, keys: tuple[str, ...] = ("doc_id",), max_items: int = INDEX_ITEMS, max_bytes: int = INDEX_BYTES) -> DataFrame:
    """keys, item_id, n_shingles, n_found and containment of every pair of a row and an item row that it contains."""
    spark = docs.sparkSession
    ship(spark)
    items = durable(items.select(F.col("item_id").cast("long").alias("item_id"), nullable_text().alias("text")).withColumn("item", F.monotonically_increasing_id()))
    rows = docs.select(F.struct(*(F.col(f"`{k}`") for k in keys)).alias("key"), nullable_text().alias("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    few = n <= max_items and size <= max_bytes
    found = _search(rows, items, threshold) if few else _join(rows, items, threshold)
    names = items.select("item", "item_id")
    found = found.join(F.broadcast(names) if few else names, "item")
    return found.select("key.*", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def _kinds(rows: DataFrame) -> T.StructType:
    longs = [T.StructField(c, T.LongType()) for c in ("item", "n_shingles", "n_found")]
    return T.StructType([rows.schema["key"], *longs])


def _search(rows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    index = rows.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.select("item", "text").collect()], threshold))  # bounded by matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            yield _told(batch, [(i, *m) for i in range(len(texts)) for m in index.value.search(texts[i].as_py())], ["key"])

    return rows.mapInArrow(run, _kinds(rows))


def _distinct_hashes(text: str) -> np.ndarray:
    return np.unique(_hashes(np.array([_code(w) for w in words_of(text)], np.uint64)))


def _bitmap(sketches: DataFrame, bits: int) -> np.ndarray:
    """One byte per eight values of the first ``bits`` bits of a hash; of bounded size, made block by block."""
    blocks, size = 1 << min(FILTER_BLOCKS, bits - 3), 1 << max(0, bits - 3 - FILTER_BLOCKS)

    def block(t: pa.Table) -> pa.Table:
        flags = np.zeros(size * 8, bool)
        flags[t["bit"].to_numpy() - t["block"][0].as_py() * size * 8] = True
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int64()), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    out = np.zeros(blocks * size, np.uint8)
    bit = F.shiftrightunsigned("hash", 64 - bits)
    dealt = sketches.select(bit.alias("bit")).distinct().select("bit", F.floor(F.col("bit") / (size * 8)).alias("block"))
    for at, got in dealt.groupBy("block").applyInArrow(block, "block long, bits binary").toLocalIterator():  # 1 << FILTER_BLOCKS rows, 32 MB in all at most
        out[at * size : (at + 1) * size] = np.frombuffer(got, np.uint8)
    return out


def _join(rows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sketch(words_of(t), threshold) for t in b["text"].to_pylist()]
            of = np.repeat(np.arange(len(got)), [len(s) for _, _, s in got])
            values = np.concatenate([np.zeros(0, np.uint64), *(s for _, _, s in got)]).view(np.int64)
            yield pa.record_batch([b["item"].take(pa.array(of)), pa.array(np.array([g[1] for g in got], np.int64)[of]), pa.array(values)], names=["item", "hits", "hash"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (doc, item) in enumerate(zip(b["text"].to_pylist(), b["item_text"].to_pylist())):
                n = len(set(_shingles(words_of(item))))
                got = contained(item, set(_shingles(words_of(doc))))
                if got >= threshold * n - 1e-9:
                    out.append((i, b["item"][i].as_py(), n, got))
            yield _told(b, out, ["key"])

    sketches = durable(items.select("item", "text").mapInArrow(sketched, "item long, hits long, hash long"))
    count = sketches.count()
    bits = min(FILTER_BITS, max(FILTER_BLOCKS + 3, (8 * count).bit_length()))
    passing = rows.sparkSession.sparkContext.broadcast(_bitmap(sketches, bits))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, text in zip(b["text_id"].to_pylist(), b["text"].to_pylist()):
                h = _distinct_hashes(text)
                bit = h >> np.uint64(64 - bits)
                h = h[passing.value[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                yield pa.record_batch([pa.array(np.full(len(h), number)), pa.array(h.view(np.int64))], names=["text_id", "hash"])

    # equal texts are one here; should two texts share an id, their candidates are verified for both
    text_id = F.xxhash64("text").alias("text_id")
    hashes = durable(rows.select(text_id, "text").mapInArrow(hashed, "text_id long, hash long").distinct())
    often = durable(hashes.groupBy("hash").agg(F.count("*").alias("n")))
    met = spread_join(hashes, durable(sketches.join(often, "hash")), ["hash"], "n", hashes.count())
    pairs = durable(met.groupBy("text_id", "item", "hits").agg(F.count("*").alias("k")).where("k >= hits").select("text_id", "item"))
    texts = pairs.join(items.select("item", F.col("text").alias("item_text")), "item")
    asked = rows.select("key", "text", text_id)
    few = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()
    texts = F.broadcast(texts) if few[0] <= INDEX_ITEMS and few[1] <= INDEX_BYTES else texts
    return asked.join(texts, "text_id").select("key", "text", "item", "item_text").mapInArrow(verified, _kinds(rows))
