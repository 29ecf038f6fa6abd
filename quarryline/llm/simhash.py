"""Near duplicates by SimHash: 64-bit fingerprints of word shingles, found by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within ``RADIUS`` bits have, by the pigeonhole
principle, one segment that differs in few bits (see ``BALLS``). Short segments have few rows to ask with and
crowded buckets, long ones the reverse; ``balls_for`` chooses by the number of fingerprints. Every fingerprint is a table row under
its own segments, and asks with every value in a small Hamming ball round each of them; what meets under
one value is compared in full. Rows of one bucket are linked by a spanning forest, so a dense bucket
costs about its size and gives fewer links than rows; a bucket over ``BLOCK`` rows is cut into blocks
and every pair of blocks is compared, so no task holds more than two blocks of one bucket. Documents that share a
fingerprint get its component by ``spread_join``, so a fingerprint of a third of all rows crowds no task.

Defined results: null text counts as empty; no words gives fingerprint 0, which links like any other;
rows with equal texts, or repeated ids, share a component; a null doc_id never becomes a component_id
unless no other row is in the component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, nullable_text, ship, spread_join

SHINGLE, RADIUS, SEED = 4, 4, 42
#: (shift, bits, radius) of each segment: 4 differing bits can't be 2, 2 and 1 or more at once.
BALLS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
#: For more fingerprints than MANY: 4 differing bits can't be 3 and 2 or more at once. A row asks 562 times instead of
#: 46, so it pays only once comparing with the rows of buckets of 21 bits costs more than that.
LONG_BALLS, MANY = ((0, 32, 2), (32, 32, 1)), 1 << 33
BLOCK = 4096
#: Rows that a task compares at once, and hot values that are few enough to be sent to all tasks.
ROWS_A_GROUP, BROADCAST_ROWS = 100_000, 10_000

_SPREAD = np.array([[v >> (7 - j) & 1 for j in range(8)] for v in range(256)], np.uint8).view(np.uint64).ravel()


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The uint64 fingerprint of each UTF-8 text."""
    digest, parts, counts = xxhash.xxh64_digest, [], []
    for text in texts:
        words = text.lower().split()  # bytes: lower-cases A-Z alone, splits at ASCII white space alone
        n = max(1, len(words) - shingle + 1) if words else 0
        if n > 1:
            line, ends, end = b" ".join(words), [], -1
            for w in words:
                end += len(w) + 1
                ends.append(end)
            begins = [0, *[e + 1 for e in ends[: n - 1]]]
            parts.extend([digest(line[i:j], SEED) for i, j in zip(begins, ends[shingle - 1 :])])
        elif n:
            parts.append(digest(b" ".join(words), SEED))
        counts.append(n)
    return majority(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 8), counts)


def majority(h: np.ndarray, counts: list[int]) -> np.ndarray:
    """The fingerprint of each run of so many hashes (rows of 8 bytes, the highest first): the bits set in over half of it."""
    out = np.zeros(len(counts), np.uint64)
    if not len(h):
        return out
    starts = (np.cumsum(counts) - counts).tolist()
    full = [i for i, n in enumerate(counts) if n]
    # 8 counters of 8 bits a word: sums of up to 255 rows can't carry over
    cuts = [c for i in full for c in range(starts[i], starts[i] + counts[i], 255)]
    lanes = np.add.reduceat(_SPREAD[h], cuts, axis=0).view(np.uint8).reshape(len(cuts), 64).astype(np.int64)
    pieces = [(counts[i] + 254) // 255 for i in full]
    sums = np.add.reduceat(lanes, np.concatenate([[0], np.cumsum(pieces)[:-1]]), axis=0)
    bits = sums * 2 > np.array([counts[i] for i in full])[:, None]
    out[full] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        found = [fingerprints_of(texts[i : i + 512]) for i in range(0, len(texts), 512)]
        fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fp.view(np.int64))})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), nullable_text().alias("text")).mapInArrow(
        _sign, "doc_id long, fp long"
    )


def ball(value, bits: int, radius: int) -> np.ndarray:
    """All values within ``radius`` bits of each value, the value itself first."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return value[:, None] ^ np.array(masks, np.int64)[None, :]


def balls_for(n: int) -> tuple[tuple[int, int, int], ...]:
    return BALLS if n <= MANY else LONG_BALLS


def _probe(balls: tuple[tuple[int, int, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for i in range(0, len(fps), 2000):
                fp = fps[i : i + 2000]
                for s, (shift, bits, radius) in enumerate(balls):
                    own = (fp.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
                    keys = ball(own, bits, radius)
                    table = np.zeros(keys.shape, bool)
                    table[:, 0] = True
                    yield pa.record_batch({"key": (keys | s << 32).ravel(), "fp": np.repeat(fp, keys.shape[1]), "own": table.ravel()})

    return run


def spanning(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links within RADIUS bits that join all of ``fp`` that such links can join, each as positions."""
    links, rest = [], np.arange(len(fp))
    front: list[int] = []
    while len(rest) or front:
        if not front:
            front, rest = [int(rest[0])], rest[1:]
        x = front.pop()
        near = np.bitwise_count(fp[rest] ^ fp[x]) <= RADIUS
        if near.any():
            got = rest[near]
            rest = rest[~near]
            links.extend((x, int(y)) for y in got)
            front.extend(got.tolist())
    return links


def links_within(key: np.ndarray, fp: np.ndarray, own: np.ndarray, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key, one of them a table row at least."""
    order = np.argsort(key, kind="stable")
    key, fp, own = key[order], fp[order].view(np.uint64), own[order]
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
    size = np.repeat(np.diff(edges), np.diff(edges))
    a, b = [], []
    few = np.flatnonzero((size > 1) & (size <= small))
    k, f, o = key[few], fp[few], own[few]
    for d in range(1, small):
        hit = np.flatnonzero((k[d:] == k[:-d]) & (o[d:] | o[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= RADIUS))
        a.append(f[hit])
        b.append(f[hit + d])
    for i, j in zip(edges[:-1], edges[1:]):
        if j - i > small and own[i:j].any():
            part = np.unique(fp[i:j])
            if found := spanning(part):
                x, y = np.array(found).T
                a.append(part[x])
                b.append(part[y])
    pair = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
    a, b = pair(a), pair(b)
    return a[a != b], b[a != b]


def _compare(batch: pa.Table) -> pa.Table:
    a, b = links_within(*(batch.column(c).to_numpy() for c in ("key", "fp", "own")))
    return pa.table({"a": a, "b": b})


def fingerprint_links(distinct: DataFrame, block: int | None = None, balls: tuple[tuple[int, int, int], ...] | None = None) -> DataFrame:
    """(a, b): links between different fingerprints, as many as their components need. distinct: fp, once each."""
    block = block or BLOCK
    spark = distinct.sparkSession
    ship(spark)
    n = distinct.count()
    balls = balls or balls_for(n)
    rows = distinct.select("fp").mapInArrow(_probe(balls), "key long, fp long, own boolean")
    total = n * sum(ball(np.zeros(1, np.int64), b, r).size for _, b, r in balls)
    segment = lambda s, shift, bits: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(s << 32))
    own = distinct.select(F.explode(F.array(*(segment(s, shift, bits) for s, (shift, bits, _) in enumerate(balls)))).alias("key"))
    hot = durable(own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    rows = rows.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))
    if n_hot := hot.count():
        # blocks of every value that a crowded table value's ball reaches
        masks = ball(np.zeros(1, np.int64), max(b for _, b, _ in balls), max(r for _, _, r in balls)).ravel().tolist()
        flips = F.transform(F.lit(masks).cast("array<long>"), lambda m: F.col("key").bitwiseXOR(m))
        salted = hot.select(F.explode(flips).alias("key"), "n").groupBy("key").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
        salted = F.broadcast(salted) if n_hot * len(masks) <= BROADCAST_ROWS else salted
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        # a row of block m meets every block once: groups (i, j), i <= j, with m one of the two
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, mine).alias("i"), F.greatest(x, mine).alias("j")))
        met = rows.drop("i", "j").join(salted, "key", "left")
        rows = met.select("key", "fp", "own", F.explode(F.when(F.col("blocks") > 1, cells).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))).alias("c")).select("key", "fp", "own", "c.i", "c.j")
    groups = max(1, total // ROWS_A_GROUP)
    # rows of a block pair keep their own group; all others share one by a hash of their value
    g = F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups))
    packed = rows.select(g.alias("g"), F.xxhash64("key", "i", "j").alias("key"), "fp", "own") if n_hot else rows.select(g.alias("g"), "key", "fp", "own")
    return packed.groupBy("g").applyInArrow(_compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = durable(fingerprints(docs))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(fingerprint_links(distinct), "a", "b")
    # a component is named by its smallest doc_id; few fingerprints have links at all
    linked = durable(roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "least"))
    whole = durable(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k")))
    linked = spread_join(linked, whole, ["root"], "k", linked.count()).select("fp", "component_id")
    of_fp = durable(distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    found = spread_join(rows, of_fp, ["fp"], "n", rows.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
