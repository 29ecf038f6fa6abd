"""Near copies of texts: components of exact Jaccard similarity of word shingles, candidates by SimHash and MinHash bands.

A text is the set of its shingles of ``shingle`` words (as in ``simhash``: lower-cased, split at ASCII white space); a
text of fewer words is one shingle, a text without words the empty set. Equal sets are one node. Every node has a
SimHash fingerprint, of its set. Nodes of one fingerprint, and those that ``simhash.fingerprint_links`` joins within its
radius by segments, are candidates. At 0.8 about ten of 64 bits differ, more than segments can reach, so what
the fingerprints leave apart is looked for by bands: nodes that share one of BANDS keys, each made of BAND_ROWS minima,
are candidates too. At similarity 0.8 a pair shares none with probability (1 - 0.8 ** 4) ** 32, 5e-8, whatever the lengths.

Candidates are verified on whole sets, so every link has the similarity asked for. In each bucket all members are
first compared with the smallest one; what these links leave apart is then compared in all pairs within a task, which
gives fewer links than rows. A bucket of over 2 * BLOCK rows is cut into blocks and every pair of blocks is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, durable, nullable_text, release, ship, spread_join

SHINGLE, THRESHOLD, BANDS, BAND_ROWS, SEED = 5, 0.8, 32, 4, 42
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE = 256
#: Keys that are few enough to go to all tasks.
BROADCAST_KEYS = 500_000
BLOCK = 512


def shingles_of(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    line, ends, end = b" ".join(words), [], -1
    for w in words:
        end += len(w) + 1
        ends.append(end)
    begins = [0, *[e + 1 for e in ends[: n - 1]]]
    ends = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(line[i:j], SEED) for i, j in zip(begins, ends)]), ">u8").astype(np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_XOR), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _PIECE):
        x = (hashes[None, at : at + _PIECE] ^ _XOR) * _ODD
        np.minimum(least, x.min(1), out=least)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, BAND_ROWS).T:
        h = (h ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def signed(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, hash (of the text), node, its fingerprint and its band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets = [shingles_of(t, shingle) for t in b["text"].cast(pa.binary()).to_pylist()]
                keys = [band_keys(s) for s in sets]
                cuts = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                fp = simhash.majority(np.concatenate(sets).astype(">u8").view(np.uint8).reshape(-1, 8), [*map(len, sets)]) if sets else np.zeros(0, np.uint64)
                yield pa.record_batch([b["doc_id"], b["hash"], pa.array(map(_node, sets), pa.int64()), pa.array(fp.view(np.int64)), lists], names=["doc_id", "hash", "node", "fp", "keys"])

    return rows.mapInArrow(run, "doc_id long, hash long, node long, fp long, keys array<long>")


def _sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, s) of the wanted nodes, s the hashes of its shingles. wanted: hash of one text of each node, and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets = [shingles_of(t, shingle).view(np.int64) for t in b["text"].cast(pa.binary()).to_pylist()]
                cuts = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.record_batch([b["node"], pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], names=["node", "s"])

    # the least id names one row of the text; rows that are equal in both give equal sets
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    same = F.col("hash").eqNullSafe(F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    found = rows.join(few.select(F.col("hash").alias("_hash"), F.col("doc_id").alias("_id"), "node"), same)
    return found.select("node", "text").mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least that similar."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.size("s").alias("na")), "a")
    y = x.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.size("s").alias("nb")), "b")
    y = y.where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)
    shared = F.size(F.array_intersect("sa", "sb"))
    return y.where(shared >= F.lit(threshold) * (F.col("na") + F.col("nb") - shared) - 1e-9).select("a", "b")


def _compare(group: pa.Table, threshold: float) -> pa.Table:
    """Links that join what similar sets of the group can join, beside the roots that rows have already."""
    node, root = group["node"].to_numpy(), np.unique(group["root"].to_numpy(), return_inverse=True)[1]
    lists = group["s"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    values, of = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    starts, mark, found = np.cumsum(size) - size, np.zeros(len(values), np.int32), []
    for k in range(len(node) - 1):
        if (root[k + 1 :] == root[k]).all():
            continue
        own = of[starts[k] : starts[k] + size[k]]
        mark[own] = 1
        shared = np.add.reduceat(mark[of[starts[k + 1] :]], starts[k + 1 :] - starts[k + 1])
        mark[own] = 0
        near = np.flatnonzero((shared >= threshold * (size[k] + size[k + 1 :] - shared) - 1e-9) & (root[k + 1 :] != root[k])) + k + 1
        for j in near.tolist():
            if root[j] != root[k]:
                found.append((node[k], node[j]))
                root[root == root[j]] = root[k]
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of one fingerprint, each with the smallest of them, and the smallest ones of fingerprints that are linked."""
    nodes = nodes.where(F.size("keys") > 0).select("node", "fp")  # the empty set is like no other
    of = durable(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("n")))
    alike = spread_join(nodes, of.where("n > 1"), ["fp"], "n", nodes.count()).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    near = durable(simhash.fingerprint_links(of.select("fp")))
    ends = near.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    ends, total = durable(ends.join(of.select("fp", "hub"), "fp")), near.count()
    for c in "ab":
        near = durable(spread_join(near, ends.withColumnRenamed("fp", c), [c], "n", total).drop(c, "n").withColumnRenamed("hub", f"hub_{c}"))
    return alike.union(near.select("hub_a", "hub_b"))


def links(rows: DataFrame, nodes: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(a, b): verified links that join all nodes that candidate links can join. nodes: node, fp, keys, doc_id and hash of a row."""
    spread = nodes.select("node", F.explode("keys").alias("key"))
    buckets = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("n > 1")
    # buckets of the same members are one
    buckets = durable(buckets.groupBy("n", "hub", "who").agg(F.min("key").alias("key")).select("key", "hub", "n"))
    small = buckets.count() <= BROADCAST_KEYS
    members = durable(spread.join(F.broadcast(buckets), "key") if small else spread_join(durable(spread), buckets, ["key"], "n", nodes.count() * BANDS))
    tried = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).union(fingerprint_pairs(nodes))
    tried = durable(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release(rows.sparkSession)
    met = members.select("node").union(tried.select(F.explode(F.array("a", "b")))).distinct()
    wanted = durable(nodes.select("node", "doc_id", "hash").join(met, "node"))
    sets = durable(_sets(rows, wanted, shingle))
    first = durable(_verified(tried, sets, threshold))
    roots = components(first, "a", "b")
    known = durable(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    release(rows.sparkSession)
    apart = durable(known.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r"), F.max("root").alias("z")).where("n > 2 AND r <> z").select("key", "n"))
    rest = durable(spread_join(known, apart, ["key"], "n", known.count()).drop("n"))
    crowd = durable(rest.groupBy("key").count().where(F.col("count") > 2 * BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a row of block m meets every block once: groups (i, j), i <= j, with m one of the two
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, mine).alias("i"), F.greatest(x, mine).alias("j")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    rest = rest.join(F.broadcast(crowd) if crowd.count() <= BROADCAST_KEYS else crowd, "key", "left").withColumn("c", F.explode(F.when(F.col("blocks").isNotNull(), cells).otherwise(whole)))
    rest = rest.select("key", "c.i", "c.j", "node", "root").join(sets, "node")
    return first.union(rest.groupBy("key", "i", "j").applyInArrow(lambda t: _compare(t, threshold), "a long, b long"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, hash (of the text), n (rows equal in both), kept_id and kept_hash of every (doc_id, text) in docs.

    kept_id and kept_hash name what stays of the component: the smallest doc_id, nulls last, then the smallest hash.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(nullable_text()).alias("hash"), nullable_text().alias("text"))
    keyed = durable(signed(rows, shingle))
    own = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "hash")
    nodes = durable(keyed.groupBy("node").agg(F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.min(own).alias("best"), F.count("*").alias("k")))
    roots = components(links(rows, nodes.select("node", "fp", "keys", "best.doc_id", "best.hash"), shingle, threshold), "a", "b")
    of = durable(nodes.select("node", "k", "best").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    best = durable(of.groupBy("root").agg(F.min("best").alias("best"), F.count("*").alias("size")))
    kept = spread_join(of.select("node", "k", "root"), best, ["root"], "size", of.count()).select("node", "k", F.col("best.doc_id").alias("kept_id"), F.col("best.hash").alias("kept_hash"))
    each = durable(keyed.groupBy("doc_id", "hash", "node").agg(F.count("*").alias("n")))
    return spread_join(each, durable(kept), ["node"], "k", each.count()).select("doc_id", "hash", "n", "kept_id", "kept_hash")
