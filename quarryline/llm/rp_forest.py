"""Near duplicates of vectors by a forest of random-projection trees.

A tree splits its space again and again at the median of a random projection; vectors near the median go to both
sides: those within SPILL (a share of the node's vectors), and those within REACH of the distance of a pair at the
threshold, as fewer would part such pairs. A node that this would spill more than CROWDED of, a group of near copies
at the median, is not split along that direction, nor is one of fewer than FIT_LEAST sample vectors. Vectors are
compared, by cosine in double precision and only under equal labels, within the leaves of TREES trees; the leaf of a
vector is found by DEPTH comparisons. The splits are fitted to a sample, the vectors of least hash, that grows with the
depth; every vector is indexed. The depth follows the number of vectors of the largest label, so that leaves hold about
LEAF_ROWS. A leaf that is larger anyway is cut into blocks and every pair of blocks is compared, so no task holds more
than two blocks and nothing is left out.

Equal vectors are one row with a multiplicity, so a group of copies gives no pairs. A pair that meets in several
leaves counts in the first of them, which each vector's list of leaves tells; so every task reports a link count
per vector and a spanning forest, no more rows than it has read, instead of pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
label, link with nothing; vectors of different lengths are not compared; rows of equal vec_id are vectors of their
own; a null vec_id never is a component_id unless its component has no other. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, ship, spread_join

THRESHOLD, TREES, SPILL, LEAF_ROWS, FIT_ROWS, MAX_DEPTH, BLOCK, SEED = 0.93, 8, 0.12, 256, 20_000, 14, 1024, 17
#: Half the spill zone over the distance of a pair at the threshold; share of a node that may spill; sample vectors that a split needs.
REACH, CROWDED, FIT_LEAST = 0.4, 0.25, 16


class Forest:
    """Directions, one per tree and level, and the range of projections that spills, one per node."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, spill: float, seed: int = SEED, threshold: float = THRESHOLD):
        rng, width = np.random.default_rng(seed), sample.shape[1]
        self.depth, self.trees = depth, trees
        self.directions = rng.standard_normal((trees, depth, width))
        # a node that isn't split has all its vectors on the left
        self.low, self.high = np.full((trees, 1 << depth), np.inf), np.full((trees, 1 << depth), np.inf)
        reach = REACH * math.sqrt(max(0.0, 2 - 2 * threshold))  # projections of such a pair differ by about its distance
        for t in range(trees):
            members = {1: np.arange(len(sample))}
            for level in range(depth):
                along, below = sample @ self.directions[t, level], {}
                for node, rows in members.items():
                    x = along[rows]
                    below[2 * node] = rows
                    if len(x) < FIT_LEAST:
                        continue
                    a, m, b = np.quantile(x, [0.5 - spill / 2, 0.5, 0.5 + spill / 2])
                    a, b = min(a, m - reach), max(b, m + reach)
                    if ((x >= a) & (x <= b)).mean() > max(CROWDED, spill):
                        continue
                    self.low[t, node], self.high[t, node] = a, b
                    below[2 * node], below[2 * node + 1] = rows[x <= m], rows[x > m]
                members = below

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf of every tree that a vector belongs to; leaves are numbered over all trees."""
        rows, codes = [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for level in range(self.depth):
                p = (x @ self.directions[t, level])[row]
                left, right = p <= self.high[t, node], p >= self.low[t, node]
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            codes.append(node + (t << (self.depth + 1)))
        return np.concatenate(rows), np.concatenate(codes)


def _unit(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Link counts and spanning links of one leaf, or of a pair of blocks of one."""
    if table.num_rows < 2:
        return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
    ids, n, side = (table.column(c).to_numpy() for c in ("rid", "n", "side"))
    x = _unit(table.column("embedding").combine_chunks())
    leaf = table.column("leaf")[0].as_py()
    lists = table.column("leaves").to_pylist()
    codes = np.full((len(ids), max(map(len, lists))), -1)
    for r, c in enumerate(lists):
        codes[r, : len(c)] = c
    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    if table.column("i")[0].as_py() != table.column("j")[0].as_py():  # links inside a block belong to the block's own task
        cross = side[i] != side[j]
        i, j = i[cross], j[cross]
    first = np.full(len(i), np.iinfo(np.int64).max)
    for s in range(0, len(i), 100_000):  # lists ascend, so the first common leaf found is the least
        left = np.arange(s, min(s + 100_000, len(i)))
        for c in range(codes.shape[1]):
            a = codes[i[left], c]
            hit = (codes[j[left]] == a[:, None]).any(1) & (a >= 0)
            first[left[hit]] = a[hit]
            left = left[~hit]
            if not len(left):
                break
    own = first == leaf
    count = np.bincount(i[own], n[j[own]], len(ids)) + np.bincount(j[own], n[i[own]], len(ids))
    root = np.arange(len(ids))
    while len(i):  # the least row of each row's component among these rows
        low, was = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == was).all():
            break
    told = np.flatnonzero((count > 0) | (root != np.arange(len(ids))))
    return pa.table({"id": ids[told], "n": count[told].astype(np.int64), "other": ids[root[told]]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL, leaf_rows: int = LEAF_ROWS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("embedding").cast("array<float>")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), F.col("label").cast("long").alias("label"))
    valid = F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull()
    # one row for equal vectors; cells that can't be compared stay apart by their length
    unique = durable(
        rows.where(valid).groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
        .withColumn("width", F.size("embedding")).withColumn("rid", F.monotonically_increasing_id())
    )
    sizes = unique.groupBy("width", "label").count().groupBy("width").agg(F.max("count").alias("most")).orderBy("width").collect()  # a row per length of vector
    parts = []
    for width, most in sizes:
        depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(most / leaf_rows))))
        mine = unique.where(F.col("width") == width)
        fit = max(FIT_ROWS, FIT_LEAST << depth)  # 2 ** MAX_DEPTH * FIT_LEAST vectors at most
        sample = mine.orderBy(F.xxhash64("embedding"), "rid").limit(fit).select("embedding").toArrow()["embedding"].combine_chunks()
        forest = spark.sparkContext.broadcast(Forest(_unit(sample), depth, trees, spill, threshold=threshold))  # 2 ** MAX_DEPTH nodes a tree at most

        def index(batches: Iterator[pa.RecordBatch], forest=forest) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    b = whole.slice(at, 2000)
                    row, leaf = forest.value.leaves(_unit(b.column("embedding")))
                    order = np.lexsort((leaf, row))
                    row, leaf = row[order], leaf[order]
                    lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32), pa.array(leaf))
                    yield pa.record_batch([b.column("rid"), b.column("n"), b.column("label"), b.column("embedding"), lists], names=["rid", "n", "label", "embedding", "leaves"])

        kinds = "rid long, n long, label long, embedding array<float>, leaves array<long>"
        parts.append(mine.mapInArrow(index, kinds).withColumn("width", F.lit(width)))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    indexed = parts[0]
    for p in parts[1:]:
        indexed = indexed.union(p)
    found = _links(indexed, threshold, block)
    found = durable(found.groupBy("id", "other").agg(F.sum("n").alias("n")))
    counts = found.groupBy("id").agg(F.sum("n").alias("links"))
    least = unique.select("rid", "least")
    roots = components(found.select("id", "other"), "id", "other")
    linked = durable(roots.join(least, roots.node == least.rid).select("rid", "root", "least"))
    names = durable(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k")))
    linked = spread_join(linked, names, ["root"], "k", linked.count()).select("rid", "component_id")
    # n_links and component of every distinct vector, back to the rows that have it
    whole = durable(
        unique.select("rid", "label", "embedding", "n", "least").join(counts, unique.rid == counts.id, "left").drop("id").join(linked, "rid", "left")
        .select("label", "embedding", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    dealt = durable(rows.where(valid))
    done = spread_join(dealt, whole, ["label", "embedding"], "n", dealt.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(indexed: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, n, other) from every leaf."""
    rows = indexed.select("*", F.explode("leaves").alias("leaf"))
    crowd = durable(rows.groupBy("width", "label", "leaf").count().where(F.col("count") > 2 * block).select("width", "label", "leaf", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    plain = ["rid", "n", "embedding", "leaves", "width", "label", "leaf"]
    n = crowd.count()
    if n:
        rows = rows.join(F.broadcast(crowd) if n <= 10_000 else crowd, ["width", "label", "leaf"], "left")
        mine = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, mine).alias("i"), F.greatest(x, mine).alias("j"), (mine > x).cast("int").alias("side")))
        rows = rows.select(*plain, F.explode(F.when(F.col("blocks").isNotNull(), cells).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))))).alias("c")).select(*plain, "c.i", "c.j", "c.side")
    else:
        rows = rows.select(*plain, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    return rows.groupBy("width", "label", "leaf", "i", "j").applyInArrow(lambda t: _compare(t, threshold), "id long, n long, other long")
