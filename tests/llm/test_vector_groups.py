"""Recall of the whole vector operator where near copies crowd."""

import numpy as np
import pyarrow as pa

from quarryline.llm import rp_forest


def test_recall_within_a_large_group(spark):
    """A third of 12,000 rows are near copies of each other; counts of links against brute force."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((8000, 64)), rng.standard_normal(64) + rng.standard_normal((4000, 64)) * 0.25]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(12000), "embedding": pa.array(list(x), pa.list_(pa.float32()))})).selectExpr("*", "1 AS label")
    got = {r.vec_id: r.n_links for r in rp_forest.near_duplicates(df).select("vec_id", "n_links").collect()}
    counts = np.array([got[k] for k in range(12000)])
    assert (counts <= want).all() and counts.sum() >= 0.99 * want.sum()
