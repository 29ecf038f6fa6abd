"""What several corpus operators share: reading tables, durable cuts of lineage, connected components."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks import it there."""
    sc = spark.sparkContext
    if getattr(sc, "_quarryline_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="quarryline-")
    archive = os.path.join(folder, "quarryline_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((top / "quarryline").rglob("*.py")):
            z.write(p, str(p.relative_to(top)))
    sc.addPyFile(archive)  # kept until the end: the driver serves the file to executors that join later
    atexit.register(shutil.rmtree, folder, True)
    sc._quarryline_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where that is unset, one of this machine, if all runs on this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="quarryline-checkpoint-")
            atexit.register(shutil.rmtree, where, True)
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in ``checkpoint_folder``."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Collect garbage here and in the driver's JVM, so that Spark's cleaner deletes shuffle files of plans that nothing refers to.

    That happens by itself only once the driver's heap fills, and small plans leave a file or two for every task till then.
    """
    gc.collect()  # frames in reference cycles hold their plans
    spark.sparkContext._jvm.System.gc()


def nullable_text(c: str = "text"):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


#: A key of more than one in HOT_KEYS of all rows is hot, if it has over HOT_ROWS; so at most HOT_KEYS keys are hot.
HOT_KEYS, HOT_ROWS = 10_000, 64


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows with the columns of ``values`` (one row per key) for the keys that are in both. No key crowds a task.

    ``n`` is a column of values that counts the key's rows (about), ``total`` counts all rows. Values of hot keys, HOT_KEYS
    at most, go to every task; the rows of all other keys are shuffled. Both tables are read twice, so they
    should be checkpoints or cheap. Keys must not be null.
    """
    hot = F.col(n) > max(HOT_ROWS, total // HOT_KEYS)
    crowded = F.broadcast(values.where(hot))
    even = rows.join(crowded.select(*keys), keys, "left_anti")
    return rows.join(crowded, keys).unionByName(even.join(values.where(~hot), keys))


#: Links that a partition of a round's table holds, and partitions that are few enough for any table.
LINKS_A_PART, FEW_PARTS = 100_000, 16


def components(edges: DataFrame, a: str, b: str, limit: int = 100) -> DataFrame:
    """Connected components of undirected links: (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps: every step is one aggregation and one join over the links, nothing is
    gathered per node, and the links of a hub stay where they are (``spread_join``). Nodes without a link don't appear.
    The loop ends when a round leaves the links as they were. A round's table has as many partitions as its links need, so
    few links don't leave a file for every shuffle partition in every step.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    links = durable(edges.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
    seen = None
    for _ in range(limit):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        parts = max(FEW_PARTS, now[0] // LINKS_A_PART)
        links = links if seen else links.coalesce(parts)
        seen = now
        release(edges.sparkSession)
        back = links.select(F.col("v").alias("u"), F.col("u").alias("v"))  # v > u here only
        least = links.union(back).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = least.select("u", F.least("u", "m").alias("m"), "n")
        large = durable(spread_join(back, least, ["u"], "n", now[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, ["u"], "n", now[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = durable(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
    raise RuntimeError(f"components did not settle in {limit} rounds")
