"""A corpus cleaning pipeline over the documents table: quality, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of documents; the last
returns packed pieces. ``run`` writes each stage's rows as Parquet beside the checkpoints and reads them again, so a
stage never computes an earlier one anew and a lost executor costs tasks of one stage; what no later stage reads is deleted.

Rows are told apart by doc_id and the text's hash, nulls included; a row with a null doc_id never removes one that has
an id. Equal rows are one document to the near-duplicate stage, which keeps one of them. Null texts count as empty. Columns that
documents may have besides pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, near_copies, packing, pii, quality_gam
from quarryline.llm.common import checkpoint_folder, durable, nullable_text, release, table

#: Keys of rows to drop that go to every task: two numbers each.
BROADCAST_KEYS = 500_000


def _keyed(docs: DataFrame) -> DataFrame:
    """All columns of docs in one, ``row``, so that no name of theirs can clash, and the key of the row."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(nullable_text()).alias("hash"))


def _having(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose key is among keys (left_semi) or isn't (left_anti); nulls are equal to each other here."""
    keys = durable(keys.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, same, how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality model accepts."""
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return quality_gam.with_scores(whole, model).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest doc_id, nulls last.

    Texts of SHINGLE-word similarity THRESHOLD or more are linked (see near_copies): SimHash fingerprints are met by op2's
    segments, bands find what these can't reach, and whole sets decide. op2's own contract is op2's alone.
    """
    rows = _keyed(docs)
    found = durable(near_copies.near_copies(docs))
    gone = ~(F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    left = _having(rows, found.where(gone), "left_anti")
    again = durable(found.where(~gone & (F.col("n") > 1)))  # equal rows: one of them stays
    if not again.isEmpty():
        left = _having(left, again, "left_anti").unionByName(_having(left, again, "left_semi").dropDuplicates(["doc_id", "hash"]))
    return left.select("row.*")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    rows = _keyed(docs)
    found = decontaminate.matches(rows.select("doc_id", "hash", F.col("row.text").alias("text")), table(spark, sf_dir, "benchmark"), keys=("doc_id", "hash"))
    return _having(rows, found, "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut into sequences of powers of two."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("personal_data", personal_data), ("packing", pack)]

#: Fingerprint hashing, the trained model and tokenizers have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    folder, before = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # no later stage reads it
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
        release(spark)  # the stage's shuffles and checkpoints
    return docs
