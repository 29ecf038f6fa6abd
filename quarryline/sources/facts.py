"""Reading facts and writing relations and their changes. All of it is Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import relation


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, or some of its columns, as it is."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Facts in lines of tab-separated values; a line that doesn't fit the schema is no fact."""
    return relation(spark.read.schema(schema).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return relation(spark.read.schema(schema).json(path))


def write_relation(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_changes(log: DataFrame, path: str, batch: int) -> None:
    """A batch of changes (columns and added), in a folder of its own, so that writing it again gives no doubles."""
    log.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")
