"""Streams of facts into a database by Structured Streaming.

A stream's micro-batches are ingested one after another. A boolean column, ``added`` unless named otherwise, tells
additions from removals; a stream without one only adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..plans.program import Database


def feed(database: Database, message: str, stream: DataFrame, added: str = "added") -> DataStreamWriter:
    """A writer that ingests ``stream`` as ``message``; start it with a trigger and a checkpoint of your own."""

    def ingest(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if added in batch.columns:
                plus, minus = batch.where(F.col(added)).drop(added), batch.where(~F.col(added)).drop(added)
                database.ingest({message: plus}, {message: minus})
            else:
                database.ingest({message: batch})
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(ingest)


def drain(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Ingest what is there now, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
