"""Staging rows that arrive as a stream, loaded into the star one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from riskloom.schemas import STAGING_SCHEMA
from riskloom.sources.batches import CreditStore


def read_arrivals(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Staging rows that arrive as Parquet files."""
    return spark.readStream.schema(STAGING_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def load_arrivals(arrivals: DataFrame, store: CreditStore, checkpoint: str, stream: str = "llegadas") -> StreamingQuery:
    """Publish each micro-batch as one commit of the store, then stop when the input is read.

    The commit names the stream and the micro-batch's number. A micro-batch that ran before, for example because the
    job died between its commit and the stream's own record of it, is skipped: nothing is published twice.
    """

    def publish(rows: DataFrame, number: int) -> None:
        store.load_numbered(stream, number, rows)

    return (
        arrivals.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
