"""The endless stream of next-token batches over epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shardloom.sources.shards import batch_stream

__all__ = ["batch_stream", "draw_to_table"]


def draw_to_table(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append all batches up to the end the stream was given to a Parquet table."""
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
