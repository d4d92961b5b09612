"""The batch operators on streams: each micro-batch is an ordinary DataFrame, and stored results make a batch that comes again harmless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def per_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Applies an operator of this library to each micro-batch and writes its rows under the batch's number, replacing what a failed try left.

    So an operator that shuffles or ranks works as on a table, stream-static joins included, and a batch counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_of_key(stream: DataFrame, keys: list[str], event_time: str, late: str = "1 day") -> DataFrame:
    """The probe cache on a stream: the first row of each key within the watermark; state is let go once keys are too old to come again."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, by: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by event-time window and group, late rows within the watermark included."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width).alias("window"), *by).agg(F.count("*").alias("n"))
