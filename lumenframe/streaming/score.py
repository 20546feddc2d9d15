"""The stateless scorers on streams, and idempotent block ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """All that is there now, scored and appended once: the checkpoint remembers what has been read."""
    return scorer(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def windowed_rates(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means by tumbling window with a watermark; the same on a table and on a stream."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def ingest_blocks(stream: DataFrame, block: str, target: str, checkpoint: str):
    """Each micro-batch replaces the blocks it holds, so a replayed batch changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(block).parquet(target)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
