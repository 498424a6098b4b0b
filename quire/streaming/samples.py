"""Samples and counts kept up to date over a stream of deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import merge_sample


def keep_sample(stream: DataFrame, key_col: str, k: int, path: str, seed: int = 0):
    """A writer that merges each micro-batch into the sample stored under ``path``.

    The versions alternate between two folders, so a batch that is repeated after a failure
    reads what the batch before it wrote and gives the same sample again.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        arrived = batch.select(key_col)
        held = arrived.limit(0) if epoch == 0 else spark.read.parquet(f"{path}/v{(epoch - 1) % 2}").select(key_col)
        merge_sample(held, arrived, key_col, k, seed).write.mode("overwrite").parquet(f"{path}/v{epoch % 2}")

    return stream.writeStream.foreachBatch(merge).outputMode("update")


def windowed_counts(stream: DataFrame, time_col: str, group_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and group, closed once the watermark has passed."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), group_col).agg(F.count(F.lit(1)).alias("n"))
