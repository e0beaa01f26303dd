"""Resumable work as micro-batches: each run takes what is new, processes it and appends; a checkpoint remembers what was done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, schema, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 50) -> None:
    """Runs step over files of the source folder that no earlier run has seen, appends to the sink, and ends. Exactly once per file."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    q = step(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_metrics(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts and means per window and key; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
