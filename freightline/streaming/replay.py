"""Runs a streaming transform over a feed that arrives in several deliveries."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def run_deliveries(spark: SparkSession, deliveries: Sequence[DataFrame], transform: Callable[[DataFrame], DataFrame],
                   name: str, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Each delivery lands as files in one folder and is taken up by an ``availableNow`` run that goes on
    from the checkpoint of the run before, so state and watermark carry over; the run ends with a batch
    without data that emits what the new watermark closes.  Append mode into Parquet, or ``sink(batch,
    batch_id)``, which must replace what an earlier try of the same id wrote.  Returns the sink's rows
    (None with a ``sink``).  Feed, checkpoint and output live in the shared scratch folder."""
    feed, out, progress = (scratch_path(spark, f"{name}-{part}") for part in ("feed", "out", "progress"))
    for delivery in deliveries:
        delivery.write.mode("append").parquet(feed)
        writer = transform(spark.readStream.schema(delivery.schema).parquet(feed)).writeStream.outputMode("append")
        writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", out)
        writer.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return None if sink else spark.read.parquet(out)
