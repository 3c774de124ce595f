"""Extensions that the batch analytics have no counterpart for: totals of event time over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, by: str, time: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sums and counts of each window; rows later than ``late`` are dropped. Works on streams and tables."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    grouped = own.groupBy(F.window(time, width).alias("w"), by).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), by, "total", "n")


def new_files(spark: SparkSession, path: str, schema, sink: str, checkpoint: str) -> None:
    """Appends files of ``path`` that an earlier call hasn't seen to ``sink``, then stops."""
    stream = spark.readStream.schema(schema).parquet(path)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
