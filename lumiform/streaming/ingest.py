"""Incremental ingestion: a file stream that takes what is there and stops, with running counts by event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def available_counts(spark: SparkSession, folder: str, name: str, checkpoint: str, out: str) -> DataFrame:
    """Hourly counts and sums by event type over the files of a table, written by micro-batches and read back."""
    static = spark.read.parquet(f"{folder}/{name}.parquet")
    stream = spark.readStream.schema(static.schema).parquet(f"{folder}/{name}*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    flat = hourly.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = flat.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    latest = rows.groupBy("hour", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return latest.select("hour", "event_type", "s.n", "s.total")
