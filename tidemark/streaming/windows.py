"""Structured Streaming over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, one file or a folder of part files, as a stream; new ones would be read as they come."""
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parquet*")


def counted(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums of each type in each day; a day is final once the watermark has passed it."""
    rows = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is there, as one bounded run of the stream; the sink is a folder of updates, of which the last counts."""
    folder = scratch(spark)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    run = (
        counted(event_stream(spark, sf_dir))
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    run.awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    last = rows.groupBy("w", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "v.n", F.round("v.total", 4).alias("total")
    )
