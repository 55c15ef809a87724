"""An append-only ledger of measurements as a stream: late rows, hourly counts, best so far per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.session import scratch_path


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """window start, event_type, n, total of events (ts, event_type, value); rows later than ``late`` are dropped by the watermark."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into parquet in the shared folder and return the table: state and output survive lost executors."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
