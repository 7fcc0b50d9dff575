
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def chunk_counts(events: DataFrame, chunk: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events for each half-open window and type; works on tables and on streams alike."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", chunk).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 6).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")
    )
