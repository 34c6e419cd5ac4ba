"""Incremental ingest by Structured Streaming; the stores that it mirrors are refreshed in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the events that files of a folder hold; ts as a timestamp, for watermarks need one."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str = "7 days", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows and sum of values by window and type; late rows count until the watermark has passed."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_per_key(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def append_new_keys(stream: DataFrame, store: str, keys: list[str], checkpoint: str):
    """Appends rows of keys that the store lacks, batch by batch; a batch that is run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            old = spark.read.parquet(store).select(*keys).distinct()
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        else:
            new = new.join(old, keys, "left_anti")
        new.write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
