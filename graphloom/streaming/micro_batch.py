"""Incremental insertion as a stream: every micro-batch is merged into Parquet state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def insert_stream(stream: DataFrame, state: str, checkpoint: str, key: str, newest: str) -> None:
    """Run all that is there through ``foreachBatch``; each batch writes its latest row of every key.

    A batch is written under its own number, so a batch that is tried again after a failure
    replaces its own rows and none is counted twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        others = [c for c in batch.columns if c not in (key, newest)]
        last = batch.groupBy(key).agg(F.max(F.struct(newest, *others)).alias("r")).select(key, f"r.{newest}", *[f"r.{c}" for c in others])
        last.write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_state(spark: SparkSession, state: str, key: str, newest: str) -> DataFrame:
    """The latest row of every key over all batches."""
    rows = spark.read.parquet(state).drop("batch")
    others = [c for c in rows.columns if c not in (key, newest)]
    return rows.groupBy(key).agg(F.max(F.struct(newest, *others)).alias("r")).select(key, f"r.{newest}", *[f"r.{c}" for c in others])


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, by, n): tumbling counts; rows later than the watermark are left out by the stream."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 1) -> DataFrame:
    """The files of a folder, or a single file, as a stream."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)
