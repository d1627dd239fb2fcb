"""Incremental ingestion and windows as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, path: str, schema: StructType, files_a_batch: int | None = None) -> DataFrame:
    """New Parquet files of a table: a folder of files, or one file of that name."""
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(store).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.option("pathGlobFilter", "*.parquet").parquet(path)


def ingest_new_files(spark: SparkSession, path: str, schema: StructType, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], files_a_batch: int | None = None) -> None:
    """Appends what files that were not seen before hold, and stops; a restart goes on after them.

    Each batch is written under its own number, so that a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = new_files(spark, path, schema, files_a_batch)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling_counts(events: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Events of each window and key; in append mode, events of windows that ended more than
    ``late`` before the newest event are dropped, and so is their state."""
    d = events.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return d.agg(F.count(F.lit(1)).alias("n_events")).select(F.col("window.start").alias("window_start"), *keys, "n_events")


def run_windows(spark: SparkSession, path: str, schema: StructType, sink: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], files_a_batch: int | None = None) -> None:
    """Appends the windows that have ended, as a stream that stops once all files are read.

    Each batch is written under its own number, so that a repeated batch replaces itself; windows
    that are still open wait in the state for the next run."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = build(new_files(spark, path, schema, files_a_batch)).writeStream.outputMode("append").foreachBatch(put)
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
