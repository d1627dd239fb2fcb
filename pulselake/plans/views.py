"""The electrocardiogram tables' analogues over the driver's tables.

The driver's tables hold no recordings: a user is a record, an hour a segment, an event a beat
(``error`` is the S beat), and its value the amplitude.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START_US = 1_704_067_200_000_000  # 2024-01-01
HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", micros("ts") - F.lit(START_US))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record_id, seg_index, symbol, amp, us, event_id``."""
    symbol = F.when(F.col("event_type") == "error", "S").otherwise(F.col("event_type"))
    return events(spark, sf_dir).select(F.col("user_id").alias("record_id"), F.floor(F.col("us") / HOUR_US).cast("int").alias("seg_index"), symbol.alias("symbol"), F.col("value").alias("amp"), "us", "event_id")


#: The same as SQL; queries begin with WITH and these.
EVENTS_SQL = f"ev AS (SELECT *, epoch_us(ts) - {START_US} AS us FROM events)"
BEATS_SQL = f"""{EVENTS_SQL},
beats AS (
  SELECT user_id AS record_id, floor(us / {HOUR_US})::INTEGER AS seg_index,
         CASE WHEN event_type = 'error' THEN 'S' ELSE event_type END AS symbol, value AS amp, us, event_id
  FROM ev),
flags AS (SELECT record_id, seg_index, coalesce(bool_or(symbol = 'S'), false) AS is_s FROM beats GROUP BY ALL)"""
