"""Payload tables that bags meet without moving them: bucketed and sorted by record and segment.

A bag names segments; their samples are the bulk of all data.  Written once in buckets of the keys
that bags are joined by, the payload stays where it is in each join: only the bags are dealt out.
A long record is spread over all buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.grouped import parallelism

#: The keys that bags and segments share.
SEGMENT = ("record_id", "seg_index")


def write_bucketed(segments: DataFrame, folder: str, keys: tuple[str, ...] = SEGMENT, buckets: int | None = None) -> DataFrame:
    """The table, written to a folder in buckets; a file for each bucket, sorted by the keys.

    There are as many buckets as tasks in a shuffle, so that a join need not deal them out anew."""
    spark = segments.sparkSession
    n = buckets or parallelism(spark)
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = segments.repartition(n, *keys)
    dealt.write.bucketBy(n, *keys).sortBy(*keys).option("path", folder).format("parquet").saveAsTable(name)
    return spark.table(name)


def read_bucketed(spark: SparkSession, folder: str, schema: str, buckets: int, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    """A table that :func:`write_bucketed` wrote in another session, with its buckets."""
    name, by = f"bucketed_{uuid.uuid4().hex}", ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def bag_payload(bags: DataFrame, payload: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Every segment of every bag with its payload; a segment that a bag holds twice comes twice, one
    without payload is left out.

    The payload side of the join is read bucket by bucket; the bags are dealt out to its buckets."""
    return bags.join(payload.hint("shuffle_merge"), list(keys))
