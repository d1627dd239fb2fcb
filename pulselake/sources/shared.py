"""Work folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset a temporary folder serves only if everything runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="pulselake-")
    ship(spark)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as a table in a shared folder and read back: lineage ends there, and rows stay
    where they were put."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
