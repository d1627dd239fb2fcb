"""File sources and sinks: listings, CSV, JSON lines, nested and partitioned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import BAG_CACHE, META, SCORES, SPLITS, TABLES

#: The files of a record, and what a name may end with.
REQUIRED = ("hea", "SIG", "ANN", "json")
DENOISED = "_seg_all_denoise"


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """``record_name, ext, path`` of a folder; the files themselves are not read."""
    paths = spark.read.format("binaryFile").load(folder).select("path")
    return paths.select(base_name(F.col("path")).alias("record_name"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("ext"), "path")


def complete_records(files: DataFrame, key: str = "record_name", part: str = "ext", required=REQUIRED) -> DataFrame:
    """Records that have every required part: relational division, sorted."""
    wanted = F.col(part).isin(*required)
    d = files.where(wanted).groupBy(key).agg(F.count_distinct(part).alias("n"))
    return d.where(F.col("n") == len(required)).select(key).orderBy(key)


def pending(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records that are not done yet."""
    return records.join(done.select(key).distinct(), key, "left_anti")


def header_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``record_name, line_no, line`` of every header file, numbered within the file."""
    whole = spark.read.text(folder, wholetext=True, pathGlobFilter="*.hea").select(base_name(F.col("_metadata.file_path")).alias("record_name"), "value")
    return whole.select("record_name", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """``record_name, text`` of every report."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(base_name(F.col("_metadata.file_path")).alias("record_name"), F.col("value").alias("text"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).csv(path, header=True)


def splits(spark: SparkSession, pattern: str) -> DataFrame:
    """Split rows with the seed from their file's name."""
    seed = F.regexp_extract("_metadata.file_name", r"seed(\d+)", 1).try_cast("int")
    return spark.read.schema(SPLITS).csv(pattern, header=True).withColumn("split_seed", seed)


def score_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file_base, time, score`` of all score files, read once."""
    return spark.read.schema(SCORES).csv(folder, header=True, pathGlobFilter="*.csv").select(base_name(F.col("_metadata.file_path")).alias("file_base"), "time", "score")


def resolved_names(records: DataFrame, files: DataFrame, record: str = "record_id", file_base: str = "file_base") -> DataFrame:
    """``record, file_base``: of each record the first candidate name that exists; a record
    without any is left out."""
    name = F.col(record)
    short = F.when(name.endswith(DENOISED), F.replace(name, F.lit(DENOISED), F.lit("")))
    candidates = F.array(name, F.concat(name, F.lit("_topk")), short, F.concat(short, F.lit("_topk")))
    d = records.select(name, F.posexplode(candidates).alias("priority", file_base)).where(F.col(file_base).isNotNull())
    d = d.join(files.select(file_base).distinct(), file_base)
    first = Window.partitionBy(record).orderBy("priority")
    return d.withColumn("rn", F.row_number().over(first)).where("rn = 1").select(record, file_base)


def write_bag_cache(bags: DataFrame, folder: str) -> None:
    """JSON lines, a folder for each split seed and split."""
    bags.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").partitionBy("seed", "split").json(folder)


def read_bag_cache(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BAG_CACHE).json(folder)


def write_records(tables: dict[str, DataFrame], folder: str) -> None:
    """The record's parts as tables, each in a folder of its own; segments apart by lead."""
    for name, table in tables.items():
        parted = ["lead"] if name == "segments" and "lead" in table.columns else []
        table.write.mode("overwrite").partitionBy(*parted).parquet(f"{folder}/{name}")


def read_records(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables that :func:`write_records` wrote, by its schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def write_record_list(records: DataFrame, path: str, name: str = "record_name") -> None:
    """A record list: a CSV file of names with a header; written in parts."""
    records.select(F.col(name).cast("string").alias(name)).write.mode("overwrite").csv(path, header=True)


def read_record_list(spark: SparkSession, path: str, name: str = "record_name") -> DataFrame:
    return spark.read.schema(f"{name} string").csv(path, header=True)


def listed_records(spark: SparkSession, path: str, generate: Callable[[], DataFrame]) -> DataFrame:
    """The record list at ``path``; where there is none, ``generate`` makes it first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        write_record_list(generate(), path)
    return read_record_list(spark, path)


def nested_records(records: DataFrame, segments: DataFrame, key: str = "record_id") -> DataFrame:
    """Each record with its segments as an ordered array of structs; none is an empty array."""
    rows = F.struct("seg_index", *(c for c in segments.columns if c not in (key, "seg_index")))
    grouped = segments.groupBy(key).agg(F.sort_array(F.collect_list(rows)).alias("segments"))
    joined = records.join(grouped, key, "left")
    return joined.withColumn("segments", F.coalesce("segments", F.array().cast(grouped.schema["segments"].dataType)))
