"""CSV and JSON-lines sources that tell broken rows apart.

A row that cannot be read by the schema is neither dropped nor turned into nulls: it goes, with its
file and its text, to a table of rejects beside the rows.  Rows that can be read but break a rule
of their source (a label that is no number, a score that is none) go there with the rule's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BAG_CACHE, META, SPLITS
from .files import base_name

BROKEN, FILE = "__broken", "__file"


class Checked:
    """Rows of a source, and what was rejected of it: ``file, reason, row``.

    ``rules`` name conditions that every row must meet; null counts as broken.  The first rule that a row breaks is its
    reason; what the schema cannot read is ``unreadable``."""

    def __init__(self, read: DataFrame, rules: dict[str, Column]):
        reason = F.when(F.col(BROKEN).isNotNull(), F.lit("unreadable"))
        for name, holds in rules.items():
            reason = reason.when(~F.coalesce(holds, F.lit(False)), F.lit(name))
        self._marked = read.withColumn("__reason", reason)
        self._columns = [c for c in read.columns if c not in (BROKEN, FILE)]

    @property
    def rows(self) -> DataFrame:
        return self._marked.where("__reason is null").select(*self._columns)

    @property
    def rejects(self) -> DataFrame:
        text = F.coalesce(BROKEN, F.to_json(F.struct(*self._columns)))
        return self._marked.where("__reason is not null").select(F.col(FILE).alias("file"), F.col("__reason").alias("reason"), text.alias("row"))


def _reader(spark: SparkSession, schema: str):
    # columns are not pruned: a row is broken or not whatever columns are wanted
    return spark.read.schema(f"{schema}, {BROKEN} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).option("columnPruning", "false")


def _with_file(read: DataFrame) -> DataFrame:
    return read.withColumn(FILE, base_name(F.col("_metadata.file_path")))


def checked_csv(spark: SparkSession, path: str, schema: str, rules: dict[str, Column] | None = None) -> Checked:
    return Checked(_with_file(_reader(spark, schema).option("header", "true").csv(path)), rules or {})


def checked_json(spark: SparkSession, path: str, schema: str, rules: dict[str, Column] | None = None, base: str | None = None) -> Checked:
    """``base`` is the folder below which folders' names are columns, where ``path`` is but one of them."""
    reader = _reader(spark, schema)
    return Checked(_with_file((reader.option("basePath", base) if base else reader).json(path)), rules or {})


def checked_metadata(spark: SparkSession, path: str) -> Checked:
    """The metadata summary; every row names its file and its label."""
    return checked_csv(spark, path, META, {"no file": F.length("File") > 0, "label": F.col("Label").isin(0, 1)})


def checked_splits(spark: SparkSession, pattern: str) -> Checked:
    """Split rows of all seeds, distinct, with the seed that their file or folder is named after and a numeric label.

    A path without files is an error."""
    seed = F.regexp_extract("_metadata.file_path", r"seed(\d+)[^/]*(?:/[^/]*)?$", 1).try_cast("int")
    read = _with_file(_reader(spark, SPLITS).option("header", "true").csv(pattern).withColumn("split_seed", seed))
    rules = {"no seed": F.col("split_seed").isNotNull(), "split": F.col("split").isin("train", "val", "test"), "label": F.col("label").try_cast("int").isNotNull()}
    return Checked(read.withColumn("label", F.trim("label")), rules)


def distinct_splits(checked: Checked) -> DataFrame:
    rows = checked.rows.dropDuplicates(["PID", "file_path", "split", "label", "split_seed"])
    return rows.withColumn("label", F.col("label").cast("int"))


def checked_bags(spark: SparkSession, folder: str, base: str | None = None) -> Checked:
    """Bag rows of all caches in a folder; every bag has a file, a label and keys."""
    return checked_json(spark, folder, BAG_CACHE, {"no file": F.col("file_path").isNotNull(), "label": F.col("label").isNotNull(), "no keys": F.col("selected_keys").isNotNull()}, base)
