"""The cache of bags: written for each split seed and split, and judged as a whole when read.

A cache serves if it is there, is not forced anew, has rows, its first row names the settings at
hand, all rows can be read and every bag has the wanted length.  Otherwise all of it is a miss.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checked import checked_bags


class Settings(NamedTuple):
    """What the first row of a cache must say; names as in the file."""

    method: str
    radius: int
    seg_per_record: int
    fill: str
    upsample_factor: int = 1


class CacheJudgement(NamedTuple):
    status: str  # valid, or why not: absent, forced, empty, settings, unreadable, length
    bags: DataFrame | None  # only of a valid one


def _path(folder: str, seed: int, split: str) -> str:
    return f"{folder}/seed={seed}/split={split}"


def write_one_cache(bags: DataFrame, folder: str, seed: int, split: str, settings: Settings) -> None:
    """Bags (``file_path, label, selected_keys``) of one split, as JSON lines that each say the settings."""
    said = {name: F.lit(value) for name, value in settings._asdict().items()}
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    bags.select("file_path", "label", "selected_keys").withColumns(said | {"created_at": stamp}).write.mode("overwrite").json(_path(folder, seed, split))


def _first_line(spark: SparkSession, folder: str) -> str | None:
    """The first line of the first file with any, in the order of names; None if there is no file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    found = sorted(str(s.getPath()) for s in files.listStatus(where) if s.isFile() and s.getLen() > 0 and not s.getPath().getName().startswith(("_", ".")))
    line = spark.read.text(found[0]).first() if found else None
    return line.value if line else ""


def judge_bag_cache(spark: SparkSession, folder: str, seed: int, split: str, settings: Settings, force: bool = False) -> CacheJudgement:
    """The bags cached for a split seed and split, or why they do not serve."""
    path = _path(folder, seed, split)
    line = _first_line(spark, path)
    if line is None:
        return CacheJudgement("absent", None)
    if force:
        return CacheJudgement("forced", None)
    if not line:
        return CacheJudgement("empty", None)
    try:
        first = {"upsample_factor": 1} | json.loads(line)
    except ValueError:
        return CacheJudgement("unreadable", None)
    if any(first.get(name) != value for name, value in settings._asdict().items()):
        return CacheJudgement("settings", None)
    checked = checked_bags(spark, path, base=folder)
    if not checked.rejects.isEmpty():
        return CacheJudgement("unreadable", None)
    if not checked.rows.where(F.size("selected_keys") != settings.seg_per_record).isEmpty():
        return CacheJudgement("length", None)
    return CacheJudgement("valid", checked.rows)


def load_or_make(spark: SparkSession, folder: str, seed: int, split: str, settings: Settings, make, force: bool = False) -> DataFrame:
    """The cached bags; on a miss, what ``make()`` gives (``file_path, label, selected_keys``) is cached first."""
    judged = judge_bag_cache(spark, folder, seed, split, settings, force)
    if judged.bags is None:
        write_one_cache(make(), folder, seed, split, settings)
        judged = judge_bag_cache(spark, folder, seed, split, settings)
    if judged.bags is None:
        raise ValueError(f"the bags made for {settings} do not serve: {judged.status}")
    return judged.bags
