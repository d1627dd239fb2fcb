"""Figures of groups, and the rows of groups, where one group may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def fresh(name: str, *taken: DataFrame) -> str:
    """The name, or one like it that no column of the tables has."""
    held = {c.lower() for d in taken for c in d.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def null_safe_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``; null keys meet."""
    names = {k: fresh(f"__key_{i}", rows, table) for i, k in enumerate(keys)}
    other = table.withColumnsRenamed(names)
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(other, same, how).drop(*names.values())


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], member: Column, nulls_meet: bool = False) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key; an inner join, in which
    null keys are lost unless ``nulls_meet``.

    The rows of a key are dealt by ``member`` over as many salts as there are tasks, and a row of
    ``table`` goes to no more salts than its key has."""
    salt = F.pmod(F.xxhash64(member), F.lit(parallelism(rows.sparkSession))).cast("int")
    name = fresh("__salt", rows, table)
    salted = rows.withColumn(name, salt)
    wanted = salted.select(*keys, name).distinct()
    if nulls_meet:
        return null_safe_join(salted, null_safe_join(wanted, table, keys), [*keys, name]).drop(name)
    return salted.join(wanted.join(table, keys), [*keys, name]).drop(name)
