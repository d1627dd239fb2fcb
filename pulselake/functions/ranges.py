"""Rows of groups in order, where one group may hold any share of all rows.

No group is ordered by one task.  Spark's range partitioner deals the rows out by group and order,
so that a large group is cut into ranges; each row is written with its place, which is its range
and its position there.  What a range needs of those before it (how many rows, their sums, the
last row) is one row for each group and range.

Repeated rows may be cut anywhere; nulls in the keys are a group of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .grouped import null_safe_join, parallelism

PLACE, RANGE = "__place", "__range"
#: monotonically_increasing_id counts a partition's rows in its lower bits.
_BITS = 33


def placed(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "ranges") -> DataFrame:
    """``rows`` with ``__range`` and ``__place``, written: by keys and then by order, places rise, and
    a range is what one task wrote."""
    by = [*keys, *order]
    n = parallelism(rows.sparkSession)
    d = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(PLACE, F.monotonically_increasing_id())
    return written(d.withColumn(RANGE, F.shiftright(PLACE, _BITS).cast("int")), name)


def _before(parts: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """``parts``, a row for each group and range, with the sums of columns over the ranges before."""
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({new: F.coalesce(F.sum(old).over(earlier), F.lit(0).cast(parts.schema[old].dataType)) for new, old in names.items()})


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str, keep_place: bool = False) -> DataFrame:
    """``rows`` with ``name``: each row's number within its group, from 1 on."""
    d = placed(rows, keys, order)
    parts = d.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("__n"), F.min(PLACE).alias("__first"))
    starts = _before(parts, keys, {"__start": "__n"}).select(*keys, RANGE, "__start", "__first")
    d = null_safe_join(d, starts, [*keys, RANGE])
    d = d.withColumn(name, (F.col("__start") + F.col(PLACE) - F.col("__first") + 1).cast("long")).drop("__start", "__first")
    return d if keep_place else d.drop(PLACE, RANGE)


def running_sums(rows: DataFrame, keys: list[str], order: Column | str, names: list[str]) -> DataFrame:
    """``rows`` with ``before_<name>``: the sum of each name over the rows before, as doubles."""
    d = placed(rows, keys, [order])
    parts = d.groupBy(*keys, RANGE).agg(*(F.sum(F.col(n).cast("double")).alias(f"__{n}") for n in names))
    starts = _before(parts, keys, {f"__before_{n}": f"__{n}" for n in names}).drop(*(f"__{n}" for n in names))
    d = null_safe_join(d, starts, [*keys, RANGE])
    inside = Window.partitionBy(*keys, RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"before_{n}": F.col(f"__before_{n}") + F.coalesce(F.sum(F.col(n).cast("double")).over(inside), F.lit(0.0)) for n in names}
    return d.withColumns(sums).drop(PLACE, RANGE, *(f"__before_{n}" for n in names))


def lagged(rows: DataFrame, keys: list[str], order: list[Column | str], columns: dict[str, str]) -> DataFrame:
    """``rows`` with columns of the row before within the group: new name to old name; null for the
    first.  A range's last row is carried to the next range of its group."""
    d = placed(rows, keys, order)
    kept = {f"__last_{new}": old for new, old in columns.items()}
    lasts = d.groupBy(*keys, RANGE).agg(F.max_by(F.struct(*(F.col(old).alias(new) for new, old in kept.items())), PLACE).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy(RANGE)
    lasts = lasts.withColumn("__carried", F.lag("__last").over(earlier)).select(*keys, RANGE, "__carried")
    inside = Window.partitionBy(*keys, RANGE).orderBy(PLACE)
    d = null_safe_join(d, lasts, [*keys, RANGE]).withColumn("__first", F.row_number().over(inside) == 1)
    back = {new: F.when(F.col("__first"), F.col("__carried")[f"__last_{new}"]).otherwise(F.lag(old).over(inside)) for new, old in columns.items()}
    return d.withColumns(back).drop(PLACE, RANGE, "__carried", "__first")
