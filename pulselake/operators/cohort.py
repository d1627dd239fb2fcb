"""Record metadata, splits and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_rows(meta: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is null or NaN."""
    return meta.dropna(subset=columns)


def z_scores(meta: DataFrame, features: list[str], fit_on: Column | None = None) -> DataFrame:
    """Each feature less its mean, over its sample deviation; null where that is zero.

    Mean and deviation are over all rows, or those where ``fit_on`` holds."""
    fit = meta.where(fit_on) if fit_on is not None else meta
    stats = fit.agg(*(f(c).alias(f"__{n}_{c}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_samp))))
    joined = meta.crossJoin(F.broadcast(stats))  # one row
    scaled = {c: F.try_divide(F.col(c) - F.col(f"__mean_{c}"), F.nullif(F.col(f"__std_{c}"), F.lit(0.0))) for c in features}
    return joined.withColumns(scaled).select(*meta.columns)


def label_codes(meta: DataFrame, column: str, into: str) -> DataFrame:
    """Codes 0, 1, ... of the column's values in sorted order, from its distinct values alone."""
    codes = meta.select(column).where(F.col(column).isNotNull()).distinct()
    codes = codes.withColumn(into, F.dense_rank().over(Window.orderBy(column)) - 1)
    return meta.join(codes, column, "left")


def last_row(meta: DataFrame, key: str, position: str) -> DataFrame:
    """Of rows with the same key, the one that comes last."""
    newest = Window.partitionBy(key).orderBy(F.desc(position))
    return meta.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn")


def with_vector(rows: DataFrame, vectors: DataFrame, key: str, width: int) -> DataFrame:
    """Each row with its vector, or zeros of the same width."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return rows.join(vectors, key, "left").withColumn("vector", F.coalesce("vector", zeros))


def split_rows(splits: DataFrame, split: str) -> DataFrame:
    """Distinct whole rows of a split, the label as a whole number."""
    return splits.dropDuplicates().where(F.col("split") == split).withColumn("label", F.expr("try_cast(label as int)"))


def positive_weight(rows: DataFrame, label: str, keys: list[str], cap: float = 20.0, fallback: float = 15.0) -> DataFrame:
    """Counts of each class and min(negatives / positives, cap); the fallback, and ratio 0, if a
    class is missing."""
    d = rows.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) != 1).alias("n_neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    weight = F.when(both, F.least(F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos").cast("double")), F.lit(cap))).otherwise(F.lit(fallback))
    ratio = F.when(both, F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).otherwise(F.lit(0.0))
    return d.withColumn("pos_weight", weight).withColumn("pos_ratio", ratio)
