"""Grids of settings, and run rows aggregated with confidence intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grouped import null_safe_join

#: The sampling grid.
KS, RADII, GRID_FILLS = (20, 60, 100, 140, 180), (0, 1, 2), ("normal", "duplicate", "half", "slike")
Z95 = 1.96


def _values(spark: SparkSession, name: str, values: list) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.posexplode(F.array(*map(F.lit, values))).alias(f"{name}_no", name))


def sampling_grid(spark: SparkSession, ks=KS, radii=RADII, fills=GRID_FILLS) -> DataFrame:
    """Every setting, numbered in the order k, radius, fill; a few dozen rows."""
    grid = _values(spark, "k", list(ks)).crossJoin(_values(spark, "radius", list(radii))).crossJoin(_values(spark, "fill", list(fills)))
    number = F.row_number().over(Window.orderBy("k_no", "radius_no", "fill_no")) - 1
    return grid.select(number.alias("config_id"), "k", "radius", "fill")


def experiment_grid(configs: DataFrame, factors: list[int], seg_seeds: list[int], split_seeds: DataFrame, models: list[str]) -> DataFrame:
    spark = configs.sparkSession
    grid = configs.crossJoin(_values(spark, "upsample_factor", factors)).crossJoin(_values(spark, "seg_seed", seg_seeds)).crossJoin(split_seeds).crossJoin(_values(spark, "model", models))
    return grid.drop("upsample_factor_no", "seg_seed_no", "model_no")


def _interval(metric: str, n: str) -> list[Column]:
    clean = F.when(~F.isnan(metric), F.col(metric))  # a missing metric counts as a run all the same
    mean, std = F.avg(clean), F.coalesce(F.stddev_samp(clean), F.lit(0.0))
    half = Z95 * std / F.greatest(F.lit(1.0), F.sqrt(F.count(F.lit(1)).cast("double")))
    return [F.round(x, 4).alias(f"{metric}_{name}") for name, x in (("mean", mean), ("std", std), ("ci95_lo", mean - half), ("ci95_hi", mean + half))]


def aggregate_runs(runs: DataFrame, keys: list[str], metrics: list[str], n: str) -> DataFrame:
    """Number of runs, and each metric's mean, sample deviation (0 for one run) and 95 % interval.

    Rows with a null key are no group."""
    whole = runs.dropna(subset=keys)
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), *(c for m in metrics for c in _interval(m, n))).orderBy(*keys)


def run_moments(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """What aggregates of runs can be merged from: of each group the number of runs, and of each metric
    the number of values, their mean and their sum of squares about it.  Null keys are groups."""
    figures = [F.count(F.lit(1)).alias("runs")]
    for m in metrics:
        x = F.when(~F.isnan(m), F.col(m).cast("double"))
        n, mean = F.count(x), F.coalesce(F.avg(x), F.lit(0.0))
        figures.append(F.struct(n.alias("n"), mean.alias("mean"), (F.coalesce(F.var_pop(x), F.lit(0.0)) * n).alias("m2")).alias(m))
    return runs.groupBy(*keys).agg(*figures)


def merged_moments(parts: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Moments of the union of all parts of each group: means first, then squares about them."""
    weigh = lambda m: F.coalesce(F.try_divide(F.sum(F.col(m)["n"] * F.col(m)["mean"]), F.sum(F.col(m)["n"]).cast("double")), F.lit(0.0))
    means = parts.groupBy(*keys).agg(*(weigh(m).alias(f"__{m}") for m in metrics))
    d = null_safe_join(parts, means, keys)
    figures = [F.sum("runs").alias("runs")]
    for m in metrics:
        gap = F.col(m)["mean"] - F.col(f"__{m}")
        figures.append(F.struct(F.sum(F.col(m)["n"]).alias("n"), F.first(f"__{m}").alias("mean"), F.sum(F.col(m)["m2"] + F.col(m)["n"] * gap * gap).alias("m2")).alias(m))
    return d.groupBy(*keys).agg(*figures)


def moments_report(moments: DataFrame, keys: list[str], metrics: list[str], n: str) -> DataFrame:
    """The same table as :func:`aggregate_runs` makes of the runs themselves."""
    columns = [F.col("runs").alias(n)]
    for m in metrics:
        x, count = F.col(m), F.col("runs").cast("double")
        mean = F.when(x["n"] > 0, x["mean"])
        std = F.when(x["n"] > 1, F.sqrt(x["m2"] / (x["n"] - 1))).otherwise(0.0)
        half = Z95 * std / F.greatest(F.lit(1.0), F.sqrt(count))
        columns += [F.round(v, 4).alias(f"{m}_{name}") for name, v in (("mean", mean), ("std", std), ("ci95_lo", mean - half), ("ci95_hi", mean + half))]
    return moments.dropna(subset=keys).select(*keys, *columns)


def two_level_aggregates(runs: DataFrame, keys: list[str], split_key: str, metrics: list[str]) -> DataFrame:
    """Both levels, with and without the split key, in one pass over grouping sets."""
    whole = runs.dropna(subset=[*keys, split_key])
    sets = [[F.col(k) for k in [*keys, split_key]], [F.col(k) for k in keys]]
    return whole.groupingSets(sets, *keys, split_key).agg(F.grouping(split_key).cast("int").alias("rolled_up"), F.count(F.lit(1)).alias("n_runs"), *(c for m in metrics for c in _interval(m, "n_runs")))


def summary(per_run: DataFrame, per_split: DataFrame, overall: DataFrame) -> DataFrame:
    """All three shapes under one another, tagged."""
    tagged = [d.withColumn("summary_type", F.lit(t)) for t, d in (("segseed", per_split), ("overall", overall), ("per_run", per_run))]
    return tagged[0].unionByName(tagged[1], allowMissingColumns=True).unionByName(tagged[2], allowMissingColumns=True)


def append_runs(runs: DataFrame, path: str, decimals: int = 4) -> None:
    """Adds run rows to the log; doubles are rounded."""
    doubles = {c: F.round(c, decimals) for c, t in runs.dtypes if t == "double"}
    runs.withColumns(doubles).write.mode("append").parquet(path)


def overwrite(table: DataFrame, path: str) -> None:
    """Aggregates are written anew each time."""
    table.write.mode("overwrite").parquet(path)
