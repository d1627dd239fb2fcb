"""Signal quality of leads and similarity of beats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, z_normalised
from ..functions.ranges import lagged

STATISTICS = ("nan_ratio", "amp_mean", "amp_std", "amp_skewness", "amp_kurtosis")


def _present(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def signal_statistics(samples: DataFrame, keys: list[str], value: str, dummy: bool = False) -> DataFrame:
    """Share of missing samples, mean, population deviation, and biased skewness and excess
    kurtosis of the others, from one row per sample; 0 where undefined, or nulls if ``dummy``."""
    if dummy:
        return samples.select(*keys).distinct().select(*keys, *(F.lit(None).cast("double").alias(s) for s in STATISTICS))
    x = _present(F.col(value).cast("double"))
    zero = lambda c: F.coalesce(_present(c), F.lit(0.0))
    return samples.groupBy(*keys).agg(
        (1 - F.count(x) / F.count(F.lit(1))).alias("nan_ratio"), zero(F.avg(x)).alias("amp_mean"), zero(F.stddev_pop(x)).alias("amp_std"),
        zero(F.skewness(x)).alias("amp_skewness"), zero(F.kurtosis(x)).alias("amp_kurtosis"),
    )


def array_statistics(segments: DataFrame, samples: str) -> DataFrame:
    """The same from one row per segment, by folds over its array; no row is multiplied."""
    clean = F.filter(F.transform(samples, lambda v: v.cast("double")), lambda v: v.isNotNull() & ~F.isnan(v))
    d = segments.withColumn("__x", clean).withColumn("__n", F.size("__x"))
    mean = F.when(F.col("__n") > 0, F.aggregate("__x", F.lit(0.0), lambda s, v: s + v) / F.col("__n"))
    d = d.withColumn("__mean", mean)
    moment = lambda p: F.aggregate("__x", F.lit(0.0), lambda s, v: s + F.pow(v - F.col("__mean"), F.lit(float(p)))) / F.col("__n")
    some = F.col("__n") > 0
    d = d.withColumns({f"__m{p}": F.when(some, moment(p)) for p in (2, 3, 4)})
    varied = F.col("__m2") > 0
    out = {
        "nan_ratio": F.when(F.size(samples) > 0, 1 - F.col("__n") / F.size(samples)).otherwise(0.0), "amp_mean": F.coalesce("__mean", F.lit(0.0)), "amp_std": F.coalesce(F.sqrt("__m2"), F.lit(0.0)),
        "amp_skewness": F.when(varied, F.col("__m3") / F.pow("__m2", F.lit(1.5))).otherwise(0.0), "amp_kurtosis": F.when(varied, F.col("__m4") / (F.col("__m2") * F.col("__m2")) - 3).otherwise(0.0),
    }
    return d.withColumns(out).drop("__x", "__n", "__mean", "__m2", "__m3", "__m4")


def resampled(x: Column, length: int) -> Column:
    """The array at ``length`` evenly spaced places from its first to its last element, linear between them."""
    at = lambda i: i * (F.size(x) - 1) / F.lit(float(max(1, length - 1)))
    value = lambda k: F.coalesce(F.get(x, k.cast("int")).cast("double"), F.lit(0.0))
    between = lambda p: value(F.floor(p)) * (1 - (p - F.floor(p))) + value(F.floor(p) + 1) * (p - F.floor(p))
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: between(at(i))))


def normalised_beat(samples: Column, length: int | None = None) -> Column:
    """The beat brought to ``length``, with mean 0 and deviation 1; zeros if it is constant, null, or
    has a missing sample."""
    whole = F.coalesce(~F.exists(samples, lambda v: v.isNull() | F.isnan(v)) & (F.size(samples) > 0), F.lit(False))
    x = resampled(samples, length) if length else samples
    n = F.lit(length) if length else F.coalesce(F.greatest(F.size(samples), F.lit(0)), F.lit(0))
    return F.when(whole, z_normalised(x)).otherwise(F.array_repeat(F.lit(0.0), n))


def beat_pairs(beats: DataFrame, keys: list[str], order: str, samples: str, length: int | None = None) -> DataFrame:
    """``keys, order, beat, before``: each beat, normalised, with the one before it (null for the
    first), in groups of any size."""
    d = beats.select(*keys, order, normalised_beat(F.col(samples), length).alias("beat"))
    return lagged(d, keys, [order], {"before": "beat"})


def _mean_of_pairs(pairs: DataFrame, keys: list[str], figure: Column, name: str) -> DataFrame:
    """The figure's mean over the pairs of each group with more than three beats; null without any."""
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.avg(figure).alias(name)).where("__n > 3").drop("__n")


def beat_correlation(beats: DataFrame, keys: list[str], order: str, samples: str, length: int | None = None) -> DataFrame:
    """Mean Pearson correlation of consecutive beats; pairs with a beat of zeros have none."""
    r = F.try_divide(dot(F.col("beat"), F.col("before")), F.size("beat"))
    constant = (dot(F.col("beat"), F.col("beat")) == 0) | (dot(F.col("before"), F.col("before")) == 0)
    return _mean_of_pairs(beat_pairs(beats, keys, order, samples, length), keys, F.when(~constant, r), "bs_corr")


def warping_distance(a: Column, b: Column) -> Column:
    """Dynamic time warping cost of two arrays where a diagonal step counts twice; null for an empty
    one.  A fold over the anti-diagonals: a cell's neighbours are in the last two."""
    n, m, inf = F.size(a), F.size(b), F.lit(float("inf"))
    cost = lambda i, j: F.abs(F.get(a, i) - F.get(b, j))
    seats = F.sequence(F.lit(0), n - 1)
    start = F.struct(F.transform(seats, lambda i: F.when(i == 0, cost(i, F.lit(0))).otherwise(inf)).alias("last"), F.array_repeat(inf, n).alias("last2"))

    def cell(s: Column, d: Column, i: Column) -> Column:
        beside = F.least(F.get(s["last"], i), F.get(s["last"], i - 1)) + cost(i, d - i)
        return F.when((i > d) | (d - i >= m), inf).otherwise(F.least(beside, F.get(s["last2"], i - 1) + 2 * cost(i, d - i)))

    def step(s: Column, d: Column) -> Column:
        return F.struct(F.transform(seats, lambda i: cell(s, d, i)).alias("last"), s["last"].alias("last2"))

    diagonals = F.when(n + m > 2, F.sequence(F.lit(1), n + m - 2)).otherwise(F.array().cast("array<int>"))
    return F.when((n > 0) & (m > 0), F.aggregate(diagonals, start, step, lambda s: F.get(s["last"], n - 1)))


def beat_dtw(beats: DataFrame, keys: list[str], order: str, samples: str, fixed_length: int) -> DataFrame:
    """Mean warping distance of consecutive beats, each brought to the fixed length, over it."""
    pairs = beat_pairs(beats, keys, order, samples, fixed_length)
    return _mean_of_pairs(pairs, keys, warping_distance(F.col("beat"), F.col("before")) / fixed_length, "bs_dtw")
