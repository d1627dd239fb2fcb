"""A class-weighted binary classifier on pooled vectors, by distributed Newton steps.

Each step is one job over all runs' rows: tasks add up every run's gradient and Hessian, which are
summed as rows of (run, place, value); a small system of equations for each run is solved on the driver.
What it holds is a few numbers for each run and feature, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import sigmoid
from ..functions.grouped import null_safe_join
from ..shipping import ship
from ..sources.shared import written
from .cohort import positive_weight

#: Runs that are fitted in one job; more come in several.
RUNS = 1000
PENALTY, TOLERANCE = 0.01, 1e-9


def _summed(rows: DataFrame, figures: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray], width: int) -> dict[int, np.ndarray]:
    """Of each run the sum of ``figures(run, x, y, w)`` over its rows."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            run, y, w = (batch.column(k).to_numpy() for k in range(3))
            x = np.column_stack((np.ones(len(y)), batch.column(3).flatten().to_numpy().reshape(len(y), width)))
            for r in np.unique(run).tolist():
                here = run == r
                total[r] = total.get(r, 0) + figures(r, x[here], y[here], w[here])
        for r, values in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([r] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["run", "place", "value"])

    sums = rows.mapInArrow(add_up, "run int, place int, value double").groupBy("run", "place").agg(F.sum("value").alias("value")).toArrow()
    run, place, value = (sums.column(k).to_numpy() for k in range(3))
    return {r: value[run == r][np.argsort(place[run == r])] for r in np.unique(run).tolist()}


def newton_coefficients(rows: DataFrame, width: int, penalty: float = PENALTY, iterations: int = 25) -> dict[int, np.ndarray]:
    """Intercept and coefficients of each run, from rows of ``run, y, w, x``.

    The penalty is on features scaled to unit deviation (weighted, unbiased), the loss a weighted
    mean; a step that does not lower a run's objective is halved."""

    def moments(_: int, x: np.ndarray, __: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.concatenate(([w.sum(), (w * w).sum()], w @ x[:, 1:], w @ x[:, 1:] ** 2))

    scales, weights = {}, {}
    for r, m in _summed(rows, moments, width).items():
        mean, square = m[2 : 2 + width] / m[0], m[2 + width :] / m[0]
        deviation = np.sqrt(np.maximum(0.0, square - mean * mean) * m[0] / max(m[0] - m[1] / m[0], 1e-300))
        scales[r], weights[r] = np.where(deviation > 0, deviation, np.inf), m[0]  # a constant feature counts for nothing
    pull = np.concatenate(([0.0], np.full(width, penalty)))
    beta = {r: np.zeros(width + 1) for r in scales}
    step = {r: np.zeros(width + 1) for r in scales}
    lowest = {r: np.inf for r in scales}
    settled: set[int] = set()
    for _ in range(iterations):
        now = {r: (b, np.concatenate(([1.0], 1 / scales[r]))) for r, b in beta.items() if r not in settled}
        if not now:
            break

        def derivatives(r: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, now: dict = now) -> np.ndarray:
            if r not in now:
                return np.zeros(0)
            b, scale = now[r]
            z = x * scale
            t = np.clip(z @ b, -700, 700)
            p = 1 / (1 + np.exp(-t))
            loss = w @ (np.logaddexp(0, t) - y * t)
            return np.concatenate(([loss], z.T @ (w * (y - p)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()))

        for r, d in _summed(rows, derivatives, width).items():
            if r not in now:
                continue
            objective = d[0] / weights[r] + (pull * beta[r] ** 2).sum() / 2
            if objective > lowest[r] + 1e-12:
                step[r] = step[r] / 2
                beta[r] = beta[r] - step[r]
                continue
            lowest[r] = objective
            hessian = d[width + 2 :].reshape(width + 1, width + 1) / weights[r] + np.diag(pull)
            dead = np.concatenate(([False], np.isinf(scales[r])))
            hessian[dead, dead] = 1.0
            step[r] = np.linalg.lstsq(hessian, d[1 : width + 2] / weights[r] - pull * beta[r], rcond=None)[0]
            beta[r] = beta[r] + step[r]
            if np.abs(step[r]).max() < TOLERANCE:
                settled.add(r)
    return {r: b * np.concatenate(([1.0], 1 / scales[r])) for r, b in beta.items()}


def weighted_logistic(rows: DataFrame, keys: list[str], label: str, vector: str, iterations: int = 25, runs: list[str] = ()) -> DataFrame:
    """``runs, keys, y, p``: probabilities of a logistic regression for each run, whose positives weigh
    what :func:`positive_weight` says.

    All vectors of one width count; a row whose vector is null, has another width than the widest, or a missing
    element takes no part and has no probability.  Null runs are a run."""
    spark = rows.sparkSession
    ship(spark)
    runs = list(runs)
    x = F.transform(vector, lambda v: v.cast("double"))
    d = rows.select(*runs, *keys, F.when(F.col(label) == 1, 1.0).otherwise(0.0).alias("y"), x.alias("x"))
    width = d.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    whole = F.coalesce((F.size("x") == width) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)), F.lit(False))
    d = d.withColumn("x", F.when(whole, F.col("x")))
    weights = written(positive_weight(d.where("x is not null"), "y", runs).select(*runs, "pos_weight").withColumn("__run", F.monotonically_increasing_id()), "runs")
    d = null_safe_join(d, weights, runs, "left") if runs else d.crossJoin(F.broadcast(weights))  # one row
    d = written(d.select("__run", *runs, *keys, "y", F.when(F.col("y") == 1, F.col("pos_weight")).otherwise(1.0).alias("w"), "x"), "instances")
    numbers = sorted(r[0] for r in weights.select("__run").collect())  # one for each run
    found = []
    for at in range(0, len(numbers), RUNS):
        part = numbers[at : at + RUNS]
        number = F.create_map(*(F.lit(v) for k, r in enumerate(part) for v in (r, k)))
        fitted = newton_coefficients(d.where(F.col("__run").isin(part) & F.col("x").isNotNull()).select(number[F.col("__run")].alias("run"), "y", "w", "x"), width, iterations=iterations)
        found += [(part[k], b.tolist()) for k, b in fitted.items()]
    table = spark.createDataFrame(found, "__run long, b array<double>")
    d = d.join(F.broadcast(table) if len(found) * (width + 1) < 1_000_000 else table, "__run", "left")
    score = F.aggregate(F.zip_with("x", F.slice("b", 2, width), lambda v, b: v * b), F.element_at("b", 1), lambda s, t: s + t)
    return d.select(*runs, *keys, F.col("y").cast("int").alias("y"), F.when(F.col("x").isNotNull(), sigmoid(score)).alias("p"))
