"""Element-wise array expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where a lambda repeats it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def z_normalised(a: Column) -> Column:
    """Mean 0 and population deviation 1; a constant array becomes zeros."""
    n = F.size(a)
    spread = lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m)) / n)
    scaled = lambda m, d: F.when(d == 0, F.array_repeat(F.lit(0.0), n)).otherwise(F.transform(a, lambda x: (x.cast("double") - m) / d))
    return let(total(a) / n, lambda m: let(spread(m), lambda d: scaled(m, d)))


def pad_or_crop(a: Column, length: int) -> Column:
    """Exactly ``length`` elements: zeros on the right, or cut there."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), length)), 1, length)


def patches(a: Column, width: int = 16) -> Column:
    """Consecutive pieces of ``width``, the last one filled up with zeros."""
    n = F.ceil(F.size(a) / width).cast("int")
    padded = F.concat(a, F.array_repeat(F.lit(0.0), width))
    return F.when(n == 0, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(padded, i * width + 1, width)))


def matrix(a: Column, rows: int, columns: int) -> Column:
    """A flat array as ``rows`` arrays of ``columns``."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(a, i * columns + 1, columns))


def transposed(m: Column) -> Column:
    """Rows become columns."""
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda c: F.transform(m, lambda r: F.get(r, c)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
