"""Reproducible pseudo-random columns: seeds, orders and draws from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*items: Column | str | int) -> list[Column]:
    return [(i if isinstance(i, Column) else F.lit(i)).cast("string") for i in items]


def hash32(*items: Column | str | int, separator: str = "|") -> Column:
    """The first 8 hexadecimal digits of the items' SHA-256, as a number."""
    digest = F.sha2(F.concat_ws(separator, *_text(*items)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def stable_seed(*items: Column | str | int) -> Column:
    """A seed that depends on all items, joined by two vertical bars."""
    return hash32(*items, separator="||")


def hash_order(seed: Column, tag: str, key: Column) -> Column:
    """Sorting by this is a random order, the same on every run."""
    return F.sha2(F.concat_ws("|", *_text(seed, tag, key)), 256)
