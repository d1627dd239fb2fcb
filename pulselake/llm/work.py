"""What the operators of this subpackage share: written stages, components, tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouped import fresh, lookup, parallelism
from ..sources.shared import shared_folder

__all__ = ["Forest", "components", "discard", "fresh", "groups_of", "labelled", "lookup", "lookup_left", "parallelism", "shared_folder", "staged", "tiled", "tiled_by_class", "with_groups"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as a table in the shared folder and read back: lineage ends there,
    and a lost executor costs no more than the stage at hand."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables from which nothing will be read any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, from batches that are sorted by integer or string ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1 within one task; ``join`` tells whether it made a new edge."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def stars(self) -> list[tuple[int, int]]:
        """Each tree as edges from its least member to every other one."""
        return [(r, i) for i in range(len(self.up)) if (r := self.root(i)) != i]


def lookup_left(rows: DataFrame, table: DataFrame, keys: list[str], member: Column) -> DataFrame:
    """Like ``lookup``, but as an outer join: rows without a key, or with one that is not there, stay."""
    salt = F.pmod(F.xxhash64(member), F.lit(parallelism(rows.sparkSession))).cast("int")
    salted = rows.withColumn("__salt", salt)
    wanted = salted.select(*keys, "__salt").distinct().join(table, keys)
    return salted.join(wanted, [*keys, "__salt"], "left").drop("__salt")


def with_groups(rows: DataFrame, group: list[str], member: Column, figures: list[Column], having: str) -> DataFrame:
    """``rows`` with figures of their group; the rows of other groups than ``having`` go."""
    return lookup(rows, rows.groupBy(*group).agg(*figures).where(having), group, member)


def tiled(members: DataFrame, group: list[str], member: Column, tile: int) -> DataFrame:
    """Deals each group into tile pairs ``(tile_a, tile_b)``, ``tile_a <= tile_b``, so that every
    two members of a group meet in exactly one tile pair, of ``2 * tile`` members or so.

    A group of at most ``tile`` members is one pair (0, 0).  Adds ``tile_own``; in a pair of two
    tiles only members of different tiles are to be compared.  Groups of one member go."""
    n = F.ceil(F.col("__m") / F.lit(tile)).cast("int")
    return (
        with_groups(members, group, member, [F.count(F.lit(1)).alias("__m")], "__m > 1")
        .withColumn("tile_own", F.pmod(F.xxhash64(member), n).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("tile_a", F.least("tile_own", "__other"))
        .withColumn("tile_b", F.greatest("tile_own", "__other"))
        .drop("__m", "__other")
    )


def tiled_by_class(members: DataFrame, group: list[str], member: Column, tile: int, weight: Column | None = None, most: int = 0) -> DataFrame:
    """The same where only members of different classes (column ``component``) are compared.

    The class with most members of a group is never compared with itself: the others are dealt
    into tile pairs among themselves, and each of their tiles meets each chunk of the large class
    as ``(tile, -1 - chunk)``; there ``tile_own`` is -1 for the large class.  So the work is the
    group's size times that of its other classes.  A tile holds ``tile`` members, or so many that
    their ``weight`` comes to ``most``, if that is fewer.  Groups of one class go."""
    weight = F.lit(0) if weight is None else weight
    classes = members.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("m"), F.sum(weight).alias("w"))
    largest = F.max(F.struct("m", "component", "w"))
    sizes = classes.groupBy(*group).agg((F.sum("m") - largest["m"]).alias("__few"), (F.sum("w") - largest["w"]).alias("__few_w"), largest.alias("__large")).where("__few > 0")
    d = lookup(members, sizes, group, member)
    number = lambda m, w: F.greatest(F.ceil(m / F.lit(tile)), F.ceil(w / F.lit(most)) if most else F.lit(1), F.lit(1)).cast("int")
    d = d.withColumn("__tiles", number(F.col("__few"), F.col("__few_w"))).withColumn("__chunks", number(F.col("__large.m"), F.col("__large.w")))
    d = d.withColumn("__in_large", F.col("component") == F.col("__large.component"))
    tiles, chunks = F.sequence(F.lit(0), F.col("__tiles") - 1), F.transform(F.sequence(F.lit(1), F.col("__chunks")), lambda c: -c)
    own = F.when(F.col("__in_large"), F.lit(-1)).otherwise(F.pmod(F.xxhash64(member), "__tiles")).cast("int")
    chunk = (-1 - F.pmod(F.xxhash64(member), "__chunks")).cast("int")
    d = d.withColumn("tile_own", own).withColumn("__other", F.explode(F.when(F.col("__in_large"), tiles).otherwise(F.concat(tiles, chunks))))
    here = F.when(F.col("__in_large"), F.struct(F.col("__other").alias("a"), chunk.alias("b")))
    here = here.when(F.col("__other") < 0, F.struct(F.col("tile_own").alias("a"), F.col("__other").alias("b")))
    here = here.otherwise(F.struct(F.least("tile_own", "__other").alias("a"), F.greatest("tile_own", "__other").alias("b")))
    d = d.withColumn("__here", here).withColumn("tile_a", F.col("__here.a")).withColumn("tile_b", F.col("__here.b"))
    return d.drop("__few", "__few_w", "__large", "__tiles", "__chunks", "__in_large", "__other", "__here")


def _are_stars(edges: DataFrame) -> bool:
    """Every upper end has one lower end, which is no upper end itself."""
    ends = edges.select(F.col("b").alias("node"), "a").union(edges.select("a", F.lit(None).cast("long")))
    roles = ends.groupBy("node").agg(F.min("a").alias("least"), F.max("a").alias("most"), F.bool_or(F.col("a").isNull()).alias("lower"))
    return roles.where("least <> most or (lower and least is not null)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``, the smallest node that each node of ``edges(a, b)`` reaches.

    Alternates large-star and small-star steps until the edges are stars, each around the smallest
    node of its component.  A step keeps at most one row for each edge and is written, so that
    none is computed twice; the edges of a node of high degree are dealt over salts."""
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = with_groups(both, ["u"], F.col("v"), [F.least(F.min("v"), F.col("u")).alias("m")], "true").where("v > u")
        large = staged(large.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "large-star")
        # small star: from each node to its lower neighbours and itself; (a, b) has a < b
        small = with_groups(large, ["b"], F.col("a"), [F.min("a").alias("m")], "true")
        small = small.select(F.col("m").alias("a"), F.col("b").alias("b")).union(small.select("m", "a"))
        last, edges = edges, staged(small.where("a <> b").distinct(), "small-star")
        discard(last, large)
    found = edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    found.staged_at = edges.staged_at
    return found


def labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (``no``, ``rep``, others) with ``component``: the smallest ``rep`` that each
    reaches over ``links`` between their numbers."""
    parts = components(links)
    least = parts.join(classes.select(F.col("no").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    found = lookup(parts, least, ["component"], F.col("node")).select(F.col("node").alias("no"), "least")
    out = staged(classes.join(found, "no", "left").withColumn("component", F.coalesce("least", "rep")).drop("least"), "labelled")
    discard(parts)
    return out
