"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random; its code is the signs of the rotated components, packed into
bits, and the correction factor stored beside it is the code's inner product with the rotated
vector.  Against another rotated vector q, the code's inner product with q over that factor is an
unbiased estimate of the cosine.  Its error has the standard deviation
sqrt(1 - f**2) / f * sin(angle) / sqrt(d - 1), so a pair at or above the threshold stays within
EPSILON of those with the sine at the threshold.  A record holds code, factor and the rotated
vector in 8 bits a component, all written once; vectors themselves are read again only for pairs
that the bounds leave.

Pairs come from buckets, so that no group is compared with the whole table: groups of sign bits
of further rotations are keys, each a bucket for every label.  Two vectors of cosine 0.98 or more
share a sign with probability 1 - acos(0.98) / pi or more, so they meet in none of the buckets
with a probability of at most MISS.  Within a bucket, pairs whose codes differ in more bits than
a pair at the threshold would, but for DIFFER, go at once, by bit counts; then those whose upper
bounds stay below the threshold.  The vectors of the others are compared exactly, in double
precision; a pair that meets in several buckets counts in the first.  Large buckets are dealt
into tile pairs.  Equal vectors of a label are one class with a count, so groups of copies are
never expanded.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows
without a label, link with nothing: n_links 0, their own component, kept.  A null vec_id stays
null and unlinked, kept.  Repeated rows are links of one another; rows of one vec_id with
different vectors or labels are vectors of their own.  Vectors of different lengths do not link.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Forest, discard, groups_of, labelled, lookup_left, staged, tiled

THRESHOLD = 0.98
#: The largest probability that a pair at the threshold meets in no bucket, and that its codes
#: differ in more bits than are let pass.
MISS, DIFFER = 1e-6, 1e-9
#: A bucket of vectors in random directions holds about so many; fewest bits of a bucket.
BUCKET, LEAST_BITS = 64, 10
#: Members of a tile, and the width of the bound in standard deviations of the estimate.
TILE, EPSILON = 1024, 6.0
SEED = 7


def rotation(dim: int, no: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, no]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def most_differing(dim: int, threshold: float) -> int:
    """Sign bits in which the codes of a pair at the threshold may differ, but for DIFFER."""
    p, above, most = math.acos(threshold) / math.pi, 1.0, -1
    while above > DIFFER and most < dim:
        most += 1
        above -= math.comb(dim, most) * p**most * (1 - p) ** (dim - most)
    return most


class Coder:
    """Codes, factors and bucket keys of unit vectors of one length."""

    def __init__(self, dim: int, bits: int, tables: int, threshold: float):
        self.dim, self.bits, self.tables, self.threshold = dim, bits, tables, threshold
        self.rotations = [rotation(dim, i) for i in range(1 + -(-bits * tables // dim))]
        self.most = most_differing(dim, threshold)
        self.words = -(-dim // 64)
        self.layout = np.dtype([("code", "<u8", (self.words,)), ("factor", "<f4"), ("step", "<f4"), ("turned", "i1", (dim,))])

    def keys(self, unit: np.ndarray) -> np.ndarray:
        signs = np.concatenate([unit @ r for r in self.rotations[1:]], axis=1)[:, : self.bits * self.tables] > 0
        return signs.reshape(len(unit), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))

    def records(self, unit: np.ndarray) -> np.ndarray:
        """Packed code, correction factor and the rotated vector in steps of a 127th of its largest component."""
        turned = unit @ self.rotations[0]
        signs = turned > 0
        bits = np.packbits(signs, axis=1, bitorder="little")
        out = np.zeros(len(unit), dtype=self.layout)
        wide = np.zeros((len(unit), 8 * self.words), dtype=np.uint8)
        wide[:, : bits.shape[1]] = bits
        out["code"] = wide.view("<u8")
        out["factor"] = np.maximum(np.abs(turned).sum(axis=1) / math.sqrt(self.dim), 1e-6)
        out["step"] = np.abs(turned).max(axis=1) / 127
        out["turned"] = np.rint(turned / out["step"][:, None])
        return out

    def estimate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimates of the cosines of pairs of records, row by row: a's codes on b's rotated vectors."""
        bits = np.unpackbits(a["code"].view(np.uint8).reshape(len(a), -1), axis=1, count=self.dim, bitorder="little")
        dot = np.where(bits, b["turned"], -b["turned"].astype(np.int16)).sum(axis=1, dtype=np.int32) * b["step"].astype(float)
        return dot / math.sqrt(self.dim) / a["factor"]

    def upper(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Upper confidence bounds that hold for pairs at or above the threshold; also for what the
        rounding to 8 bits may have taken."""
        factor, sine = a["factor"].astype(float), math.sqrt(1 - self.threshold**2)
        spread = np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor * sine / math.sqrt(max(1, self.dim - 1))
        return self.estimate(a, b) + b["step"] / 2 * math.sqrt(self.dim) / factor + EPSILON * spread

    def survivors(self, records: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which members of a tile pair have a partner in it that the bounds do not rule out."""
        two = own.min() != own.max()
        left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        alive = np.zeros(len(own), dtype=bool)
        code = records["code"]
        for a in range(0, len(left), 256):
            rows = left[a : a + 256]
            differ = sum(np.bitwise_count(code[rows, None, w] ^ code[None, right, w]).astype(np.uint16) for w in range(self.words))
            i, j = np.nonzero(differ <= self.most)
            i, j = rows[i], right[j]
            if not two:
                i, j = i[i < j], j[i < j]
            for b in range(0, len(i), 16384):
                x, y = i[b : b + 16384], j[b : b + 16384]
                p, q = records[x], records[y]
                near = (self.upper(p, q) >= self.threshold) & (self.upper(q, p) >= self.threshold)
                alive[x[near]] = alive[y[near]] = True
        return alive

    def links(self, unit: np.ndarray, own: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) of a tile pair with cosine at the threshold or above, in double precision,
        that meet in no table before this one.  If ``own`` holds two tiles, only pairs across them."""
        keys = self.keys(unit)[:, :table]
        two = own.min() != own.max()
        left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        found = [(np.zeros(0, np.int64),) * 2]
        for a in range(0, len(left), 256):
            rows = left[a : a + 256]
            i, j = np.nonzero(unit[rows] @ unit[right].T >= self.threshold - 1e-9)
            i, j = rows[i], right[j]
            if not two:
                i, j = i[i < j], j[i < j]
            for b in range(0, len(i), 65536):
                x, y = i[b : b + 65536], j[b : b + 65536]
                fresh = ~(keys[x] == keys[y]).any(axis=1)
                x, y = x[fresh], y[fresh]
                near = (unit[x] * unit[y]).sum(axis=1) >= self.threshold
                found.append((x[near], y[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_CODERS: dict[tuple, Coder] = {}


def coder(*shape) -> Coder:
    if shape not in _CODERS:
        _CODERS[shape] = Coder(*shape)
    return _CODERS[shape]


def bucket_shape(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a bucket for n vectors, and the number of tables."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, n / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their class, and the classes: ``no, rep, copies, label, x, same``."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), x.alias("x"))
    sound = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("x", lambda c: c != 0)
    d = d.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # -0.0 and 0.0 are the same component; the label's length parts it from the components
    d = d.withColumn("x", F.when(F.col("sound"), F.transform("x", lambda c: c + F.lit(0.0))))
    label = F.col("label").cast("string")
    text = F.concat(F.length(label), F.lit(":"), label, F.lit(":"), F.concat_ws(",", F.transform("x", lambda c: c.cast("string"))))
    d = d.withColumn("same", F.when(F.col("sound"), F.unhex(F.sha2(text, 256))))
    first = F.min_by(F.struct("label", "x"), "vec_id")
    classes = d.where("sound").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), first.alias("v"))
    classes = classes.select(F.monotonically_increasing_id().alias("no"), "rep", "copies", "v.label", "v.x", "same")
    return d.select("vec_id", "same"), classes


def deduplicate(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each vector."""
    rows, classes = _classes(vectors)
    reps = staged(classes, "vector-classes")
    bits, tables = bucket_shape(reps.count(), threshold)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, label, x = (batch.column(i) for i in range(3))
            dims = x.value_lengths().to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                c, take = coder(int(dim), bits, tables, threshold), pa.array(at)
                unit = _units(x.take(take))
                keys = pa.array(list(c.keys(unit)), pa.list_(pa.int64()))
                records = pa.array([r.tobytes() for r in c.records(unit)], pa.binary())
                yield pa.RecordBatch.from_arrays([no.take(take), label.take(take), pa.array(np.full(len(at), dim, np.int32)), keys, records], names=["no", "label", "dim", "keys", "record"])

    label = reps.schema["label"].dataType.simpleString()
    codes = staged(reps.select("no", "label", "x").mapInArrow(encode, f"no long, label {label}, dim int, keys array<long>, record binary"), "codes")
    members = codes.select("no", "label", "dim", "record", F.posexplode("keys").alias("table", "key"))
    members = members.withColumn("bucket", F.xxhash64("label", "dim", "table", "key"))
    group = ["bucket", "label", "dim", "table", "key"]
    keys = [*group, "tile_a", "tile_b"]

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, keys):
            own = g["tile_own"].to_numpy()
            if g["tile_a"][0].as_py() != g["tile_b"][0].as_py() and own.min() == own.max():
                continue
            c = coder(g["dim"][0].as_py(), bits, tables, threshold)
            alive = c.survivors(np.frombuffer(b"".join(g["record"].to_pylist()), dtype=c.layout), own)
            if alive.any():
                yield from g.select(["no", "tile_own", *keys]).filter(pa.array(alive)).combine_chunks().to_batches()

    place = f"no long, tile_own int, bucket long, label {label}, dim int, table int, key long, tile_a int, tile_b int"
    dealt = tiled(members, group, F.col("no"), TILE).repartition("bucket", "tile_a", "tile_b").sortWithinPartitions(*keys, "no")
    near = staged(dealt.mapInArrow(rule_out, place), "survivors")
    exact = near.join(reps.select("no", "copies", "x"), "no").repartition("bucket", "tile_a", "tile_b").sortWithinPartitions(*keys, "no")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, keys):
            unit, no, copies = _units(g["x"]), g["no"].to_numpy(), g["copies"].to_numpy()
            i, j = coder(g["dim"][0].as_py(), bits, tables, threshold).links(unit, g["tile_own"].to_numpy(), g["table"][0].as_py())
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(no)) + np.bincount(j, copies[i], len(no))
            forest = Forest(len(no))
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(x, y)
            out = [(int(no[k]), int(links[k]), None) for k in np.flatnonzero(links).tolist()] + [(int(no[y]), 0, int(no[x])) for x, y in forest.stars()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["no", "links", "other"])

    links = staged(exact.mapInArrow(link, "no long, links long, other long"), "links")
    discard(codes, near)
    counts = links.groupBy("no").agg(F.sum("links").alias("links"))
    found = labelled(reps.select("no", "rep", "copies", "same"), links.where("other is not null").select(F.col("no").alias("a"), F.col("other").alias("b")))
    found = found.join(counts, "no", "left").select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    component = F.coalesce("component", "vec_id")
    out = lookup_left(rows, found, ["same"], F.col("vec_id")).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
    result = staged(out, "vectors-linked")
    discard(reps, links)
    return result
