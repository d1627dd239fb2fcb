"""Exact top-k search by inner product of whole-number vectors.

Queries and candidates are laid out in tiles.  Each pair of a query tile and a candidate tile is
one matrix product, of which only each query's best k are kept; lists of FAN_IN tiles at a time
are merged until one list for each query is left.

Components become ``floor(64 * x)``.  A product is computed in double precision where no partial
sum can pass 2**53, which makes it exact, else with 64-bit integers; vectors whose products might
pass 64 bits are multiplied as whole numbers of any size, and their scores end at the 64-bit bounds.
A tile's candidates are scored BLOCK at a time, of which each query's best k so far are held.

Defined cases: a component beyond the largest double counts as that (so 1e300 takes part); vectors that are null or hold null or non-finite components take no part, nor do
rows without a vec_id; vectors of different lengths score over the components that both have;
rows that share a query's vec_id are the query's own; ties go to the smaller vec_id; an empty
table has no result.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import discard, groups_of, parallelism, staged

K, SCALE, QUERY_EVERY = 20, 64, 20
#: The largest tiles, in bytes of their numbers; fewest rows of a shard; lists that are merged at a time.
TILE_BYTES, LEAST_SHARD, FAN_IN = 16_000_000, 2048, 32
#: Candidates and queries that are multiplied at once.
BLOCK, QUERIES = 8192, 256
_LEAST, _MOST, _LARGEST = -(1 << 63), (1 << 63) - 1, 1.7976931348623157e308


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: the rows that take part."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    d = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    # from 2**53 on a double is a whole number already
    whole = lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(F.greatest(F.least(c, F.lit(float(1 << 53))), F.lit(-float(1 << 53)))).cast("double")).otherwise(F.greatest(F.least(c, F.lit(_LARGEST)), F.lit(-_LARGEST)))
    return d.where(~F.coalesce(bad, F.lit(False)).eqNullSafe(True) & ~F.exists(F.col("x"), lambda c: c.isNull())).select(
        "vec_id", F.transform("x", lambda c: whole(c * SCALE)).alias("v")
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values, ends = flat.flatten().to_numpy(), flat.value_lengths().to_numpy()
    if len(set(ends.tolist())) == 1:
        return values.reshape(len(ends), -1)
    out = np.zeros((len(ends), int(ends.max(initial=0))), dtype=values.dtype)
    out[np.arange(out.shape[1]) < ends[:, None]] = values
    return out


def _fast(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k where ``bound`` holds all scores: query by query, numbers that order by score and
    then by the candidates' order."""
    n = len(c_ids)
    exact = np.float64 if bound < 2**52 else np.int64
    held = np.full((len(q), 0), _LEAST, np.int64)
    for b in range(0, n, BLOCK):
        right, ids = c[b : b + BLOCK].T.astype(exact), c_ids[b : b + BLOCK]
        keep = min(k, held.shape[1] + len(ids))
        after = np.empty((len(q), keep), np.int64)
        for a in range(0, len(q), QUERIES):
            rank = (q[a : a + QUERIES].astype(exact) @ right).astype(np.int64)
            rank *= n
            rank -= np.arange(b, b + len(ids))
            rank[q_ids[a : a + QUERIES, None] == ids] = _LEAST
            if k < len(ids):
                rank = np.partition(rank, len(ids) - k, axis=1)[:, len(ids) - k :]
            both = np.concatenate((held[a : a + QUERIES], rank), axis=1)
            after[a : a + QUERIES] = np.partition(both, both.shape[1] - keep, axis=1)[:, both.shape[1] - keep :]
        held = after
    row, seat = np.nonzero(held != _LEAST)
    rank = held[row, seat]
    place = -rank % n
    return q_ids[row], c_ids[place], (rank + place) // n


def _large(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k in whole numbers of any size, a query and a block at a time."""
    out: list[tuple[int, int, int]] = []
    for i, x in zip(q_ids.tolist(), q, strict=True):
        best: list[tuple[int, int]] = []
        left = np.array([int(v) for v in x], dtype=object)
        for b in range(0, len(c_ids), BLOCK):
            scores = np.array([[int(v) for v in row] for row in c[b : b + BLOCK]], dtype=object).reshape(-1, len(left)) @ left
            some = ((-min(_MOST, max(_LEAST, int(s))), j) for s, j in zip(scores, c_ids[b : b + BLOCK].tolist(), strict=True) if j != i)
            best = heapq.nsmallest(k, itertools.chain(best, some))
        out += [(i, j, -s) for s, j in best]
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (q_ids[:0], c_ids[:0], q_ids[:0])


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best k of the tile: query_id, vec_id, score."""
    dim = min(q.shape[1], c.shape[1])
    order = np.argsort(c_ids, kind="stable")
    c_ids, c, q = c_ids[order], c[order, :dim], q[:, :dim]
    size = lambda x: np.maximum(x.max(axis=1, initial=0), -x.min(axis=1, initial=0).astype(np.float64))
    sizes_q, sizes_c = size(q), size(c)
    # vectors so small that a score, times the candidates, stays within 64 bits
    small = (2.0**62 / (max(dim, 1) * max(len(c_ids), 1))) ** 0.5
    small_q, small_c = sizes_q < small, sizes_c < small
    bound = float(sizes_q[small_q].max(initial=0)) * float(sizes_c[small_c].max(initial=0)) * max(dim, 1)
    parts = [_fast(q_ids[small_q], q[small_q], c_ids[small_c], c[small_c], k, bound)] if small_q.any() and small_c.any() else []
    if not small_c.all():
        parts.append(_large(q_ids[small_q], q[small_q], c_ids[~small_c], c[~small_c], k))
    if not small_q.all():
        parts.append(_large(q_ids[~small_q], q[~small_q], c_ids, c, k))
    if not parts:
        return q_ids[:0], c_ids[:0], q_ids[:0]
    query, vec, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.lexsort((vec, ~score, query))  # ~ turns the order around without leaving 64 bits
    query, vec, score = query[by], vec[by], score[by]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], vec[rank < k], score[rank < k]


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` of every query's k best."""
    d = d_staged = staged(whole_vectors(vectors), "vectors")
    largest = F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))
    n, n_q, width, most = d.agg(F.count(F.lit(1)), F.count_if(F.pmod("vec_id", F.lit(query_every)) == 0), F.max(F.size("v")), largest).first()
    bytes_each = 2 if (most or 0.0) < 1 << 15 else 8
    if bytes_each == 2:  # narrow numbers, so that few copies of few bytes are sent
        d = d.withColumn("v", F.col("v").cast("array<short>"))
    rows = max(LEAST_SHARD, TILE_BYTES // (bytes_each * max(1, width or 1)))
    tiles = max(1, -(-n_q // rows))
    shards = max(1, -(-n // rows), min(parallelism(d.sparkSession), n // LEAST_SHARD))
    deal = F.xxhash64("vec_id")
    c = d.withColumn("shard", F.pmod(deal, F.lit(shards)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("is_query", F.lit(False))
    q = d.where(F.pmod("vec_id", F.lit(query_every)) == 0).distinct()
    q = q.withColumn("tile", F.pmod(deal, F.lit(tiles)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("is_query", F.lit(True))
    both = c.unionByName(q).repartition("tile", "shard").sortWithinPartitions("tile", "shard")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["tile", "shard"]):
            is_query = group["is_query"].to_numpy()
            if is_query.all() or not is_query.any():
                continue
            ids, m = group["vec_id"].to_numpy(), _matrix(group["v"])
            found = best_of_tile(ids[is_query], m[is_query], ids[~is_query], m[~is_query], k)
            shard = np.full(len(found[0]), group["shard"][0].as_py(), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(shard)], names=["query_id", "vec_id", "score", "list"])

    lists = both.mapInArrow(product, "query_id long, vec_id long, score long, list int")
    while True:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("list", F.floor(F.col("list") / FAN_IN).cast("int"))
        best = Window.partitionBy("query_id", "list").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if shards == 1:
            best = staged(lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "best")
            discard(d_staged)
            return best
