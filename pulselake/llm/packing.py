"""Best-fit packing by minimum bin slack.

Bins are filled one after another: of the pieces that are left, subset sums over a bitset find
the fullest feasible combination, and it is removed.  Lengths decide alone, so the whole choice
is made on the histogram of lengths (at most ``capacity`` numbers, whatever the corpus), and a
combination is taken as often as the counts allow.  Each combination uses up one length or
brings its count below what the combination takes, which bounds the plan by the capacity, too.
The pieces never meet in one place: each finds its bin from its rank among those of its length.

Defined cases: a null or empty text is one piece, the end id; repeated rows are packed each, as
documents of their own; an empty table needs no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import encoder
from .work import discard, parallelism, staged

CAPACITY = 2048
#: Ranks within a length are counted apart in salts of about so many pieces.
SALT_PIECES = 100_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document, each ended by id 0.

    A document of more than ``capacity`` ids is cut into pieces of that many; what is over
    makes the first piece shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode(t.as_py() for t in batch.column(1)), strict=True):
                raw = memoryview(ids + b"\0\0\0\0")
                n = len(raw) // 4
                start, k = 0, 0
                stop = n if n <= capacity else n % capacity or capacity
                while start < n:
                    out.append((doc, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                    start, stop, k = stop, stop + capacity, k + 1
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of ``counts`` (length: how many), the combination with the largest sum up to ``room``.

    Longest first; bit s of the set is on if s can be filled.  The sets after each step tell
    which lengths made the best sum."""
    inside = (1 << (room + 1)) - 1
    sets, steps, now = [], [], 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, many = min(counts[length], room // length), 1
        while left and not now >> room & 1:
            many = min(many, left)
            sets.append(now)
            steps.append((length, many))
            now = (now | now << (length * many)) & inside
            left -= many
            many *= 2
        if now >> room & 1:
            break
    total = now.bit_length() - 1
    took: dict[int, int] = {}
    for before, (length, many) in zip(reversed(sets), reversed(steps), strict=True):
        if not before >> total & 1:
            took[length] = took.get(length, 0) + many
            total -= length * many
    return took


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows ``(length, first rank, rank after, first bin, in each bin, offset)`` and the bins used.

    Every bin gets the longest piece that is left, and the fullest combination beside it."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        if not rest[seed]:
            del rest[seed]
        took = fullest(rest, capacity - seed)
        took[seed] = took.get(seed, 0) + 1
        times = min(left[n] // many for n, many in took.items())
        offset = 0
        for n in sorted(took, reverse=True):
            many = took[n]
            rows.append((n, used[n], used[n] + many * times, bins, many, offset))
            used[n] += many * times
            left[n] -= many * times
            if not left[n]:
                del left[n]
            offset += many * n
        bins += times
    return rows, bins


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (columns of :func:`pieces`), each with ``sequence_id`` and ``offset``."""
    salts = max(parallelism(items.sparkSession), -(-items.count() // SALT_PIECES))
    salted = items.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy("length").orderBy("__salt")
    bases = counts.withColumn("base", F.sum("n").over(by_length) - F.col("n"))
    # at most `capacity` rows: bounded, whatever the corpus
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan_bins(histogram, capacity)
    plan = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    held = items.sparkSession.sparkContext.broadcast(plan)
    inner = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("__rank", F.row_number().over(inner) - 1)
    ranked = ranked.join(bases.select("length", "__salt", "base"), ["length", "__salt"])
    ranked = ranked.select(*items.columns, (F.col("base") + F.col("__rank")).alias("__rank"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        key = plan[:, 0] << 44 | plan[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            row = plan[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            cols = [b.column(n) for n in schema.names[:5]]
            cols += [pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return ranked.mapInArrow(place, _PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    items = staged(pieces(docs, vocabulary, capacity), "pieces")
    packed = staged(pack(items, capacity), "packed")
    discard(items)
    return packed
