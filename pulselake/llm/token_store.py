"""Token ids in binary files, with Elias-Fano encoded document boundaries.

A file holds the ids of consecutive documents, one after another, two or four bytes each, and
two Elias-Fano sequences: where the documents end, and their doc_ids.  Of each value the low
bits are stored as they are, and the high bits in unary, about two bits a document; the place
of every SAMPLE-th one in the unary bits lets ``select`` find any boundary without a table of
64-bit offsets.

    bytes 0-3   b"EFT1"
    then        8 unsigned 64-bit numbers: documents, ids, bytes of an id, nulls (documents at the
                end without a doc_id), smallest doc_id (two's complement), bytes of the boundaries,
                bytes of the doc_ids, 0
    then        boundaries, doc_ids, ids; all little-endian

Defined cases: a null text is the end id alone; a null doc_id comes after all others; repeated
rows are documents of their own, in the order of their texts; an empty table makes no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import open_file, write_file
from .tokens import encoder
from .work import parallelism, shared_folder, staged

MAGIC = b"EFT1"
SAMPLE = 256
#: A file is closed when it holds so many ids.
FILE_IDS = 16_000_000


class EliasFano:
    """A non-decreasing sequence of numbers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(places[-1]) + 1 if n else 0) + 7 & ~7, dtype=np.uint8)
        bits[places] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        word = int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8].tobytes(), "little")
        return word >> a % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it and a walk over at most SAMPLE ones."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> at % 8 << at % 8
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return (8 * byte + (word & -word).bit_length() - 1 - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high + (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def to_bytes(self) -> bytes:
        head = struct.pack("<5Q", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes | memoryview) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<5Q", raw)
        low, high = np.frombuffer(raw, np.uint8, a, 40), np.frombuffer(raw, np.uint8, b, 40 + a)
        return cls(n, low_bits, low, high, np.frombuffer(raw, "<u4", c, 40 + a + b))


def file_parts(doc_ids: list[int | None], ends: list[int], ids: np.ndarray) -> list[bytes]:
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    bounds, names = EliasFano.of(np.array(ends)).to_bytes(), EliasFano.of((known - base).astype(np.uint64)).to_bytes()
    head = MAGIC + struct.pack("<4QqQQQ", len(doc_ids), len(ids), width, len(doc_ids) - len(known), base, len(bounds), len(names), 0)
    return [head, bounds, names, ids.astype(f"<u{width}").tobytes()]


def read_file(raw: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """Of a file: doc_ids, document ends and ids."""
    if raw[:4] != MAGIC:
        raise ValueError("not a file of token ids")
    n, n_ids, width, nulls, base, a, b, _ = struct.unpack_from("<4QqQQQ", raw, 4)
    view = memoryview(raw)[68:]
    doc_ids: list[int | None] = (EliasFano.from_bytes(view[a : a + b]).all().astype(np.int64) + base).tolist()
    return doc_ids + [None] * nulls, EliasFano.from_bytes(view[:a]), np.frombuffer(raw, f"<u{width}", n_ids, 68 + a + b)


def bounds_of(ends: EliasFano, i: int) -> tuple[int, int]:
    """Where the ids of a file's i-th document begin and end."""
    return ends.select(i - 1) if i else 0, ends.select(i)


def write_store(docs: DataFrame, vocabulary: str, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files in ascending doc_id order; returns ``name, part, file, n_ids``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        part, made = TaskContext.get().partitionId(), []
        names: list[int | None] = []
        ends: list[int] = []
        held: list[bytes] = []
        size = 0

        def close() -> None:
            nonlocal names, ends, held, size
            name = f"ids-{part:06d}-{len(made):06d}.eft"
            write_file(f"{folder}/{name}", file_parts(names, ends, np.frombuffer(b"".join(held), "<u4")))
            made.append((name, part, len(made), size))
            names, ends, held, size = [], [], [], 0

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode(t.as_py() for t in batch.column(1)), strict=True):
                names.append(doc)
                held.append(ids + b"\0\0\0\0")
                size += len(ids) // 4 + 1
                ends.append(size)
                if size >= file_ids:
                    close()
        if names:
            close()
        cols = list(zip(*made, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["name", "part", "file", "n_ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    ranged = narrow.repartitionByRange(parallelism(docs.sparkSession), order[0]).sortWithinPartitions(*order)
    return ranged.mapInArrow(write, "name string, part long, file long, n_ids long")


def read_store(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, file`` of every document, from the files alone;
    ``files`` tells their order."""
    order = Window.orderBy("part", "file")  # a row for each file
    starts = files.withColumn("base", F.sum("n_ids").over(order) - F.col("n_ids")).select("name", "base")
    starts = starts.repartition(parallelism(files.sparkSession), "name")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0), batch.column(1), strict=True):
                with open_file(f"{folder}/{name.as_py()}") as file:
                    doc_ids, bounds, ids = read_file(file.read())
                starts, ends = np.array([bounds_of(bounds, i) for i in range(len(doc_ids))], dtype=np.int64).reshape(-1, 2).T
                wide = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + base.as_py()), pa.array(ends - starts), pa.array(crcs, pa.int64()), pa.array([name.as_py()] * len(crcs))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                )

    return starts.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def store_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "token-ids")
    files = staged(write_store(docs, vocabulary, folder), "token-files")
    if files.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    return read_store(files, folder)
