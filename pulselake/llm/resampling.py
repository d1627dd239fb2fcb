"""Importance resampling towards a target distribution, by hashed runs of words.

The tokenizers library's pre-tokeniser, an untrained regular-expression split, gives the words of
the lower-cased text with their offsets.  Runs of one to three words are pairs of offsets (where
the first word starts, where the last one ends); the CRC of a run follows from those of its words,
as appending n bytes acts linearly on a CRC.  Buckets of the runs are written with each document
as 16-bit numbers, so that texts are split once; histograms of both corpora give the buckets'
gains, a table of BUCKETS numbers, and a document's weight is the sum over its runs.  Perturbing
the weights by Gumbel noise of the doc_id draws without replacement; ranks come from ranges of the
scores, so that no task orders all documents.

Defined cases: a null or empty text has no word: 0 features, weight 0, never drawn; long texts are
split in chunks cut between words; a null doc_id has the noise of an empty id and comes after others
at ties; repeated rows have one score and ranks of their own; an empty target has all counts 0; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from ..functions.ranges import numbered
from ..functions.stable import hash32
from ..shipping import ship
from .crc import Appender
from .work import discard, staged

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Texts are split in chunks of so many characters or a little more, and so many words are hashed at once.
CHUNK, BLOCK = 4096, 1 << 18


def splitter():
    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def lowered(text: str) -> str:
    """A to Z in lower case, nothing else."""
    return text.encode().lower().decode()


def words_of(split, text: str) -> Iterator[tuple[int, list[tuple[str, tuple[int, int]]]]]:
    """The words of a lower-cased text with their offsets, in chunks that end between words: where a
    chunk starts, and its words with offsets from there."""
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, min(len(text), at + CHUNK))
        stop = cut.start() if cut else len(text)
        yield at, split.pre_tokenize_str(text[at:stop])
        at = stop


class _Words(dict):
    """Numbers of distinct words, with the CRCs of each alone and behind a space, and its bytes."""

    def __init__(self):
        self.alone, self.behind, self.sizes = array("I"), array("I"), array("q")

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        self.alone.append(zlib.crc32(raw))
        self.behind.append(zlib.crc32(b" " + raw))
        self.sizes.append(len(raw) + 1)
        self[word] = len(self)
        return len(self) - 1


def run_buckets(ids: np.ndarray, words: _Words, appender: Appender) -> list[np.ndarray]:
    """Buckets of all runs of one word, of two, and so on, by the run's first word."""
    behind, sizes = np.array(words.behind, np.uint32), np.array(words.sizes, np.int64)
    crc = np.array(words.alone, np.uint32)[ids]
    out = [crc % BUCKETS]
    for k in range(1, LONGEST):
        last = ids[k:]
        crc = appender.append(crc[: len(last)], behind[last], sizes[last]) if len(last) else crc[:0]
        out.append(crc % BUCKETS)
    return [o.astype(np.uint16) for o in out]


def text_buckets(texts: list[str | None], split, appender: Appender) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text the number of its words and the buckets of all its runs."""
    held: list[tuple[array, int]] = []
    words, n = _Words(), 0

    def hashed() -> Iterator[tuple[int, np.ndarray]]:
        ends = np.cumsum([len(ids) for ids, _ in held])
        ids = np.concatenate([np.frombuffer(i, np.int32) if len(i) else np.zeros(0, np.int32) for i, _ in held])
        runs = run_buckets(ids, words, appender)
        for stop, (i, _) in zip(ends.tolist(), held, strict=True):
            a = stop - len(i)
            yield len(i), np.concatenate([r[a : max(a, stop - k)] for k, r in enumerate(runs)])

    for text in texts:
        ids = array("i")
        for _, found in words_of(split, lowered(text or "")):
            ids.extend([words[w] for w, _ in found])
        held.append((ids, len(ids)))
        n += len(ids)
        if n >= BLOCK:
            yield from hashed()
            held, words, n = [], _Words(), 0
    if held:
        yield from hashed()


def hashed_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_words, n_features, buckets``: 16-bit bucket numbers of all runs of each text, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, appender = splitter(), Appender()
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                found = list(text_buckets(part.column(1).to_pylist(), split, appender))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())],
                    names=["key", "n_words", "n_features", "buckets"],
                )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return staged(rows.mapInArrow(run, "key long, n_words long, n_features long, buckets binary"), "runs")


def histogram(hashed: DataFrame) -> DataFrame:
    """``bucket, n``: how many runs fall into each bucket; tasks add theirs up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer(), np.uint16), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return hashed.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket: BUCKETS numbers whatever the corpora."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = both.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    sums = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + BUCKETS) / ((d("s") + 1) * (d("all_t") + BUCKETS))
    rows = counts.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain")).collect()  # sums: one row
    gains = np.zeros(BUCKETS, np.int64)
    for bucket, gain in rows:
        gains[bucket] = gain
    return gains


def weighed(hashed: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the sum of the gains of each document's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gains[np.frombuffer(raw.as_buffer(), np.uint16)].sum()) for raw in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return hashed.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: str) -> Column:
    """Thousandths of a Gumbel draw that depends on the doc_id alone."""
    h = hash32(F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), separator=":")
    return F.floor(F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))) * -1000).cast("long")


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document: ``rank`` is null unless drawn.

    ``target`` has a column ``text``; of the documents with ``least_words`` words so many hundredths
    are drawn, those of the highest scores."""
    ship(documents.sparkSession)
    source, goal = hashed_documents(documents, "doc_id", "text"), hashed_documents(target.withColumn("__no", F.lit(None).cast("long")), "__no", "text")
    gains = bucket_gains(histogram(source), histogram(goal))
    eligible = F.col("n_words") >= least_words
    drawn = percent * source.where(eligible).count() // 100
    d = weighed(source, gains).withColumn("score", F.col("weight") + noise("doc_id")).withColumn("__in", eligible)
    ranked = numbered(d, [], [F.desc("__in"), F.desc("score"), F.asc_nulls_last("doc_id")], "__rank")
    discard(source, goal)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("__in") & (F.col("__rank") <= drawn), F.col("__rank")).alias("rank"))
