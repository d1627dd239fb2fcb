"""WARC archives of pages, with an external merge of their capture indexes.

Each task writes the records of its pages into archives, a gzip member for each record, and
leaves a run: its captures sorted by URL key, timestamp and page.  Runs are cut at the same
sampled keys, so that each key range is merged on its own, by a loser tree over its slices of
all runs; the ranges together are the capture histories in global order.  Captures then lead
back into the archives, from which every record is read.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest
page_id is the response, the others are revisits, which carry the payload's digest and length
but not the payload.  Records of the same page_id as the response are responses, too.

Pages have no capture time; WARC-Date is START plus page_id seconds (START for none).

Defined cases: a null html is an empty payload; a null url is written as ``urn:page:<page_id>``;
a null page_id never decides a response and is always one; repeated rows are records each; an
empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import open_file, write_file
from .work import discard, groups_of, parallelism, shared_folder, staged

START = datetime(2024, 1, 1, tzinfo=UTC)
#: An archive is closed when it holds so many bytes; captures of a merged range, about, and the keys
#: that are sampled for each.  The driver receives one key for each range.
ARCHIVE_BYTES, RANGE_CAPTURES, KEYS_A_RANGE = 32_000_000, 20_000, 32
SALTS = 32
_URI = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """The host's names from the top domain down, then path and query, in lower case."""
    try:
        parts = urlsplit(url.lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    host = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    return f"{host}{f':{port}' if port and port not in (80, 443) else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}"


def when(page_id: int | None) -> datetime:
    try:
        return START + timedelta(seconds=page_id or 0)
    except OverflowError:
        return START


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    uri = (url or f"{_URI}{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URI}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {when(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URI}{refers_to}>"]
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + gz.flush()


def read_record(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a response's digest and
    length are those of the payload that was read."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]  # behind the HTTP head
    number = lambda name: int(v) if (v := fields.get(name, "<>")[1:-1].removeprefix(_URI)) else None
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), int(fields["X-Payload-Length"]), stated, "revisit", number("WARC-Refers-To")
    if payload_digest(body) != stated:
        raise ValueError("a payload differs from its digest")
    return number("WARC-Record-ID"), len(body), stated, "response", None


class LoserTree:
    """Merges sorted lists: inner nodes hold the losers of their matches, the winner stands on top,
    and after a step only the winner's path is played again."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.tree = [-1] * max(1, len(runs))
        for i in range(len(runs)):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _play(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node > 0:
            if self.tree[node] < 0:  # the first to come waits for its opponent
                self.tree[node] = i
                return
            if self._less(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.runs:
            best = self.tree[0]
            if self.at[best] >= len(self.runs[best]):
                return
            yield self.runs[best][self.at[best]]
            self.at[best] += 1
            self._play(best)


_CAPTURE = pa.struct([("key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
_KEY = "key string, ts string"


def _digests(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            payloads = [(h.as_py() or "").encode() for h in batch.column(2)]
            keys = [url_key(u or f"{_URI}{i}") for i, u in zip(ids, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([payload_digest(p) for p in payloads]), pa.array([len(p) for p in payloads], pa.int64()), pa.array(keys), pa.array([f"{when(i):%Y%m%d%H%M%S}" for i in ids])],
                names=["page_id", "digest", "bytes", "key", "ts"],
            )

    return pages.mapInArrow(run, f"page_id long, digest string, bytes long, {_KEY}")


def _cuts(captures: DataFrame) -> list[tuple[str, str, int]]:
    """Where the key ranges end: a sample of keys is sorted in Spark, and every KEYS_A_RANGE-th stays."""
    spark, n = captures.sparkSession, captures.count()
    ranges = max(min(n, parallelism(spark)), -(-n // RANGE_CAPTURES))
    if ranges < 2:
        return []
    page = F.coalesce("page_id", F.lit(-1)).alias("page")
    share = min(1.0, KEYS_A_RANGE * ranges / n)
    sample = captures.select("key", "ts", page).where(F.pmod(F.xxhash64("key", "page", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    step = max(1, int(n * share) // ranges)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            yield b.take(pa.array(range((step - 1 - seen) % step, b.num_rows, step), pa.int64()))
            seen += b.num_rows

    ordered = sample.repartitionByRange("key", "ts", "page").sortWithinPartitions("key", "ts", "page")
    return sorted({(r.key, r.ts, r.page) for r in ordered.mapInArrow(thin, f"{_KEY}, page long").collect()})


def write_archives(pages: DataFrame, folder: str, cuts: list) -> DataFrame:
    """Writes ``page_id, url, html, digest, refers_to``; returns each run's slices by range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        size, captures = 0, []

        def close() -> None:
            nonlocal parts, size, no
            write_file(f"{folder}/pages-{part:06d}-{no:06d}.warc.gz", parts)
            parts, size, no = [], 0, no + 1

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = record(page_id, url, (html or "").encode(), digest, refers_to)
                captures.append((url_key(url or f"{_URI}{page_id}"), f"{when(page_id):%Y%m%d%H%M%S}", -1 if page_id is None else page_id, f"pages-{part:06d}-{no:06d}.warc.gz", size, len(member)))
                parts.append(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    close()
        if parts:
            close()
        captures.sort()
        slices: dict[int, list] = {}
        for c in captures:
            slices.setdefault(bisect_right(cuts, c[:3]), []).append(dict(zip(("key", "ts", "page_id", "file", "at", "size"), c, strict=True)))
        for i, got in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([got], pa.list_(_CAPTURE))], names=["range", "run", "captures"])

    narrow = pages.select("page_id", "url", "html", "digest", "refers_to")
    return narrow.mapInArrow(run, "range int, run int, captures array<struct<key:string,ts:string,page_id:long,file:string,at:long,size:long>>")


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures in global order: ``range, place`` within it, and the capture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, ["range"]):
            lists = [[tuple(c.values()) for c in s.as_py()] for s in g["captures"]]
            merged = list(LoserTree(lists))
            cols = list(zip(*merged, strict=True))
            n = len(merged)
            types = [f.type for f in _CAPTURE]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g["range"][0].as_py()] * n, pa.int32()), pa.array(range(n), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=["range", "place", "key", "ts", "page_id", "file", "at", "size"],
            )

    dealt = runs.repartition(parallelism(runs.sparkSession), "range").sortWithinPartitions("range", "run")
    return dealt.mapInArrow(run, f"range int, place long, {_KEY}, page_id long, file string, at long, size long")


def read_captures(index: DataFrame, folder: str) -> DataFrame:
    """Every record that the index leads to, read from its archive."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "history_range", "history_place"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, ["file"]):  # one archive's captures
            rows = []
            with open_file(f"{folder}/{g['file'][0].as_py()}") as archive:
                for at, size, *place in zip(*(g[c].to_pylist() for c in ("at", "size", "key", "ts", "range", "place")), strict=True):
                    archive.seek(at)
                    rows.append((*read_record(archive.read(size)), *place))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    dealt = index.repartition(parallelism(index.sparkSession), "file").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, capture_time string, history_range int, history_place long")


def archive_pages(table: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives and their merged index, and reads every page's record back."""
    spark = table.sparkSession
    pages = table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digests = staged(_digests(pages), "digests")
    deciding = digests.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull())
    keepers = deciding.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("m")).where("m > 1")
    # a payload may be very common: its captures are dealt over salts
    keepers = keepers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = deciding.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = salted.join(keepers, ["digest", "salt"]).where("page_id <> keeper").select("page_id", "digest", F.col("keeper").alias("refers_to")).distinct()
    facts = digests.where("page_id is not null").select("page_id", "digest").distinct().join(revisits, ["page_id", "digest"], "left").withColumnRenamed("page_id", "fact_id")
    # rows that share a page_id may differ: each finds its own payload's fact by digest as well
    joined = _with_digest(pages).join(facts, (F.col("page_id") == F.col("fact_id")) & (F.col("digest_here") == F.col("digest")), "left")
    joined = joined.select("page_id", "url", "html", F.col("digest_here").alias("digest"), "refers_to")
    folder = shared_folder(spark, "warc")
    runs = staged(write_archives(joined, folder, _cuts(digests)), "runs")
    if runs.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, capture_time string, history_range int, history_place long")
    history = staged(merge_runs(runs), "capture-history")
    discard(digests, runs)
    return read_captures(history, folder)


def _with_digest(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [payload_digest((h.as_py() or "").encode()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.string())], names=["page_id", "url", "html", "digest_here"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, html string, digest_here string")
