"""Importance resampling against a plain recount."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pulselake.llm import queries, resampling
from pulselake.llm.crc import Appender

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(w):
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, targets, percent=5, least=20):
    """Rows (doc_id, n_features, weight, score, rank) of documents in a list, repeats included."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = np.zeros(10_000), np.zeros(10_000)
    for counts, texts in ((s, [x for _, x in docs]), (t, targets)):
        for x in texts:
            for f in features(words(x)):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    out = []
    for i, x in docs:
        fs = features(words(x))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least])
    eligible = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {id(r): n for n, r in enumerate(eligible[: percent * len(eligible) // 100], 1)}
    return sorted((str((*r[:4], drawn.get(id(r))))) for r in out)


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_against_a_recount(spark):
    docs = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    targets = [r.text for r in queries.table(spark, SF, "benchmark").collect()]
    assert rows(queries.op11_resample(spark, SF)) == brute(docs, targets)


def test_edges(spark, edge_docs, no_docs):
    docs = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    target = spark.createDataFrame([("the alpha beta", 1), (None, 2), ("", 3)], "text string, doc_id int")
    for percent, least in ((5, 20), (50, 1), (100, 0)):
        assert rows(resampling.resample(edge_docs, target, percent, least)) == brute(docs, ["the alpha beta"], percent, least)
    assert rows(resampling.resample(edge_docs, target.limit(0), 50, 1)) == brute(docs, [], 50, 1)
    assert rows(resampling.resample(no_docs, target)) == []


@pytest.mark.parametrize("chunk", [1, 7, 64, 4096])
def test_words_and_offsets_of_chunks(monkeypatch, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    text = resampling.lowered("Ab1-cD é日本  x\x1cy z " * 40 + "long" * 50 + "İSTANBUL end")
    found = [(w, at + a, at + b) for at, part in resampling.words_of(resampling.splitter(), text) for w, (a, b) in part]
    assert [w for w, _, _ in found] == WORD.findall(text) and all(text[a:b] == w for w, a, b in found)


def test_blocks_of_words(monkeypatch):
    texts = ["a b c d", None, "", "x", "é é é é " * 30, "y z"] * 5
    monkeypatch.setattr(resampling, "BLOCK", 11)
    for text, (n, buckets) in zip(texts, resampling.text_buckets(texts, resampling.splitter(), Appender()), strict=True):
        w = words(text)
        assert n == len(w) and sorted(buckets.tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in features(w))


def test_appended_crcs():
    a, b = [b"", b"abc", b"\xff" * 9], [b" tail", b"", b" x" * 70]
    got = Appender().append(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]
