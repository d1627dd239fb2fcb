"""Vectors and pages, against brute force."""

import zlib

import numpy as np
import pytest

from hypothesis import given
from hypothesis import strategies as st

from pulselake.llm import embedding_dedup, queries, topk, warc

SF = "/root/testdata/sf0.001"

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    rng, rows = np.random.default_rng(1), []
    for g in range(6):
        c = rng.normal(size=16)
        for k in range(30):
            rows.append((len(rows), (c + rng.normal(size=16) * (0.05 if k < 20 else 0.2)).tolist(), g % 3))
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n, rows[0][1], 0), (n + 1, None, 0), (n + 2, [0.0] * 16, 0), (n + 3, [NAN] + [1.0] * 15, 0), (n + 4, [INF] + [1.0] * 15, 1), (n + 5, [None] + [1.0] * 15, 1), (n + 6, rows[1][1], None)]
    rows += [(None, rows[0][1], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [1.0, 2.0], 0), (n + 9, [], 0), (n + 10, [2.0 * x for x in rows[0][1]], 0)]
    rows = [(*r, 3, "x") for r in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep int, key string").repartition(3)


def sound(r):
    return r.vec_id is not None and r.label is not None and r.embedding is not None and len(r.embedding) > 0 and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)


def test_near_duplicate_vectors(spark, vectors):
    rows = vectors.collect()
    links = {}
    up = {r.vec_id: r.vec_id for r in rows if r.vec_id is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and sound(a) and sound(b) and a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding, float), np.array(b.embedding, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[i] = links.get(i, 0) + 1
                    p, q = root(a.vec_id), root(b.vec_id)
                    up[max(p, q)] = min(p, q)
    want = sorted(str((r.vec_id, links.get(i, 0), None if r.vec_id is None else root(r.vec_id), r.vec_id is None or root(r.vec_id) == r.vec_id)) for i, r in enumerate(rows))
    got = sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in embedding_dedup.deduplicate(vectors).collect())
    assert got == want


def test_tiles_of_large_buckets(spark, vectors, monkeypatch):
    whole = sorted(map(str, embedding_dedup.deduplicate(vectors).collect()))
    monkeypatch.setattr(embedding_dedup, "TILE", 6)
    assert sorted(map(str, embedding_dedup.deduplicate(vectors).collect())) == whole


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    c = embedding_dedup.Coder(64, 10, 20, 0.98)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    r, true = c.records(x), x @ x.T
    i, j = np.nonzero(~np.eye(400, dtype=bool))
    assert abs((c.estimate(r[i], r[j]) - true[i, j]).mean()) < 0.005
    y = x + rng.normal(size=x.shape) * 0.024
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = (x * y).sum(axis=1) >= 0.98
    assert 50 < near.sum() < 350
    assert (c.upper(r[near], c.records(y)[near]) >= 0.98).all()
    assert np.bitwise_count(r["code"] ^ c.records(y)["code"])[near].max() <= c.most < 24


def test_labels_of_text_keep_their_commas(spark):
    rows = [(0, [2.0, 1.0], "1"), (1, [1.0], "1,2.0"), (2, [4.0, 2.0], "1"), (3, [2.0, 1.0], "1,2.0"), (3, [1.0, 2.0], "1")]
    got = embedding_dedup.deduplicate(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 1, 0), (1, 0, 1), (2, 1, 0), (3, 0, 3), (3, 0, 3)]


def brute_top(rows, k=20):
    ok = [r for r in rows if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    v = [(r.vec_id, [int(np.floor(64.0 * float(x))) for x in r.embedding]) for r in ok]
    out = set()
    for q, a in {(i, tuple(x)) for i, x in v if i % 20 == 0}:
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q)[:k]  # noqa: B905
        out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s)}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k(spark, vectors, scale):
    from pyspark.sql import functions as F

    d = vectors.withColumn("embedding", F.transform("embedding", lambda x: (x * F.lit(scale)).cast("float"))).where("vec_id is null or vec_id <> 180")
    got = topk.top_k(d).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute_top(d.collect()) and len(got) == len(set(got))


def test_top_k_of_huge_components(spark):
    """Finite components of any size take part; scores end at the bounds of 64 bits."""
    rng = np.random.default_rng(6)
    huge = [1e300, -1e300, 1e18, -1e17, 5e15, 3e9, 0.0, 1.0, 1.7e308]
    rows = [(i, [float(v) for v in (rng.choice(huge, 3) if i % 3 == 0 else rng.normal(size=3))]) for i in range(70)]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    largest = int(1.7976931348623157e308)
    whole = {i: [max(-largest, min(largest, int(x) * 64 if abs(x) >= 1e15 else int(np.floor(64 * x)))) for x in v] for i, v in rows}
    want = set()
    for q in range(0, 70, 20):
        s = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)[:20]
        want |= {(q, n, i, -x) for n, (x, i) in enumerate(s, 1)}
    assert got == want


def test_a_full_tile_needs_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    c, ids = rng.integers(-600, 600, (125_000, 64)).astype(np.int16), rng.permutation(125_000)
    tracemalloc.start()
    query, vec, score = topk.best_of_tile(ids[:600], c[:600], ids, c, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(query) == 12_000
    full = c[:3].astype(np.int64) @ c.T.astype(np.int64)
    for i in range(3):
        best = sorted((-int(s), int(j)) for s, j in zip(full[i], ids, strict=True) if j != ids[i])[:20]
        assert [(-int(s), int(j)) for s, j in zip(score[query == ids[i]], vec[query == ids[i]], strict=True)] == best


def test_top_k_leaves_its_result_alone(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir())
    topk.top_k(queries.table(spark, SF, "embeddings")).count()
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["best"]


def test_top_k_of_many_tiles(spark, monkeypatch):
    d = queries.table(spark, SF, "embeddings")
    for name, n in (("TILE_BYTES", 1), ("LEAST_SHARD", 7), ("FAN_IN", 3)):
        monkeypatch.setattr(topk, name, n)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(d).collect()} == brute_top(d.collect())


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://www.Host{i % 3}.example.com/p/{i % 4}?q={i}", f"<p>text {i % 7}</p>") for i in range(40)]
    rows += [(40, None, None), (41, "http://a b:x/\r\n", ""), (42, "", "é" * 5000), (43, "http://[bad", "é" * 5000), (44, "u", "same"), (44, "u", "same"), (None, "n", "same"), (45, "v", "same")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, key string").repartition(3)


@pytest.mark.parametrize("which,least", [("edges", 0), ("edges", 12), ("table", 0)])
def test_archives(spark, pages, which, least):
    d = pages if which == "edges" else queries.table(spark, SF, "pages")
    rows = [(r.page_id, (r.html or "").encode()) for r in d.collect()]
    keeper = {}
    for i, p in rows:
        if i is not None and len(p) >= least:
            keeper[p] = max(i, keeper.get(p, i))
    want = []
    for i, p in rows:
        revisit = i is not None and p in keeper and keeper[p] != i
        want.append(str((i, len(p), warc.payload_digest(p), "revisit" if revisit else "response", keeper[p] if revisit else None)))
    got = warc.archive_pages(d, least).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(want)
    got.sort(key=lambda r: (r.history_range, r.history_place))
    keys = [(r.url_key, r.capture_time, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)


@given(st.lists(st.lists(st.integers(0, 20)).map(sorted), max_size=9))
def test_loser_tree(runs):
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_record_round_trip():
    a = warc.record(7, "http://x/", "é".encode(), warc.payload_digest("é".encode()), None)
    assert warc.read_record(a) == (7, 2, warc.payload_digest("é".encode()), "response", None)
    raw = zlib.decompress(a, 31)
    assert b"Content-Type: application/http; msgtype=response" in raw and b"HTTP/1.1 200 OK\r\n" in raw and "\r\n\r\né\r\n\r\n".encode() in raw
    b = warc.record(3, None, b"abc", warc.payload_digest(b"abc"), 7)
    assert warc.read_record(b) == (3, 3, warc.payload_digest(b"abc"), "revisit", 7)


def test_empty_tables(spark, vectors, pages):
    assert embedding_dedup.deduplicate(vectors.limit(0)).count() == topk.top_k(vectors.limit(0)).count() == warc.archive_pages(pages.limit(0)).count() == 0
