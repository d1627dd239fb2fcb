"""Token ids, their files, counts and packing, against the library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from pulselake.llm import packing, queries, token_counts, token_store
from pulselake.llm.tokens import encoder

SF = "/root/testdata/sf0.001"

BPE = encoder(queries.vocabulary())
PIECES = st.lists(st.sampled_from(["a", "bc", " ", "  ", "\n", "12", "é", "日本", "<|endoftext|>", ".", "'ll", "x" * 30, "²", "\x1d", "_", "A", "\t", "\xa0", "。", "<|end", "oftext|>"]), max_size=60).map("".join)


def ids(text):
    return BPE.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_pieces_are_the_whole(text):
    assert next(BPE.encode([text])) == np.asarray(ids(text), dtype="<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(PIECES, st.sampled_from([8, 20, 64]), st.sampled_from([2, 4, 16]))
def test_resynchronised_counts(text, chunk, overlap):
    assert token_counts.count_huge(BPE.tokenizer, text, chunk, overlap, BPE.special) == len(ids(text))


def test_unspaced_texts_are_not_encoded_over_and_over():
    """All that is encoded of a text without white space comes to a few times its length."""
    rng = np.random.default_rng(3)
    marked = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 150_000))
    marked = "。".join(marked[i : i + 37] for i in range(0, len(marked), 37))
    for text in (marked, "x" * 200_000, "ab12" * 40_000, marked.replace("。", "")):
        work = []

        class Counting:
            def encode(self, part, add_special_tokens):
                work.append(len(part))  # noqa: B023
                return BPE.tokenizer.encode(part, add_special_tokens=add_special_tokens)

        assert token_counts.count_huge(Counting(), text, special=BPE.special) == len(ids(text))
        assert sum(work) <= 3 * len(text) + token_counts.CHUNK_CHARS


def test_other_vocabularies_are_encoded_by_the_library():
    other = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert BPE.known and not other.known
    for text in ("Hello  World, 123!\n", "", "<|endoftext|> a"):
        assert next(other.encode([text])) == np.asarray(other.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=700).map(sorted))
def test_elias_fano(values):
    e = token_store.EliasFano.from_bytes(token_store.EliasFano.of(np.array(values, dtype=np.int64)).to_bytes())
    assert e.all().tolist() == values and [e.select(i) for i in range(len(values))] == values


def brute(docs):
    rows = docs.select("doc_id", "text").collect()
    return sorted(((r.doc_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


@pytest.mark.parametrize("which", ["edges", "table"])
def test_store(spark, edge_docs, which):
    docs = edge_docs if which == "edges" else queries.table(spark, SF, "documents")
    got = token_store.store_round_trip(docs, queries.vocabulary()).orderBy("start").collect()
    start = 0
    want = brute(docs)
    assert len(got) == len(want)
    for r, (doc, text) in zip(got, want, strict=True):
        raw = np.asarray([*ids(text), 0], dtype="<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4


def test_store_closes_files(spark, edge_docs, tmp_path):
    files = token_store.write_store(edge_docs, queries.vocabulary(), str(tmp_path), file_ids=50).collect()
    assert len(files) > 3 and sum(f.n_ids for f in files) == sum(len(ids(t)) + 1 for _, t in brute(edge_docs))
    assert not list(tmp_path.glob("*.tmp"))


def test_counts(spark, edge_docs):
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(edge_docs, queries.vocabulary()).collect())
    assert got == sorted((len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for _, t in brute(edge_docs))


@pytest.mark.parametrize("which", ["edges", "table"])
def test_packing(spark, edge_docs, which):
    docs = edge_docs if which == "edges" else queries.table(spark, SF, "documents")
    got = packing.pack_documents(docs, queries.vocabulary()).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 2
    want = []
    for doc, text in brute(docs):
        all_ids = np.asarray([*ids(text), 0], dtype="<u4")
        n, first = len(all_ids), len(all_ids) if len(all_ids) <= 2048 else len(all_ids) % 2048 or 2048
        cuts = [0, *range(first, n + 1, 2048)]
        want += [(doc or -1, k, a, b - a, zlib.crc32(all_ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((d or -1, *x) for d, *x in want)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=12), st.integers(1, 60))
def test_fullest(counts, room):
    took = packing.fullest(counts, room)
    reach = {0}
    for n, c in counts.items():
        for _ in range(c):
            reach |= {r + n for r in reach if r + n <= room}
    assert sum(n * c for n, c in took.items()) == max(reach) and all(c <= counts[n] for n, c in took.items())


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_uses_every_piece_once(histogram):
    rows, bins = packing.plan_bins(histogram, 64)
    used = {}
    fill = {}
    for n, a, b, first, many, offset in rows:
        assert used.get(n, 0) == a
        used[n] = b
        for i in range((b - a) // many):
            fill[first + i] = fill.get(first + i, 0) + n * many
    assert used == histogram and max(fill.values(), default=0) <= 64 and len(fill) == bins


def test_empty_tables(spark, no_docs):
    v = queries.vocabulary()
    assert packing.pack_documents(no_docs, v).count() == token_counts.count_tokens(no_docs, v).count() == token_store.store_round_trip(no_docs, v).count() == 0
