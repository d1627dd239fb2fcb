"""Documents' bounds by select, in the reader of single documents and in the query's."""

import numpy as np
from pulselake.llm import queries, token_store


def test_bounds_of_single_documents():
    sizes = np.random.default_rng(1).integers(1, 900, 1000)
    ends = np.cumsum(sizes)
    raw = b"".join(token_store.file_parts(list(range(1000)), ends.tolist(), np.arange(ends[-1], dtype="<u4")))
    _, bounds, ids = token_store.read_file(raw)
    for i in (999, 0, 1, 255, 256, 257, 512, 700):
        a, b = token_store.bounds_of(bounds, i)
        assert (a, b) == (ends[i] - sizes[i], ends[i]) and ids[a:b].tolist() == list(range(a, b))


def test_query_reads_through_select(spark, edge_docs):
    got = token_store.store_round_trip(edge_docs, queries.vocabulary()).orderBy("start").collect()
    assert len(got) == edge_docs.count() and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got[:-1], got[1:], strict=True))
    code = token_store.read_store.__code__
    decode = next(c for c in code.co_consts if getattr(c, "co_name", "") == "decode")
    inner = [c for c in decode.co_consts if hasattr(c, "co_names")]
    assert any("bounds_of" in c.co_names for c in (decode, *inner)) and "all" not in decode.co_names
