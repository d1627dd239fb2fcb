"""Each stage of the pipeline works on what the stage before kept, and its decisions take effect."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pulselake.llm import langid, mixing, queries
from pulselake.llm.tokens import encoder
from pulselake.llm.work import staged
from test_near_duplicates import least_of_groups

SF = "/root/testdata/sf0.001"


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def named(df):
    """Rows without a doc_id may differ in what becomes of them."""
    return Counter({k: n for k, n in texts(df).items() if k[0] is not None})


@pytest.mark.parametrize("which", ["table", "edges"])
def test_stages(spark, edge_docs, which):
    docs = queries.table(spark, SF, "documents") if which == "table" else edge_docs
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "mixture", "sequences"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        kept.append(docs := staged(stage(spark, docs, SF), name))
    first, second, third, last = kept
    assert first.columns == second.columns == third.columns == columns
    start = queries.table(spark, SF, "documents") if which == "table" else edge_docs
    good = {r.doc_id for r in langid.identify(start).collect() if r.lang_pred != "und" and r.score >= langid.LEAST_SCORE}
    assert named(first) == Counter({k: n for k, n in named(start).items() if k[0] in good})
    gone = {i for i, least in least_of_groups(first.where("doc_id is not null"), corpus_pipeline.NEAR).items() if i != least}
    assert named(second) == Counter({k: n for k, n in named(first).items() if k[0] not in gone})
    copies = {r.doc_id: r.copies for r in mixing.mix(second).collect()}
    assert set(named(third)) == {k for k in named(second) if copies[k[0]]}
    bpe = encoder(queries.vocabulary())
    want = Counter()
    for (_, text), n in texts(third).items():
        ids = bpe.whole(text or "") + b"\0\0\0\0"
        size = len(ids) // 4
        cut = size if size <= 2048 else size % 2048 or 2048
        cuts = [0, *range(cut, size + 1, 2048)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            want[b - a, zlib.crc32(ids[4 * a : 4 * b])] += n
    rows = last.collect()
    assert Counter((r.length, r.ids_crc32) for r in rows) == want
    room = Counter()
    for r in rows:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048 and len(room) <= -(-int(np.sum(list(room.values()))) // 2048) + 2


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert corpus_pipeline.ORACLE_SQL is None and got.count() > 0 and "sequence_id" in got.columns
