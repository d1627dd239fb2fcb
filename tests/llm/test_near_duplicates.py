"""Near-duplicates at other thresholds than op5's, against brute force."""

import random

import pytest
from pulselake.llm import minhash_dedup
from test_documents import closure, shingle_set

import corpus_pipeline


def altered(spark, changes, groups, seed=7):
    """Texts of 100 words, each with copies in which so many words far apart are changed."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((len(rows), " ".join(base)))
        for k in changes:
            w = list(base)
            for i in range(k):
                w[10 + 80 // k * i] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def least_of_groups(docs, percent):
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return closure(ids, linked)


def test_stage_takes_four_fifths(spark):
    docs = altered(spark, (2,), 60).union(altered(spark, (3,), 20, 8).selectExpr("doc_id + 1000", "text")).cache()
    want = {i for i, c in least_of_groups(docs, 80).items() if i == c}
    assert len(want) == 60 + 40
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_thresholds(spark, percent, monkeypatch):
    for name in ("LIMIT", "LOT", "SKETCH_TILE", "TILE"):
        monkeypatch.setattr(minhash_dedup, name, 8)
    docs = altered(spark, (0, 1, 2, 3, 4), 12)
    got = {r.doc_id: r.component_id for r in minhash_dedup.deduplicate(docs, percent).collect()}
    assert got == least_of_groups(docs, percent)


def test_search_follows_the_threshold():
    for percent in (60, 80, 85, 95):
        how, s = minhash_dedup.search(percent), percent / 100
        assert (1 - s) ** how.trees <= minhash_dedup.MISS and (1 - s**minhash_dedup.PATH) ** how.branches <= minhash_dedup.LOST
    assert minhash_dedup.search(80).least < minhash_dedup.search(85).least
    with pytest.raises(ValueError):
        minhash_dedup.search(0)


def test_recall_at_the_threshold_of_op5():
    """No tree is left out: at 0.85 eight trees, and no branching loses more than three single tokens would."""
    how = minhash_dedup.search(minhash_dedup.PERCENT)
    assert (how.trees, how.branches, minhash_dedup.PATH, minhash_dedup.DEPTH) == (8, 8, 4, 4) and how.least <= 0.71 * minhash_dedup.SKETCH + 1
    assert 0.15**how.trees < 3e-7 and (1 - 0.85**minhash_dedup.PATH) ** how.branches < 0.0034
