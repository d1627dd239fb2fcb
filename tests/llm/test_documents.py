"""Near-duplicates, languages, licences and mixing, against brute force."""

import random
import re

import pytest
from pulselake.llm import langid, license_scan, minhash_dedup, mixing, queries

SF = "/root/testdata/sf0.001"

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def closure(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def check_components(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = closure(ids, linked)
    got = minhash_dedup.deduplicate(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def near_copies(spark, n, groups):
    rng, rows = random.Random(3), []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_near_duplicates_edges(spark, edge_docs):
    check_components(edge_docs)


def test_near_duplicates_table(spark):
    check_components(queries.table(spark, SF, "documents"))


def test_large_groups_branch_and_tile(spark, monkeypatch):
    for name in ("LIMIT", "TILE"):
        monkeypatch.setattr(minhash_dedup, name, 8)
    check_components(near_copies(spark, 40, 4))


def test_distinct_documents(spark, edge_docs):
    kept = minhash_dedup.distinct_documents(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [0, 3, 4, 5, 6, 7, 8, 10, 11, 13]


def test_languages(spark, edge_docs):
    sf = SF.replace("sf0.001", "sf0.01")
    docs = queries.table(spark, sf, "documents").select("doc_id", "text", "lang")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 350 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    edges = {r.doc_id: r for r in langid.identify(edge_docs).collect()}
    assert edges[3].lang_pred == edges[4].lang_pred == edges[10].lang_pred == "und" and edges[3].score == 0
    assert all(0 <= r.score <= 1 for r in edges.values()) and edges[0].lang_pred in ("en", "fr", "de")
    kept = langid.accepted(edge_docs)
    assert kept.columns == edge_docs.columns and 3 not in {r.doc_id for r in kept.collect()}
    nothing = edge_docs.withColumn("lang", edge_docs["source"].substr(1, 0)).where("lang is null")
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}


def test_tables_of_byte_pairs_are_the_network():
    net = langid.train(["the cat and the dog " * 30, "der hund und die katze " * 30], ["en", "de"])
    x = langid.windows_of("ein kleiner hund in the garden, ".encode() * 20)
    assert abs(langid._forward(net, x)[2] - langid.Predictor(net).windows(x)).max() < 1e-5


def base_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("which", ["edges", "table", "made"])
def test_licences(spark, edge_docs, which):
    texts = ["cc by cc by CC-BY", "all rights reserved all rights reserved", "xcc by", "general public licenses", "This work is licensed under the GNU General Public License, version 3."]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = {"edges": edge_docs, "table": queries.table(spark, SF, "documents"), "made": made}[which]
    rows = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    got = license_scan.scan_licenses(docs).distinct().collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted({(i, *base_places(t)) for i, t in rows}, key=key)
    assert sorted({(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got}, key=key) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    if which == "made":
        assert {r.doc_id: r.labels for r in got}[4] == "gpl,gpl-3.0"
    if which == "edges":
        assert {r.doc_id: r.labels for r in got}[13] == "apache-2.0,proprietary,reserved"


def water_level(sizes, weights):
    target, open_ = {}, set(sizes)
    left = sum(sizes.values())
    while True:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * left > 3 * sizes[s] * w}
        if not over:
            return target | {s: weights[s] * left / w if w else 0.0 for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left = sum(sizes.values()) - sum(target.values())
        open_ -= over


@pytest.mark.parametrize("which", ["edges", "table"])
def test_mixture(spark, edge_docs, which):
    docs = edge_docs if which == "edges" else queries.table(spark, SF, "documents")
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r.size for r in got) == sorted(size(r.text) for r in docs.select("text").collect())
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = water_level(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
    assert all(abs(taken[s] - goal[s]) < 1 for s in sizes)


def test_mixed_documents(spark):
    docs = queries.table(spark, SF, "documents")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_documents(docs)
    got = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert rows.columns == docs.columns and got == {i: n for i, n in copies.items() if n}


def test_empty_tables(spark, no_docs):
    for f in (minhash_dedup.deduplicate, minhash_dedup.distinct_documents, langid.identify, langid.accepted, license_scan.scan_licenses, mixing.mix, mixing.mixed_documents):
        assert f(no_docs).count() == 0


def test_columns_of_clashing_names(spark):
    """Helper columns give way to the documents' own."""
    names = ("__salt", "__gone", "__key", "__copies", "__copy", "_salt", "component", "node", "rep", "no", "same")
    text = "one two three four five six seven eight nine ten"
    rows = [(i, text if i < 3 else f"{text} {i} a b c d e f g", "s", *(f"{n}{i}" for n in names)) for i in range(6)] + [(None, text, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    for f in (minhash_dedup.distinct_documents, mixing.mixed_documents):
        got = f(docs)
        assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}
    kept = {r.doc_id for r in minhash_dedup.distinct_documents(docs).collect()}
    assert kept == {0, 3, 4, 5, None}


def test_rows_of_one_doc_id_are_documents_of_their_own(spark):
    texts = [" ".join(f"w{k * 100 + i}" for i in range(60)) for k in range(2)]
    docs = spark.createDataFrame([(1, texts[0]), (5, texts[0]), (5, texts[1]), (9, texts[1] + " x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.deduplicate(docs).collect())
    assert got == [(1, 56, 1, True), (5, 56, 1, False), (5, 56, 5, True), (9, 57, 5, False)]
