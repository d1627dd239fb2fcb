"""Dynamic itemset counting against counting everything."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pulselake.llm import collocations, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(docs, longest=3):
    found, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                found.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return found, n


def brute(docs, threshold=10, longest=3, reported=2000, contained=50):
    found, n = counts(docs, longest)
    out = []
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= contained * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:reported], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def rows(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def test_against_counting_everything(spark):
    docs = [tuple(r) for r in queries.table(spark, SF, "documents").select("lang", "text").collect()]
    assert rows(queries.op12_collocations(spark, SF)) == brute(docs)


@pytest.fixture(scope="module")
def small(spark):
    rng, words = random.Random(8), ["a", "b", "c", "d", "é", "ß", "rare", "x-y", "A", " ", "\x1c"]
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), rng.choice([None, "", " . ", "a b c a b c"] + [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n", "\t", "!?"]) for _ in range(rng.randrange(60))) for _ in range(12)])) for _ in range(160)]
    return rows, spark.createDataFrame(rows, "lang string, text string").repartition(5)


@pytest.mark.parametrize(("threshold", "longest", "reported", "contained", "shards"), [(10, 3, 2000, 50, 3), (2, 3, 5, 90, 1), (5, 2, 2000, 50, 4), (12, 5, 2000, 70, 2)])
def test_settings(small, threshold, longest, reported, contained, shards):
    docs, table = small
    assert rows(collocations.collocations(table, threshold, longest, reported, contained, shards)) == brute(docs, threshold, longest, reported, contained)


def test_counts_hold_when_all_phrases_share_few_slots(small, monkeypatch):
    """Phrases of one slot are activated too early, and are counted right."""
    docs, table = small
    monkeypatch.setattr(collocations, "SLOTS", 3)
    monkeypatch.setattr(collocations, "BLOCK", 200)
    found, n = counts(docs)
    want = {(lang, " ".join(p), len(p), a) for lang, f in found.items() for p, a in f.items() if a >= 10} | {(lang, "", 0, a) for lang, a in n.items()}
    assert {(r.lang, r.phrase, r.words, r.n) for r in collocations.frequent_phrases(table).collect()} == want


def test_phrases_of_three_words_whose_slots_are_words(spark, monkeypatch):
    """A phrase of three words begins with those of two where words have set the slots of its parts."""
    rng = random.Random(3)
    docs = [(rng.choice(["en", None]), " ".join(rng.choice(["red green blue", "ha ha ha ha", "one two", "red"]) for _ in range(9)) + rng.choice(["", ". red green blue"])) for _ in range(60)]
    table = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "SLOTS", 3)
    assert rows(collocations.collocations(table)) == brute(docs)


def test_a_repeated_word_whose_pair_has_the_slot_of_another_word(spark):
    """The same with all slots: of a few thousand words some pair meets a word."""
    slot = lambda phrase: zlib.crc32(f"en\0{phrase}".encode()) % collocations.SLOTS
    words = {slot(w): w for w in (f"v{i}" for i in range(20_000))}
    twice, other = next((w, words[slot(f"{w} {w}")]) for w in (f"w{i}" for i in range(20_000)) if slot(f"{w} {w}") in words)
    docs = [("en", f"{other}. {twice} {twice} {twice}. x y z")] * 150
    assert rows(collocations.collocations(spark.createDataFrame(docs, "lang string, text string").repartition(3))) == brute(docs)


def test_scores_beyond_64_bits(spark, monkeypatch):
    phrases = spark.createDataFrame([("en", "", 0, 10**15), ("en", "a", 1, 9 * 10**14), ("en", "b", 1, 8 * 10**14), ("en", "a b", 2, 7 * 10**14)], "lang string, phrase string, words int, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: phrases)
    (row,) = collocations.collocations(phrases).collect()
    assert row.score == 10**6 * (7 * 10**14) ** 2 // (9 * 10**14 * 8 * 10**14)


def test_edges(edge_docs, no_docs):
    docs = [tuple(r) for r in edge_docs.select("lang", "text").collect()]
    assert rows(collocations.collocations(edge_docs, threshold=2)) == brute(docs, threshold=2)
    assert rows(collocations.collocations(no_docs)) == []


def plain_tokens(raw):
    folded = re.sub(rb"[.,;:!?\x0a-\x0d]", b" \n ", raw.lower()).replace(b"\t", b" ")
    return [w for w in folded.split(b" ") if w]


@pytest.mark.parametrize("raw", [b"", b" ", b"a", b"\n", "A  b.B\tc\x0b\x1c,".encode(), b"\0 \0\0 a\0 a", b"x" * 7 + b" " + b"x" * 8 + b" " + b"x" * 9, b" ".join(b"y" * n for n in (15, 16, 17, 18, 16, 300, 300)), "é" .encode() * 8 + b"\t" + "é".encode() * 9])
def test_tokens(raw):
    ids, words = collocations.tokens(raw)
    assert [words[i] for i in ids] == plain_tokens(raw) and words[0] == b"\n" and len(set(words)) == len(words)


def test_tokens_of_mixes_that_meet(monkeypatch):
    """Words that are told apart by what they are, not by how they mix."""
    real, calls = np.unique, []

    def unique(a, **kw):
        calls.append(kw)
        return real(a if kw.get("axis") == 0 else a * 0, **kw) if len(calls) == 1 else real(a, **kw)

    monkeypatch.setattr(collocations.np, "unique", unique)
    ids, words = collocations.tokens(b"one two one three")
    assert [words[i] for i in ids] == [b"one", b"two", b"one", b"three"] and len(calls) == 2


def test_phrases_of_many_words(small):
    """Numbers of phrases are made anew where they would pass 64 bits."""
    raw = b" ".join(f"w{i % 97}".encode() for i in range(3000))
    reached = np.zeros(collocations.SLOTS, np.uint8)
    got = {k: (len(n), int(n.sum())) for k, _, n, _, _ in collocations.counted("en", raw, 11, reached, collocations.Appender(), 12, 12)}
    assert got == {k: (97, 3000 - k + 1) for k in range(2, 13)} | {0: (1, 3000), 1: (97, 3000)}
