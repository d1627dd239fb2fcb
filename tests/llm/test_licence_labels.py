"""Labels and scores of licence scans against a scan of every place."""

import math
import random

import pytest
from pulselake.llm import license_scan, queries
from pulselake.llm.license_scan import BASE, TEMPLATES, scan_licenses, slack, words_of


def split(text):
    return [w.decode() for w in words_of(text)]


def full_scan(texts):
    """Every template is held against every place of every text."""
    files = [split(t) for t in texts]
    weight = {w: math.log(1 + len(files) / (1 + sum(w in set(f) for f in files))) for t in (*BASE, *(t for _, t, _ in TEMPLATES)) for w in split(t)}
    found = []
    for words in files:
        labels = {label for p, label in BASE.items() if f" {p} " in f" {' '.join(words)} "}
        score = 1.0 if labels else 0.0
        for label, t, keys in TEMPLATES:
            t, free, keys = split(t), [k.startswith("... ") for k in keys], [k.removeprefix("... ").split() for k in keys]
            at = [" ".join(t).split(" ".join(k))[0].count(" ") for k in keys]
            for a in range(len(words)):
                follow = lambda: next((b for b in range(a + 1, len(words)) if words[b : b + len(keys[0])] == keys[0]), len(words))  # noqa: B023, E731
                after = lambda k: any(words[b : b + len(k)] == k for b in range(a + len(keys[0]), follow()))  # noqa: B023, E731
                near = lambda k, p: any(words[b : b + len(k)] == k for b in range(max(0, a + p - slack(p)), a + p + slack(p) + 1))  # noqa: B023, E731
                if words[a : a + len(keys[0])] == keys[0] and all(after(k) if o else near(k, p - at[0]) for k, p, o in zip(keys[1:], at[1:], free[1:], strict=True)):
                    labels.add(label)
                    here = [w for p, w in enumerate(t) if any(0 <= b < len(words) and words[b] == w for b in range(a + p - at[0] - slack(abs(p - at[0])), a + p - at[0] + slack(abs(p - at[0])) + 1))]
                    score = max(score, sum(weight[w] for w in here) / sum(weight[w] for w in t))
        found.append((",".join(sorted(labels)), score))
    return found


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(docs).collect()}
    want = full_scan(texts)
    assert {i: label for i, (label, _) in got.items()} == {i: label for i, (label, _) in enumerate(want)}
    assert all(got[i][1] == pytest.approx(score) for i, (_, score) in enumerate(want))
    return {i: label for i, (label, _) in got.items()}


def test_templates_with_words_that_no_document_holds(spark):
    got = check(spark, ["GNU General Public License version 3", "nothing of the kind", "Apache License, Version 2.0"])
    assert got == {0: "gpl,gpl-3.0", 1: "", 2: "apache-2.0"}


def test_key_phrases_alone_give_the_label_whatever_other_files_hold(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    mpl = "Mozilla Public License, v. 2.0"
    for others in (["nothing"], [bsd] * 5, [mpl, "redistribution forms mozilla"] * 3, ["source code and binary use v 2 0"] * 9):
        got = check(spark, [bsd, mpl, "Released under the MIT license.", *others])
        assert (got[0], got[1], got[2]) == ("bsd", "mpl-2.0", "mit")


def test_names_of_any_length_and_usual_notices(spark):
    third = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software"
    texts = [
        third.format("Lawrence Livermore National Security LLC the US Department of Energy"), third.format("x " * 500), third.format("a Neither the name of b"), "may be used to endorse or promote products derived from this software. Neither the name of",
        "SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: Apache-2.0", "licensed under LGPL-2.1", "MIT licence", "Creative Commons Attribution-ShareAlike 4.0", "the Apache 2.0 license",
    ]
    got = check(spark, texts)
    assert [got[i] for i in range(len(texts))] == ["bsd-3-clause"] * 3 + ["", "mit", "gpl-2.0", "apache-2.0", "lgpl-2.1", "mit", "cc-by-sa-4.0", "apache-2.0"]


def test_groups_of_copies_and_altered_templates(spark):
    rng, texts = random.Random(5), ["GNU General Public License version 3"] * 40 + ["this work is licensed under the sun"]
    for _, t, keys in TEMPLATES:
        key_words = {w for k in keys for w in k.removeprefix("... ").split()}
        for share in (0.0, 0.5, 1.0):
            words = [w if w in key_words or rng.random() < share else f"q{rng.randrange(99)}" for w in split(t)]
            texts += [" ".join(words), " ".join(words[1:]), "before it " + " ".join(words) + " and after " + t]
        moved = split(t)
        for _ in range(3):
            moved.insert(rng.randrange(len(moved)), "q")
        texts.append(" ".join(moved))
    check(spark, texts)


def test_documents_of_the_table(spark):
    rows = queries.table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()
    assert {"gpl,gpl-3.0", "apache-2.0", "mit"} & set(check(spark, [r.text for r in rows]).values())


def test_labels_do_not_hang_on_the_counts():
    for counts in ({}, {w: n for n, w in enumerate("gnu general public license version 3 apache 2 0".split(), 1)}, {"license": 10, "gnu": 10}):
        index = license_scan.Index(counts, 10)
        for _, t, _ in TEMPLATES:
            assert index.scan(t)[5] == full_scan([t])[0][0]
        assert index.scan("gnu general public license version 3")[5] == "gpl,gpl-3.0"


def test_base_phrases_are_found_by_the_index(monkeypatch):
    """Each is led to by its rarest word, whichever that is, also where the word repeats."""
    monkeypatch.setattr(license_scan, "BASE", BASE | {"x y x": "twice"})
    text = "x y x y x cc by cc by general public license public rights reserved all rights reserved by"
    words = text.split()
    want = sorted(i for p in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    for common in ("x", "y", "cc", "by", "general", "public", "license", "all", "rights", "reserved"):
        index = license_scan.Index({common: 9}, 10)
        assert common not in index.base and len([b for found in index.base.values() for b in found]) == len(license_scan.BASE)
        assert index.scan(text)[1:5] == (len(want), want[0], want[-1], "cc-by,gpl,reserved,twice")
