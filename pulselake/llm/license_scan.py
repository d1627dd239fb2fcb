"""Licence scans by a positional rare-token index.

Templates are licences and notices as word sequences, with mandatory key phrases.  A first pass
counts in how many documents each licence word occurs, over the whole corpus.  Of each file the
licence words are looked up, the rarest first; a template is a candidate if the file holds all
of its key words, whichever led to it.  The postings of the word that led to it give, by relative
position, the places at which the template may stand; there all its key phrases are verified, each
within a slack that grows with its distance from the first one, or, where a name of any length may
stand between, anywhere before the next first one.  Where they stand the file has the
label, whatever other files hold; the score is the share, by rarity in the corpus, of the
template's words that are in their places, 1 with a base phrase.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.  The base
phrases are found the same way, by each one's rarest word, wherever its words stand consecutively.

Defined cases: a null or empty text has no words, places or labels, and score 0; texts of any length
are scanned whole; repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Identifiers in files' headers, and the labels that they give.
SPDX = {
    "MIT": "mit", "Apache-2.0": "apache-2.0", "GPL-2.0": "gpl-2.0", "GPL-3.0": "gpl-3.0", "LGPL-2.1": "lgpl-2.1", "LGPL-3.0": "lgpl-3.0", "AGPL-3.0": "agpl-3.0", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd-3-clause",
    "ISC": "isc", "Zlib": "zlib", "MPL-2.0": "mpl-2.0", "Unlicense": "unlicense", "BSL-1.0": "bsl-1.0", "CC0-1.0": "cc0-1.0", "CC-BY-4.0": "cc-by-4.0", "CC-BY-SA-4.0": "cc-by-sa-4.0",
}
#: Templates of the method: label, words of the licence or notice, and the key
#: phrases that must stand in every copy, in their order.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("you may not use this file except in compliance with the license", "without warranties or conditions of any kind"),
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("under the terms of the gnu general public license", "version 3 of the license"),
    ),
    (
        "gpl-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("under the terms of the gnu general public license", "version 2 of the license"),
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation""",
        ("gnu lesser general public license",),
    ),
    (
        "agpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License""",
        ("gnu affero general public license",),
    ),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", ("cc by nc nd 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal", ("waived all copyright and related or neighboring rights",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
        OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("permission is hereby granted free of charge", "copy of this software"),
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    (
        "bsd-3-clause",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
        ("neither the name of", "... may be used to endorse or promote products derived from this software"),
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
        anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
        ("permission is granted to anyone to use this software for any purpose", "to alter it and redistribute it freely"),
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ("mozilla public license v 2 0",),
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ("free and unencumbered software released into the public domain",),
    ),
    (
        "bsl-1.0",
        """Boost Software License - Version 1.0 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license""",
        ("boost software license",),
    ),
    ("proprietary", "All rights reserved", ("all rights reserved",)),
    ("mit", "Released under the MIT licence", ("mit licence",)),
    ("apache-2.0", "Licensed under the Apache 2.0 license", ("apache 2 0 license",)),
    ("lgpl-2.1", "Licensed under LGPL-2.1", ("licensed under lgpl 2 1",)),
    ("cc-by-sa-4.0", "Licensed under Creative Commons Attribution-ShareAlike 4.0", ("creative commons attribution sharealike 4 0",)),
    *((label, f"SPDX-License-Identifier: {name}", ("spdx license identifier " + " ".join(re.split("[-.]", name.lower())),)) for name, label in SPDX.items()),
)


def slack(distance: int) -> int:
    """By how many words a word or phrase so far from the first key phrase may be out of place."""
    return 3 + distance // 8


#: Bytes that are no part of words become spaces; A-Z become a-z.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_CLEAN).split()


class Template(NamedTuple):
    label: str
    words: list[bytes]
    keys: list[list[bytes]]
    at: list[int]  # where in the words each key phrase begins
    open: list[bool]  # whether words of any number may stand before it


#: Before a key phrase: behind the first one, names of any length may stand there.
ANY = "... "


def template(label: str, text: str, keys: tuple[str, ...]) -> Template:
    words, at = words_of(text), []
    phrases = [k.removeprefix(ANY).encode().split() for k in keys]
    for phrase in phrases:
        at.append(next(p for p in range(at[-1] if at else 0, len(words)) if words[p : p + len(phrase)] == phrase))
    return Template(label, words, phrases, at, [k.startswith(ANY) for k in keys])


class Index:
    """Postings of the key phrases' words, and the weights of rarity in a corpus of all words."""

    def __init__(self, counts: dict[str, int], n_docs: int):
        self.templates = [template(*t) for t in TEMPLATES]
        base = [(p.encode().split(), label) for p, label in BASE.items()]
        known = {w for t in self.templates for w in t.words} | {w for phrase, _ in base for w in phrase}
        self.idf = {w: math.log(1 + n_docs / (counts.get(w.decode(), 0) + 1)) for w in known}
        #: Licence words, the rarest first.
        self.rank = {w: i for i, w in enumerate(sorted(known, key=lambda w: (-self.idf[w], w)))}
        #: By key word: the template, the key phrase, and where in the phrase the word stands.
        self.postings: dict[bytes, list[tuple[int, int, int]]] = {}
        for t, one in enumerate(self.templates):
            for k, phrase in enumerate(one.keys):
                for p, w in enumerate(phrase):
                    self.postings.setdefault(w, []).append((t, k, p))
        self.holders = {w: sorted({t for t, _, _ in found}) for w, found in self.postings.items()}
        #: How many different key words each template has: a file must hold them all.
        self.needed = [len({w for k in t.keys for w in k}) for t in self.templates]
        #: By each base phrase's rarest word: the phrase, where in it the word stands, its label.
        self.base: dict[bytes, list[tuple[list[bytes], int, str]]] = {}
        for phrase, label in base:
            rarest = min(phrase, key=self.rank.__getitem__)
            self.base.setdefault(rarest, []).append((phrase, phrase.index(rarest), label))

    def candidates(self, held: set[bytes]) -> dict[int, bytes]:
        """Templates of which a file holds every key word, each with the first of them that led
        to it: the file's licence words are looked up in the order of their rarity."""
        led: dict[int, bytes] = {}
        found: Counter = Counter()
        for w in sorted(self.postings.keys() & held, key=self.rank.__getitem__):
            for t in self.holders[w]:
                led.setdefault(t, w)
                found[t] += 1
        return {t: w for t, w in led.items() if found[t] == self.needed[t]}

    def places(self, words: list[bytes], t: int, rare: bytes) -> set[int]:
        """Where the template's first key phrase stands with all others in their places.

        The postings of the rare word give the places; what stands there is verified."""
        one = self.templates[t]
        first, found = one.keys[0], set()
        starts = [i for i, w in enumerate(words) if w == first[0] and words[i : i + len(first)] == first] if any(one.open) else []
        for i, w in enumerate(words):
            if w != rare:
                continue
            for s, k, p in self.postings[rare]:
                if s != t or i < p or words[i - p : i - p + len(one.keys[k])] != one.keys[k]:
                    continue
                if one.open[k]:  # the last first phrase before it
                    near = starts[max(0, bisect_left(starts, i - p) - 1) :][:1]
                else:
                    far = one.at[k] - one.at[0]
                    reach = slack(far) if k else 0
                    near = range(max(0, i - p - far - reach), i - p - far + reach + 1)
                for a in near:
                    if a not in found and words[a : a + len(first)] == first and self._stands(words, one, a, starts):
                        found.add(a)
        return found

    @staticmethod
    def _stands(words: list[bytes], one: Template, a: int, starts: list[int]) -> bool:
        """The other key phrases stand where they should beside the first one at ``a``; an open one
        anywhere before the next first one."""
        for key, at, open_ in zip(one.keys[1:], one.at[1:], one.open[1:], strict=True):
            there = a + at - one.at[0]
            reach = slack(at - one.at[0])
            if open_:
                later = starts[bisect_left(starts, a + 1) :][:1]
                near = range(a + len(one.keys[0]), later[0] if later else len(words))
            else:
                near = range(max(0, there - reach), there + reach + 1)
            if not any(words[b] == key[0] and words[b : b + len(key)] == key for b in near if b < len(words)):
                return False
        return True

    def share(self, words: list[bytes], t: int, a: int) -> float:
        """The share, by rarity, of the template's words that stand in their places."""
        one, got = self.templates[t], 0.0
        for p, w in enumerate(one.words):
            there, reach = a + p - one.at[0], slack(abs(p - one.at[0]))
            if w in words[max(0, there - reach) : max(0, there + reach + 1)]:
                got += self.idf[w]
        return min(1.0, got / sum(self.idf[w] for w in one.words))

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = words_of(text)
        held = set(words)
        at: list[int] = []
        base = set()
        if leads := self.base.keys() & held:
            for i, w in enumerate(words):
                if w in leads:
                    for phrase, p, label in self.base[w]:
                        if i >= p and words[i - p : i - p + len(phrase)] == phrase:
                            at.append(i - p)
                            base.add(label)
        labels, score = set(base), 1.0 if base else 0.0
        for t, rare in self.candidates(held).items():
            for a in self.places(words, t, rare):
                labels.add(self.templates[t].label)
                score = max(score, self.share(words, t, a))
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each template word occurs; at most as many rows as such words."""
    known = frozenset(w for t in (*BASE, *(t for _, t, _ in TEMPLATES)) for w in words_of(t))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                found.update(known.intersection(words_of(t.as_py())))
            found[b""] += batch.num_rows
        words = [w.decode() for w in found]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word: r.n for r in rows}
    return counts, counts.pop("", 0)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ship(docs.sparkSession)
    counts, n = document_frequencies(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(counts, n)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        for batch in batches:
            cols = list(zip(*(index.scan(t.as_py()) for t in batch.column(1)), strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
