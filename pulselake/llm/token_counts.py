"""Token counts, with overlap resynchronisation for huge documents.

A huge document is encoded in overlapping chunks, with offsets.  Two neighbouring chunks are
spliced at a token boundary that both have and that is proven stable: where something else turns
into white space, or letters, digits and punctuation turn into one another (but not from
punctuation to letters, which contractions span).  No piece of the pre-tokeniser spans such a
place, and where a special string does it is not taken, so the tokens before it and after it do
not depend on each other.  The overlap reaches back to the last such place of the left chunk; it
is doubled if the boundaries do not align.  A chunk without any such place is doubled, so that all
that is encoded comes to a few times the text at most.

Defined cases: a null text counts as empty: 0 bytes, 0 tokens; repeated rows count each; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .tokens import PieceEncoder, encoder

#: Longer texts are counted in chunks of so many characters, overlapping by so many at first.
HUGE_CHARS, CHUNK_CHARS, OVERLAP_CHARS = 65_536, 32_768, 256
LIMIT = 512
#: Characters that every library takes for white space, digits, letters and punctuation.
_SPACE, _DIGIT = r" \t\n\r", "0-9"
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARK = r"!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
STABLE = re.compile(f"(?<=[{_LETTER}{_DIGIT}{_MARK}])(?=[{_SPACE}])|(?<=[{_LETTER}])(?=[{_DIGIT}{_MARK}])|(?<=[{_DIGIT}])(?=[{_LETTER}{_MARK}])|(?<=[{_MARK}])(?=[{_DIGIT}])")


def _ends(tokenizer, text: str) -> list[int]:
    """Where each token ends, in characters of ``text``."""
    return [b for _, b in tokenizer.encode(text, add_special_tokens=False).offsets]


def _last_stable(text: str, ends: set[int], first: int, stop: int, special: tuple[str, ...]) -> int | None:
    """The last stable place between them that is one of ``ends``, looked for in widening stretches from the end."""
    width = 64
    while True:
        low = max(first, stop - width)
        for k in reversed([m.start() for m in STABLE.finditer(text, low + 1, stop)]):
            if k in ends and not any(s in text[max(0, k - len(s) + 1) : k + len(s) - 1] for s in special):
                return k
        if low == first:
            return None
        width *= 2


def count_huge(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, special: tuple[str, ...] = ()) -> int:
    """The tokens of the whole text, though no more than a chunk is encoded at once."""
    longest = max(map(len, special), default=0)
    total, begun, at, size = 0, 0, 0, chunk  # tokens before `begun` are counted; the chunk starts at `at`
    stop = min(len(text), size)
    ends = [at + e for e in _ends(tokenizer, text[at:stop])]
    while stop < len(text):
        # a special string may go on behind the chunk: places so near its end are left alone
        cut = _last_stable(text, set(ends), begun, max(begun, stop - 1 - longest), special)
        if cut is None:  # nothing stable in all of the chunk: it grows
            size *= 2
            at, stop = begun, min(len(text), begun + size)
            ends = [at + e for e in _ends(tokenizer, text[at:stop])]
            continue
        width = overlap
        while True:
            nxt = max(begun, cut - width)
            after = min(len(text), max(nxt + chunk, stop + 1))
            more = [nxt + e for e in _ends(tokenizer, text[nxt:after])]
            if cut in more or nxt == begun:
                break
            width *= 2  # the chunks do not align yet
        total += sum(begun < e <= cut for e in ends)
        begun, at, stop, ends, size = cut, nxt, after, more, chunk
    return total + sum(e > begun for e in ends)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe: PieceEncoder = encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            short = (len(ids) // 4 for ids in bpe.encode(t for t in texts if len(t) <= HUGE_CHARS))
            tokens = [next(short) if len(t) <= HUGE_CHARS else (count_huge(bpe.tokenizer, t, special=bpe.special) if bpe.known else len(bpe.whole(t)) // 4) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
