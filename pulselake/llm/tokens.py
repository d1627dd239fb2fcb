"""Exact ids of the public byte-level BPE vocabulary, encoded piece by piece.

The pre-tokeniser of ``byte_bpe_50k.json`` cuts a text into pieces, and the merges
never cross a piece.  The ids of a text are therefore the ids of its pieces, one
after another, and a piece that was met before need not be encoded again.  Every
piece is encoded by the ``tokenizers`` library itself; a bounded cache holds its ids
as little-endian unsigned 32-bit integers, so that a document is one ``bytes.join``.
A vocabulary with another pre-tokeniser, a normaliser or the like is encoded by the
library, text by text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: The pre-tokeniser's pattern, written for ``re`` (letters, digits and the
#: rest, each with one space before it), and what a vocabulary file says of it.
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
KNOWN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

#: Any other character than these may be a letter, a digit or white space to ``re`` and
#: something else to the library; a text with one is encoded whole by the library.
_UNSURE = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u20ac]")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Pieces that are remembered, in each of two generations.
GENERATION = 300_000


class _Pieces(dict):
    """Piece to its ids; a missing one is looked up in the generation before, then made."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
        if len(piece) <= 64:
            self[piece] = got
        return got

    def turn(self) -> None:
        if len(self) > GENERATION:
            self.old = dict(self)
            self.clear()


def _byte_letters() -> dict[int, int]:
    """The vocabulary writes each byte as one character: printable ones as themselves, the
    others, in order, as the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class PieceEncoder:
    """``encode(texts)`` yields the library's ids of each text, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.special = tuple(t["content"] for t in said.get("added_tokens") or ())
        pre, model = said.get("pre_tokenizer") or {}, said["model"]
        plain = not any(said.get(k) for k in ("normalizer", "truncation", "padding", "post_processor"))
        plain &= model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        #: Whether the pieces are those of PATTERN.
        self.known = plain and bool(pre) and all(pre.get(k, v) == v for k, v in KNOWN.items())
        self._model = self.tokenizer.model
        self._letters = _byte_letters()
        self._split = re.compile(PATTERN).findall
        self._pieces = _Pieces(self._piece)

    def whole(self, text: str) -> bytes:
        """The ids of a text that the library encodes in one call."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """The library's merges over one piece."""
        word = piece.encode().decode("latin-1").translate(self._letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self._model.tokenize(word)])

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text is empty."""
        get = self._pieces.__getitem__
        for t in texts:
            t = t or ""
            if not self.known or any(map(t.__contains__, self.special)) or any(map(t.__contains__, _SEPARATORS)) or (not t.isascii() and _UNSURE.search(t)):
                yield self.whole(t)
            else:
                yield b"".join(map(get, self._split(t)))
                self._pieces.turn()


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
