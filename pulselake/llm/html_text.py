"""Main text of HTML pages by a recurrent block labeller, trained here in numpy.

Each leaf block of a page is a vector: hashes of the tags and names on its path, hashes of its
words, and a few measures.  A bidirectional LSTM reads a page's blocks in order, so that each is
classified with the whole document before and behind it in view; the article's blocks, in page
order, make the text.

Labels come from the pages themselves: where markup names an article and what stands apart from it.
The network learns from at most SAMPLE such pages, those of the least hashes of their url and
page_id, as they are and DRESSES times more in another dress (article and surroundings in other
elements, under other names or none that say anything), so that it does not hang on one layout.  A
page that shows no article gives its long unlinked blocks as one.

Defined cases: a null or empty page has no block and gives an empty text; a page without any main
block gives an empty text; unclosed tags end where HTML ends them; repeated rows give the same text
each; long pages are read whole; without any page to learn from every block counts as main.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .html_blocks import APART_NAMES, Block, blocks_of, dressed, marked_main

#: Bounds the sample on which the network is fitted, and the blocks that are learned of a page.
SAMPLE, DRESSES, LEARNED_BLOCKS = 300, 4, 64
PATHS, WORDS = 512, 64
MEASURES = 11
WIDTH = PATHS + WORDS + MEASURES
EMBED, HIDDEN = 24, 16
EPOCHS, BATCH, RATE = 20, 32, 0.01
#: So many padded blocks are labelled at once, or one page.
CELLS = 16_384
_STOP = re.compile(r"[.!?,;:](?:\s|$)")


class Hashes(dict):
    """Places of names and words in the vectors, looked up once each."""

    def __init__(self, size: int, most: int = 200_000):
        self.size, self.most = size, most

    def __missing__(self, name: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[name] = n = zlib.crc32(name.encode()) % self.size
        return n


def vectors(blocks: list[Block], paths: Hashes, words: Hashes) -> np.ndarray:
    """A row for each block of a page."""
    x = np.zeros((len(blocks), WIDTH), dtype=np.float32)
    for i, b in enumerate(blocks):
        row, n = x[i], len(b.text)
        for element in b.path:
            row[paths[element[0]]] = 1
            for name in element[1:]:
                row[paths["." + name]] = 1
        if b.path:
            row[paths["leaf " + b.path[-1][0]]] = 1
        found = b.text.lower().split()
        counts = np.bincount([words[w] for w in found], minlength=WORDS)
        row[PATHS : PATHS + WORDS] = counts / np.sqrt((counts * counts).sum())
        row[-MEASURES:] = (
            np.log1p(n) / 8, b.linked / n, min(1.0, len(_STOP.findall(b.text)) / len(found)), len(found) < 4, i / len(blocks), i == 0, i == len(blocks) - 1,
            "©" in b.text, min(1.0, len(b.path) / 12), any(not APART_NAMES.isdisjoint(e[1:]) for e in b.path), any(e[0] in ("article", "main") for e in b.path),
        )
    return x


class Network(NamedTuple):
    embed: np.ndarray  # WIDTH x EMBED
    embed_bias: np.ndarray
    into: list[np.ndarray]  # of each direction: EMBED x 4 HIDDEN
    again: list[np.ndarray]  # HIDDEN x 4 HIDDEN
    bias: list[np.ndarray]
    out: np.ndarray  # 2 HIDDEN + EMBED
    out_bias: np.ndarray

    def flat(self) -> list[np.ndarray]:
        return [self.embed, self.embed_bias, *self.into, *self.again, *self.bias, self.out, self.out_bias]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _recur(z: np.ndarray, mask: np.ndarray, again: np.ndarray, order: range, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction, from what comes in at each step: steps x pages x 4 HIDDEN."""
    h = c = np.zeros((z.shape[1], HIDDEN), np.float32)
    states, trace = np.zeros((*z.shape[:2], HIDDEN), np.float32), []
    for t in order:
        a = z[t] + h @ again
        gates, g, m = _sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :]), mask[t][:, None]
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        new = f * c + i * g
        tanh = np.tanh(new)
        if keep:
            trace.append((t, m, h, c, i, f, o, g, tanh))
        c = m * new + (1 - m) * c
        h = m * (o * tanh) + (1 - m) * h
        states[t] = h
    return states, trace


def _unwind(d_states: np.ndarray, trace: list, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of what came in and of the recurrent weights."""
    d_z, d_again = np.zeros((*d_states.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(again)
    d_h = d_c = np.zeros_like(d_states[0])
    for t, m, h, c, i, f, o, g, tanh in reversed(trace):
        d_h = d_h + d_states[t]
        d_new = m * (d_c + d_h * o * (1 - tanh * tanh))
        d_a = np.concatenate((d_new * g * i * (1 - i), d_new * c * f * (1 - f), m * d_h * tanh * o * (1 - o), d_new * i * (1 - g * g)), axis=1)
        d_z[t] = d_a
        d_again += h.T @ d_a
        d_h = (1 - m) * d_h + d_a @ again.T
        d_c = (1 - m) * d_c + d_new * f
    return d_z, d_again


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Steps x pages x WIDTH, and a mask of what is there."""
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), WIDTH), np.float32), np.zeros((longest, len(pages)), np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
    return x, mask


def _forward(net: Network, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    steps = len(x)
    e = np.tanh(x @ net.embed + net.embed_bias)
    ways = [_recur(e @ net.into[k] + net.bias[k], mask, net.again[k], range(steps) if k == 0 else range(steps - 1, -1, -1), keep) for k in (0, 1)]
    seen = np.concatenate((ways[0][0], ways[1][0], e), axis=2)
    return _sigmoid(seen @ net.out + net.out_bias), (e, seen, ways)


def fit(sample: list[tuple[np.ndarray, np.ndarray]], seed: int = 3) -> Network:
    """Gradient descent over labelled pages; the same pages make the same network."""
    rng = np.random.default_rng(seed)
    draw = lambda a, b: rng.normal(0, a**-0.5, (a, b)).astype(np.float32)
    forget = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN))).astype(np.float32)
    net = Network(
        draw(40, WIDTH).reshape(WIDTH, 40)[:, :EMBED].copy(), np.zeros(EMBED, np.float32), [draw(EMBED, 4 * HIDDEN) for _ in range(2)], [draw(HIDDEN, 4 * HIDDEN) for _ in range(2)],
        [forget.copy() for _ in range(2)], draw(2 * HIDDEN + EMBED, 1)[:, 0], np.zeros(1, np.float32),
    )
    first, second = [np.zeros_like(p) for p in net.flat()], [np.zeros_like(p) for p in net.flat()]
    steps, step = EPOCHS * -(-len(sample) // BATCH), 0
    for _ in range(EPOCHS):
        # pages of like length meet, in a new order each time
        order = sorted(rng.permutation(len(sample)).tolist(), key=lambda i: len(sample[i][0]) // 8)
        batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
        for k in rng.permutation(len(batches)):
            x, mask = _padded([sample[i][0] for i in batches[k]])
            y = np.zeros_like(mask)
            for j, i in enumerate(batches[k]):
                y[: len(sample[i][1]), j] = sample[i][1]
            p, (e, seen, ways) = _forward(net, x, mask, keep=True)
            d = (p - y) * mask / mask.sum()
            d_seen = d[..., None] * net.out
            d_e, backs = d_seen[..., 2 * HIDDEN :].copy(), []
            for w in (0, 1):
                d_z, d_again = _unwind(d_seen[..., w * HIDDEN : (w + 1) * HIDDEN], ways[w][1], net.again[w])
                flat = d_z.reshape(-1, 4 * HIDDEN)
                backs.append((e.reshape(-1, EMBED).T @ flat, d_again, flat.sum(axis=0)))
                d_e += d_z @ net.into[w].T
            d_pre = (d_e * (1 - e * e)).reshape(-1, EMBED)
            grads = [x.reshape(-1, WIDTH).T @ d_pre, d_pre.sum(axis=0), *(b[0] for b in backs), *(b[1] for b in backs), *(b[2] for b in backs), seen.reshape(-1, seen.shape[2]).T @ d.ravel(), d.sum(keepdims=True)[0]]
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for q, m, v, dq in zip(net.flat(), first, second, grads, strict=True):
                m += 0.1 * (dq - m)
                v += 0.001 * (dq * dq - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def labelled_pages(html: str, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The page's vectors and labels, as it is (if its markup says which) and in other dress."""
    rng, paths, words = random.Random(seed), Hashes(PATHS), Hashes(WORDS)
    blocks = blocks_of(html)
    marks = [marked_main(b) for b in blocks]
    out = []
    if any(marks):
        out.append((vectors(blocks, paths, words), np.array([m is True for m in marks], np.float32)))
        main, other = [b.text for b, m in zip(blocks, marks, strict=True) if m], [b.text for b, m in zip(blocks, marks, strict=True) if not m]
    else:
        long = [len(b.text) > 80 and 5 * b.linked < len(b.text) and m is not False for b, m in zip(blocks, marks, strict=True)]
        main, other = [b.text for b, m in zip(blocks, long, strict=True) if m], [b.text for b, m in zip(blocks, long, strict=True) if not m]
    if main:
        for _ in range(DRESSES):
            at = rng.randrange(len(main))
            page, labels = dressed(main[at : at + rng.randrange(3, 24)] if rng.random() < 0.5 else main[:24], other[:60], rng)
            found = blocks_of(page)
            if len(found) == len(labels):
                out.append((vectors(found, paths, words), np.array(labels, np.float32)))
    cut = [max(0, rng.randrange(len(y)) - LEARNED_BLOCKS // 2) if len(y) > LEARNED_BLOCKS else 0 for _, y in out]
    return [(x[a : a + LEARNED_BLOCKS], y[a : a + LEARNED_BLOCKS]) for (x, y), a in zip(out, cut, strict=True)]


def training_sample(pages: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of at most SAMPLE pages; they are made where the pages are."""
    learn = pages.where(F.length("html") > 0).withColumn("key", F.xxhash64("page_id", "url"))
    keys = learn.select("key").distinct().orderBy("key").limit(SAMPLE)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = labelled_pages(html.as_py(), key)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array([x.astype(np.float16).tobytes() for x, _ in found], pa.binary()), pa.array([y.astype(np.int8).tobytes() for _, y in found], pa.binary())], names=["key", "no", "x", "y"])

    chosen = learn.join(F.broadcast(keys), "key").select("key", "html")
    rows = chosen.mapInArrow(draw, "key long, no int, x binary, y binary").dropDuplicates(["key", "no"]).orderBy("key", "no").limit(SAMPLE * (DRESSES + 1)).collect()
    return [(np.frombuffer(bytes(r.x), np.float16).reshape(-1, WIDTH).astype(np.float32), np.frombuffer(bytes(r.y), np.int8).astype(np.float32)) for r in rows if len(r.y)]


class Labeller:
    """A network, and the hashes that its task has looked up."""

    def __init__(self, net: Network | None):
        self.net, self.paths, self.words = net, Hashes(PATHS), Hashes(WORDS)

    def labels(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Of each block of each page whether it is main text."""
        if self.net is None:
            return [np.ones(len(p), bool) for p in pages]
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            # as many of the longest that are left as CELLS holds
            take = max(1, CELLS // len(pages[order[-1]]))
            now, order = order[-take:], order[:-take]
            x, mask = _padded([vectors(pages[i], self.paths, self.words) for i in now])
            p, _ = _forward(self.net, x, mask)
            for k, i in enumerate(now):
                out[i] = p[: len(pages[i]), k] >= 0.5
        return out

    def texts(self, htmls: list[str | None]) -> list[str]:
        pages = [blocks_of(h) for h in htmls]
        return ["\n".join(b.text for b, m in zip(page, main.tolist(), strict=True) if m) for page, main in zip(pages, self.labels(pages), strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page."""
    ship(pages.sparkSession)
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sample = training_sample(d)
    held = d.sparkSession.sparkContext.broadcast(fit(sample) if sample else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value)
        for batch in batches:
            for part in (batch.slice(a, 200) for a in range(0, batch.num_rows, 200)):
                texts = labeller.texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long")
