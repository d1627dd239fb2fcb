"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded; filters of several widths run over fixed-length windows; each filter's
largest response in a window (max pooling) goes through a linear layer and a softmax.  A
document's probabilities are the mean over all its windows, weighted by their bytes.

Training takes a sample of at most SAMPLE labelled documents, those of the least hashes of their
doc_id, and trains with Adam on windows drawn from the whole of each.  Prediction applies the
network to every window of every text.  Filter responses to byte pairs are added from tables, so
that a filter of width four costs two look-ups a position.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows without a label
are predicted like all others; repeated rows are predicted alike; without any labelled document
everything is ``und`` with score 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Bounds the sample on which the network is fitted.
SAMPLE = 3000
WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 8, (2, 3, 4)
WINDOWS_A_DOC, EPOCHS, BATCH, RATE = 4, 5, 64, 0.01
HELD_OUT_OF, HELD_OUT = 4, 2
UNKNOWN = "und"
#: A document is rejected below this score, not far above chance.
LEAST_SCORE = 0.3


class Network(NamedTuple):
    labels: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # width x EMBED x FILTERS
    bias: np.ndarray  # filters
    out: np.ndarray  # filters x labels
    out_bias: np.ndarray


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text; the last one is filled up with zero bytes."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


def _forward(net: Network, x: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    e = net.embed[x]
    pooled, seats = [], []
    for w, f in zip(WIDTHS, net.filters, strict=True):
        n = WINDOW - w + 1
        r = sum(e[:, k : k + n] @ f[k] for k in range(w))
        at = r.argmax(axis=1)
        seats.append(at)
        pooled.append(np.take_along_axis(r, at[:, None], axis=1)[:, 0])
    h = np.concatenate(pooled, axis=1) + net.bias
    z = np.maximum(h, 0) @ net.out + net.out_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return h, seats, z / z.sum(axis=1, keepdims=True)


def drawn_windows(text: str, seed: int) -> np.ndarray:
    """At most WINDOWS_A_DOC windows, drawn from the whole text."""
    w = windows_of(text.encode())
    return w[np.random.default_rng(seed).permutation(len(w))[:WINDOWS_A_DOC]]


def train(texts: list[str], langs: list[str], seed: int = 5) -> Network:
    """A network fitted on windows of the texts."""
    return fit([(lang, drawn_windows(text, seed + i)) for i, (text, lang) in enumerate(zip(texts, langs, strict=True))], seed)


def fit(sample: list[tuple[str, np.ndarray]], seed: int = 5) -> Network:
    """Gradient descent over labelled windows; the same windows make the same network."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in sample})
    number = {lang: i for i, lang in enumerate(labels)}
    x = np.concatenate([w for _, w in sample])
    y = np.array([number[lang] for lang, w in sample for _ in range(len(w))])
    weight = len(y) / (len(labels) * np.maximum(1, np.bincount(y, minlength=len(labels))))
    total = FILTERS * len(WIDTHS)
    net = Network(
        labels,
        rng.normal(0, 0.5, (256, EMBED)),
        [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS],
        np.zeros(total),
        rng.normal(0, total**-0.5, (total, len(labels))),
        np.zeros(len(labels)),
    )
    flat = [net.embed, *net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            b, t = x[order[a : a + BATCH]], y[order[a : a + BATCH]]
            h, seats, p = _forward(net, b)
            g = p.copy()
            g[np.arange(len(t)), t] -= 1
            g *= weight[t][:, None] / len(t)
            active = np.maximum(h, 0)
            d_h = (g @ net.out.T) * (h > 0)
            d_embed, d_filters = np.zeros_like(net.embed), []
            rows = np.arange(len(t))[:, None]
            for i, (w, f, at) in enumerate(zip(WIDTHS, net.filters, seats, strict=True)):
                d = d_h[:, i * FILTERS : (i + 1) * FILTERS]
                d_f = np.zeros_like(f)
                for k in range(w):
                    byte = b[rows, at + k]  # the byte under each filter's best place
                    d_f[k] = np.einsum("nfe,nf->ef", net.embed[byte], d)
                    for e, tap in enumerate(f[k]):
                        d_embed[:, e] += np.bincount(byte.ravel(), (d * tap).ravel(), minlength=256)
                d_filters.append(d_f)
            step += 1
            rate = RATE * (1 - step / (1 + EPOCHS * -(-len(x) // BATCH)))
            grads = [d_embed, *d_filters, d_h.sum(axis=0), active.T @ g, g.sum(axis=0)]
            for q, m, v, dq in zip(flat, first, second, grads, strict=True):
                m += 0.1 * (dq - m)
                v += 0.001 * (dq * dq - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Predictor:
    """A network with tables of its filters' responses to pairs of bytes."""

    def __init__(self, net: Network):
        self.net = net
        taps = [[(net.embed @ f[k]).astype(np.float32) for k in range(len(f))] for f in net.filters]  # 256 x FILTERS
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        # each part: a table by byte pair, and how far behind the filter's first byte it looks
        self.parts = [[(pair(t[k], t[k + 1] if k + 1 < len(t) else 0 * t[k]), k) for k in range(0, len(t), 2)] for t in taps]

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        last = x[:, -1:].astype(np.int32) << 8
        pairs = np.concatenate((pairs, last), axis=1)  # an odd tap looks at one byte of its pair
        pooled = []
        for w, parts in zip(WIDTHS, self.parts, strict=True):
            n = WINDOW - w + 1
            r = np.take(parts[0][0], pairs[:, :n], axis=0)
            for table, k in parts[1:]:
                r += np.take(table, pairs[:, k : k + n], axis=0)
            pooled.append(r.max(axis=1))
        h = np.concatenate(pooled, axis=1) + self.net.bias
        z = np.maximum(h, 0) @ self.net.out + self.net.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        raws = [(t or "").encode() for t in texts]
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not some:
            return langs, scores
        sizes = np.array([-(-len(raws[i]) // WINDOW) for i in some])
        x = np.concatenate([windows_of(raws[i]) for i in some])
        p = np.concatenate([self.windows(x[a : a + 128]) for a in range(0, len(x), 128)])
        weight = np.full(len(x), float(WINDOW))
        weight[np.cumsum(sizes) - 1] = [(len(raws[i]) - 1) % WINDOW + 1 for i in some]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        mean = np.add.reduceat(p * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
        for i, row in zip(some, mean, strict=True):
            k = int(row.argmax())
            langs[i], scores[i] = self.net.labels[k], min(1.0, float(row[k]))
        return langs, scores


def training_sample(docs: DataFrame) -> list[tuple[str, np.ndarray]]:
    """Labels and windows of at most SAMPLE labelled documents that are not held out, of the least
    hashes.  Windows are drawn where the documents are: no text leaves its task."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).withColumn("key", F.xxhash64("doc_id"))
    ids = learn.select("doc_id", "key").distinct().orderBy("key", "doc_id").limit(SAMPLE)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [drawn_windows(t.as_py(), k & 0xFFFFFFFF).tobytes() for t, k in zip(b.column(2), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(got, pa.binary())], names=["doc_id", "key", "lang", "windows"])

    chosen = learn.join(F.broadcast(ids.select("doc_id")), "doc_id").select("doc_id", "key", "text", "lang")
    drawn = chosen.mapInArrow(draw, "doc_id long, key long, lang string, windows binary")
    rows = drawn.orderBy("key", "doc_id", "lang", "windows").limit(SAMPLE).collect()
    return [(r.lang, np.frombuffer(bytes(r.windows), dtype=np.uint8).reshape(-1, WINDOW)) for r in rows]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def _fitted(docs: DataFrame) -> Broadcast:
    """The network, or None where there is nothing to learn from."""
    ship(docs.sparkSession)
    sample = training_sample(docs)
    return docs.sparkSession.sparkContext.broadcast(fit(sample) if any(len(w) for _, w in sample) else None)


def identify(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: one row for each document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = _fitted(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(held.value) if held.value else None
        for batch in batches:
            for part in (batch.slice(a, 200) for a in range(0, batch.num_rows, 200)):
                texts = part.column(2).to_pylist()
                langs, scores = predictor.texts(texts) if predictor else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(documents: DataFrame) -> DataFrame:
    """The documents, with their own columns, whose language is told with LEAST_SCORE or more."""
    held = _fitted(documents)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(held.value) if held.value else None
        for batch in batches:
            for part in (batch.slice(a, 200) for a in range(0, batch.num_rows, 200)):
                if predictor:
                    langs, scores = predictor.texts(part.column(at).to_pylist())
                    yield part.filter(pa.array([lang != UNKNOWN and s >= LEAST_SCORE for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
