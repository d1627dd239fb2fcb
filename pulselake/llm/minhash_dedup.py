"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its 5-word shingles; two are linked from a share of ``percent`` on.  In
each of several independent trees it is put into the node of its minwise token under that tree's
hash.  Small nodes are compared exhaustively by sketches of SKETCH minwise tokens, large ones in
lots; a forest of each lot's likeliest links is confirmed pair by pair on the full sets.  What is
connected then is never compared again: of a node that is still open, only documents of different
components are.  Where those pairs are many the node branches into children, each by a path of
PATH more minwise tokens chosen for it, down to DEPTH; in the leaves, what may be a link joins documents into candidate clusters, and
within a cluster every pair across components that the sketches do not rule out is confirmed on
the full sets.

Recall: a pair of similarity s misses a tree's root node with probability 1 - s, and a branching
into b children loses (1 - s ** PATH) ** b of that tree's pairs.  ``search`` takes the numbers of
trees and children, and the cut of the sketches, from the threshold: a pair that is just a link meets in no
root with probability MISS at most, is lost by a branching with LOST, ruled out with RULED_OUT.

Documents with equal sets are one class from the start, so groups of copies are never expanded;
nodes, clusters and stars of any size are dealt over tasks.

Defined cases: words are runs of other than white space, A-Z lower-cased; fewer than five words
are one shingle; a null text or one without words is empty, linked with nothing and kept; a
null doc_id is linked with nothing and kept; repeated rows share their component and are kept
alike; rows of one doc_id with different texts are documents of their own; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Forest, components, discard, fresh, groups_of, labelled, lookup, lookup_left, staged, tiled_by_class, with_groups

WORDS = 5
#: Links: 100 * intersection >= percent * union; op5's percent.
PERCENT = 85
#: Largest probabilities that a pair at the threshold meets in no tree, that a branching loses it,
#: and that the sketches rule it out.
MISS, LOST, RULED_OUT = 3e-7, 0.0034, 2e-5
#: Tokens of a child's path.  Nodes branch so many times at most.  A node is small if no more than
#: LIMIT * LIMIT pairs of sketches are to be compared in it: at that size about 0.4 ms for each of its
#: documents (120 ns a pair), where the sketch of a document of 370 words takes 0.3 ms.
PATH, DEPTH, LIMIT = 4, 4, 4096
#: Documents of a lot in which likely links are looked for, and of a tile of sketches.
LOT, SKETCH_TILE = 512, 2048
#: Tokens of a sketch.
SKETCH = 128
#: Documents of a tile of full sets, and the bytes of their sets, which are far below a task's memory.
TILE, TILE_BYTES = 512, 64_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RNG = np.random.default_rng(2024)
_WEIGHTS = _RNG.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = _RNG.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class Search(NamedTuple):
    """What follows from the threshold; ``least`` is the number of equal tokens of a possible pair."""

    percent: int
    trees: int
    branches: int
    least: int


def search(percent: int) -> Search:
    if not 20 <= percent <= 100:
        raise ValueError("percent must be from 20 to 100")
    s = min(percent, 99) / 100
    needed = [math.ceil(math.log(p) / math.log(1 - meet)) for p, meet in ((MISS, s), (LOST, s**PATH))]
    least, below = 0, 0.0
    while (below := below + math.comb(SKETCH, least) * s**least * (1 - s) ** (SKETCH - least)) <= RULED_OUT:
        least += 1
    return Search(percent, *needed, least)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = got
        return got


_WORD_HASH = _WordHash()


def shingles(text: str | None) -> np.ndarray:
    """The document's set as sorted distinct 64-bit hashes."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_WORD_HASH.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _WEIGHTS[i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def sketch(hashes: np.ndarray) -> np.ndarray:
    low = hashes.astype(np.uint32)
    parts = [(low[a : a + 4096, None] * _MULTIPLIERS).min(axis=0) for a in range(0, len(low), 4096)]
    return np.minimum.reduce(parts)


def _digest(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _sketched(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                n, same, sigs = [], [], []
                for t in part.column(1):
                    s = shingles(t.as_py())
                    n.append(len(s))
                    same.append(_digest(s))
                    sigs.append(sketch(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n", "same", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, same binary, sig binary")


def _sigs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, SKETCH)


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.asarray(b, dtype=np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _roots(reps: DataFrame, trees: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _sigs(batch.column(1))
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_mixed(sig[:, t], t + 1).view(np.int64))], names=["no", "node"])

    return reps.select("no", "sig").mapInArrow(run, "no long, node long")


def _branched(nodes: DataFrame, branches: int) -> DataFrame:
    """Each document goes to so many children of its node, each by PATH tokens that the node chooses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sig = batch.column(1).to_numpy().view(np.uint64), _sigs(batch.column(3))
            for j in range(branches):
                child = _mixed(node, 7 + j)
                for k in range(PATH):
                    chosen = (_mixed(node, 77 + j * PATH + k) % np.uint64(SKETCH)).astype(np.int64)
                    child = _mixed(sig[np.arange(len(node)), chosen], child)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(child.view(np.int64)), *batch.columns[2:]], names=["no", "node", "n", "sig", "component"])

    return nodes.select("no", "node", "n", "sig", "component").mapInArrow(run, "no long, node long, n long, sig binary, component long")


def _possible(sig: np.ndarray, n: np.ndarray, rows: np.ndarray, cols: np.ndarray, how: Search) -> np.ndarray:
    """Numbers of equal tokens of rows x cols; -1 where the sizes or the number rule the pair out."""
    equal = (sig[rows, None] == sig[None, cols]).sum(axis=2, dtype=np.int16)
    a, b = n[rows, None], n[None, cols]
    out = (equal < how.least) | (100 * np.minimum(a, b) < how.percent * np.maximum(a, b))
    equal[out] = -1
    return equal


def _pairs(sig: np.ndarray, n: np.ndarray, own: np.ndarray, how: Search, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Possible pairs of a tile pair, most alike first; only of different numbers in ``apart``."""
    two = own.min() != own.max()
    left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
    found = []
    for a in range(0, len(left), 16):
        rows = left[a : a + 16]
        equal = _possible(sig, n, rows, right, how)
        if apart is not None:
            equal[apart[rows, None] == apart[None, right]] = -1
        i, j = np.nonzero(equal >= 0)
        s, i, j = equal[i, j], rows[i], right[j]
        ok = slice(None) if two else i < j
        found.append((s[ok], i[ok], j[ok]))
    s, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(-s, kind="stable")
    return i[order], j[order]


def _batch(rows: list[tuple[int, ...]], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=list(names))


def _likeliest(nodes: DataFrame, how: Search) -> DataFrame:
    """``node, a, b``: a forest of the likeliest links of each node, dealt into lots of LOT
    documents or so; each tree deals a large node's documents anew."""
    lots = F.ceil(F.col("m") / F.lit(LOT))
    dealt = nodes.select("node", F.pmod(F.xxhash64("node", "no"), lots).cast("int").alias("lot"), "no", "n", "sig")
    dealt = dealt.repartition("node", "lot").sortWithinPartitions("node", "lot", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, ...]] = []
        for g in groups_of(batches, ["node", "lot"]):
            no, node, forest = g["no"].to_numpy(), g["node"][0].as_py(), Forest(g.num_rows)
            i, j = _pairs(_sigs(g["sig"]), g["n"].to_numpy(), np.zeros(len(no)), how)
            out += [(node, int(no[x]), int(no[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(x, y)]
            if len(out) > 10_000:
                yield _batch(out, "node", "a", "b")
                out = []
        if out:
            yield _batch(out, "node", "a", "b")

    return dealt.mapInArrow(run, "node long, a long, b long")


def _sets(wanted: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """``no, words``: the full sets of the classes ``wanted`` (``no``), from one document of each."""
    full = reps.select("no", "rep", "same").join(wanted, "no").join(docs, F.col("rep") == F.col("doc_id")).select("no", "same", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                found = [shingles(t.as_py()) for t in part.column(2)]
                right = [i for i, (s, same) in enumerate(zip(found, part.column(1).to_pylist(), strict=True)) if _digest(s) == same]
                words = [pa.array(found[i].view(np.int64)) for i in right]
                ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
                values = pa.concat_arrays(words) if words else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(right, pa.int64())), pa.ListArray.from_arrays(pa.array(ends), values)], names=["no", "words"])

    return full.mapInArrow(run, "no long, words array<long>").dropDuplicates(["no"])


def _judged(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` of distinct pairs, on the full sets."""
    d = lookup(pairs, sets.select(F.col("no").alias("a"), F.col("words").alias("words_a")), ["a"], F.col("b"))
    d = lookup(d, sets.select(F.col("no").alias("b"), F.col("words").alias("words_b")), ["b"], F.col("a"))
    common = F.size(F.array_intersect("words_a", "words_b"))
    union = F.size("words_a") + F.size("words_b") - common
    return d.select("a", "b", (100 * common.cast("long") >= percent * union.cast("long")).alias("linked"))


def _candidates(leaves: DataFrame, how: Search) -> DataFrame:
    """``a, b``: stars around the documents of a leaf that may be linked beyond their component."""
    dealt = tiled_by_class(leaves, ["node"], F.col("no"), SKETCH_TILE)
    dealt = dealt.repartition("node", "tile_a", "tile_b").sortWithinPartitions("node", "tile_a", "tile_b", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, ["node", "tile_a", "tile_b"]):
            own = g["tile_own"].to_numpy()
            if len(own) < 2 or (g["tile_a"][0].as_py() != g["tile_b"][0].as_py() and own.min() == own.max()):
                continue
            no, forest = g["no"].to_numpy(), Forest(len(own))
            i, j = _pairs(_sigs(g["sig"]), g["n"].to_numpy(), own, how, g["component"].to_numpy())
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(x, y)
            if out := [(int(no[x]), int(no[y])) for x, y in forest.stars()]:
                yield _batch(out, "a", "b")

    return dealt.mapInArrow(run, "a long, b long").distinct()


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate((a, b)), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _confirmed(full: DataFrame, how: Search) -> DataFrame:
    """``a, b``: links between the components of each candidate cluster, as stars; a link counts
    once it is confirmed on the full sets."""
    dealt = tiled_by_class(full, ["cluster"], F.col("no"), TILE, 8 * F.col("n"), TILE_BYTES)
    keys = ["cluster", "tile_a", "tile_b"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, keys):
            own = g["tile_own"].to_numpy()
            if len(own) < 2 or (g["tile_a"][0].as_py() != g["tile_b"][0].as_py() and own.min() == own.max()):
                continue
            no, forest, component = g["no"].to_numpy(), Forest(len(own)), g["component"].to_numpy()
            first: dict[int, int] = {}
            for k, c in enumerate(component.tolist()):
                forest.join(first.setdefault(c, k), k)
            words = [w.values.to_numpy() for w in g["words"]]
            i, j = _pairs(_sigs(g["sig"]), g["n"].to_numpy(), own, how, component)
            out = []
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if forest.root(x) != forest.root(y) and alike(words[x], words[y], how.percent):
                    forest.join(x, y)
                    out.append((int(no[x]), int(no[y])))
            if out:
                yield _batch(out, "a", "b")

    return dealt.mapInArrow(run, "a long, b long")


def _links(reps: DataFrame, docs: DataFrame, how: Search) -> DataFrame:
    """``a, b``: links between the numbers of classes that connect all that is to be connected."""
    roots = staged(_roots(reps, how.trees), "roots")
    met = with_groups(roots, ["node"], F.col("no"), [F.count(F.lit(1)).alias("m")], "m > 1")
    nodes = staged(met.join(reps.select("no", "n", "sig"), "no"), "nodes")
    discard(roots)

    likely = staged(_likeliest(nodes, how), "likeliest")
    pairs = likely.select("a", "b").distinct()
    sets = staged(_sets(pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct(), reps, docs), "sets")
    judged = staged(_judged(pairs, sets, how.percent), "judged")
    parts = components(judged.where("linked").select("a", "b"))

    # what is left: nodes of more than a lot, and others of which a likely link
    # proved false; of each, the pairs beyond a component
    doubtful = likely.join(judged.where("not linked"), ["a", "b"]).select("node").distinct()
    left = nodes.where(F.col("m") > LOT).unionByName(nodes.where(F.col("m") <= LOT).join(doubtful, "node", "left_semi"))
    known = left.drop("m").join(parts.withColumnRenamed("node", "no"), "no", "left")
    level = staged(known.withColumn("component", F.coalesce("component", "no")), "level-0")
    used, leaves = [level], []
    for depth in range(DEPTH + 1):
        sizes = level.groupBy("node", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("node")
        sizes = sizes.agg(F.sum("c").alias("m"), (F.sum("c") - F.max("c")).alias("few")).where("few > 0")
        level = staged(lookup(level, sizes, ["node"], F.col("no")), f"open-{depth}")
        used.append(level)
        large = F.col("few") * F.col("m") > LIMIT * LIMIT
        leaves.append(level if depth == DEPTH else level.where(~large))
        if depth == DEPTH or level.where(large).isEmpty():
            break
        used.append(level := staged(_branched(level.where(large), how.branches).distinct(), f"branches-{depth}"))
    columns = ["node", "no", "n", "sig", "component"]
    open_leaves = leaves[0].select(*columns)
    for more in leaves[1:]:
        open_leaves = open_leaves.unionByName(more.select(*columns))
    clusters = components(_candidates(open_leaves, how)).select(F.col("node").alias("no"), F.col("component").alias("cluster"))
    more_sets = _sets(clusters.select("no"), reps, docs)
    full = reps.select("no", "n", "sig").join(clusters, "no").join(more_sets, "no")
    full = staged(full.join(parts.withColumnRenamed("node", "no"), "no", "left").withColumn("component", F.coalesce("component", "no")), "cluster-sets")
    stars = parts.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    confirmed = staged(stars.unionByName(_confirmed(full, how)), "links")
    discard(nodes, likely, sets, judged, parts, full, *used)
    return confirmed


def deduplicate(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each document."""
    how = search(percent)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = staged(_sketched(docs), "sketches")
    known = sketches.where("n > 0 and doc_id is not null")
    classes = known.groupBy("same").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    reps = staged(classes.withColumn("no", F.monotonically_increasing_id()), "set-classes")
    links = _links(reps, docs, how)
    found = labelled(reps.select("no", "rep", "same"), links)
    out = sketches.withColumn("same", F.when(F.col("doc_id").isNotNull(), F.col("same"))).select("doc_id", "n", "same")
    out = lookup_left(out, found.select("same", "component"), ["same"], F.col("doc_id"))
    component = F.coalesce("component", "doc_id")
    result = staged(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "documents-linked")
    discard(sketches, reps, links, found)
    return result


def distinct_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with its own columns: the one with the least doc_id.

    Rows without a doc_id, a text or a word stay; rows that share a doc_id all go if none of them
    is kept, and else stay; an empty table stays empty."""
    gone = fresh("__gone", docs)
    copies = deduplicate(docs, percent).groupBy(F.col("doc_id").alias(gone)).agg(F.bool_or("kept").alias("kept")).where("not kept").select(gone)
    return docs.join(copies, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
