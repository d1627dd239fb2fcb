"""Phrase collocations by dynamic itemset counting.

The documents are dealt into SHARDS shards, which are scanned in a cycle.  Words are counted from
the start; a longer phrase is activated once both its subphrases (without the last, and without the
first word) have come to the threshold, and is counted from the next shard on until it has seen
each shard once.  So short and long phrases are counted in the same scans, and every count is that
of all documents.  A phrase that comes to the threshold is never missed: each occurrence of it is
one of its subphrases.

Which phrases have come to the threshold, and at which step, is told to the tasks by a table of
SLOTS bytes, one for each hash of a phrase, whatever the corpus; the first phrase of a slot sets
it for good.  Phrases that share a slot are activated too early, which costs a counter and changes
no count: of any length, they are counted from the step on at which they begin.  Each step writes its
counts block by block.  Running sums, which tell when a phrase comes to the threshold, are kept by the
phrases' CRCs, and end once it has; the phrases themselves are added up once, when all shards have
been seen, and only those that may have come to it.

Defined cases: a null text is empty; a null language is ``und``; repeated rows count each; a text of
any length is split whole; a language without candidates has no row; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import lookup
from ..shipping import ship
from ..sources.shared import shared_folder
from .crc import Appender
from .work import discard, staged

THRESHOLD, LONGEST, REPORTED, CONTAINED = 10, 3, 2000, 50
SHARDS = 3
SLOTS, NEVER = 1 << 24, 255
#: So many bytes of a language's texts are counted at once.
BLOCK = 1 << 22
_BREAK = b"\n"
_FOLD = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
#: A key is the language (escaped), a null character and the phrase; the mark is its CRC, or null where
#: it does not matter whether the phrase comes to the threshold, or it is known to have.
COUNTS = "mark int, key string, begun int, n long"


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def tokens(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the words of a text, with 0 between pieces, and the words by number."""
    text = raw.lower().translate(_FOLD)
    data = np.frombuffer(text, np.uint8)
    breaks = data == _BREAK[0]
    solid = (data != 32) & ~breaks
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    starts, sizes = np.flatnonzero(first), np.flatnonzero(last) - np.flatnonzero(first) + 1
    # a word of up to 16 bytes is two numbers and its length; a longer one is its number among those
    eights = np.ndarray(len(text) + 9, "<u8", buffer=text + bytes(16), strides=(1,))
    low, high = eights[starts] & _MASKS[np.minimum(sizes, 8)], eights[np.minimum(starts + 8, len(text))] & _MASKS[np.clip(sizes - 8, 0, 8)]
    long = np.flatnonzero(sizes > 16)
    known: dict[bytes, int] = {}
    low[long] = [known.setdefault(text[a : a + n], len(known)) for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
    high[long] = 0
    kind = np.minimum(sizes, 17).astype(np.uint64)
    mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F) + kind)
    mixed ^= mixed >> np.uint64(29)
    _, where, number = np.unique(mixed, return_index=True, return_inverse=True)
    same = where[number]
    if not (np.array_equal(low, low[same]) and np.array_equal(high, high[same]) and np.array_equal(kind, kind[same])):
        # two words of one mix
        _, where, number = np.unique(np.column_stack((low, high, kind)), axis=0, return_index=True, return_inverse=True)
    ids = np.zeros(len(text), np.int64)
    ids[starts] = number + 1
    return ids[np.flatnonzero(first | breaks)], [_BREAK, *(text[a : a + n] for a, n in zip(starts[where].tolist(), sizes[where].tolist(), strict=True))]


def escaped(lang: str) -> str:
    return lang.replace("%", "%25").replace("\0", "%00")


def counted(lang: str, raw: bytes, step: int, reached: np.ndarray, appender: Appender, longest: int, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]]:
    """Of one block of texts, for each length: number of words, step at which the phrases' counting
    began, their counts, their CRCs, and their words.  Length 0 counts all words."""
    ids, words = tokens(raw)
    inside = ids > 0
    names = pa.array(words, pa.binary())
    prefix = f"{escaped(lang)}\0".encode()
    alone = np.array([zlib.crc32(prefix + w) for w in words], np.uint32)
    behind = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    if step < shards:
        counts = np.bincount(ids, minlength=len(words))
        yield 0, np.zeros(1, np.int64), np.array([inside.sum()]), np.zeros(1, np.uint32), []
        yield 1, np.zeros(len(words) - 1, np.int64), counts[1:], alone[1:], [names.slice(1)]
    crc, ok, codes, kinds = alone[ids], inside, ids, len(words)
    for k in range(2, longest + 1 if step else 2):  # any length may begin at step 1: words may have set its subphrases' slots
        at = reached[crc % np.uint32(len(reached))].astype(np.int64)
        begun = 1 + np.maximum(at[:-1], at[1:])
        ok = ok[:-1] & inside[k - 1 :]
        here = np.flatnonzero(ok & (begun <= step) & (step < begun + shards))
        # phrases as numbers: that of the first words, then the last one
        if kinds * len(words) >= 1 << 63:
            distinct, codes = np.unique(codes, return_inverse=True)
            kinds = len(distinct)
        kinds *= len(words)
        last = ids[k - 1 :]
        codes = codes[: len(last)] * len(words) + last
        _, first, n = np.unique(codes[here], return_index=True, return_counts=True)
        first = here[first]
        asked = slice(len(last)) if k < longest else first  # the longest phrases are in no longer one
        crc = appender.append(crc[asked], behind[last[asked]], sizes[last[asked]])
        yield k, begun[first], n, crc[first] if k < longest else crc, [names.take(pa.array(ids[first + j])) for j in range(k)]


def scan(shard: DataFrame, step: int, reached: np.ndarray, longest: int, shards: int) -> DataFrame:
    """Counts of one shard: ``lang, phrase, words, begun, n``, of each block of texts apart."""
    packed = shard.sparkSession.sparkContext.broadcast(zlib.compress(reached.tobytes(), 1))  # SLOTS bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        appender, held, size = Appender(), {}, 0
        table = np.frombuffer(zlib.decompress(packed.value), np.uint8)

        def flush() -> Iterator[pa.RecordBatch]:
            while held:
                lang, texts = held.popitem()
                prefix = pa.scalar(f"{escaped(lang)}\0".encode())
                for k, begun, n, crc, parts in counted(lang, _BREAK.join(texts), step, table, appender, longest, shards):
                    phrase = pc.binary_join_element_wise(*parts, b" ") if parts else pa.array([b""])
                    key = pc.binary_join_element_wise(prefix, phrase, b"").cast(pa.string())
                    known = (table[crc % np.uint32(len(table))] != NEVER) | (k in (0, longest))
                    yield pa.RecordBatch.from_arrays([pa.array(crc.view(np.int32), mask=known), key, pa.array(begun, pa.int32()), pa.array(n, pa.int64())], names=["mark", "key", "begun", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode()
                held.setdefault(lang, []).append(raw)
                size += len(raw)
                if size >= BLOCK:
                    yield from flush()
                    size = 0
        yield from flush()

    return shard.mapInArrow(run, COUNTS)


def _sharded(documents: DataFrame, shards: int) -> DataFrame:
    """The documents' texts, dealt at random into shards and written; counts do not depend on it."""
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = documents.select(lang.alias("lang"), text.alias("text"), F.floor(F.rand(7) * shards).cast("int").alias("shard"))
    path = shared_folder(d.sparkSession, "shards")
    d.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    table = d.sparkSession.read.schema("lang string, text string, shard int").parquet(path)
    table.staged_at = path
    return table


def _slot(slots: int) -> F.Column:
    return F.pmod(F.col("mark").cast("long").bitwiseAND(0xFFFFFFFF), F.lit(slots))


def _slots(marks: DataFrame, slots: int) -> np.ndarray:
    """The slots of marks; a bit for each slot at most."""
    bits = marks.select(_slot(slots).alias("slot")).groupBy(F.expr("slot div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).toArrow()
    at, packed = bits.column(0).to_numpy(), bits.column(1).to_numpy().astype("<i8")
    on = np.unpackbits(packed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64)
    row, bit = np.nonzero(on)
    return at[row] * 64 + bit


def _likely(counts: DataFrame, reached: np.ndarray) -> DataFrame:
    """``key, n``: the counts of phrases that may have come to the threshold, by their marks' slots."""
    bits = np.packbits(np.pad(reached != NEVER, (0, -len(reached) % 64)), bitorder="little").view("<i8")
    one = counts.sparkSession.createDataFrame(pa.table({"bits": pa.array([bits], pa.list_(pa.int64()))}))
    there = counts.withColumn("slot", _slot(len(reached))).join(F.broadcast(one), F.expr("mark is null or getbit(get(bits, cast(slot div 64 as int)), cast(slot % 64 as int)) = 1"))  # one row, a bit for each slot
    return there.select("key", "n")


def frequent_phrases(documents: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """``lang, phrase, words, n``: every phrase of up to ``longest`` words with ``threshold``
    occurrences or more, and for each language all words as the phrase of 0 words; written."""
    spark = documents.sparkSession
    ship(spark)
    table = _sharded(documents, shards)
    log = shared_folder(spark, "counts")
    reached = np.full(SLOTS, NEVER, np.uint8)
    running, finished = None, []
    step, newest = 0, -1
    while True:
        shard = table.where(F.col("shard") == step % shards).select("lang", "text")
        scan(shard, step, reached, longest, shards).write.partitionBy("begun").option("parquet.enable.dictionary", "false").parquet(f"{log}/step={step}")
        steps = [f"{log}/step={s}" for s in range(max(0, step - shards + 1), step + 1)]
        seen = spark.read.schema("mark int, key string, n long, begun int").parquet(steps[-1]).where("mark is not null").select("begun", "mark", "n")
        # phrases below the threshold go on being counted by their marks, while they are open
        d = (seen if running is None else seen.unionByName(running.where(F.col("begun") + shards > step))).groupBy("begun", "mark").agg(F.sum("n").alias("n"))
        last, running = running, staged(d.withColumn("there", F.col("n") >= threshold), "running")
        if last is not None:
            discard(last)
        slots = _slots(running.where("there"), len(reached))
        slots = slots[reached[slots] == NEVER]
        reached[slots] = step
        newest = step if len(slots) else newest
        at = running.staged_at
        running = running.where("not there").drop("there")
        running.staged_at = at
        if step - shards + 1 >= 0:  # those that began so long ago have seen each shard
            begun = step - shards + 1
            counts = spark.read.option("basePath", log).schema("mark int, key string, n long, step int, begun int").parquet(*steps).where(F.col("begun") == begun)
            whole = _likely(counts, reached).groupBy("key").agg(F.sum("n").alias("n")).where((F.col("n") >= threshold) | F.col("key").endswith("\0"))
            finished.append(staged(whole, "finished"))
            for path in steps:
                counts.staged_at = f"{path}/begun={begun}"
                discard(counts)
        step += 1
        if step > newest + shards:  # what began last has seen each shard
            break
    found = finished[0]
    for part in finished[1:]:
        found = found.unionByName(part)
    lang = F.replace(F.replace(F.expr("substring(key, 1, instr(key, '\\u0000') - 1)"), F.lit("%00"), F.lit("\0")), F.lit("%25"), F.lit("%"))
    phrase = F.expr("substring(key, instr(key, '\\u0000') + 1)")
    words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    found = found.select(lang.alias("lang"), phrase.alias("phrase"), "n").withColumn("words", words)
    out = staged(found.where((F.col("words") == 0) | (F.col("n") >= threshold)).select("lang", "phrase", "words", "n"), "phrases")
    spent = spark.range(0)
    spent.staged_at = log
    discard(*finished, running, table, spent)
    return out


def _part(first: F.Column, length: F.Column) -> F.Column:
    return F.array_join(F.slice("__words", first, length), " ")


def collocations(documents: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, reported: int = REPORTED, contained: int = CONTAINED, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``reported`` phrases of each language.

    ``a``, ``l`` and ``r`` count the phrase, its first part and its rest, at the cut of the lowest
    score (a million times a * a / (l * r), rounded down); ``n`` all words of the language.  Phrases inside
    a longer one that is ``contained`` hundredths as frequent or more are dropped."""
    phrases = frequent_phrases(documents, threshold, longest, shards)
    known = phrases.where("words > 0").select("lang", F.col("phrase").alias("part"), "n")
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a")).withColumn("__words", F.split("phrase", " "))

    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "cut", _part(F.lit(1), F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("rest"))
    cuts = lookup(cuts, known.select("lang", F.col("part").alias("first"), F.col("n").alias("l")), ["lang", "first"], F.col("phrase"))
    cuts = lookup(cuts, known.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")), ["lang", "rest"], F.col("phrase"))
    # exact for counts of up to 15 digits
    exact = "(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    lowest = F.min(F.struct(F.expr(exact).alias("score"), F.col("cut"), "l", "r")).alias("low")
    scored = cuts.groupBy("lang", "phrase", "words").agg(F.first("a").alias("a"), lowest)

    size = F.explode(F.sequence(F.lit(2), F.col("words") - 1))
    inner = candidates.where("words > 2").withColumn("size", size).withColumn("from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.groupBy("lang", _part(F.col("from"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))

    best = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= reported)
    sizes = phrases.where("words = 0").select("lang", "n")
    top = top.join(sizes, "lang")
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").cast("long").alias("score"))
