"""Mixing sources to target weights.

Each document gets a hash-random key; within its source the documents are range-sorted by
that key, distributed prefix sums of their sizes tell how many words lie before each, and the
source is cut where its budget ends, after as many whole epochs as the budget holds.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last;
repeated rows are separate documents of the same key, in any order among themselves; an empty
table mixes to an empty one; with no words at all every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import discard, fresh, lookup, staged

#: A word, and the weights of the sources in the order of their code points.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
MOST_EPOCHS = 3
#: A source is cut into ranges by the first hexadecimal digits of the key, three or so many that a
#: range of a source with all documents has about RANGE_DOCUMENTS.
RANGE_DOCUMENTS = 50_000


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Of ``(source, source_size)``, one row for each source, also ``target``.

    The whole is shared by weight; what exceeds MOST_EPOCHS times a source's size is shared
    among the others by weight, until none is above.  In the order of size for each unit of
    weight the capped sources come first, so running sums find the level in one pass."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, len(WEIGHTS)) + 1).cast("int"))
    d = sizes.withColumn("w", weight.cast("long")).withColumn("cap", (MOST_EPOCHS * F.col("source_size")).cast("long"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    d = d.withColumn("total", F.sum("source_size").over(whole)).withColumn("w_all", F.sum("w").over(whole))
    d = d.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn(
        "w_left", F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    # a source is capped if its share of what those before it leave exceeds its cap
    d = d.withColumn("capped", F.col("w") * (F.col("total") - F.col("cap_before")) > F.col("cap") * F.col("w_left"))
    capped_sum = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole)
    free_w = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(whole)
    share = (F.col("w") * (F.col("total") - capped_sum)).cast("double") / F.nullif(free_w, F.lit(0)).cast("double")
    return d.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, copies``: one row for each document.

    ``taken`` cuts the document at the end of the budget exactly there; ``copies`` counts whole
    copies, that document being in if half of it or more is."""
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), key.alias("key"))
    sizes = d = staged(d, "sizes")
    digits = max(3, math.ceil(math.log(max(1, d.count() / RANGE_DOCUMENTS), 16)))
    d = d.withColumn("range", F.substring("key", 1, digits))
    ranges = d.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    source_of = Window.partitionBy("source")
    ranges = ranges.withColumn("range_before", F.sum("range_size").over(source_of.orderBy("range")) - F.col("range_size"))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    goal = goal.withColumnRenamed("source", "goal_source")
    ranges = ranges.withColumnsRenamed({"source": "range_source", "range": "range_no"})
    ranges = ranges.join(goal, F.col("range_source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    d = d.withColumn("inner_before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    d = d.join(ranges, F.col("source").eqNullSafe(F.col("range_source")) & (F.col("range") == F.col("range_no"))).select(
        "doc_id", "size", "source", "source_size", "target", (F.col("range_before") + F.col("inner_before")).alias("before")
    )
    budget = F.floor(F.coalesce(F.col("target"), F.lit(0.0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    d = d.withColumn("epochs", epochs).withColumn("left", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    whole = (2 * part >= F.col("size")) & (F.col("before") < F.col("left"))
    mixed = staged(d.select(
        "doc_id", "size", "source", "source_size", "target",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        (F.col("epochs") + whole.cast("long")).alias("copies"),
    ), "mixed")
    discard(sizes)
    return mixed


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their own columns, a row for each whole copy.

    Rows that share a doc_id, or have none, come as often as the one of them that comes most often;
    documents without a whole copy go, and an empty table stays empty."""
    key, copies, copy = (fresh(n, docs) for n in ("__key", "__copies", "__copy"))
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    plan = mix(docs).groupBy(named(F.col("doc_id")).alias(key)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    apart = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # those without a doc_id may be many
    joined = lookup(docs.withColumn(key, named(F.col("doc_id"))), plan, [key], apart)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
