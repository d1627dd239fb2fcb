"""Bag-level pooling and tensors.  Learned weights are inputs, as plain lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, pad_or_crop, sigmoid, transposed
from ..functions.grouped import lookup, null_safe_join


def _literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def affine(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Each row of weights times x, plus its bias."""
    return F.array(*(dot(x, _literal(w)) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)))


def gated_score(x: Column, a: list[list[float]], a_bias: list[float], b: list[list[float]], b_bias: list[float], v: list[float]) -> Column:
    """v . (tanh(a x + a_bias) * sigmoid(b x + b_bias))."""
    gate = F.zip_with(affine(x, a, a_bias), affine(x, b, b_bias), lambda s, t: F.tanh(s) * sigmoid(t))
    return dot(gate, _literal(v))


#: Exponentials are summed by scores' nearest multiples of this, within which none overflows.
_STEP = 32.0


def _stepped(instances: DataFrame, score: str) -> DataFrame:
    """``__step``: the nearest multiple of the score; ``__e``: the exponential of what is left."""
    d = instances.withColumn("__step", F.rint(F.col(score) / _STEP) * _STEP)
    return d.withColumn("__e", F.exp(F.col(score) - F.col("__step")))


def _with_peak(sums: DataFrame, keys: list[str]) -> DataFrame:
    """``__scale``: by what sums of a step are multiplied to be those under the bag's greatest step."""
    d = null_safe_join(sums, sums.groupBy(*keys).agg(F.max("__step").alias("__peak")), keys)
    return d.withColumn("__scale", F.exp(F.col("__step") - F.col("__peak")))


def softmax_weights(instances: DataFrame, keys: list[str], score: str) -> DataFrame:
    """``weight``: the softmax of the scores within each bag, of any size."""
    sums = _stepped(instances, score).groupBy(*keys, "__step").agg(F.sum("__e").alias("__e"))
    bags = _with_peak(sums, keys).groupBy(*keys).agg(F.max("__peak").alias("__peak"), F.sum(F.col("__e") * F.col("__scale")).alias("__all"))
    d = lookup(instances, bags, keys, F.xxhash64(*instances.columns), nulls_meet=True)
    return d.withColumn("weight", F.exp(F.col(score) - F.col("__peak")) / F.col("__all")).drop("__peak", "__all")


def attention_pool(instances: DataFrame, keys: list[str], score: str, vector: str) -> DataFrame:
    """``keys, pos, pooled``: the softmax-weighted sum of the bag's vectors, element by element.

    Elements are summed as rows, step by step of the scores, so that instances meet in partial sums
    only and the bag's greatest score need not be known to them."""
    parts = _stepped(instances, score).select(*keys, "__step", "__e", F.posexplode(vector).alias("pos", "x"))
    sums = parts.groupBy(*keys, "__step", "pos").agg(F.sum(F.col("__e") * F.col("x").cast("double")).alias("__ex"), F.sum("__e").alias("__e"))
    over = lambda c: F.sum(F.col(c) * F.col("__scale"))
    return _with_peak(sums, keys).groupBy(*keys, "pos").agg((over("__ex") / over("__e")).alias("pooled"))


def pooled_vectors(pooled: DataFrame, keys: list[str], value: str = "pooled") -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("pos", value)))
    return pooled.groupBy(*keys).agg(F.transform(rows, lambda r: r[value]).alias("vector"))


def top_instances(instances: DataFrame, keys: list[str], score: str, order: str, k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    return instances.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= k).drop("__rank")


def topk_mean_pool(instances: DataFrame, keys: list[str], score: str, order: str, vector: str, k: int = 5) -> DataFrame:
    """The element-wise mean of the k best instances' vectors."""
    parts = top_instances(instances, keys, score, order, k).select(*keys, F.posexplode(vector).alias("pos", "x"))
    return parts.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("pooled"))


def position_code(position: Column, width: int) -> Column:
    """Sinusoids: even elements sine, odd ones cosine, of wavelengths rising to 10000."""
    out = []
    for i in range(width):
        angle = position * F.lit(math.exp(-math.log(10000.0) * (i - i % 2) / width))
        out.append(F.cos(angle) if i % 2 else F.sin(angle))
    return F.array(*out)


def with_position(instances: DataFrame, position: str, vector: str, width: int, scale: float) -> DataFrame:
    code = position_code(F.col(position), width)
    return instances.withColumn(vector, F.zip_with(vector, code, lambda x, c: x.cast("double") + F.lit(scale) * c))


def bag_tensor(bags: DataFrame, segments: DataFrame, keys: list[str], leads: list[str], length: int) -> DataFrame:
    """``tensor``: K x leads x length of each bag; duplicates stay, leads come in their order.

    ``segments`` has ``record_id, seg_index, lead, samples``; a missing lead is zeros, and a
    segment without any of the leads is left out."""
    by_lead = segments.where(F.col("lead").isin(leads)).groupBy("record_id", "seg_index").agg(F.map_from_entries(F.collect_list(F.struct("lead", "samples"))).alias("by_lead"))
    chosen = by_lead.select("record_id", "seg_index", select_leads(F.col("by_lead"), leads, length).alias("channels"))
    joined = bags.join(chosen, ["record_id", "seg_index"])
    rows = F.sort_array(F.collect_list(F.struct("bag_pos", "channels")))
    return joined.groupBy(*keys).agg(F.transform(rows, lambda r: r["channels"]).alias("tensor"))


def select_leads(by_lead: Column, leads: list[str], length: int) -> Column:
    """The leads' samples in order, each padded or cropped; zeros for a missing one."""
    zeros = F.array_repeat(F.lit(0.0), length)
    return F.array(*(F.coalesce(pad_or_crop(F.transform(F.try_element_at(by_lead, F.lit(n)), lambda x: x.cast("double")), length), zeros) for n in leads))


def variant_layout(segments: DataFrame, matrix: str, symbols: str, width: int) -> DataFrame:
    """The second layout: samples as rows of channels, symbols as bytes."""
    channels = F.transform(transposed(F.col(matrix)), lambda c: pad_or_crop(c, width))
    return segments.withColumn(matrix, channels).withColumn(symbols, F.transform(symbols, lambda b: F.decode(b, "UTF-8")))


def first_lead_wins(leads: DataFrame, keys: list[str], lead: str, position: str) -> DataFrame:
    first = Window.partitionBy(*keys, lead).orderBy(position)
    return leads.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def joined_features(bag: Column, meta: Column) -> Column:
    """The bag's representation followed by the metadata."""
    return F.concat(bag, meta)
