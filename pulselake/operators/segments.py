"""Beats, segments and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assign_segments(beats: DataFrame, segment_length: int, sample: str = "sample") -> DataFrame:
    """Beat to half-open segment as arithmetic instead of a range join; ``offset`` is re-based."""
    return beats.withColumn("seg_index", F.floor(F.col(sample) / segment_length).cast("int")).withColumn(
        "offset", (F.col(sample) - F.col("seg_index").cast("long") * segment_length).cast("long")
    )


def whole_segments(segments: DataFrame, length: Column, segment_length: int, max_segments: int | None = None) -> DataFrame:
    """Segments that the signal fills, without the dropped tail, up to an optional maximum."""
    n = F.floor(length / segment_length)
    return segments.where(F.col("seg_index") < (F.least(n, F.lit(max_segments)) if max_segments is not None else n))


def segment_flags(segments: DataFrame, beats: DataFrame, symbol: str = "S") -> DataFrame:
    """``record_id, seg_index, is_s``: whether any beat of the segment has exactly that symbol.

    A segment without beats is not an S segment.  Only beats of the symbol are shuffled."""
    hit = beats.where(F.col("symbol") == symbol).select("record_id", "seg_index").distinct().withColumn("hit", F.lit(True))
    return segments.select("record_id", "seg_index").join(hit, ["record_id", "seg_index"], "left").select("record_id", "seg_index", F.coalesce("hit", F.lit(False)).alias("is_s"))


def flags_of_beats(beats: DataFrame, symbol: str = "S") -> DataFrame:
    """The flags where every segment has a beat, as one aggregation."""
    return beats.groupBy("record_id", "seg_index").agg(F.coalesce(F.bool_or(F.col("symbol") == symbol), F.lit(False)).alias("is_s"))


def record_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count_if("is_s").alias("n_s"))


def eligible_records(flags: DataFrame, least: int = 2) -> DataFrame:
    """Records with at least so many S segments (segments, not beats)."""
    return record_counts(flags).where(F.col("n_s") >= least)


def neighbours(flags: DataFrame, radius: int) -> DataFrame:
    """Existing non-S segments within ``radius`` of an S segment: a band join as an equi-join."""
    shifts = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    near = flags.where("is_s").select("record_id", "seg_index", shifts.alias("shift"))
    near = near.where("shift <> 0").select("record_id", (F.col("seg_index") + F.col("shift")).alias("seg_index")).distinct()
    return flags.where("not is_s").select("record_id", "seg_index").join(near, ["record_id", "seg_index"], "left_semi")


def beats_by_record(records: DataFrame, beats: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each record with its beats in order as arrays; a record without any has empty arrays."""
    rows = beats.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    joined = records.select(key).join(rows, key, "left")
    out = joined.withColumn("rows", F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType)))
    return out.select(key, *(F.col("rows")[c].alias(c) for c in columns))
