"""Invariants of bags, and edges that the driver's tables lack."""

import itertools

import pytest
from pyspark.sql import functions as F

from pulselake.functions.stable import stable_seed
from pulselake.operators import sampling, segments


def flags(spark, spec):
    """spec: record to a string of S and N by index; '.' is a gap."""
    rows = [(r, i, c == "S") for r, s in spec.items() for i, c in enumerate(s) if c != "."]
    return spark.createDataFrame(rows, "record_id string, seg_index int, is_s boolean")


def configs(spark, k, radius, fill):
    return spark.createDataFrame([(0, k, radius, fill)], "config_id int, k int, radius int, fill string")


def bag(spark, spec, k, radius, fill, scores=None, ups=None):
    s = spark.createDataFrame(scores, "record_id string, time string, score string") if scores else None
    got = sampling.sample_bags(flags(spark, spec), configs(spark, k, radius, fill), sampling.external_segments(s) if s is not None else None, ups).orderBy("record_id", "upsample_index", "bag_pos").collect()
    return {key: [r.seg_index for r in g] for key, g in itertools.groupby(got, lambda r: (r.record_id, r.upsample_index))}


SPEC = {"a": "SNNS.NNNSN", "one": "SNNNNN", "none": "NNNN", "all": "SSS", "many": "SSSSSSSSNN"}


@pytest.mark.parametrize("fill", [*sampling.FILLS, "unknown", None])
def test_size_and_s_first(spark, fill):
    bags = bag(spark, SPEC, 6, 1, fill)
    assert {k[0] for k in bags} == {"a", "all", "many"}
    assert all(len(b) == 6 for b in bags.values())
    assert bags["a", 0][:3] == [0, 3, 8]
    assert set(bags["a", 0][3:6]) <= {1, 2, 7, 9}  # the neighbours fill it
    assert set(bags["many", 0]) <= set(range(8)) and len(set(bags["many", 0])) == 6
    assert set(bags["all", 0]) == {0, 1, 2}
    assert bags == bag(spark, SPEC, 6, 1, fill)


def test_fills_beyond_the_record(spark):
    assert set(bag(spark, SPEC, 20, 0, "normal")["a", 0][9:]) <= {1, 2, 5, 6, 7, 9}
    assert set(bag(spark, SPEC, 20, 0, "duplicate")["a", 0][3:]) <= {0, 3, 8}
    half = bag(spark, SPEC, 20, 0, "half")["a", 0]
    assert set(half[3:12]) <= {0, 3, 8} and sorted(half[12:18]) == [1, 2, 5, 6, 7, 9]
    scored = [("a", "25", "0.9"), ("a", "29", "0.95"), ("a", "71", "0.5"), ("a", "990", "1"), ("a", "x", "1"), ("a", "-5", "1"), ("a", "60", "n/a")]
    slike = bag(spark, SPEC, 20, 0, "slike", scored)["a", 0]
    assert slike[:9] == [0, 3, 8, 2, 7, 1, 5, 6, 9] and set(slike[9:]) <= {2, 7}


def test_external_set_of_the_random_fill_is_from_times_alone(spark):
    """Scores that are no numbers rank nothing, but their times name segments all the same."""
    scored = [("r", str(10 * i), "n/a") for i in range(20, 30)] + [("r", "300", "0.5")]
    spec = {"r": "SS" + "N" * 38}
    got = bag(spark, spec, 8, 0, "slike_random", scored)["r", 0]
    assert got[:2] == [0, 1] and set(got[2:]) <= set(range(20, 31)) and len(set(got)) == 8
    assert bag(spark, spec, 8, 0, "slike", scored)["r", 0] == [0, 1, 30, 2, 3, 4, 5, 6]
    over = bag(spark, {"r": "SS" + "N" * 3}, 9, 0, "slike_random", [("r", "30", "n/a")])["r", 0]
    assert over[:5] == [0, 1, 3, 2, 4] and set(over[5:]) == {3}


def test_whole_segments_up_to_a_maximum(spark):
    d = spark.createDataFrame([(i,) for i in range(6)], "seg_index int")
    kept = lambda most: sorted(r.seg_index for r in segments.whole_segments(d, F.lit(47), 10, most).collect())
    assert kept(None) == [0, 1, 2, 3] and kept(2) == [0, 1] and kept(9) == [0, 1, 2, 3]


def test_config_tags(spark):
    tag = sampling.config_tag(F.lit("s_first"), F.lit(1), F.lit(20), F.lit("half"), F.lit(42), F.col("id"))
    assert [r.t for r in spark.range(1, 3).select(tag.alias("t")).collect()] == ["s_first_R1_K20_Fhalf_SS42", "s_first_R1_K20_Fhalf_SS42_UP2"]


def test_upsampled_bags_differ(spark):
    ups = sampling.upsampled(spark.createDataFrame([("a", 1), ("many", 0)], "record_id string, label int"), "label", 3).select("record_id", "upsample_index")
    bags = bag(spark, {"a": "SNSNNNNNNNNNNNNNNNNNN", "many": SPEC["many"]}, 8, 0, "normal", ups=ups)
    assert sorted(bags) == [("a", 0), ("a", 1), ("a", 2), ("many", 0)]
    assert len({tuple(b) for k, b in bags.items() if k[0] == "a"}) > 1


def test_neighbours(spark):
    f = flags(spark, {"a": "SN.NSNN"})
    near = lambda r: {x.seg_index for x in segments.neighbours(f, r).collect()}
    assert near(0) == set() and near(1) == {1, 3, 5} and near(2) == {1, 3, 5, 6}


def test_flags_need_the_exact_symbol(spark):
    segs = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2)], "record_id string, seg_index int")
    beats = spark.createDataFrame([("a", 0, "s"), ("a", 1, "S"), ("a", 1, "S")], "record_id string, seg_index int, symbol string")
    got = {r.seg_index: r.is_s for r in segments.segment_flags(segs, beats).collect()}
    assert got == {0: False, 1: True, 2: False}


def test_cache_validation(spark):
    ok = spark.createDataFrame([([1, 2], "half"), ([3, 4], "half")], "selected_keys array<int>, fill string")
    valid = lambda d, **kw: sampling.cache_is_valid(d, kw, 2).first().valid
    assert valid(ok, fill="half") and not valid(ok, fill="normal") and not valid(ok.limit(0), fill="half")
    assert not valid(ok.union(spark.createDataFrame([([1], "half")], ok.schema)), fill="half")


def test_seed_matches_sha256(spark):
    import hashlib

    got = spark.range(1).select(stable_seed(F.lit(42), F.lit("x"), F.lit(3)).alias("s")).first().s
    assert got == int(hashlib.sha256(b"42||x||3").hexdigest()[:8], 16)
