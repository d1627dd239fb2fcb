"""Signal quality, fiducial features, metrics and pooling on edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.functions import arrays
from pulselake.operators import bags, cohort, experiments, fiducials, metrics, quality

NAN = float("nan")


def test_array_statistics(spark):
    d = spark.createDataFrame([(0, [NAN, NAN]), (1, [2.0, 2.0, 2.0]), (2, [1.0, 2.0, 4.0, 9.0, NAN]), (3, [])], "i int, x array<double>")
    got = {r.i: r for r in quality.array_statistics(d, "x").collect()}
    assert (got[0].nan_ratio, got[0].amp_mean, got[0].amp_std) == (1.0, 0.0, 0.0)
    assert (got[1].amp_std, got[1].amp_skewness, got[1].amp_kurtosis) == (0.0, 0.0, 0.0)
    x = np.array([1.0, 2, 4, 9])
    z = (x - x.mean()) / x.std()
    assert got[2].nan_ratio == pytest.approx(0.2) and got[2].amp_skewness == pytest.approx((z**3).mean()) and got[2].amp_kurtosis == pytest.approx((z**4).mean() - 3)
    assert got[3].nan_ratio == 0.0


def test_beats(spark):
    rows = [("a", i, [math.sin(i + j) for j in range(8)]) for i in range(4)] + [("few", i, [1.0, 2.0]) for i in range(3)] + [("flat", i, [1.0, 1.0] if i % 2 else [1.0, 2.0]) for i in range(5)] + [("gap", i, [1.0, NAN if i == 2 else 2.0]) for i in range(4)]
    d = spark.createDataFrame(rows, "r string, i int, x array<double>")
    got = {r.r: r.bs_corr for r in quality.beat_correlation(d, ["r"], "i", "x").collect()}
    want = np.mean([np.corrcoef([math.sin(i + j) for j in range(8)], [math.sin(i + 1 + j) for j in range(8)])[0, 1] for i in range(3)])
    assert got["a"] == pytest.approx(want) and "few" not in got and got["flat"] is None and got["gap"] == pytest.approx(1.0)
    # the third beat has a missing sample, so it is zeros and its two pairs count
    assert quality.beat_dtw(d, ["r"], "i", "x", 10).where("r = 'gap'").first().bs_dtw > 0.5


def test_fiducial_gates(spark):
    def points(record, wave, samples):
        return [(record, wave, i, s, 1.0, float(i)) for i, s in enumerate(samples)]

    rows = points("three", "R_Peak", [0, 100, 200]) + points("four", "R_Peak", [0, 100, 200, 300]) + points("five", "R_Peak", [0, 100, 200, 300, 400])
    rows += points("five", "Q_Peak", [10, None, 210, 310]) + points("five", "T_Offset", [20, 120, 230, 320])
    d = spark.createDataFrame(rows, "record_id string, wave string, beat_no int, sample int, lead_1 double, lead_2 double")
    waves = ["R_Peak", "Q_Peak", "S_Peak", "P_Onset", "P_Peak", "P_Offset", "T_Onset", "T_Peak", "T_Offset"]
    got = {r.record_id: r for r in fiducials.features(fiducials.wave_beats(d, ["record_id"], "wave", "beat_no", ["sample", "lead_1", "lead_2"], waves), ["record_id"], 100.0).collect()}
    assert got["three"].r_axis is None and got["four"].rr_int is None and got["four"].r_axis is not None
    f = got["five"]
    assert f.rr_int == 1.0 and f.qt_int == pytest.approx(0.4 / 3) and f.qtc_baz == f.qt_int and f.p_amp is None
    none = fiducials.features(fiducials.wave_beats(d, ["record_id"], "wave", "beat_no", ["sample", "lead_1", "lead_2"], waves), ["record_id"], 100.0, lead_one=None)
    assert none.where("record_id = 'five'").first().r_axis is None


def test_pad_patch_position(spark):
    d = spark.createDataFrame([(n, [1.0] * n) for n in (0, 15, 16, 17, 1249, 1250, 1251)], "n int, x array<double>")
    got = {r.n: r for r in d.select("n", F.size(arrays.pad_or_crop(F.col("x"), 1250)).alias("p"), arrays.patches(F.col("x")).alias("q")).collect()}
    assert all(r.p == 1250 for r in got.values())
    assert [len(got[n].q) for n in (0, 15, 16, 17)] == [0, 1, 1, 2] and got[17].q[1] == [1.0] + [0.0] * 15
    code = spark.range(1).select(bags.position_code(F.lit(3), 4).alias("c")).first().c
    assert code == pytest.approx([math.sin(3), math.cos(3), math.sin(0.03), math.cos(0.03)])


def test_bag_tensor(spark):
    b = spark.createDataFrame([("c", "a", 1, 1), ("c", "a", 2, 0), ("c", "a", 3, 1)], "config_id string, record_id string, bag_pos int, seg_index int")
    s = spark.createDataFrame([("a", 0, "II", [1.0]), ("a", 1, "V5", [2.0, 3.0, 4.0])], "record_id string, seg_index int, lead string, samples array<double>")
    t = bags.bag_tensor(b, s, ["config_id", "record_id"], ["V5", "II"], 2).first().tensor
    assert t == [[[2.0, 3.0], [0.0, 0.0]], [[0.0, 0.0], [1.0, 0.0]], [[2.0, 3.0], [0.0, 0.0]]]
    assert bags.pooled_vectors(spark.createDataFrame([("a", 1, 2.0), ("a", 0, 1.0)], "k string, pos int, pooled double"), ["k"]).first().vector == [1.0, 2.0]


def test_metrics_edges(spark):
    rows = [("tie", 1, 0.5), ("tie", 0, 0.5), ("one", 1, 0.9), ("none", 1, 0.1), ("none", 0, 0.2)]
    d = spark.createDataFrame(rows, "k string, y int, p double")
    assert {r.k: r.auroc for r in metrics.auroc(d, ["k"]).collect()} == {"tie": 0.5, "one": None, "none": 0.0}
    assert {r.k: r.ap for r in metrics.average_precision(d, ["k"]).collect()} == {"tie": 0.5, "one": 1.0, "none": 0.5}
    m = {r.k: r for r in metrics.binary_metrics(d, ["k"]).collect()}
    assert m["none"].precision == m["none"].f1 == 0.0 and m["tie"].recall == 1.0


def test_best_epoch(spark):
    logs = {"never": [0.001] * 3, "once": [0.5] + [0.5005] * 30 + [0.9], "late": [0.1, 0.102, 0.1025, 0.2]}
    d = spark.createDataFrame([(k, i, v) for k, vs in logs.items() for i, v in enumerate(vs)], "k string, i int, v double")
    got = {r.k: (r.best, r.best_epoch, r.stop_epoch, r.stopped) for r in metrics.best_epoch(d, ["k"], ["i"], "v").collect()}
    assert got == {"never": (None, None, 3, False), "once": (0.5, 1, 31, True), "late": (0.2, 4, 4, False)}


def test_cohort_edges(spark):
    d = spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 5.0), (2, None, 5.0)], "i int, a double, b double")
    got = {r.i: (r.a, r.b) for r in cohort.z_scores(cohort.complete_rows(d, ["a"]), ["a", "b"]).collect()}
    assert got[0] == (pytest.approx(-(0.5**0.5)), None)
    w = spark.createDataFrame([("x", 1), ("y", 0)] + [("z", 1)] + [("z", 0)] * 50, "k string, y int")
    got = {r.k: (r.pos_weight, r.pos_ratio) for r in cohort.positive_weight(w, "y", ["k"]).collect()}
    assert got["x"] == got["y"] == (15.0, 0.0) and got["z"][0] == 20.0


def test_runs_edges(spark):
    d = spark.createDataFrame([("a", 0.5), ("b", NAN), ("b", 0.25), (None, 0.1)], "k string, v double")
    got = {r.k: (r.n, r.v_mean, r.v_std, r.v_ci95_lo) for r in experiments.aggregate_runs(d, ["k"], ["v"], "n").collect()}
    assert got == {"a": (1, 0.5, 0.0, 0.5), "b": (2, 0.25, 0.0, 0.25)}


def test_weighted_logistic_against_newton(spark):
    from pulselake.operators import ml

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1.0, 2.0, 0.5]
    y = (x @ [1.0, -0.5, 2.0] + rng.normal(size=300) > 1.2).astype(float)
    w = np.where(y == 1, min(20.0, (y == 0).sum() / (y == 1).sum()), 1.0)
    # features are scaled to unit deviation (weighted, unbiased) for the penalty, the intercept is free
    mean = (w[:, None] * x).sum(0) / w.sum()
    scale = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - (w**2).sum() / w.sum()))
    z = np.c_[x / scale, np.ones(300)]
    beta, penalty = np.zeros(4), np.array([0.01, 0.01, 0.01, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        gradient = z.T @ (w * (p - y)) / w.sum() + penalty * beta
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + np.diag(penalty), gradient)
    want = 1 / (1 + np.exp(-z @ beta))
    d = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(300)], "i int, y int, x array<double>")
    got = {r.i: r.p for r in ml.weighted_logistic(d, ["i"], "y", "x", 200).collect()}
    assert np.abs(np.array([got[i] for i in range(300)]) - want).max() < 1e-8
    # runs of their own in the same jobs; null is a run, vectors that are not whole take no part
    rows = [(r, i, int(y[i]), x[i].tolist()) for r in ("a", None) for i in range(300) if r or i % 2] + [("a", -1, 1, None), ("a", -2, 0, [1.0]), ("a", -3, 0, [1.0, NAN, 2.0])]
    runs = {(r.r, r.i): r.p for r in ml.weighted_logistic(spark.createDataFrame(rows, "r string, i int, y int, x array<double>"), ["i"], "y", "x", 200, ["r"]).collect()}
    assert np.abs(np.array([runs["a", i] for i in range(300)]) - want).max() < 1e-8 and runs["a", -1] is runs["a", -2] is runs["a", -3] is None
    assert runs[None, 1] != runs["a", 1] and all(0 < runs[None, i] < 1 for i in range(1, 300, 2))


def test_resampled_beats(spark):
    d = spark.createDataFrame([(0, [0.0, 2.0]), (1, [1.0]), (2, []), (3, [1.0, 3.0, 5.0])], "i int, x array<double>")
    got = {r.i: r.y for r in d.select("i", quality.resampled(F.col("x"), 5).alias("y")).collect()}
    assert got[0] == [0.0, 0.5, 1.0, 1.5, 2.0] and got[1] == [1.0] * 5 and got[2] is None and got[3] == [1.0, 2.0, 3.0, 4.0, 5.0]
    rows = [("a", i, [math.sin(k / (5 + i)) for k in range(5 + i)]) for i in range(5)]
    r = quality.beat_correlation(spark.createDataFrame(rows, "r string, i int, x array<double>"), ["r"], "i", "x", 16).first().bs_corr
    assert 0.99 < r <= 1.0


def test_running_sums_of_many_ranges(spark):
    from pulselake.functions.ranges import running_sums

    rows = [("a", float(i % 97) / 7, 1.0) for i in range(97)] + [("b", float(-i), 2.0) for i in range(5)]
    for down in (False, True):
        got = running_sums(spark.createDataFrame(rows, "k string, p double, n double"), ["k"], F.desc("p") if down else "p", ["n"]).collect()
        assert len(got) == len(rows)
        assert all(r.before_n == sum(n for k, p, n in rows if k == r.k and (p > r.p if down else p < r.p)) for r in got)


def test_amplitudes_at_points(spark):
    points = spark.createDataFrame([("a", 0, 1), ("a", 0, 9), ("a", 0, None), ("b", 0, 0)], "record_id string, seg_index int, sample int")
    segs = spark.createDataFrame([("a", 0, "I", [1.0, 2.0]), ("a", 0, "V1", [7.0, 8.0])], "record_id string, seg_index int, lead string, samples array<double>")
    got = fiducials.with_amplitudes(points, segs, ["record_id", "seg_index"], "sample", {"lead_1": "I", "lead_2": "II"}).collect()
    assert {(r.record_id, r.sample, r.lead_1, r.lead_2) for r in got} == {("a", None, None, None), ("a", 1, 2.0, None), ("a", 9, None, None), ("b", 0, None, None)}
    none = fiducials.features(fiducials.wave_beats(points.selectExpr("record_id", "'R_Peak' as wave", "seg_index as beat", "sample"), ["record_id"], "wave", "beat", ["sample"], ["R_Peak"]), ["record_id"], 125.0, dummy=True)
    assert none.count() == 2 and none.columns[1] == "p_amp" and len(none.columns) == 20 and none.first().rr_int is None
