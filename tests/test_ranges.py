"""Groups of any size in order: numbers, sums, the row before, folds; null keys and hot groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pulselake.functions import ranges
from pulselake.functions.grouped import lookup
from pulselake.operators import bags, fiducials, metrics, quality

NAN = float("nan")


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows in one group, some keys null, values that repeat."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None, str(i)]), i, rng.randrange(40), float(rng.randrange(5))) for i in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, i long, v int, x double").repartition(7), rows


def by_key(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return groups


def test_numbers(hot):
    d, rows = hot
    got = {(r.k, r.i): r.no for r in ranges.numbered(d, ["k"], ["i"], "no").collect()}
    want = {(k, r[1]): n for k, g in by_key(rows).items() for n, r in enumerate(sorted(g, key=lambda r: r[1]), 1)}
    assert got == want
    whole = sorted((r.no, r.v, r.i) for r in ranges.numbered(d, [], [F.desc("v"), "i"], "no").collect())
    assert [n for n, _, _ in whole] == list(range(1, 3001)) and [(-v, i) for _, v, i in whole] == sorted((-r[2], r[1]) for r in rows)


def test_no_task_orders_a_group(hot):
    d, _ = hot
    placed = ranges.placed(d, ["k"], ["i"])
    assert placed.where("k = 'hot'").select(ranges.RANGE).distinct().count() > 1
    assert placed.select(ranges.PLACE).distinct().count() == 3000


def test_running_sums(hot):
    d, rows = hot
    got = {(r.k, r.i): r.before_x for r in ranges.running_sums(d, ["k"], "i", ["x"]).collect()}
    for k, g in by_key(rows).items():
        total = 0.0
        for r in sorted(g, key=lambda r: r[1]):
            assert got[k, r[1]] == total
            total += r[3]


def test_the_row_before(hot):
    d, rows = hot
    got = {(r.k, r.i): (r.last_i, r.last_v) for r in ranges.lagged(d, ["k"], ["i"], {"last_i": "i", "last_v": "v"}).collect()}
    for k, g in by_key(rows).items():
        before = (None, None)
        for r in sorted(g, key=lambda r: r[1]):
            assert got[k, r[1]] == before
            before = r[1], r[2]


def test_repeated_rows_and_empty_tables(spark):
    d = spark.createDataFrame([("a", 1)] * 50, "k string, i int").repartition(3)
    assert sorted(r.no for r in ranges.numbered(d, ["k"], ["i"], "no").collect()) == list(range(1, 51))
    none = d.limit(0)
    assert ranges.numbered(none, ["k"], ["i"], "no").count() == ranges.lagged(none, ["k"], ["i"], {"p": "i"}).count() == ranges.running_sums(none, ["k"], "i", ["i"]).count() == 0


def test_look_ups_keep_null_keys(spark):
    d = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "k string, i int")
    got = lookup(d, d.groupBy("k").agg(F.count("*").alias("n")), ["k"], F.col("i"), nulls_meet=True).collect()
    assert sorted((r.i, r.n) for r in got) == [(1, 2), (2, 1), (3, 2)]


def test_null_keys_in_metrics_and_pools(spark):
    rows = [(k, y, p) for k in (None, "a") for y, p in ((1, 0.9), (0, 0.2), (1, 0.4), (0, 0.6))]
    d = spark.createDataFrame(rows, "k string, y int, p double")
    for table, column, want in ((metrics.auroc(d, ["k"]), "auroc", 0.75), (metrics.average_precision(d, ["k"]), "ap", (1 + 2 / 3) / 2)):
        got = {r.k: r[column] for r in table.collect()}
        assert got == pytest.approx({None: want, "a": want})
    assert {r.k for r in metrics.evaluate(d, ["k"]).collect()} == {None, "a"}
    assert {(r.k, r.section) for r in metrics.evaluation_report(d, ["k"]).collect()} == {(k, s) for k in (None, "a") for s in ("metrics", "classes", "confusion")}
    inst = spark.createDataFrame([(None, 1.0, [1.0, 2.0]), (None, 3.0, [5.0, 0.0]), ("b", 700.0, [1.0, 1.0]), ("b", -700.0, [9.0, 9.0])], "k string, s double, x array<double>")
    w = 1 / (1 + math.exp(-2))
    pooled = {(r.k, r.pos): r.pooled for r in bags.attention_pool(inst, ["k"], "s", "x").collect()}
    assert pooled == pytest.approx({(None, 0): 5 * w + 1 - w, (None, 1): 2 * (1 - w), ("b", 0): 1.0, ("b", 1): 1.0})
    weights = sorted((str(r.k), round(r.weight, 9)) for r in bags.softmax_weights(inst, ["k"], "s").collect())
    assert weights == sorted([("None", round(w, 9)), ("None", round(1 - w, 9)), ("b", 1.0), ("b", 0.0)])
    assert sorted(str(r.k) for r in bags.top_instances(inst, ["k"], "s", "s", 1).collect()) == ["None", "b"]


def folded(values, gain=0.001, patience=30):
    best, at, flat, n = 0.0, 0, 0, 0
    for v in values:
        if flat >= patience:
            break
        n += 1
        if v is not None and not math.isnan(v) and v > best + gain:
            best, at, flat = v, n, 0
        else:
            flat += 1
    return (best if at else None, at or None, n, flat >= patience)


@pytest.mark.parametrize(("span", "fan", "patience"), [(512, 64, 30), (8, 2, 5), (16, 3, 3)])
def test_best_epochs_of_long_runs(spark, monkeypatch, span, fan, patience):
    monkeypatch.setattr(metrics, "SPAN", span)
    monkeypatch.setattr(metrics, "FAN", fan)
    rng = random.Random(span)
    runs = {"rising": [i / 1000 for i in range(1400)], "flat": [0.5] * 90, "never": [-1.0] * 40, "short": [0.1, NAN, 0.3], "missing": [None] * patience + [1.0], "last": [None] * (patience - 1) + [1.0], None: [0.2, 0.1]}
    for n in range(12):
        runs[f"r{n}"] = [rng.choice([None, NAN, rng.random() * (1 + i / 50)]) for i in range(rng.choice([1, patience, 8 * span, 5 * span + 1]))]
    d = spark.createDataFrame([(k, i, v) for k, vs in runs.items() for i, v in enumerate(vs)], "k string, i int, v double").repartition(5)
    got = {r.k: (r.best, r.best_epoch, r.stop_epoch, r.stopped) for r in metrics.best_epoch(d, ["k"], ["i"], "v", patience=patience).collect()}
    assert got == {k: folded(vs, patience=patience) for k, vs in runs.items()}


def reference_dtw(a, b):
    n, m = len(a), len(b)
    c = [[math.inf] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d = abs(a[i - 1] - b[j - 1])
            c[i][j] = d if i == j == 1 else min(c[i - 1][j] + d, c[i][j - 1] + d, c[i - 1][j - 1] + 2 * d)
    return c[n][m]


def test_warping_against_the_recurrence(spark):
    rng = random.Random(0)
    pairs = [([rng.gauss(0, 1) for _ in range(n)], [rng.gauss(0, 1) for _ in range(m)]) for n, m in ((1, 1), (1, 5), (5, 1), (4, 3), (9, 12), (12, 9))]
    rows = spark.createDataFrame(pairs + [([], [1.0])], "a array<double>, b array<double>").select("a", "b", quality.warping_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in rows:
        assert r.d == pytest.approx(reference_dtw(r.a, r.b)) if r.a else r.d is None


def test_beats_with_missing_samples_and_other_lengths(spark):
    """A beat with a missing sample counts as zeros; beats of any length are resampled first."""
    import numpy as np

    rng = random.Random(5)
    beats = [[rng.gauss(0, 1) for _ in range(n)] for n in (4, 3, 5, 2, 6)]
    beats[2][1] = NAN
    d = spark.createDataFrame([("a", i, b) for i, b in enumerate(beats)], "r string, i int, x array<double>")

    def normal(b, n):
        x = np.interp(np.linspace(0, len(b) - 1, n), range(len(b)), b)
        return np.zeros(n) if np.isnan(b).any() or x.std() == 0 else (x - x.mean()) / x.std()

    z = [normal(b, 8) for b in beats]
    want = np.mean([reference_dtw(p, q) / 8 for p, q in zip(z, z[1:])])
    assert quality.beat_dtw(d, ["r"], "i", "x", 8).first().bs_dtw == pytest.approx(want)
    r = np.mean([np.corrcoef(z[i], z[i + 1])[0, 1] for i in (0, 3)])
    assert quality.beat_correlation(d, ["r"], "i", "x", 8).first().bs_corr == pytest.approx(r)


def test_intervals_of_a_long_lead(spark):
    d = spark.range(2000).select(F.lit("a").alias("r"), F.col("id").alias("n"), (F.col("id") * F.col("id")).alias("s")).repartition(6)
    got = {r.n: r.interval for r in fiducials.successive_intervals(d, ["r"], "n", "s").collect()}
    assert got == {i: None if i == 0 else 2 * i - 1 for i in range(2000)}
