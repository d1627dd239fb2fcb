"""Metadata, splits, signal quality and fiducial features over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranges import numbered
from ..operators import cohort, fiducials, quality
from . import views

QUERIES, ORACLES = {}, {}


def registered(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@registered(
    """WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS d, avg(c_nationkey) AS mn, stddev_samp(c_nationkey) AS dn FROM customer)
SELECT c_custkey, round((c_acctbal - m) / nullif(d, 0), 6) AS acctbal, round((c_nationkey - mn) / nullif(dn, 0), 6) AS nation FROM customer, s"""
)
def meta_zscore(spark, sf_dir):
    meta = views.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nation"))
    z = cohort.z_scores(cohort.complete_rows(meta, ["acctbal", "nation"]), ["acctbal", "nation"])
    return z.select("c_custkey", F.round("acctbal", 6).alias("acctbal"), F.round("nation", 6).alias("nation"))


@registered("SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS code FROM customer")
def label_encode(spark, sf_dir):
    return cohort.label_codes(views.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code")


@registered(
    """WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS d FROM customer WHERE c_acctbal >= 0)
SELECT o_orderkey, round(coalesce((c_acctbal - m) / d, 0), 6) AS v0, coalesce(c_nationkey, 0)::DOUBLE AS v1
FROM orders CROSS JOIN s LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey"""
)
def meta_join_default(spark, sf_dir):
    meta = views.table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.col("c_nationkey").cast("double").alias("n"))
    vectors = cohort.z_scores(meta, ["c_acctbal"]).select("o_custkey", F.array("c_acctbal", "n").alias("vector"))
    d = cohort.with_vector(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), vectors, "o_custkey", 2)
    return d.select("o_orderkey", F.round(F.col("vector")[0], 6).alias("v0"), F.col("vector")[1].alias("v1"))


@registered("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def meta_last_wins(spark, sf_dir):
    return cohort.last_row(views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@registered(
    """WITH s AS (
  SELECT DISTINCT source AS pid, lang AS file_path, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split, toxic AS label
  FROM labels JOIN documents USING (doc_id))
SELECT * FROM s WHERE split = 'train'"""
)
def split_distinct(spark, sf_dir):
    d = views.table(spark, sf_dir, "labels").join(views.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    last = F.col("doc_id") % 10
    split = F.when(last < 7, "train").when(last < 8, "val").otherwise("test")
    rows = d.select(F.col("source").alias("pid"), F.col("lang").alias("file_path"), split.alias("split"), F.col("toxic").cast("string").alias("label"))
    return cohort.split_rows(rows, "train")


@registered(
    """WITH c AS (SELECT lang, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic <> 1) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, p::BIGINT AS n_pos, n::BIGINT AS n_neg, round(CASE WHEN p > 0 AND n > 0 THEN least(n::DOUBLE / p, 20) ELSE 15 END, 6)::DOUBLE AS pos_weight,
       round(CASE WHEN p > 0 AND n > 0 THEN p::DOUBLE / (p + n) ELSE 0 END, 6)::DOUBLE AS pos_ratio FROM c"""
)
def pos_weight(spark, sf_dir):
    d = views.table(spark, sf_dir, "labels").join(views.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    w = cohort.positive_weight(d, "toxic", ["lang"])
    return w.withColumns({c: F.round(c, 6) for c in ("pos_weight", "pos_ratio")})


_MOMENTS = """SELECT {keys}, round(1 - count(x)::DOUBLE / count(*), 6) AS nan_ratio, round(coalesce(m, 0), 6) AS amp_mean, round(coalesce(sqrt(avg((x - m) ** 2)), 0), 6) AS amp_std,
  round(coalesce(avg((x - m) ** 3) / nullif(avg((x - m) ** 2), 0) ** 1.5, 0), 6) AS amp_skewness, round(coalesce(avg((x - m) ** 4) / nullif(avg((x - m) ** 2), 0) ** 2 - 3, 0), 6) AS amp_kurtosis
FROM (SELECT *, avg(x) OVER (PARTITION BY {keys}) AS m FROM d) GROUP BY {keys}, m"""


def _rounded(d, keys):
    return d.select(*keys, *(F.round(c, 6).alias(c) for c in quality.STATISTICS))


@registered("WITH d AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber < 7 THEN l_quantity END AS x FROM lineitem) " + _MOMENTS.format(keys="l_returnflag, l_linestatus"))
def signal_quality(spark, sf_dir):
    x = F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).otherwise(F.lit(float("nan")))
    keys = ["l_returnflag", "l_linestatus"]
    return _rounded(quality.signal_statistics(views.table(spark, sf_dir, "lineitem").select(*keys, x.alias("x")), keys, "x"), keys)


@registered("WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) " + _MOMENTS.format(keys="vec_id"))
def signal_quality_arrays(spark, sf_dir):
    return _rounded(quality.array_statistics(views.table(spark, sf_dir, "embeddings"), "embedding"), ["vec_id"])


#: Beats of 40 to 64 samples, every eleventh with a missing one, brought to 64.
_BEATS = """b AS (SELECT vec_id, label, vec_id % 11 = 0 AS gap, list_transform(embedding[1:40 + vec_id % 25], lambda x: x::DOUBLE) AS x FROM embeddings),
y AS (SELECT vec_id, label, gap, list_transform(range(0, 64), lambda i: x[floor(i * (len(x) - 1) / 63.0::DOUBLE)::INTEGER + 1] * (1 - (i * (len(x) - 1) / 63.0::DOUBLE - floor(i * (len(x) - 1) / 63.0::DOUBLE)))
    + coalesce(x[floor(i * (len(x) - 1) / 63.0::DOUBLE)::INTEGER + 2], 0) * (i * (len(x) - 1) / 63.0::DOUBLE - floor(i * (len(x) - 1) / 63.0::DOUBLE))) AS x FROM b),
m AS (SELECT *, list_avg(x) AS m, sqrt(list_avg(list_transform(x, lambda v: (v - list_avg(x)) ** 2))) AS d FROM y),
z AS (SELECT vec_id, label, gap OR d = 0 AS flat, list_transform(x, lambda v: CASE WHEN gap OR d = 0 THEN 0.0::DOUBLE ELSE (v - m) / d END) AS a, count(*) OVER (PARTITION BY label) AS n FROM m),
p AS (SELECT * FROM (SELECT *, lag(a) OVER w AS b, lag(flat) OVER w AS flat_b FROM z WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE n > 3)"""


def _beats(spark, sf_dir):
    x = F.slice("embedding", F.lit(1), (40 + F.col("vec_id") % 25).cast("int"))
    missing = (F.col("vec_id") % 11 == 0)
    gapped = F.transform(x, lambda v, i: F.when(missing & (i == 4), F.lit(float("nan"))).otherwise(v.cast("double")))
    return views.table(spark, sf_dir, "embeddings").select("vec_id", "label", gapped.alias("samples"))


@registered(f"WITH {_BEATS} SELECT label, round(avg(CASE WHEN NOT flat AND NOT flat_b THEN list_inner_product(a, b) / 64 END), 6) AS bs_corr FROM p GROUP BY label")
def beat_correlation(spark, sf_dir):
    d = quality.beat_correlation(_beats(spark, sf_dir), ["label"], "vec_id", "samples", 64)
    return d.select("label", F.round("bs_corr", 6).alias("bs_corr"))


_DTW = f"""WITH RECURSIVE {_BEATS},
r AS (
  SELECT label, vec_id, a, b, 0 AS d, list_transform(range(0, 64), lambda i: CASE WHEN i = 0 THEN abs(a[1] - b[1]) ELSE 'inf'::DOUBLE END) AS last, list_transform(range(0, 64), lambda i: 'inf'::DOUBLE) AS last2 FROM p WHERE b IS NOT NULL
  UNION ALL
  SELECT label, vec_id, a, b, d + 1, list_transform(range(0, 64), lambda i: CASE WHEN d + 1 - i NOT BETWEEN 0 AND 63 THEN 'inf'::DOUBLE ELSE
    least(least(coalesce(last[i], 'inf'::DOUBLE), last[i + 1]) + abs(a[i + 1] - b[d + 2 - i]), coalesce(last2[i], 'inf'::DOUBLE) + 2 * abs(a[i + 1] - b[d + 2 - i])) END), last
  FROM r WHERE d < 126)
SELECT label, round(avg(last[64] / 64), 6) AS bs_dtw FROM r WHERE d = 126 GROUP BY label"""


@registered(_DTW)
def beat_dtw(spark, sf_dir):
    d = quality.beat_dtw(_beats(spark, sf_dir), ["label"], "vec_id", "samples", 64)
    return d.select("label", F.round("bs_dtw", 6).alias("bs_dtw"))


_POINTS = f"""WITH {views.EVENTS_SQL},
pt AS (SELECT user_id AS record_id, event_type AS wave, us / 1000000.0::DOUBLE AS sample, value AS lead_2, value * (1 + event_id % 3) - 100 AS lead_1,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS beat_no FROM ev)"""
WAVES = ["click", "error", "purchase", "signup", "view"]


def points(spark, sf_dir):
    e = numbered(views.events(spark, sf_dir), ["user_id", "event_type"], ["us", "event_id"], "beat_no")
    return e.select(
        F.col("user_id").alias("record_id"), F.col("event_type").alias("wave"), (F.col("us") / 1_000_000).alias("sample"), F.col("value").alias("lead_2"),
        (F.col("value") * (1 + F.col("event_id") % 3) - 100).alias("lead_1"), F.col("beat_no").cast("int").alias("beat_no"), "event_id",
    )


def wave_beats(spark, sf_dir):
    return fiducials.wave_beats(points(spark, sf_dir), ["record_id"], "wave", "beat_no", ["sample", "lead_1", "lead_2"], WAVES)


@registered(_POINTS + " SELECT record_id, wave, beat_no::INTEGER AS beat_no, round(sample - lag(sample) OVER (PARTITION BY record_id, wave ORDER BY beat_no), 6) AS interval FROM pt")
def rr_interval(spark, sf_dir):
    d = fiducials.successive_intervals(points(spark, sf_dir), ["record_id", "wave"], "beat_no", "sample")
    return d.select("record_id", "wave", "beat_no", F.round("interval", 6).alias("interval"))


_LISTS = _POINTS + """, cnt AS (SELECT record_id, wave, count(*) AS n FROM pt GROUP BY ALL),
recs AS (SELECT DISTINCT record_id FROM pt)"""


def _pair_sql(a: str, b: str, value: str, shift: int = 0) -> str:
    """Mean of b less a as a correlated subquery, with the length gates."""
    return f"""(SELECT CASE WHEN (SELECT n FROM cnt WHERE cnt.record_id = recs.record_id AND wave = '{a}') = (SELECT n FROM cnt WHERE cnt.record_id = recs.record_id AND wave = '{b}')
      AND count(*) > 3 THEN avg(y.{value} - x.{value}) END FROM pt x JOIN pt y ON x.record_id = y.record_id AND y.beat_no = x.beat_no + {shift}
    WHERE x.record_id = recs.record_id AND x.wave = '{a}' AND y.wave = '{b}')"""


@registered(_LISTS + f" SELECT record_id, round({_pair_sql('click', 'view', 'sample', 1)}, 4) AS tp FROM recs")
def tp_interval(spark, sf_dir):
    return wave_beats(spark, sf_dir).groupBy("record_id").agg(F.round(fiducials.successive_mean("click", "view", "sample"), 4).alias("tp"))


@registered(_LISTS + f" SELECT record_id, round({_pair_sql('click', 'view', 'lead_2')}, 6) AS amp FROM recs")
def wave_amplitude(spark, sf_dir):
    return wave_beats(spark, sf_dir).groupBy("record_id").agg(F.round(fiducials.paired_mean("click", "view", "lead_2"), 6).alias("amp"))


@registered(_POINTS + " SELECT record_id, round(avg(degrees(atan2(lead_2, lead_1))) FILTER (wave = 'error'), 6) AS axis FROM pt GROUP BY 1")
def wave_axis(spark, sf_dir):
    return wave_beats(spark, sf_dir).groupBy("record_id").agg(F.round(fiducials.axis_mean("error", "lead_1", "lead_2"), 6).alias("axis"))


#: Which event stands for which wave.
STAND_INS = {
    "P_Onset": "click", "P_Peak": "view", "P_Offset": "signup", "Q_Peak": "purchase", "R_Peak": "error", "S_Peak": "view",
    "T_Onset": "signup", "T_Peak": "purchase", "T_Offset": "view",
}


def _features_sql() -> str:
    at = STAND_INS
    cols = {n: " + ".join(f"{w} * {_pair_sql(at[base], at[peak], 'lead_2')}" for peak, base, w in pairs) for n, pairs in fiducials.AMPLITUDES.items()}
    cols |= {n: f"{_pair_sql(at[a], at[b], 'sample')} / 125.0::DOUBLE" for n, (a, b) in fiducials.INTERVALS.items()}
    cols["rr_int"] = f"{_pair_sql('error', 'error', 'sample', 1)} / 125.0::DOUBLE"
    cols["tp_seg"] = f"{_pair_sql(at['T_Offset'], at['P_Onset'], 'sample', 1)} / 125.0::DOUBLE"
    cols |= {n: f"(SELECT avg(degrees(atan2(lead_2, lead_1))) FROM pt WHERE pt.record_id = recs.record_id AND wave = '{at[w]}')" for n, w in fiducials.AXES.items()}
    inner = ", ".join(f"{sql} AS {n}" for n, sql in cols.items())
    names = [*cols, "qtc_baz", "qtc_frid"]
    outer = ", ".join(f"CASE WHEN n_r > 3 THEN round({n}, 4) END AS {n}" for n in names)
    return f"""{_LISTS}, f AS (SELECT record_id, (SELECT n FROM cnt WHERE cnt.record_id = recs.record_id AND wave = 'error') AS n_r, {inner} FROM recs),
q AS (SELECT *, CASE WHEN rr_int > 0 THEN qt_int / sqrt(rr_int) END AS qtc_baz, CASE WHEN rr_int > 0 THEN qt_int / rr_int ** (1.0::DOUBLE / 3.0::DOUBLE) END AS qtc_frid FROM f)
SELECT record_id, {outer} FROM q"""


@registered(_features_sql())
def fiducial_features(spark, sf_dir):
    d = fiducials.features(wave_beats(spark, sf_dir), ["record_id"], 125.0, names=STAND_INS)
    return d.select("record_id", *(F.round(c, 4).alias(c) for c in d.columns[1:]))


@registered(f"WITH {views.BEATS_SQL} SELECT record_id, seg_index, string_agg(us::VARCHAR, ',' ORDER BY us, symbol) AS fsample, string_agg(symbol, ',' ORDER BY us, symbol) AS fiducial FROM beats GROUP BY ALL")
def fiducial_order(spark, sf_dir):
    d = fiducials.ordered_points(views.beats(spark, sf_dir), ["record_id", "seg_index"], "us", "symbol")
    return d.select("record_id", "seg_index", F.concat_ws(",", F.transform("fsample", lambda x: x.cast("string"))).alias("fsample"), F.concat_ws(",", "fiducial").alias("fiducial"))


#: Peaks of each vector: components above both neighbours.
_PEAKS = """pk AS (
  SELECT vec_id, label, unnest(list_filter(range(1, 63), lambda i: embedding[i + 1] > embedding[i] AND embedding[i + 1] > embedding[i + 2])) AS sample FROM embeddings)"""


@registered(
    f"""WITH {_PEAKS}, nb AS (SELECT vec_id + 1 AS vec_id, embedding AS other FROM embeddings)
SELECT pk.vec_id, sample::INTEGER AS sample, round(embedding[sample + 1]::DOUBLE, 6) AS lead_1, round(other[sample + 1]::DOUBLE, 6) AS lead_2 FROM pk JOIN embeddings USING (vec_id) LEFT JOIN nb ON nb.vec_id = pk.vec_id"""
)
def point_amplitudes(spark, sf_dir):
    """Samples of two leads at each vector's peaks; the second lead is the vector before it."""
    v = views.table(spark, sf_dir, "embeddings")
    inner = F.filter(F.sequence(F.lit(1), F.size("embedding") - 2), lambda i: (F.get("embedding", i) > F.get("embedding", i - 1)) & (F.get("embedding", i) > F.get("embedding", i + 1)))
    peaks = v.select("vec_id", F.explode(inner).alias("sample"))
    leads = v.select("vec_id", F.lit("I").alias("lead"), F.col("embedding").alias("samples"))
    leads = leads.unionByName(v.select((F.col("vec_id") + 1).alias("vec_id"), F.lit("II").alias("lead"), F.col("embedding").alias("samples")))
    d = fiducials.with_amplitudes(peaks, leads, ["vec_id"], "sample", {"lead_1": "I", "lead_2": "II"})
    return d.select("vec_id", "sample", F.round("lead_1", 6).alias("lead_1"), F.round("lead_2", 6).alias("lead_2"))


@registered(
    """SELECT vec_id, i::INTEGER AS pos, round(embedding[floor(i * 63 / 127.0::DOUBLE)::INTEGER + 1]::DOUBLE * (1 - (i * 63 / 127.0::DOUBLE - floor(i * 63 / 127.0::DOUBLE)))
  + coalesce(embedding[floor(i * 63 / 127.0::DOUBLE)::INTEGER + 2], 0)::DOUBLE * (i * 63 / 127.0::DOUBLE - floor(i * 63 / 127.0::DOUBLE)), 6) AS value FROM embeddings, range(0, 128) t(i)"""
)
def beat_resample(spark, sf_dir):
    """Beats at twice their number of samples."""
    d = views.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(quality.resampled(F.col("embedding"), 128)).alias("pos", "value"))
    return d.select("vec_id", "pos", F.round("value", 6).alias("value"))
