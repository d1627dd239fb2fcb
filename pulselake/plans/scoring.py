"""Metrics, run aggregates and bag pooling over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.ranges import numbered
from ..operators import bags, experiments, metrics, ml
from . import views

QUERIES, ORACLES = {}, {}


def registered(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


#: Scores tie now and then, as they are rounded.
_PRED = "pred AS (SELECT vec_id, vec_id % 7 AS grp, (label < 5)::INTEGER AS y, round(1 / (1 + exp(-8 * embedding[1]::DOUBLE)), 2) AS p FROM embeddings)"


def predictions(spark, sf_dir):
    d = views.table(spark, sf_dir, "embeddings")
    return d.select("vec_id", (F.col("vec_id") % 7).alias("grp"), (F.col("label") < 5).cast("int").alias("y"), F.round(arrays.sigmoid(8 * F.col("embedding")[0].cast("double")), 2).alias("p"))


def _rounded(d, *names, digits=6):
    return d.withColumns({n: F.round(n, digits) for n in names})


@registered(
    f"""WITH {_PRED}, r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2.0::DOUBLE AS rk FROM pred),
g AS (SELECT grp, sum(rk) FILTER (y = 1) AS s, count(*) FILTER (y = 1)::DOUBLE AS n1, count(*) FILTER (y <> 1)::DOUBLE AS n0 FROM r GROUP BY grp)
SELECT grp, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auroc FROM g"""
)
def auroc(spark, sf_dir):
    return _rounded(metrics.auroc(predictions(spark, sf_dir), ["grp"]), "auroc")


_AP = f"""WITH {_PRED}, s AS (SELECT grp, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM pred GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (PARTITION BY grp ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT grp, round(sum(pos * tp::DOUBLE / (tp + fp)) / sum(pos), 6) AS ap FROM c GROUP BY grp"""


@registered(_AP)
def average_precision(spark, sf_dir):
    return _rounded(metrics.average_precision(predictions(spark, sf_dir), ["grp"]), "ap")


@registered(f"WITH {_PRED} SELECT grp, y, count(*) FILTER (p < 0.5)::BIGINT AS pred_0, count(*) FILTER (p >= 0.5)::BIGINT AS pred_1 FROM pred GROUP BY grp, y")
def confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), ["grp"])


_CELLS = f"""WITH {_PRED}, c AS (SELECT grp, count(*) FILTER (y = 1 AND p >= 0.5)::DOUBLE AS tp, count(*) FILTER (y <> 1 AND p >= 0.5)::DOUBLE AS fp,
  count(*) FILTER (y = 1 AND p < 0.5)::DOUBLE AS fn, count(*) FILTER (y <> 1 AND p < 0.5)::DOUBLE AS tn FROM pred GROUP BY grp)"""
_BINARY = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


@registered(_CELLS + f" SELECT grp, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, {_BINARY} FROM c")
def binary_metrics(spark, sf_dir):
    return _rounded(metrics.binary_metrics(predictions(spark, sf_dir), ["grp"]), "accuracy", "precision", "recall", "f1")


@registered(
    _CELLS + """, k AS (
  SELECT grp, '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS precision, coalesce(tn / nullif(tn + fp, 0), 0) AS recall, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1, tn + fp AS support FROM c
  UNION ALL SELECT grp, '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM c),
u AS (
  SELECT * FROM k
  UNION ALL SELECT grp, 'accuracy', a, a, a, n FROM (SELECT grp, (tp + tn) / (tp + fp + fn + tn) AS a, tp + fp + fn + tn AS n FROM c)
  UNION ALL SELECT grp, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM k GROUP BY grp
  UNION ALL SELECT grp, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM k GROUP BY grp)
SELECT grp, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM u"""
)
def class_report(spark, sf_dir):
    return _rounded(metrics.class_report(predictions(spark, sf_dir), ["grp"]), "precision", "recall", "f1")


@registered(
    f"""{_AP.replace('SELECT grp, round(sum(pos * tp', ', ap AS (SELECT grp, round(sum(pos * tp').replace('FROM c GROUP BY grp', 'FROM c GROUP BY grp)')},
{_CELLS.split(f'WITH {_PRED}, ')[1].replace('c AS', 'cell AS', 1)},
r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2.0::DOUBLE AS rk FROM pred),
g AS (SELECT grp, sum(rk) FILTER (y = 1) AS s, count(*) FILTER (y = 1)::DOUBLE AS n1, count(*) FILTER (y <> 1)::DOUBLE AS n0 FROM r GROUP BY grp)
SELECT grp, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auroc, ap, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, {_BINARY}
FROM g JOIN ap USING (grp) JOIN cell USING (grp)"""
)
def evaluate_runs(spark, sf_dir):
    return _rounded(metrics.evaluate(predictions(spark, sf_dir), ["grp"]), "auroc", "ap", "accuracy", "precision", "recall", "f1")


@registered(
    f"""WITH ev AS ({ORACLES["evaluate_runs"]}), cr AS ({ORACLES["class_report"]}), cm AS ({ORACLES["confusion"]})
SELECT grp, 'metrics' AS section, 'all' AS item, unnest(['auroc', 'ap', 'accuracy', 'precision', 'recall', 'f1']) AS measure, unnest([auroc, ap, accuracy, precision, recall, f1])::DOUBLE AS value FROM ev
UNION ALL SELECT grp, 'classes', class, unnest(['precision', 'recall', 'f1', 'support']), unnest([precision, recall, f1, support]::DOUBLE[]) FROM cr
UNION ALL SELECT grp, 'confusion', y::VARCHAR, unnest(['pred_0', 'pred_1']), unnest([pred_0, pred_1]::DOUBLE[]) FROM cm"""
)
def evaluation_report(spark, sf_dir):
    return _rounded(metrics.evaluation_report(predictions(spark, sf_dir), ["grp"]), "value")


@registered(
    f"""WITH RECURSIVE {views.EVENTS_SQL}, v AS (SELECT user_id, value / 500 AS v, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM ev),
s AS (
  SELECT user_id, 0 AS epoch, 0.0::DOUBLE AS best, 0 AS best_epoch, 0 AS flat FROM (SELECT DISTINCT user_id FROM v)
  UNION ALL
  SELECT s.user_id, epoch + 1, CASE WHEN v > best + 0.001 THEN v ELSE best END, CASE WHEN v > best + 0.001 THEN epoch + 1 ELSE best_epoch END, CASE WHEN v > best + 0.001 THEN 0 ELSE flat + 1 END
  FROM s JOIN v ON v.user_id = s.user_id AND v.n = s.epoch + 1 WHERE flat < 30)
SELECT user_id, CASE WHEN best_epoch > 0 THEN round(best, 6) END AS best, CASE WHEN best_epoch > 0 THEN best_epoch END AS best_epoch, epoch AS stop_epoch, flat >= 30 AS stopped
FROM s QUALIFY epoch = max(epoch) OVER (PARTITION BY user_id)"""
)
def best_epoch(spark, sf_dir):
    log = views.events(spark, sf_dir).withColumn("v", F.col("value") / 500)
    return _rounded(metrics.best_epoch(log, ["user_id"], ["us", "event_id"], "v"), "best")


_RUNS = "runs AS (SELECT o_orderpriority AS method, o_orderstatus AS fill, month(o_orderdate)::INTEGER AS split_seed, o_totalprice / 1000000 AS test_auc, CASE WHEN o_orderkey % 50 > 0 THEN o_totalprice / 900000 END AS val_best_auc FROM orders)"


def runs(spark, sf_dir, also=()):
    d = views.table(spark, sf_dir, "orders")
    val = F.when(F.col("o_orderkey") % 50 > 0, F.col("o_totalprice") / 900_000).otherwise(F.lit(float("nan")))
    return d.select(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("fill"), F.month("o_orderdate").alias("split_seed"), (F.col("o_totalprice") / 1_000_000).alias("test_auc"), val.alias("val_best_auc"), *also)


def _agg(keys: str, n: str) -> str:
    cols = []
    for m in ("val_best_auc", "test_auc"):
        half = f"1.96 * coalesce(stddev_samp({m}), 0) / greatest(1, sqrt(count(*)))"
        cols += [f"round(avg({m}), 4) AS {m}_mean", f"round(coalesce(stddev_samp({m}), 0), 4) AS {m}_std", f"round(avg({m}) - {half}, 4) AS {m}_ci95_lo", f"round(avg({m}) + {half}, 4) AS {m}_ci95_hi"]
    return f"SELECT {keys}, count(*)::BIGINT AS {n}, {', '.join(cols)} FROM runs GROUP BY {keys}"


_METRICS = ["val_best_auc", "test_auc"]


@registered(f"WITH {_RUNS} {_agg('method, fill, split_seed', 'n_segseeds')}")
def runs_segseed_agg(spark, sf_dir):
    return experiments.aggregate_runs(runs(spark, sf_dir), ["method", "fill", "split_seed"], _METRICS, "n_segseeds")


@registered(f"WITH {_RUNS} {_agg('method, fill', 'n_runs')}")
def runs_overall_agg(spark, sf_dir):
    return experiments.aggregate_runs(runs(spark, sf_dir), ["method", "fill"], _METRICS, "n_runs")


@registered(
    f"WITH {_RUNS}, a AS ({_agg('method, fill, split_seed', 'n_runs')}), b AS ({_agg('method, fill', 'n_runs')}) SELECT 0 AS rolled_up, * FROM a UNION ALL BY NAME SELECT 1 AS rolled_up, * FROM b"
)
def runs_two_level(spark, sf_dir):
    return experiments.two_level_aggregates(runs(spark, sf_dir), ["method", "fill"], "split_seed", _METRICS)


@registered(
    f"""WITH {_RUNS}, a AS ({_agg('method, fill, split_seed', 'n_segseeds')}), b AS ({_agg('method, fill', 'n_runs')})
SELECT 'segseed' AS summary_type, * FROM a UNION ALL BY NAME SELECT 'overall' AS summary_type, * FROM b
UNION ALL BY NAME SELECT 'per_run' AS summary_type, method, fill, split_seed, round(test_auc, 4) AS test_auc, round(val_best_auc, 4) AS val_best_auc FROM runs"""
)
def runs_summary_union(spark, sf_dir):
    r = runs(spark, sf_dir)
    per_run = r.withColumn("test_auc", F.round("test_auc", 4)).withColumn("val_best_auc", F.round(F.when(~F.isnan("val_best_auc"), F.col("val_best_auc")), 4))
    split = experiments.aggregate_runs(r, ["method", "fill", "split_seed"], _METRICS, "n_segseeds")
    return experiments.summary(per_run, split, experiments.aggregate_runs(r, ["method", "fill"], _METRICS, "n_runs"))


_WIDTH = 64
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x, 8 * embedding[9]::DOUBLE AS score FROM embeddings)"
_POOL = ", w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY label)) AS e FROM {src}), z AS (SELECT *, e / sum(e) OVER (PARTITION BY label) AS wt FROM w)\nSELECT label, pos::INTEGER AS pos, round(sum(wt * x[pos + 1]), 6) AS pooled FROM z, range(0, 64) t(pos) GROUP BY label, pos"


def instances(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return views.table(spark, sf_dir, "embeddings").select("vec_id", "label", x.alias("x"), (8 * F.col("embedding")[8].cast("double")).alias("score"))


@registered(f"WITH {_V}{_POOL.format(src='v')}")
def attention_pool(spark, sf_dir):
    return _rounded(bags.attention_pool(instances(spark, sf_dir), ["label"], "score", "x"), "pooled")


@registered(f"WITH {_V}, w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY label)) AS e FROM v) SELECT vec_id, label, round(e / sum(e) OVER (PARTITION BY label), 9) AS weight FROM w")
def attention_weights(spark, sf_dir):
    """The weights behind attention_pool."""
    d = bags.softmax_weights(instances(spark, sf_dir), ["label"], "score")
    return d.select("vec_id", "label", F.round("weight", 9).alias("weight"))


#: Given weights of the gated score: two hidden units.
_A = [[math.sin(i + 1) for i in range(_WIDTH)], [math.cos(2 * i) for i in range(_WIDTH)]]
_B = [[math.cos(i + 1) for i in range(_WIDTH)], [math.sin(3 * i) for i in range(_WIDTH)]]
_A_BIAS, _B_BIAS, _GATE = [0.1, -0.2], [0.05, 0.3], [4.0, -3.0]


def _gated_sql(x: str = "x") -> str:
    lit = lambda row: "[" + ", ".join(f"{v!r}::DOUBLE" for v in row) + "]"
    terms = [f"{g!r}::DOUBLE * tanh(list_inner_product({x}, {lit(a)}) + {ab!r}::DOUBLE) * (1 / (1 + exp(-(list_inner_product({x}, {lit(b)}) + {bb!r}::DOUBLE))))" for g, a, ab, b, bb in zip(_GATE, _A, _A_BIAS, _B, _B_BIAS, strict=True)]
    return " + ".join(terms)


def _gated(d):
    return d.withColumn("score", bags.gated_score(F.col("x"), _A, _A_BIAS, _B, _B_BIAS, _GATE))


@registered(f"WITH {_V}, g AS (SELECT vec_id, label, x, {_gated_sql()} AS score FROM v){_POOL.format(src='g')}")
def gated_pool(spark, sf_dir):
    return _rounded(bags.attention_pool(_gated(instances(spark, sf_dir)), ["label"], "score", "x"), "pooled")


@registered(f"WITH {_V}, k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 5) SELECT label, pos::INTEGER AS pos, round(avg(x[pos + 1]), 6) AS pooled FROM k, range(0, 64) t(pos) GROUP BY label, pos")
def topk_pool(spark, sf_dir):
    return _rounded(bags.topk_mean_pool(instances(spark, sf_dir), ["label"], "score", "vec_id", "x"), "pooled")


def _code_sql() -> str:
    parts = [f"x[{i + 1}] + 0.1::DOUBLE * {'cos' if i % 2 else 'sin'}(bp * {math.exp(-math.log(10000.0) * (i - i % 2) / _WIDTH)!r}::DOUBLE)" for i in range(_WIDTH)]
    return "[" + ", ".join(parts) + "]"


@registered(
    f"""WITH {_V}, b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS bp FROM v), c AS (SELECT vec_id, label, {_code_sql()} AS x FROM b),
h AS (SELECT vec_id, label, x, {_gated_sql()} AS score FROM c), g AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 10){_POOL.format(src='g')}"""
)
def time_pool(spark, sf_dir):
    d = numbered(instances(spark, sf_dir), ["label"], ["vec_id"], "no").withColumn("bp", F.col("no") - 1)
    d = _gated(bags.with_position(d, "bp", "x", _WIDTH, 0.1))
    return _rounded(bags.attention_pool(bags.top_instances(d, ["label"], "score", "vec_id", 10), ["label"], "score", "x"), "pooled")


@registered(
    """SELECT vec_id, i::INTEGER AS patch, round(list_sum(list_transform(embedding[i * 10 + 1:i * 10 + 10], lambda x: x::DOUBLE)), 6) AS total, 10 AS width FROM embeddings, range(0, 7) t(i)"""
)
def patchify(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    d = views.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(arrays.patches(x, 10)).alias("patch", "p"))
    return d.select("vec_id", "patch", F.round(arrays.total(F.col("p")), 6).alias("total"), F.size("p").alias("width"))


@registered("SELECT vec_id, 80 AS long_width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS long_total, 50 AS short_width, round(list_sum(list_transform(embedding[1:50], lambda x: x::DOUBLE)), 6) AS short_total FROM embeddings")
def pad_crop(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    d = views.table(spark, sf_dir, "embeddings").select("vec_id", arrays.pad_or_crop(x, 80).alias("a"), arrays.pad_or_crop(x, 50).alias("b"))
    return d.select("vec_id", F.size("a").alias("long_width"), F.round(arrays.total(F.col("a")), 6).alias("long_total"), F.size("b").alias("short_width"), F.round(arrays.total(F.col("b")), 6).alias("short_total"))


@registered("SELECT vec_id, pos::INTEGER AS pos, round(CASE WHEN pos < 64 THEN embedding[pos + 1]::DOUBLE WHEN pos = 64 THEN label::DOUBLE ELSE 1 END, 6) AS value FROM embeddings, range(0, 66) t(pos)")
def feature_concat(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    d = views.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(bags.joined_features(x, F.array(F.col("label").cast("double"), F.lit(1.0)))).alias("pos", "value"))
    return _rounded(d, "value")


@registered("SELECT vec_id, pos::INTEGER AS pos, CASE WHEN l < 0 THEN 0 ELSE round(list_sum(list_transform(embedding[l * 16 + 1:l * 16 + 16], lambda x: x::DOUBLE)), 6) END AS total FROM embeddings, (VALUES (0, 2), (1, -1), (2, 0)) t(pos, l)")
def lead_select(spark, sf_dir):
    m = arrays.matrix(F.transform("embedding", lambda v: v.cast("double")), 4, 16)
    names = F.array(*map(F.lit, ("V5", "V1", "II", "aVR")))
    d = views.table(spark, sf_dir, "embeddings").select("vec_id", F.map_from_arrays(names, m).alias("by_lead"))
    d = d.select("vec_id", F.posexplode(bags.select_leads(F.col("by_lead"), ["II", "V6", "V5"], 20)).alias("pos", "s"))
    return d.select("vec_id", "pos", F.round(arrays.total(F.col("s")), 6).alias("total"))


@registered("SELECT vec_id, c::INTEGER AS channel, i::INTEGER AS sample, round(embedding[16 * i + c + 1]::DOUBLE, 6) AS value FROM embeddings, range(0, 16) t(c), range(0, 4) u(i)")
def layout_transpose(spark, sf_dir):
    rows = arrays.matrix(F.transform("embedding", lambda v: v.cast("double")), 4, 16)  # 4 samples of 16 channels
    symbols = F.array(F.lit("S").cast("binary"))
    d = bags.variant_layout(views.table(spark, sf_dir, "embeddings").select("vec_id", rows.alias("sig"), symbols.alias("symbol")), "sig", "symbol", 4)
    d = d.where(F.array_contains("symbol", "S")).select("vec_id", F.posexplode("sig").alias("channel", "s"))
    return _rounded(d.select("vec_id", "channel", F.posexplode("s").alias("sample", "value")), "value")


@registered(None)
def weighted_logreg(spark, sf_dir):
    d = views.table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    return _rounded(ml.weighted_logistic(d, ["vec_id"], "y", "embedding"), "p", digits=4)


_PARTS, _NEWTON = 4, 12


def _newton_sql() -> str:
    """Newton steps of all runs as a recursive query; the small systems by elimination."""
    n = _PARTS + 1
    h = lambda i, j: f"sum(w * p * (1 - p) * x[{i}] * x[{j}]) / any_value(ws)" + (" + 0.01" if i == j > 1 else "")
    rhs = lambda i: f"sum(w * (y - p) * x[{i}]) / any_value(ws)" + (f" - 0.01 * any_value(b)[{i}]" if i > 1 else "")
    rows = ", ".join("[" + ", ".join([*(h(i, j) for j in range(1, n + 1)), rhs(i)]) + "]" for i in range(1, n + 1))
    solved = f"SELECT run, step, b, [{rows}] AS m0 FROM (SELECT r.run, r.step, r.b, d.x, d.y, d.w, d.ws, 1 / (1 + exp(-list_inner_product(r.b, d.x))) AS p FROM r JOIN d ON r.run = d.run WHERE r.step < {_NEWTON}) GROUP BY run, step, b"
    for k in range(1, n + 1):
        m = f"m{k - 1}"
        solved = f"SELECT run, step, b, list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 2}), lambda j: CASE WHEN i = {k} THEN {m}[i][j] / {m}[{k}][{k}] ELSE {m}[i][j] - {m}[i][{k}] / {m}[{k}][{k}] * {m}[{k}][j] END)) AS m{k} FROM ({solved})"
    parts = ", ".join(f"list_sum(list_transform(embedding[{16 * i + 1}:{16 * i + 16}], lambda v: v::DOUBLE))" for i in range(_PARTS))
    mean = ", ".join(f"sum(w * x[{i}]) / sum(w) AS m{i}" for i in range(1, _PARTS + 1))
    spread = ", ".join(f"sqrt(sum(w * (x[{i}] - m{i}) ** 2) / (any_value(ws) - any_value(ws2) / any_value(ws))) AS s{i}" for i in range(1, _PARTS + 1))
    scaled = ", ".join(f"x[{i}] / s{i}" for i in range(1, _PARTS + 1))
    return f"""WITH RECURSIVE f AS (SELECT vec_id, (vec_id % 3)::INTEGER AS run, (label < 5)::INTEGER AS y, [{parts}] AS x FROM embeddings),
c AS (SELECT run, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM f GROUP BY run),
w AS (SELECT f.*, CASE WHEN y = 0 THEN 1.0 WHEN pos > 0 AND neg > 0 THEN least(neg::DOUBLE / pos, 20) ELSE 15 END::DOUBLE AS w FROM f JOIN c USING (run)),
m AS (SELECT run, sum(w) AS ws, sum(w * w) AS ws2, {mean} FROM w GROUP BY run),
s AS (SELECT run, {spread} FROM w JOIN m USING (run) GROUP BY run),
d AS (SELECT vec_id, run, y, w, ws, [1.0::DOUBLE, {scaled}] AS x FROM w JOIN m USING (run) JOIN s USING (run)),
r AS (
  SELECT run, 0 AS step, {[0.0] * n}::DOUBLE[] AS b FROM c
  UNION ALL
  SELECT run, step + 1, list_transform(range(1, {n + 1}), lambda i: b[i] + m{n}[i][{n + 1}]) FROM ({solved}))
SELECT d.run, vec_id, y, round(1 / (1 + exp(-list_inner_product(b, x))), 4) AS p FROM d JOIN r ON r.run = d.run AND step = {_NEWTON}"""


@registered(_newton_sql())
def weighted_logreg_runs(spark, sf_dir):
    """Three runs at once, on vectors pooled to four numbers."""
    total = lambda i: arrays.total(F.slice("embedding", 16 * i + 1, 16))
    d = views.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 3).cast("int").alias("run"), (F.col("label") < 5).cast("int").alias("y"), F.array(*(total(i) for i in range(_PARTS))).alias("x"))
    return _rounded(ml.weighted_logistic(d, ["vec_id"], "y", "x", runs=["run"]), "p", digits=4)
