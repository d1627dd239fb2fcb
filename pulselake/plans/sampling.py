"""Segments, S-first sampling and its grids over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, stable
from ..operators import bags, experiments, sampling, segments
from . import views

QUERIES, ORACLES = {}, {}


def registered(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.flags_of_beats(views.beats(spark, sf_dir))


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of segments from outside: purchases' values, the smallest unreadable."""
    e = views.events(spark, sf_dir).where("event_type = 'purchase'")
    score = F.when(F.col("value") < 5, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return e.select(F.col("user_id").alias("record_id"), (F.col("us") / (views.HOUR_US / 10)).cast("string").alias("time"), score.alias("score"))


SCORES_SQL = f"""raw_scores AS (
  SELECT user_id AS record_id, us / {views.HOUR_US / 10} AS time,
         CASE WHEN value < 5 THEN NULL ELSE value END AS score
  FROM ev WHERE event_type = 'purchase'),
scores AS (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, time, seg_index) AS score_rank
  FROM (SELECT record_id, floor(time / 10)::INTEGER AS seg_index, time, score
        FROM raw_scores WHERE score IS NOT NULL AND time >= 0
        QUALIFY row_number() OVER (PARTITION BY record_id, floor(time / 10) ORDER BY score DESC, time) = 1)),
listed AS (SELECT DISTINCT record_id, floor(time / 10)::INTEGER AS seg_index FROM raw_scores WHERE time >= 0)"""


@registered(f"WITH {views.EVENTS_SQL} SELECT event_id, user_id AS record_id, floor(us / 3600000000)::INTEGER AS seg_index, (us - floor(us / 3600000000)::BIGINT * 3600000000)::BIGINT AS \"offset\" FROM ev")
def segment_assignment(spark, sf_dir):
    d = segments.assign_segments(views.events(spark, sf_dir), views.HOUR_US, "us")
    return d.select("event_id", F.col("user_id").alias("record_id"), "seg_index", "offset")


@registered(
    f"""WITH {views.BEATS_SQL}, len AS (SELECT record_id, max(us) AS n FROM beats GROUP BY 1)
SELECT record_id, seg_index, count(*)::BIGINT AS n_beats, min(us - seg_index::BIGINT * 3600000000)::BIGINT AS first_offset
FROM beats JOIN len USING (record_id) WHERE seg_index < floor(n / 3600000000) GROUP BY ALL"""
)
def segment_rebase(spark, sf_dir):
    b = views.beats(spark, sf_dir)
    length = b.groupBy("record_id").agg(F.max("us").alias("n"))
    d = segments.assign_segments(b, views.HOUR_US, "us").join(length, "record_id")
    d = segments.whole_segments(d, F.col("n"), views.HOUR_US)
    return d.groupBy("record_id", "seg_index").agg(F.count(F.lit(1)).alias("n_beats"), F.min("offset").alias("first_offset"))


@registered(f"WITH {views.BEATS_SQL} SELECT * FROM flags")
def s_segment_flags(spark, sf_dir):
    b = views.beats(spark, sf_dir)
    return segments.segment_flags(b.select("record_id", "seg_index").distinct(), b)


@registered(f"WITH {views.BEATS_SQL} SELECT record_id, count(*)::BIGINT AS n_segments, count(*) FILTER (is_s)::BIGINT AS n_s FROM flags GROUP BY 1 HAVING count(*) FILTER (is_s) >= 10")
def eligible_records(spark, sf_dir):
    return segments.eligible_records(flags(spark, sf_dir), 10)


@registered(
    f"""WITH {views.BEATS_SQL}
SELECT DISTINCT n.record_id, n.seg_index FROM flags n JOIN flags s ON n.record_id = s.record_id AND s.is_s
  AND abs(n.seg_index - s.seg_index) <= 2 WHERE NOT n.is_s"""
)
def neighbor_expand(spark, sf_dir):
    return segments.neighbours(flags(spark, sf_dir), 2)


@registered("SELECT doc_id, ('0x' || substr(sha256(concat_ws('||', '2024', '42', doc_id::VARCHAR, 's_first')), 1, 8))::BIGINT AS seed FROM documents")
def stable_seed(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", stable.stable_seed(F.lit(2024), F.lit(42), F.col("doc_id"), F.lit("s_first")).alias("seed"))


def sample_sql(configs: list[tuple[int, int, int, str]], ups: str = "SELECT record_id, 0 AS upsample_index FROM (SELECT DISTINCT record_id FROM flags)") -> str:
    grid = ", ".join(f"({c}, {k}, {r}, '{f}')" for c, k, r, f in configs)
    h32 = "('0x' || substr(sha256(concat_ws('|', {}::VARCHAR, 'd', {}::VARCHAR, {}::VARCHAR)), 1, 8))::BIGINT"
    bag = "config_id, record_id, upsample_index"
    return f"""
WITH {views.BEATS_SQL}, {SCORES_SQL},
grid(config_id, k, radius, fill) AS (VALUES {grid}),
ups AS ({ups}),
e AS (SELECT * FROM (SELECT *, count(*) FILTER (is_s) OVER (PARTITION BY record_id) AS n_s, count(*) OVER (PARTITION BY record_id) AS n_all FROM flags) WHERE n_s >= 2),
g AS (SELECT record_id, seg_index, (SELECT min(abs(s.seg_index - e.seg_index)) FROM flags s WHERE s.record_id = e.record_id AND s.is_s) AS gap FROM e),
d AS (
  SELECT config_id, record_id, upsample_index, k, fill, seg_index, is_s, n_s, n_all, score_rank,
         CASE fill WHEN 'slike' THEN score_rank IS NOT NULL WHEN 'slike_random' THEN (record_id, seg_index) IN (SELECT (record_id, seg_index) FROM listed) ELSE false END AS ext,
         NOT is_s AND gap <= radius AS near,
         ('0x' || substr(sha256(concat_ws('||', '2024', '42', record_id::VARCHAR, 's_first', radius::VARCHAR, k::VARCHAR, fill, upsample_index::VARCHAR)), 1, 8))::BIGINT AS seed
  FROM e JOIN g USING (record_id, seg_index) LEFT JOIN scores USING (record_id, seg_index) JOIN ups USING (record_id) CROSS JOIN grid),
n AS (
  SELECT *, greatest(0, k - n_s - n_near) AS need
  FROM (SELECT *, count(*) FILTER (near) OVER w AS n_near, count(*) FILTER (ext) OVER w AS n_ext FROM d WINDOW w AS (PARTITION BY {bag}))),
st AS (
  SELECT *, CASE WHEN is_s THEN 0 WHEN n_s >= k THEN NULL WHEN near THEN 1 WHEN fill = 'normal' THEN 2 WHEN fill = 'half' THEN 3
                 WHEN ext THEN 2 WHEN fill LIKE 'slike%' THEN 3 END AS stage
  FROM n),
o AS (
  SELECT *, CASE WHEN stage = 0 AND n_s < k OR stage = 3 AND fill <> 'half' THEN lpad(seg_index::VARCHAR, 12, '0')
                 WHEN stage = 2 AND fill = 'slike' THEN lpad(score_rank::VARCHAR, 12, '0')
                 ELSE sha256(concat_ws('|', seed::VARCHAR, CASE stage WHEN 0 THEN 's' WHEN 1 THEN 'n' ELSE 'f' END, seg_index::VARCHAR)) END AS ord
  FROM st WHERE stage IS NOT NULL),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {bag}, stage ORDER BY ord) AS nth FROM o)
  WHERE fill <> 'half' OR stage <> 3 OR nth <= need // 2),
b AS (SELECT DISTINCT {bag}, k, fill, seed, need, n_s, n_all, n_near, n_ext FROM n WHERE n_s < k AND need > 0),
t AS (
  SELECT *, 2 AS stage, 'S' AS pool, CASE WHEN fill = 'duplicate' THEN need ELSE need - need // 2 END AS times, n_s AS size FROM b WHERE fill IN ('duplicate', 'half')
  UNION ALL
  SELECT *, 4, CASE WHEN n_all > n_s THEN 'N' ELSE 'A' END, greatest(0, need // 2 - (n_all - n_s - n_near)), CASE WHEN n_all > n_s THEN n_all - n_s ELSE n_all END FROM b WHERE fill = 'half'
  UNION ALL
  SELECT *, 4, CASE WHEN n_all > n_s THEN 'N' ELSE 'A' END, greatest(0, k - n_all), CASE WHEN n_all > n_s THEN n_all - n_s ELSE n_all END FROM b WHERE fill = 'normal'
  UNION ALL
  SELECT *, 4, CASE WHEN n_ext > 0 THEN 'E' ELSE 'A' END, greatest(0, k - n_all), CASE WHEN n_ext > 0 THEN n_ext ELSE n_all END FROM b WHERE fill LIKE 'slike%'),
j AS (SELECT *, unnest(range(1, times + 1)) AS j FROM t WHERE times > 0),
w AS (SELECT *, {h32.format('seed', 'stage', 'j')} % size AS pos FROM j),
m AS (
  SELECT {bag}, 'A' AS pool, seg_index, row_number() OVER (PARTITION BY {bag} ORDER BY seg_index) - 1 AS pos FROM n
  UNION ALL SELECT {bag}, CASE WHEN is_s THEN 'S' ELSE 'N' END, seg_index, row_number() OVER (PARTITION BY {bag}, is_s ORDER BY seg_index) - 1 FROM n
  UNION ALL SELECT {bag}, 'E', seg_index, row_number() OVER (PARTITION BY {bag} ORDER BY seg_index) - 1 FROM n WHERE ext),
u AS (
  SELECT {bag}, k, stage, ord, seg_index FROM p
  UNION ALL SELECT {bag}, k, stage, lpad(j::VARCHAR, 12, '0'), seg_index FROM w JOIN m USING (config_id, record_id, upsample_index, pool, pos)),
bags AS (
  SELECT {bag}, row_number() OVER (PARTITION BY {bag} ORDER BY stage, ord, seg_index)::INTEGER AS bag_pos, seg_index, stage, k FROM u
  QUALIFY bag_pos <= k)
"""


def _configs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    structs = [F.struct(*(F.lit(v).cast(t).alias(n) for v, n, t in zip(row, ("config_id", "k", "radius", "fill"), ("int", "int", "int", "string"), strict=True))) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def _sampler(fill: str):
    rows = [(0, 10, 1, fill), (1, 20, 1, fill), (2, 100, 2, fill)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scores = sampling.external_segments(score_rows(spark, sf_dir))
        return sampling.sample_bags(flags(spark, sf_dir), _configs(spark, rows), scores)

    QUERIES[f"sample_{fill}"] = query
    ORACLES[f"sample_{fill}"] = sample_sql(rows) + "SELECT config_id, record_id, upsample_index, bag_pos, seg_index, stage FROM bags"


for _fill in sampling.FILLS:
    _sampler(_fill)

_GRID = [(0, 20, 1, "normal"), (1, 60, 0, "HALF"), (2, 60, 2, "slike"), (3, 20, 0, None)]
_GRID_SQL = [(0, 20, 1, "normal"), (1, 60, 0, "half"), (2, 60, 2, "slike"), (3, 20, 0, "normal")]


def _grid(spark, sf_dir):
    """All settings in one plan, positive records three times."""
    f = flags(spark, sf_dir)
    records = f.select("record_id").distinct().withColumn("label", (F.col("record_id") % 3 == 0).cast("int"))
    ups = sampling.upsampled(records, "label", 3).select("record_id", "upsample_index")
    return f, _configs(spark, _GRID), sampling.external_segments(score_rows(spark, sf_dir)), ups


_UPS_SQL = "SELECT record_id, unnest(CASE WHEN record_id % 3 = 0 THEN [0, 1, 2] ELSE [0] END) AS upsample_index FROM (SELECT DISTINCT record_id FROM flags)"


@registered(sample_sql(_GRID_SQL, _UPS_SQL) + "SELECT config_id, record_id, upsample_index, bag_pos, seg_index, stage FROM bags")
def sample_grid(spark, sf_dir):
    return sampling.sample_bags(*_grid(spark, sf_dir))


@registered(sample_sql(_GRID_SQL, _UPS_SQL) + "SELECT config_id, record_id, upsample_index, string_agg(seg_index::VARCHAR, '|' ORDER BY bag_pos) AS keys FROM bags GROUP BY ALL")
def bag_sequence(spark, sf_dir):
    bags = sampling.bag_sequences(sampling.bags(*_grid(spark, sf_dir)))
    keys = F.concat_ws("|", F.transform("selected", lambda x: x.cast("string")))
    return bags.select("config_id", "record_id", "upsample_index", keys.alias("keys")).orderBy("record_id", "keys")


@registered(
    sample_sql([(0, 20, 1, "normal")]) + """
SELECT count(*)::BIGINT AS n_bags, coalesce(bool_and(n = 20), false) AS valid FROM (SELECT config_id, record_id, upsample_index, count(*) AS n FROM bags GROUP BY ALL)"""
)
def cache_validate(spark, sf_dir):
    bags = sampling.bags(flags(spark, sf_dir), _configs(spark, [(0, 20, 1, "normal")]))
    cache = sampling.bag_sequences(bags).withColumnRenamed("selected", "selected_keys").withColumn("fill", F.lit("normal"))
    return sampling.cache_is_valid(cache, {"fill": "normal", "config_id": 0}, 20)


@registered(f"WITH {views.EVENTS_SQL}, {SCORES_SQL} SELECT record_id, seg_index, score, score_rank::INTEGER AS score_rank FROM scores")
def score_rank_dedup(spark, sf_dir):
    return sampling.best_scores(score_rows(spark, sf_dir))


@registered(f"WITH {views.EVENTS_SQL}, {SCORES_SQL} SELECT DISTINCT record_id, floor(time / 10)::INTEGER AS seg_index FROM raw_scores WHERE time >= 0")
def score_unique_index(spark, sf_dir):
    return sampling.unique_indices(score_rows(spark, sf_dir))


@registered("SELECT doc_id, toxic, unnest(CASE WHEN toxic = 1 THEN [0, 1, 2, 3, 4] ELSE [0] END) AS upsample_index FROM labels")
def upsample_positive(spark, sf_dir):
    return sampling.upsampled(views.table(spark, sf_dir, "labels"), "toxic", 5).select("doc_id", "toxic", "upsample_index")


_HOUR_SQL = """hours AS (SELECT record_id, seg_index, symbol, list(amp ORDER BY us, event_id) AS samples FROM beats GROUP BY ALL)"""


@registered(
    sample_sql([(0, 20, 1, "normal")])
    + f""", {_HOUR_SQL},
chan AS (SELECT config_id, record_id, upsample_index, bag_pos, seg_index, unnest(['view', 'click', 'purchase']) AS lead, unnest([0, 1, 2]) AS channel FROM bags),
there AS (SELECT DISTINCT record_id, seg_index FROM hours WHERE symbol IN ('view', 'click', 'purchase'))
SELECT config_id, record_id, upsample_index, (row_number() OVER (PARTITION BY config_id, record_id, upsample_index, channel ORDER BY bag_pos) - 1)::INTEGER AS pos, channel,
  round(coalesce(samples[1], 0), 6) AS first, round(coalesce(list_sum(samples[1:4]), 0), 6) AS total
FROM chan JOIN there USING (record_id, seg_index) LEFT JOIN hours h ON h.record_id = chan.record_id AND h.seg_index = chan.seg_index AND h.symbol = chan.lead"""
)
def bag_tensor(spark, sf_dir):
    """Each bag as K x leads x samples: an hour's events of three types are its leads."""
    b = views.beats(spark, sf_dir)
    rows = F.sort_array(F.collect_list(F.struct("us", "event_id", "amp")))
    hours = b.groupBy("record_id", "seg_index", F.col("symbol").alias("lead")).agg(F.transform(rows, lambda r: r["amp"]).alias("samples"))
    chosen = sampling.sample_bags(segments.flags_of_beats(b), _configs(spark, [(0, 20, 1, "normal")]))
    d = bags.bag_tensor(chosen, hours, list(sampling.BAG), ["view", "click", "purchase"], 4)
    d = d.select(*sampling.BAG, F.posexplode("tensor").alias("pos", "channels")).select(*sampling.BAG, "pos", F.posexplode("channels").alias("channel", "x"))
    return d.select(*sampling.BAG, "pos", "channel", F.round(F.col("x")[0], 6).alias("first"), F.round(arrays.total(F.col("x")), 6).alias("total"))


@registered(
    f"""WITH {views.BEATS_SQL}, w AS (SELECT *, exp(amp / 100 - max(amp / 100) OVER (PARTITION BY record_id, seg_index)) AS e FROM beats)
SELECT record_id, seg_index, unnest([0, 1])::INTEGER AS pos, round(unnest([sum(e * amp) / sum(e), sum(e * (us % 3600000000) / 3600000000.0::DOUBLE) / sum(e)]), 6) AS pooled FROM w GROUP BY record_id, seg_index"""
)
def segment_pool(spark, sf_dir):
    """Attention over the positions inside a segment: larger amplitudes weigh more."""
    d = views.beats(spark, sf_dir).withColumn("score", F.col("amp") / 100)
    d = d.withColumn("x", F.array("amp", (F.col("us") % views.HOUR_US) / views.HOUR_US))
    return bags.attention_pool(d, ["record_id", "seg_index"], "score", "x").withColumn("pooled", F.round("pooled", 6))


@registered("SELECT label, vec_id, 's_first_R' || label || '_K20_Fhalf_SS42' || CASE WHEN vec_id % 3 > 1 THEN '_UP' || vec_id % 3 ELSE '' END AS tag FROM embeddings")
def config_tags(spark, sf_dir):
    d = views.table(spark, sf_dir, "embeddings")
    tag = sampling.config_tag(F.lit("s_first"), F.col("label"), F.lit(20), F.lit("half"), F.lit(42), F.col("vec_id") % 3)
    return d.select("label", "vec_id", tag.alias("tag"))


_GRID60 = """
k(k, ko) AS (VALUES (20, 0), (60, 1), (100, 2), (140, 3), (180, 4)), r(radius, ro) AS (VALUES (0, 0), (1, 1), (2, 2)),
f(fill, fo) AS (VALUES ('normal', 0), ('duplicate', 1), ('half', 2), ('slike', 3)),
grid AS (SELECT (row_number() OVER (ORDER BY ko, ro, fo) - 1)::INTEGER AS config_id, k, radius, fill FROM k, r, f)"""


def _observed_priorities(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_records"))


@registered(
    f"WITH {_GRID60} SELECT o_orderpriority, o_orderstatus, n_records, config_id, k, radius, fill FROM (SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n_records FROM orders GROUP BY ALL), grid"
)
def config_grid(spark, sf_dir):
    """Every sampling setting for every group of records that the orders hold."""
    return _observed_priorities(spark, sf_dir).crossJoin(F.broadcast(experiments.sampling_grid(spark)))


@registered(
    f"""WITH {_GRID60}, u(upsample_factor) AS (VALUES (1), (5), (10)), s AS (SELECT DISTINCT month(o_orderdate)::INTEGER AS split_seed FROM orders), m(model) AS (VALUES ('cnn'), ('resnet'), ('inception'))
SELECT config_id, k, radius, fill, upsample_factor, 42 AS seg_seed, split_seed, model FROM grid, u, s, m"""
)
def experiment_grid(spark, sf_dir):
    seeds = views.table(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("split_seed")).distinct()
    return experiments.experiment_grid(experiments.sampling_grid(spark), [1, 5, 10], [42], seeds, ["cnn", "resnet", "inception"])
