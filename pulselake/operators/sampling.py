"""S-first bags of K segments, for all settings in one plan.

A bag is ``(config_id, record_id, upsample_index)``.  A record's segments meet once, as an array
of its own (a day has 8640), and each setting makes its bag from that array:

    0  S segments (in hash order if there are K or more, else by index)
    1  other segments within the radius of an S segment, in hash order
    2  what the fill policy adds; 3 for score-led fills the rest by index
    4  draws with replacement from the policy's pool

All of it is one shuffle by record, however many settings there are.  Every order and draw comes
from the bag's stable seed, so bags are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.ranges import numbered
from ..functions.stable import hash32, hash_order, stable_seed

FILLS = ("normal", "duplicate", "half", "slike", "slike_random")
BAG = ("config_id", "record_id", "upsample_index")
BASE_SEED, SEGMENT_SEED = 2024, 42


def fill_policy(fill: Column) -> Column:
    """Lower case; null or unknown is ``normal``."""
    name = F.lower(F.coalesce(fill, F.lit("")))
    return F.when(name.isin(*FILLS), name).otherwise(F.lit("normal"))


def upsampled(records: DataFrame, label: str, factor: Column | int) -> DataFrame:
    """Positive records ``factor`` times, with index 0 to factor - 1; the others once."""
    times = factor if isinstance(factor, Column) else F.lit(factor)
    index = F.when(F.col(label) == 1, F.sequence(F.lit(0), times - 1)).otherwise(F.array(F.lit(0)))
    return records.withColumn("upsample_index", F.explode(index))


def best_scores(scores: DataFrame, seconds: int = 10) -> DataFrame:
    """``record_id, seg_index, score, score_rank``: the best row of each segment, ranked by score.

    Times and scores that are no numbers, and negative times, are dropped; ties go to the
    earlier time, then the smaller index."""
    clean = scores.select("record_id", F.expr("try_cast(time as double)").alias("time"), F.expr("try_cast(score as double)").alias("score"))
    clean = clean.dropna().where("time >= 0").withColumn("seg_index", F.floor(F.col("time") / seconds).cast("int"))
    best = F.max(F.struct("score", (-F.col("time")).alias("before"))).alias("best")
    kept = clean.groupBy("record_id", "seg_index").agg(best).select("record_id", "seg_index", "best.score", (-F.col("best.before")).alias("time"))
    ranked = numbered(kept, ["record_id"], [F.desc("score"), "time", "seg_index"], "score_rank")
    return ranked.select("record_id", "seg_index", "score", F.col("score_rank").cast("int").alias("score_rank"))


def unique_indices(scores: DataFrame, seconds: int = 10) -> DataFrame:
    """Distinct segments of the score times."""
    clean = scores.select("record_id", F.expr("try_cast(time as double)").alias("time")).dropna().where("time >= 0")
    return clean.select("record_id", F.floor(F.col("time") / seconds).cast("int").alias("seg_index")).distinct()


def external_segments(scores: DataFrame, seconds: int = 10) -> DataFrame:
    """``record_id, seg_index, score_rank``: all segments that the score times name, ranked where
    a score is a number."""
    ranked = best_scores(scores, seconds).select("record_id", "seg_index", "score_rank")
    return unique_indices(scores, seconds).join(ranked, ["record_id", "seg_index"], "left")


def sample_bags(flags: DataFrame, configs: DataFrame, scores: DataFrame | None = None, upsample: DataFrame | None = None, method: str = "s_first", least_s: int = 2) -> DataFrame:
    """``config_id, record_id, upsample_index, bag_pos, seg_index, stage``: :func:`bags`, a row for
    each segment of a bag."""
    d = bags(flags, configs, scores, upsample, method, least_s).select(*BAG, F.posexplode("bag").alias("pos", "x"))
    return d.select(*BAG, (F.col("pos") + 1).alias("bag_pos"), F.col("x.seg_index").alias("seg_index"), F.col("x.stage").alias("stage"))


def bags(flags: DataFrame, configs: DataFrame, scores: DataFrame | None = None, upsample: DataFrame | None = None, method: str = "s_first", least_s: int = 2) -> DataFrame:
    """``config_id, record_id, upsample_index, bag`` for every config, the bag an array of segments
    with their stages.

    ``configs`` has ``config_id, k, radius, fill``; ``scores`` the output of
    :func:`external_segments`; ``upsample`` has ``record_id, upsample_index``.  Records with fewer
    than ``least_s`` S segments go before the grid multiplies anything."""
    if scores is not None:
        listed = scores.select("record_id", "seg_index", F.col("score_rank").alias("rank"), F.lit(True).alias("listed"))
        flags = flags.join(listed, ["record_id", "seg_index"], "left")
    else:
        flags = flags.withColumn("rank", F.lit(None).cast("int")).withColumn("listed", F.lit(None).cast("boolean"))
    d = _record_arrays(flags).where(F.col("n_s") >= least_s)
    d = d.join(upsample, "record_id") if upsample is not None else d.withColumn("upsample_index", F.lit(0))
    grid = configs.select("config_id", "k", "radius", fill_policy(F.col("fill")).alias("fill"))
    d = d.crossJoin(F.broadcast(grid))  # a few dozen settings
    seed = stable_seed(F.lit(BASE_SEED), F.lit(SEGMENT_SEED), F.col("record_id"), F.lit(method), F.col("radius"), F.col("k"), F.col("fill"), F.col("upsample_index"))
    d = d.withColumn("seed", seed).withColumn("rest", F.filter("others", lambda x: x["gap"] > F.col("radius")))
    d = d.withColumn("need", F.greatest(F.lit(0), F.col("k") - F.size("segs") + F.size("rest")))
    return d.select(*BAG, F.slice(_bag(), 1, F.col("k")).alias("bag"))


def _record_arrays(flags: DataFrame) -> DataFrame:
    """``record_id, n_s, segs, others``: each record's segments in order, with the gap to the nearest
    S, and those that are no S segment."""
    by_index = Window.partitionBy("record_id").orderBy("seg_index")
    s_index = F.when(F.col("is_s"), F.col("seg_index"))
    before = F.last(s_index, ignorenulls=True).over(by_index.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(s_index, ignorenulls=True).over(by_index.rowsBetween(0, Window.unboundedFollowing))
    d = flags.withColumn("gap", F.least(F.col("seg_index") - before, after - F.col("seg_index")))
    rows = F.sort_array(F.collect_list(F.struct("seg_index", "is_s", "gap", "rank", "listed")))
    d = d.groupBy("record_id").agg(F.count_if("is_s").alias("n_s"), rows.alias("segs"))
    return d.withColumn("others", F.filter("segs", lambda x: ~x["is_s"]))


def _index(rows: Column) -> Column:
    return F.transform(rows, lambda x: x["seg_index"])


def _mixed(tag: str, rows: Column) -> Column:
    """Segment indices in the bag's hash order."""
    keyed = F.transform(rows, lambda x: F.struct(hash_order(F.col("seed"), tag, x["seg_index"]).alias("h"), x["seg_index"].alias("seg_index")))
    return _index(F.sort_array(keyed))


def _staged(stage: int, rows: Column) -> Column:
    return F.transform(rows, lambda i: F.struct(i.alias("seg_index"), F.lit(stage).alias("stage")))


def _drawn(stage: int, pool: Column, times: Column) -> Column:
    """So many draws with replacement from the pool."""
    draw = lambda p, j: F.element_at(p, (F.pmod(hash32(F.col("seed"), F.lit("d"), F.lit(stage), j), F.size(p)) + 1).cast("int"))
    none = F.array().cast("array<int>")
    draws = let(pool, lambda p: F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), times.cast("int")), lambda j: draw(p, j))).otherwise(none))
    return _staged(stage, F.when(times > 0, draws).otherwise(none))


def _bag() -> Column:
    """The bag, or more than it, as an array of segments with their stages."""
    segs, others, rest, need, k = F.col("segs"), F.col("others"), F.col("rest"), F.col("need"), F.col("k")
    s = F.filter(segs, lambda x: x["is_s"])
    near = F.filter(others, lambda x: x["gap"] <= F.col("radius"))
    or_all = lambda pool: let(pool, lambda p: F.when(F.size(p) > 0, p).otherwise(_index(segs)))
    short = F.greatest(F.lit(0), k - F.size(segs))  # when every segment is in
    first = F.concat(_staged(0, _index(s)), _staged(1, _mixed("n", near)))
    half = F.floor(need / 2).cast("int")
    ranked = F.filter(rest, lambda x: x["rank"].isNotNull())
    by_rank = _index(F.sort_array(F.transform(ranked, lambda x: F.struct(x["rank"].alias("r"), x["seg_index"].alias("seg_index")))))
    after = lambda kept: _staged(3, _index(F.filter(rest, lambda x: x[kept].isNull())))
    pool = lambda kept: or_all(_index(F.filter(segs, lambda x: x[kept].isNotNull())))
    fills = {
        "normal": F.concat(_staged(2, _mixed("f", rest)), _drawn(4, or_all(_index(others)), short)),
        "duplicate": _drawn(2, _index(s), need),
        "half": F.concat(_drawn(2, _index(s), need - half), _staged(3, F.slice(_mixed("f", rest), 1, half)), _drawn(4, or_all(_index(others)), half - F.size(rest))),
        "slike": F.concat(_staged(2, by_rank), after("rank"), _drawn(4, pool("rank"), short)),
        "slike_random": F.concat(_staged(2, _mixed("f", F.filter(rest, lambda x: x["listed"].isNotNull()))), after("listed"), _drawn(4, pool("listed"), short)),
    }
    added = F.when(need == 0, F.array().cast("array<struct<seg_index:int,stage:int>>"))
    for name, rows in fills.items():
        added = added.when(F.col("fill") == name, rows)
    return F.when(F.col("n_s") >= k, _staged(0, _mixed("s", s))).otherwise(F.concat(first, added))


def bag_sequences(bags: DataFrame) -> DataFrame:
    """Each of :func:`bags` as the ordered list of its segments."""
    return bags.select(*BAG, _index(F.col("bag")).alias("selected"))


def config_tag(method: Column, radius: Column, k: Column, fill: Column, seg_seed: Column, factor: Column) -> Column:
    """The settings as a name; the upsampling factor only if there is any."""
    name = F.concat(method, F.lit("_R"), radius.cast("string"), F.lit("_K"), k.cast("string"), F.lit("_F"), fill, F.lit("_SS"), seg_seed.cast("string"))
    return F.when(factor > 1, F.concat(name, F.lit("_UP"), factor.cast("string"))).otherwise(name)


def cache_is_valid(cache: DataFrame, expected: dict[str, object], k: int) -> DataFrame:
    """One row per cache: ``valid`` if there are bags, all of length k, and the settings agree."""
    agrees = F.lit(True)
    for name, value in expected.items():
        agrees = agrees & F.col(name).eqNullSafe(F.lit(value))
    return cache.agg(F.count(F.lit(1)).alias("n_bags"), F.coalesce(F.bool_and((F.size("selected_keys") == k) & agrees), F.lit(False)).alias("valid"))
