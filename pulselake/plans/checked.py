"""Sources with broken rows, the bag cache and bucketed payloads over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sampling, segments
from ..schemas import META_FEATURES
from ..sources import bag_cache, buckets, checked
from ..sources.shared import shared_folder
from . import views
from .sampling import _configs, sample_sql

QUERIES, ORACLES = {}, {}


def registered(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _write_lines(lines: DataFrame, header: str, folder: str) -> None:
    """CSV files from whole lines (column ``line``), each file under the header; nothing is quoted."""
    lines.select(F.col("line").alias(header)).write.option("header", "true").option("sep", "\u0001").option("quote", "").csv(folder)


_META_COLUMNS = ("File", "Label", "Age", "Gender", *META_FEATURES)
#: A line of the metadata summary for each customer: some are cut short, hold no number, name no file or have another label.
_META_SQL = """m AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 19 = 0 THEN '' ELSE c_name END AS f, CASE WHEN c_custkey % 17 = 0 THEN 7 ELSE c_custkey % 2 END AS lab, 20 + c_custkey % 60 AS age, c_mktsegment AS g, c_nationkey AS n FROM customer),
r AS (SELECT *, CASE WHEN k % 13 = 0 OR k % 11 = 0 THEN 'unreadable' WHEN f = '' THEN 'no file' WHEN lab = 7 THEN 'label' END AS reason,
  CASE WHEN k % 13 = 0 THEN f || ',' || lab || ',' || age ELSE f || ',' || lab || ',' || CASE WHEN k % 11 = 0 THEN 'old' ELSE age::VARCHAR END || ',' || g || '""" + "".join(f",' || (n + {i}) || '" for i in range(len(META_FEATURES))) + """' END AS line FROM m)"""


def _metadata(spark, sf_dir) -> checked.Checked:
    k, c = F.col("c_custkey"), views.table(spark, sf_dir, "customer")
    name, label = F.when(k % 19 == 0, F.lit("")).otherwise(F.col("c_name")), F.when(k % 17 == 0, F.lit(7)).otherwise(k % 2)
    first = F.concat_ws(",", name, label.cast("string"))
    whole = F.concat_ws(",", first, F.when(k % 11 == 0, F.lit("old")).otherwise((20 + k % 60).cast("string")), "c_mktsegment", *((F.col("c_nationkey") + i).cast("string") for i in range(len(META_FEATURES))))
    line = F.when(k % 13 == 0, F.concat_ws(",", first, (20 + k % 60).cast("string"))).otherwise(whole)
    folder = shared_folder(spark, "metadata")
    _write_lines(c.select(line.alias("line")), ",".join(_META_COLUMNS), folder)
    return checked.checked_metadata(spark, folder)


@registered(
    f"""WITH {_META_SQL} SELECT f AS "File", lab::INTEGER AS "Label", age::DOUBLE AS "Age", g AS "Gender", {", ".join(f'(n + {i})::DOUBLE AS "{c}"' for i, c in enumerate(META_FEATURES))} FROM r WHERE reason IS NULL"""
)
def metadata_scan(spark, sf_dir):
    """The metadata summary as a CSV source with broken lines: the rows that can be read."""
    return _metadata(spark, sf_dir).rows


@registered(f"WITH {_META_SQL} SELECT reason, CASE WHEN reason = 'unreadable' THEN line END AS line, count(*)::BIGINT AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL")
def metadata_rejects(spark, sf_dir):
    """What that source rejected, with reasons; of unreadable lines the text."""
    d = _metadata(spark, sf_dir).rejects
    return d.groupBy("reason", F.when(F.col("reason") == "unreadable", F.col("row")).alias("line")).agg(F.count(F.lit(1)).alias("n"))


_SEEDS = (1, 2, 98)
_SPLIT_SQL = f"""s AS (
  SELECT seed AS split_seed, 'p' || doc_id AS pid, source || '/' || doc_id AS file_path, CASE WHEN doc_id % 10 = 0 THEN 'holdout' WHEN (doc_id + seed) % 10 < 7 THEN 'train' WHEN (doc_id + seed) % 10 < 8 THEN 'val' ELSE 'test' END AS split,
         CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE toxic::VARCHAR END AS label, doc_id % 14 = 0 AS short, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS times
  FROM labels JOIN documents USING (doc_id), (SELECT unnest({list(_SEEDS)}) AS seed)),
r AS (SELECT *, CASE WHEN short THEN 'unreadable' WHEN split = 'holdout' THEN 'split' WHEN label = 'x' THEN 'label' END AS reason FROM s)"""


def _splits(spark, sf_dir) -> checked.Checked:
    d = views.table(spark, sf_dir, "labels").join(views.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    i, folder = F.col("doc_id"), shared_folder(spark, "splits")
    for seed in _SEEDS:
        last = (i + seed) % 10
        split = F.when(i % 10 == 0, "holdout").when(last < 7, "train").when(last < 8, "val").otherwise("test")
        start = F.concat_ws(",", F.concat(F.lit("p"), i), F.concat_ws("/", "source", i.cast("string")), split)
        line = F.when(i % 14 == 0, start).otherwise(F.concat_ws(",", start, F.when(i % 9 == 0, F.lit("x")).otherwise(F.col("toxic").cast("string"))))
        twice = F.explode(F.when(i % 3 == 0, F.array(line, line)).otherwise(F.array(line)))
        _write_lines(d.select(twice.alias("line")), "PID,file_path,split,label", f"{folder}/split_seed{seed:02d}")
    return checked.checked_splits(spark, f"{folder}/split_seed*")


@registered(f"WITH {_SPLIT_SQL} SELECT DISTINCT pid AS \"PID\", file_path, split, label::INTEGER AS label, split_seed FROM r WHERE reason IS NULL")
def split_scan(spark, sf_dir):
    """Splits of several seeds as CSV sources, with lines that repeat and lines that are broken."""
    return checked.distinct_splits(_splits(spark, sf_dir))


@registered(f"WITH {_SPLIT_SQL} SELECT reason, CASE WHEN short THEN pid || ',' || file_path || ',' || split END AS line, sum(times)::BIGINT AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL")
def split_rejects(spark, sf_dir):
    d = _splits(spark, sf_dir).rejects
    return d.groupBy("reason", F.when(F.col("reason") == "unreadable", F.col("row")).alias("line")).agg(F.count(F.lit(1)).alias("n"))


_K = 20
_BAGS_SQL = f"""{views.BEATS_SQL},
g AS (SELECT record_id, list(seg_index ORDER BY seg_index) AS segs FROM flags GROUP BY record_id),
b AS (SELECT record_id, 'rec_' || record_id AS file_path, (record_id % 2)::INTEGER AS label, list_transform(segs[1:{_K}], lambda i: 'seg_' || lpad(i::VARCHAR, 6, '0')) AS keys FROM g)"""
_SETTINGS = bag_cache.Settings("s_first", 1, _K, "normal", 1)


def _bags(spark, sf_dir) -> DataFrame:
    """A bag of each record's first segments."""
    flags = segments.flags_of_beats(views.beats(spark, sf_dir))
    d = flags.groupBy("record_id").agg(F.slice(F.sort_array(F.collect_list("seg_index")), 1, _K).alias("segs"))
    keys = F.transform("segs", lambda i: F.concat(F.lit("seg_"), F.lpad(i.cast("string"), 6, "0")))
    return d.select("record_id", F.concat(F.lit("rec_"), "record_id").alias("file_path"), (F.col("record_id") % 2).cast("int").alias("label"), keys.alias("selected_keys"))


def _bag_lines(spark, sf_dir) -> checked.Checked:
    """Caches of two splits to which lines were added that are cut short, hold a label that is no
    number, or hold no keys."""
    folder, d = shared_folder(spark, "bags"), _bags(spark, sf_dir)
    r = F.col("record_id")
    for no, split in enumerate(("train", "val")):
        part = d.where(r % 2 == no)
        bag_cache.write_one_cache(part, folder, 7, split, _SETTINGS)
        start = F.concat(F.lit('{"file_path":"'), "file_path", F.lit('","label":'))
        line = F.when(r % 7 == 0, start).when(r % 5 == 0, F.concat(start, F.lit('"x","selected_keys":[]}'))).when(r % 3 == 0, F.concat(start, F.lit("1}")))
        part.select(line.alias("value")).where("value is not null").write.mode("append").text(f"{folder}/seed=7/split={split}")
    return checked.checked_bags(spark, folder)


@registered(f"WITH {_BAGS_SQL} SELECT file_path, label, len(keys)::INTEGER AS n_keys, array_to_string(keys, '|') AS keys, 's_first' AS method, 1 AS radius, {_K} AS seg_per_record, 'normal' AS fill, 1 AS upsample_factor, 7 AS seed, CASE WHEN record_id % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM b")
def bag_cache_scan(spark, sf_dir):
    """Bags written as caches and read back, all splits at once."""
    d = _bag_lines(spark, sf_dir).rows
    return d.select("file_path", "label", F.size("selected_keys").alias("n_keys"), F.concat_ws("|", "selected_keys").alias("keys"), "method", "radius", "seg_per_record", "fill", "upsample_factor", "seed", "split")


@registered(
    f"""WITH {_BAGS_SQL}
SELECT CASE WHEN record_id % 7 = 0 OR record_id % 5 = 0 THEN 'unreadable' ELSE 'no keys' END AS reason,
  CASE WHEN record_id % 7 = 0 THEN '{{"file_path":"' || file_path || '","label":' WHEN record_id % 5 = 0 THEN '{{"file_path":"' || file_path || '","label":"x","selected_keys":[]}}' END AS line
FROM b WHERE record_id % 7 = 0 OR record_id % 5 = 0 OR record_id % 3 = 0"""
)
def bag_cache_rejects(spark, sf_dir):
    d = _bag_lines(spark, sf_dir).rejects
    return d.select("reason", F.when(F.col("reason") == "unreadable", F.col("row")).alias("line"))


@registered(
    f"""WITH {_BAGS_SQL}, c AS (SELECT count(*) FILTER (len(keys) = {_K})::BIGINT AS n, count(*) FILTER (len(keys) < {_K}) AS few FROM b)
SELECT unnest(['valid', 'forced', 'other settings', 'other seed', 'no rows', 'short bags', 'broken line', 'made']) AS wanted,
  unnest([CASE WHEN n > 0 THEN 'valid' ELSE 'empty' END, 'forced', CASE WHEN n > 0 THEN 'settings' ELSE 'empty' END, 'absent', 'empty', CASE WHEN few > 0 THEN 'length' ELSE 'valid' END, 'unreadable', 'valid']) AS status,
  unnest([CASE WHEN n > 0 THEN n END, NULL, NULL, NULL, NULL, CASE WHEN few = 0 THEN n END, NULL, n]) AS n_bags FROM c"""
)
def cache_judged(spark, sf_dir):
    """Caches on disk, judged as a whole: those that serve, and why the others do not."""
    folder, d = shared_folder(spark, "caches"), _bags(spark, sf_dir)
    full = d.where(F.size("selected_keys") == _K)
    write = lambda bags, seed: bag_cache.write_one_cache(bags, folder, seed, "train", _SETTINGS)
    write(full, 1)
    write(full.limit(0), 2)
    write(d.orderBy(F.desc(F.size("selected_keys"))), 3)
    write(full, 4)
    full.select(F.lit('{"file_path":').alias("value")).limit(1).write.mode("append").text(f"{folder}/seed=4/split=train")
    judge = lambda seed, settings=_SETTINGS, force=False: bag_cache.judge_bag_cache(spark, folder, seed, "train", settings, force)
    found = {"valid": judge(1), "forced": judge(1, force=True), "other settings": judge(1, _SETTINGS._replace(radius=2)), "other seed": judge(9), "no rows": judge(2), "short bags": judge(3), "broken line": judge(4)}
    made = bag_cache.load_or_make(spark, folder, 9, "train", _SETTINGS, lambda: full)
    out = None
    for name, (status, bags) in (found | {"made": bag_cache.CacheJudgement("valid", made)}).items():
        rows = (bags if bags is not None else spark.range(0)).agg(F.count(F.lit(1)).alias("n"))
        row = rows.select(F.lit(name).alias("wanted"), F.lit(status).alias("status"), F.when(F.lit(bags is not None), F.col("n")).alias("n_bags"))
        out = row if out is None else out.unionByName(row)
    return out


@registered(
    sample_sql([(0, 20, 1, "normal")]) + """, payload AS (SELECT record_id, seg_index, round(avg(amp), 6) AS mean_amp, count(*)::BIGINT AS n_beats FROM beats GROUP BY ALL)
SELECT config_id, record_id, upsample_index, bag_pos::INTEGER AS bag_pos, seg_index, mean_amp, n_beats FROM bags JOIN payload USING (record_id, seg_index)"""
)
def bag_payload(spark, sf_dir):
    """Bags with their segments' payload, which was written in buckets once and is not moved again."""
    b = views.beats(spark, sf_dir)
    payload = b.groupBy("record_id", "seg_index").agg(F.round(F.avg("amp"), 6).alias("mean_amp"), F.count(F.lit(1)).alias("n_beats"))
    stored = buckets.write_bucketed(payload, shared_folder(spark, "payload"))
    bags = sampling.sample_bags(segments.flags_of_beats(b), _configs(spark, [(0, 20, 1, "normal")]))
    return buckets.bag_payload(bags, stored).select("config_id", "record_id", "upsample_index", "bag_pos", "seg_index", "mean_amp", "n_beats")
