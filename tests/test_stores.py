"""Run logs that grow, payloads in buckets, sources with broken rows, and caches judged as a whole."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pulselake.operators import bags, experiments
from pulselake.sources import bag_cache, buckets, checked
from pulselake.streaming.run_log import RunLog

RUNS = "method string, fill string, split_seed int, auc double"


def run_rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b"]), rng.choice(["x", "y", None]), rng.choice([1, 2, None]), rng.choice([rng.random(), math.nan, None])) for _ in range(n)]


def table(df):
    return sorted((str(r.asDict()) for r in df.select(sorted(df.columns)).collect()))


def test_each_answer_equals_the_aggregate_over_what_has_come(spark, tmp_path):
    folder, keys = f"file://{tmp_path}", ["method", "fill"]
    log, seen, due, n = RunLog(spark, folder, keys, "split_seed", ["auc"]), [], {}, 0
    for batch, size in enumerate((2, 2, 3, 1, 11)):
        rows = run_rows(size, batch)
        spark.createDataFrame(rows, RUNS).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        log.take_new(f"{folder}/log", spark.createDataFrame([], RUNS).schema)
        seen += rows
        assert log.last() == batch
        so_far = spark.createDataFrame(seen, RUNS)
        assert table(log.by_split(batch)) == table(experiments.aggregate_runs(so_far, [*keys, "split_seed"], ["auc"], "n_segseeds"))
        assert table(log.overall(batch)) == table(experiments.aggregate_runs(so_far, keys, ["auc"], "n_runs"))
        if len(seen) // 5 > n // 5:
            due[batch] = len(seen)
        n = len(seen)
    answers = log.answers("overall")
    assert {r.batch: r.runs_seen for r in answers.collect()} == due == {2: 7, 4: 19}
    # a restart without new files changes nothing, a repeated batch replaces itself
    log.take_new(f"{folder}/log", spark.createDataFrame([], RUNS).schema)
    assert log.last() == 4
    before = table(log.overall(4))
    log.merge(spark.createDataFrame(run_rows(11, 4), RUNS), 4)
    assert table(log.overall(4)) == before


def test_several_files_are_several_batches(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = run_rows(40, 9)
    spark.createDataFrame(rows, RUNS).repartition(4).write.parquet(f"{folder}/log")
    log = RunLog(spark, folder, ["method", "fill"], "split_seed", ["auc"])
    log.take_new(f"{folder}/log", spark.createDataFrame([], RUNS).schema, files_a_batch=1)
    assert log.last() == 3 and log.answers("by_split").select("batch").distinct().count() == 4
    assert table(log.overall(3)) == table(experiments.aggregate_runs(spark.createDataFrame(rows, RUNS), ["method", "fill"], ["auc"], "n_runs"))


def exchanges_above(plan, scan):
    """Names of the exchanges between the scans of a table and the root of a physical plan."""
    found = []

    def walk(node, over):
        name = node.nodeName()
        here = [*over, name] if "Exchange" in name else over
        if scan in node.verboseStringWithSuffix(10_000) and node.children().isEmpty():
            found.append(here)
        for i in range(node.children().size()):
            walk(node.children().apply(i), here)

    walk(plan, [])
    return found


def test_payloads_stay_in_their_buckets(spark, tmp_path):
    segments = spark.createDataFrame([(r, s, lead, 0, [float(r), float(s), 1.0]) for r in range(20) for s in range(10) for lead in ("II", "V1")], "record_id int, seg_index int, lead string, lead_pos int, samples array<double>")
    picked = spark.createDataFrame([(0, r, p + 1, s) for r in range(20) for p, s in enumerate((3, 3, 7, 99))], "config_id int, record_id int, bag_pos int, seg_index int")
    stored = buckets.write_bucketed(segments, f"file://{tmp_path}/segments")
    again = buckets.read_bucketed(spark, f"file://{tmp_path}/segments", "record_id int, seg_index int, lead string, lead_pos int, samples array<double>", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for source in (stored, again):
            joined = buckets.bag_payload(picked, source)
            assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, picked.join(segments, ["record_id", "seg_index"]).collect()))
            tensor = bags.bag_tensor(picked, source, ["config_id", "record_id"], ["V1", "II"], 4)
            for d in (joined, tensor):
                plan = d._jdf.queryExecution().executedPlan()
                over = exchanges_above(plan, "Bucketed: true")
                # what is over the scan and below the join: no exchange; the tensor's bags are gathered after it
                assert over and all(len(e) <= (1 if d is tensor else 0) for e in over), plan.toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_broken_csv_rows_are_rejects(spark, tmp_path):
    (tmp_path / "split_seed98.csv").write_text('PID,file_path,split,label\np1,"a, b.h5",train,1\np1,"a, b.h5",train,1\np2,c.h5,test,one\np3,d.h5,other,0\np4,e.h5\np5,f.h5,val, 0\n')
    (tmp_path / "split_seedx.csv").write_text("PID,file_path,split,label\np6,g.h5,train,1\n")
    c = checked.checked_splits(spark, str(tmp_path / "split_seed*.csv"))
    assert sorted(map(tuple, checked.distinct_splits(c).select("PID", "file_path", "label", "split_seed").collect())) == [("p1", "a, b.h5", 1, 98), ("p5", "f.h5", 0, 98)]
    rejects = {(r.file, r.reason): r.row for r in c.rejects.collect()}
    assert set(rejects) == {("split_seed98", "label"), ("split_seed98", "split"), ("split_seed98", "unreadable"), ("split_seedx", "no seed")}
    assert rejects["split_seed98", "unreadable"] == "p4,e.h5"
    # whatever columns are wanted
    assert c.rows.select("PID").count() == 3 and c.rejects.select("reason").count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        checked.checked_splits(spark, str(tmp_path / "nothing_seed*.csv"))


SETTINGS = bag_cache.Settings("s_first", 1, 2, "normal")


def judged(spark, folder, **more):
    return bag_cache.judge_bag_cache(spark, folder, 1, "train", SETTINGS, **more)


def test_caches_are_judged_as_a_whole(spark, tmp_path):
    folder = f"file://{tmp_path}"
    made = spark.createDataFrame([("f1", 0, ["a", "b"]), ("f2", 1, ["c", "d"])], "file_path string, label int, selected_keys array<string>")
    assert judged(spark, folder).status == "absent"
    calls = []
    got = bag_cache.load_or_make(spark, folder, 1, "train", SETTINGS, lambda: calls.append(1) or made)
    assert sorted(r.file_path for r in got.collect()) == ["f1", "f2"] and got.first().seed == 1
    bag_cache.load_or_make(spark, folder, 1, "train", SETTINGS, lambda: calls.append(1) or made)
    assert len(calls) == 1 and judged(spark, folder).status == "valid" and judged(spark, folder, force=True).status == "forced"
    part = tmp_path / "seed=1" / "split=train" / "part-99999.json"
    line = '{"file_path":"f9","label":1,"selected_keys":["x","y"],"method":"other","radius":9,"seg_per_record":2,"fill":"half"}\n'
    part.write_text(line)
    assert judged(spark, folder).status == "valid"  # the first row speaks for all
    part.write_text(line.replace('["x","y"]', '["x"]'))
    assert judged(spark, folder).status == "length"
    part.write_text(line[:30])
    assert judged(spark, folder).status == "unreadable"
    part.unlink()
    (part.parent / "part-00000-0.json").write_text(line)
    assert judged(spark, folder).status == "settings"
    for f in part.parent.glob("*.json"):
        f.write_text("")
    assert judged(spark, folder).status == "empty"


def test_first_row_without_an_upsampling_factor(spark, tmp_path):
    cache = tmp_path / "seed=1" / "split=train"
    cache.mkdir(parents=True)
    (cache / "a.json").write_text('{"file_path":"f","label":1,"selected_keys":["x","y"],"method":"s_first","radius":1,"seg_per_record":2,"fill":"normal"}\n')
    assert judged(spark, f"file://{tmp_path}").status == "valid"


def test_moments_merge_to_those_of_all_runs(spark):
    rows = run_rows(300, 3)
    d = spark.createDataFrame(rows, RUNS)
    keys = ["method", "fill"]
    parts = [experiments.run_moments(d.where(F.col("split_seed").eqNullSafe(s)), keys, ["auc"]) for s in (1, 2, None)]
    merged = experiments.merged_moments(parts[0].unionByName(parts[1]).unionByName(parts[2]), keys, ["auc"])
    assert table(experiments.moments_report(merged, keys, ["auc"], "n")) == table(experiments.aggregate_runs(d, keys, ["auc"], "n"))
