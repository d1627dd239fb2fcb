"""Files, headers, reports and streams on tiny hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from pulselake.operators import experiments
from pulselake.sources import files, headers, reports
from pulselake.streaming import ingest


def test_completeness_is_case_exact(spark, tmp_path):
    for name in ("a.hea", "a.SIG", "a.ANN", "a.json", "b.hea", "b.sig", "b.ANN", "b.json", "c.hea"):
        (tmp_path / name).write_text("x")
    found = files.complete_records(files.raw_files(spark, str(tmp_path)))
    assert [r.record_name for r in found.collect()] == ["a"]


def test_header_repair(spark):
    rows = [("r", 0, "old  3 125"), ("r", 1, "x.sig 212"), ("r", 2, "a.b.SIG 1"), ("r", 3, ""), ("r", 4, " .SIG"), ("r", 5, "# note")]
    got = headers.repaired_lines(spark.createDataFrame(rows, "record_name string, line_no int, line string"))
    assert [r.line for r in got.orderBy("line_no").collect()] == ["r 3 125", "r.SIG 212", "a.b.SIG 1", "", "r.SIG", "# note"]


def test_header_parse(spark, tmp_path):
    (tmp_path / "r.hea").write_text("r 2 125/1 1000 10:00:00\nr.SIG 212 200(0)/mV 12 0 1 2 0 II\nr.SIG 212 x 12 0 1 2 0 V1\n")
    h = headers.parsed_headers(files.header_lines(spark, str(tmp_path))).first()
    assert (h.n_sig, h.fs, h.sig_len, h.sig_name, h.adc_gain, h.base_date) == (2, 125.0, 1000, ["II", "V1"], [200.0, 0.0], "")


def test_lead_names(spark):
    cases = [["unnamed"] * 12, ["MARS Export"] * 3, [""] * 5, ["II", "II"], ["unnamed", "x"]]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, n array<string>")
    got = [r.n for r in d.select("i", headers.lead_names(F.col("n")).alias("n")).orderBy("i").collect()]
    assert got[0] == list(headers.TWELVE) and got[1] == list(headers.THREE) and got[2] == [f"lead{i}" for i in range(5)] and got[3:] == cases[3:]


def test_reports(spark):
    root = reports.ROOT
    texts = [
        ("a_b_7", json.dumps({root: {"General": {"QRScomplexes": "x", "VentricularBeats": "4"}, "Ventriculars": {"Isolated": "n/a", "Runs": "2"}}})),
        ("a_8", json.dumps({root: {"PatientInfo": {"PID": "1", "Age": "63y"}, "General": {"SupraventricularBeats": "many"}}})),
        ("9", "{}"), ("z", "{broken"),
    ]
    d = reports.parsed(spark.createDataFrame(texts, "name string, text string"), "text")
    fixed = {r.name: r.report[root] and r.report[root].PatientInfo.PID for r in reports.with_patient_id(d, "name").collect()}
    assert fixed == {"a_b_7": "7", "a_8": "8", "9": None, "z": None}
    flat, rejects = reports.flattened(d, ["name"])
    got = {r.name: r for r in flat.collect()}
    a = got["a_b_7"]
    assert (a.ann_len, a.v_total, a.v_Isolated, a.v_Isolated_raw, a.v_Runs, a.v_LongestRunBPM, a.NoisePercentage) == (0, 4, None, "n/a", 2, "Unknown", "Unknown")
    assert [r.name for r in rejects.collect()] == ["a_8"] and got["z"].v_total == 0
    ages = spark.createDataFrame([("63",), ("63y",), (None,)], "a string").select(reports.age(F.col("a")).alias("x")).collect()
    assert [r.x for r in ages] == [63, -1, -1]
    names = spark.createDataFrame([("x",), ("x_y",), ("x_y_z",)], "a string").select(reports.patient_id(F.col("a")).alias("x")).collect()
    assert [r.x for r in names] == ["x", "x_y", "z"]


def test_score_names(spark, tmp_path):
    for name in ("a.csv", "a_topk.csv", "b_topk.csv", "c.csv"):
        (tmp_path / name).write_text("time,score\n5,0.5\n")
    found = files.score_files(spark, str(tmp_path))
    records = spark.createDataFrame([("a",), ("b",), ("c_seg_all_denoise",), ("d",)], "record_id string")
    got = {r.record_id: r.file_base for r in files.resolved_names(records, found).collect()}
    assert got == {"a": "a", "b": "b_topk", "c_seg_all_denoise": "c"}


def test_csv_and_cache_round_trips(spark, tmp_path):
    (tmp_path / "split_seed98.csv").write_text("PID,file_path,split,label\np1,f1,train,1\np1,f1,train,1\n")
    assert files.splits(spark, str(tmp_path / "split_seed*.csv")).distinct().first().split_seed == 98
    (tmp_path / "meta.csv").write_text("File,Label,Age,Gender\nf1,1,63,M\n")
    assert files.metadata(spark, str(tmp_path / "meta.csv")).first().Age == 63.0
    bags = spark.createDataFrame([("f1", 1, ["0", "2"], "s", 1, 2, "half", 1, 42, "train")], "file_path string, label int, selected_keys array<string>, method string, radius int, seg_per_record int, fill string, upsample_factor int, seed int, split string")
    files.write_bag_cache(bags, str(tmp_path / "cache"))
    back = files.read_bag_cache(spark, str(tmp_path / "cache")).first()
    assert back.selected_keys == ["0", "2"] and back.created_at and back.split == "train"


def test_nested_records_and_run_log(spark, tmp_path):
    records = spark.createDataFrame([("a",), ("b",)], "record_id string")
    segs = spark.createDataFrame([("a", 1, "II"), ("a", 0, "II")], "record_id string, seg_index int, lead string")
    files.write_records({"records": records, "segments": segs}, str(tmp_path / "t"))
    got = {r.record_id: [s.seg_index for s in r.segments] for r in files.nested_records(records, spark.read.parquet(str(tmp_path / "t/segments"))).collect()}
    assert got == {"a": [0, 1], "b": []}
    log = spark.createDataFrame([("x", 0.123456)], "k string, v double")
    for _ in range(2):
        experiments.append_runs(log, str(tmp_path / "log"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [0.1235, 0.1235]
    experiments.overwrite(log, str(tmp_path / "agg"))
    experiments.overwrite(log, str(tmp_path / "agg"))
    assert spark.read.parquet(str(tmp_path / "agg")).count() == 1


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    source, args = str(tmp_path / "in"), (str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b)
    spark.range(3).write.parquet(source)
    ingest.ingest_new_files(spark, source, spark.range(1).schema, *args)
    spark.range(10, 12).write.mode("append").parquet(source)
    ingest.ingest_new_files(spark, source, spark.range(1).schema, *args)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 10, 11]


def test_streams_read_folders_and_single_files(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(40).select((F.lit(1_704_067_200) + F.col("id") * 3).cast("timestamp").alias("ts"), (F.col("id") % 2).alias("k"))
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    build = lambda e: ingest.tumbling_counts(e, "ts", "10 seconds", "30 seconds", ["k"])
    single = str(next((tmp_path / "events.parquet").glob("*.parquet")))
    for source, some in ((str(tmp_path / "events.parquet"), rows), (single, spark.read.parquet(single))):
        out = str(tmp_path / f"windows-{len(source)}")
        ingest.run_windows(spark, source, rows.schema, out, out + "-cp", build)
        start = F.floor(F.unix_timestamp("ts") / 10) * 10
        newest = some.agg(F.max(F.unix_timestamp("ts"))).first()[0]
        want = some.groupBy(start.alias("at"), "k").count().where(F.col("at") + 10 <= newest - 30)
        got = spark.read.parquet(out).select(F.unix_timestamp("window_start"), "k", "n_events")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_events_of_closed_windows_are_dropped(spark, tmp_path):
    from pyspark.sql import functions as F

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda *s: spark.createDataFrame([(1_704_067_200 + x, 0) for x in s], "s long, k long").select(F.col("s").cast("timestamp").alias("ts"), "k")
    build = lambda e: ingest.tumbling_counts(e, "ts", "10 seconds", "5 seconds", ["k"])
    for batch in (at(1, 2, 100), at(3, 101), at(200)):
        batch.coalesce(1).write.mode("append").parquet(source)
        ingest.run_windows(spark, source, batch.schema, out, out + "-cp", build)
    got = {r.at - 1_704_067_200: r.n_events for r in spark.read.parquet(out).select(F.unix_timestamp("window_start").alias("at"), "n_events").collect()}
    assert got == {0: 2, 100: 2}


def test_shared_folders_are_named_on_a_cluster():
    from types import SimpleNamespace

    from pulselake.sources.shared import shared_folder

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://far:7077"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(far, "x")


def test_package_is_shipped_to_clusters_whatever_the_working_folder(monkeypatch):
    from types import SimpleNamespace

    from pulselake import shipping

    monkeypatch.chdir(shipping.ROOT)
    for master, many in (("spark://far:7077", 1), ("local[4]", 0)):
        sent = []
        context = SimpleNamespace(applicationId=f"app-{master}", master=master, addPyFile=sent.append)
        for _ in range(2):
            shipping.ship(SimpleNamespace(sparkContext=context))
        assert len(sent) == many


def test_header_rejects(spark):
    texts = {"good": ["good 1 125 1250", "good.SIG 16 200 12 0 0 0 0 II"], "short": ["short 2 125 9", "a.SIG 16"], "odd": ["odd x 125", "a.SIG 16"], "none": ["", ""]}
    lines = spark.createDataFrame([(n, i, line) for n, ls in texts.items() for i, line in enumerate(ls)], "record_name string, line_no int, line string")
    assert {r.record_name: r.rejected for r in headers.parsed_headers(lines).collect()} == {"good": False, "short": True, "odd": True}
