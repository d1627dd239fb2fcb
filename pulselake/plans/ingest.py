"""Sources, id repair, reports and streaming over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import bags, experiments, segments
from ..sources import files, headers, reports
from ..sources.shared import shared_folder
from ..streaming import ingest
from ..streaming.run_log import RunLog
from . import scoring, views

QUERIES, ORACLES = {}, {}


def registered(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@registered(f"WITH {views.EVENTS_SQL} SELECT user_id, floor(us / 86400000000)::INTEGER AS day FROM ev GROUP BY ALL HAVING count(DISTINCT event_type) = 5")
def completeness_division(spark, sf_dir):
    """Users' days that have every type of event."""
    d = views.events(spark, sf_dir).select(F.struct("user_id", F.floor(F.col("us") / 86_400_000_000).cast("int").alias("day")).alias("record"), "event_type")
    done = files.complete_records(d, "record", "event_type", ("view", "click", "signup", "purchase", "error"))
    return done.select("record.user_id", "record.day")


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def skip_done(spark, sf_dir):
    done = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return files.pending(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


_LINES = r"""lines AS (
  SELECT record_name, i::INTEGER AS line_no, CASE WHEN i % 4 = 1 THEN 'old' || i || '.sig  ' || l WHEN i % 4 = 2 THEN 'a.b.SIG ' || l ELSE l END AS line
  FROM (SELECT 'doc_' || doc_id AS record_name, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(ls) AS l, unnest(range(len(ls))) AS i))"""
#: White space that both engines' patterns know.
_TOKENS = r"string_split_regex(regexp_replace(line, '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), '[\s\x0B]+')"


def lines(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("record_name"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    i = F.col("line_no")
    marked = F.when(i % 4 == 1, F.concat(F.lit("old"), i, F.lit(".sig  "), "line")).when(i % 4 == 2, F.concat(F.lit("a.b.SIG "), "line")).otherwise(F.col("line"))
    return d.withColumn("line", marked)


@registered(
    rf"""WITH {_LINES}, t AS (SELECT *, {_TOKENS} AS t FROM lines)
SELECT record_name, line_no, CASE WHEN t = [''] THEN line ELSE array_to_string(list_concat([CASE WHEN line_no = 0 THEN record_name WHEN regexp_full_match(t[1], '[^.]*\.[sS][iI][gG]') THEN record_name || '.SIG' ELSE t[1] END], t[2:]), ' ') END AS line FROM t"""
)
def header_rewrite(spark, sf_dir):
    return headers.repaired_lines(lines(spark, sf_dir))


@registered(
    rf"""WITH {_LINES}, t AS (SELECT *, {_TOKENS} AS t FROM lines WHERE trim(line) <> '')
SELECT record_name, coalesce(max(try_cast(t[2] AS INTEGER)) FILTER (line_no = 0), 0)::INTEGER AS n_sig,
  coalesce(string_agg(t[1], '|' ORDER BY line_no) FILTER (line_no > 0), '') AS file_names, coalesce(string_agg(coalesce(t[9], ''), '|' ORDER BY line_no) FILTER (line_no > 0), '') AS sig_names,
  count(*) FILTER (line_no > 0)::BIGINT AS n_lines FROM t GROUP BY record_name"""
)
def header_parse(spark, sf_dir):
    d = headers.with_defaults(headers.parsed_headers(lines(spark, sf_dir)))
    return d.select("record_name", "n_sig", F.concat_ws("|", "file_name").alias("file_names"), F.concat_ws("|", "sig_name").alias("sig_names"), F.size("file_name").cast("long").alias("n_lines"))


@registered("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lpad(c_custkey::VARCHAR, 9, '0') ELSE c_name END AS pid FROM customer")
def patient_id(spark, sf_dir):
    """A third of the names have three tokens."""
    d = views.table(spark, sf_dir, "customer")
    tokens = F.concat(F.lit("Customer_x_"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return d.select("c_custkey", reports.patient_id(F.when(F.col("c_custkey") % 3 == 0, tokens).otherwise(F.col("c_name"))).alias("pid"))


@registered("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 ELSE (props->>'k')::INTEGER END AS age, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS gender FROM events")
def age_parse(spark, sf_dir):
    d = views.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 8 == 0, F.concat(k, F.lit("y"))).when(F.col("event_id") % 4 == 0, None).otherwise(k)
    return d.select("event_id", reports.age(text).cast("int").alias("age"), reports.gender(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("gender"))


def _report_texts(spark, sf_dir):
    """Reports in the clinical form, made of the events' properties and values."""
    d = views.table(spark, sf_dir, "events")
    k, i = F.get_json_object("props", "$.k"), F.col("event_id")
    odd = F.when(i % 5 == 0, F.lit("n/a")).otherwise(k)
    general = F.struct(odd.alias("QRScomplexes"), F.when(i % 11 == 0, F.lit("n/a")).otherwise(k).alias("VentricularBeats"), k.alias("SupraventricularBeats"), odd.alias("PacedBeats"), F.col("event_type").alias("NoisePercentage"))
    family = F.struct(odd.alias("Isolated"), k.alias("Runs"), F.col("event_type").alias("LongestRunBeats"))
    root = F.struct(general.alias("General"), F.when(i % 3 > 0, family).alias("Ventriculars"))
    whole = F.to_json(F.struct(root.alias("Holter Report")))
    text = F.when(i % 13 == 0, F.lit("{broken")).when(i % 17 == 0, F.lit("{}")).otherwise(whole)
    return reports.parsed(d.select("event_id", F.concat(F.lit("rec_"), "user_id", F.lit("_"), "event_id").alias("name"), text.alias("text")), "text")


_RAW = """e AS (SELECT *, props->>'k' AS k, event_id % 13 <> 0 AND event_id % 17 <> 0 AS there FROM events)"""


@registered(f"WITH {_RAW} SELECT event_id, there AS has_root, CASE WHEN there THEN event_id::VARCHAR END AS pid FROM e")
def report_pid_fix(spark, sf_dir):
    d = reports.with_patient_id(_report_texts(spark, sf_dir), "name")
    root = F.col("report")[reports.ROOT]
    return d.select("event_id", root.isNotNull().alias("has_root"), root["PatientInfo"]["PID"].alias("pid"))


@registered(
    f"""WITH {_RAW}, r AS (SELECT *, CASE WHEN there THEN CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE k END ELSE '0' END AS odd, CASE WHEN there AND event_id % 3 > 0 THEN 1 ELSE 0 END AS fam FROM e)
SELECT event_id, there AND event_id % 11 = 0 AS rejected,
  CASE WHEN NOT (there AND event_id % 11 = 0) THEN coalesce(try_cast(odd AS INTEGER), 0) END AS ann_len,
  CASE WHEN NOT (there AND event_id % 11 = 0) THEN CASE WHEN there THEN k::INTEGER ELSE 0 END END AS v_total,
  CASE WHEN NOT (there AND event_id % 11 = 0) THEN CASE WHEN fam = 1 THEN odd ELSE '0' END END AS "v_Isolated_raw",
  CASE WHEN NOT (there AND event_id % 11 = 0) THEN try_cast(CASE WHEN fam = 1 THEN odd ELSE '0' END AS INTEGER) END AS "v_Isolated",
  CASE WHEN NOT (there AND event_id % 11 = 0) THEN CASE WHEN fam = 1 THEN event_type ELSE 'Unknown' END END AS "v_LongestRunBeats",
  CASE WHEN NOT (there AND event_id % 11 = 0) THEN CASE WHEN there THEN event_type ELSE 'Unknown' END END AS "NoisePercentage",
  CASE WHEN NOT (there AND event_id % 11 = 0) THEN odd END AS "PacedBeats_raw" FROM r"""
)
def report_flatten(spark, sf_dir):
    flat = reports.flat_rows(_report_texts(spark, sf_dir), ["event_id"])
    return flat.select("event_id", "rejected", "ann_len", "v_total", "v_Isolated_raw", "v_Isolated", "v_LongestRunBeats", "NoisePercentage", "PacedBeats_raw")


_NAMED = """g AS (
  SELECT o_custkey, list(CASE WHEN o_custkey % 4 = 0 THEN 'Unnamed' WHEN o_custkey % 4 = 1 THEN '' ELSE o_orderpriority END ORDER BY o_orderkey) AS names FROM orders GROUP BY 1)"""


def _lead_rows(spark, sf_dir):
    c = F.col("o_custkey") % 4
    return views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(c == 0, "Unnamed").when(c == 1, "").otherwise(F.col("o_orderpriority")).alias("lead"))


@registered(
    f"""WITH {_NAMED}
SELECT o_custkey, array_to_string(CASE WHEN len(list_distinct(names)) > 1 OR o_custkey % 4 > 1 THEN names WHEN len(names) = 12 THEN ['I', 'II', 'III', 'aVR', 'aVL', 'aVF', 'V1', 'V2', 'V3', 'V4', 'V5', 'V6']
  WHEN len(names) = 3 THEN ['V5', 'V1', 'II'] ELSE list_transform(range(len(names)), lambda i: 'lead' || i) END, '|') AS names FROM g"""
)
def lead_name_normalize(spark, sf_dir):
    g = _lead_rows(spark, sf_dir).groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "lead"))), lambda r: r["lead"]).alias("names"))
    return g.select("o_custkey", F.concat_ws("|", headers.lead_names(F.col("names"))).alias("names"))


@registered("SELECT o_custkey, o_orderpriority AS lead, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def lead_first_wins(spark, sf_dir):
    d = views.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("lead"), "o_orderkey")
    return bags.first_lead_wins(d, ["o_custkey"], "lead", "o_orderkey")


@registered(
    f"""WITH {views.BEATS_SQL}
SELECT c_custkey, count(us)::BIGINT AS n_beats, coalesce(string_agg(symbol, ',' ORDER BY us, symbol), '') AS symbols FROM customer LEFT JOIN beats ON record_id = c_custkey GROUP BY 1"""
)
def beats_or_empty(spark, sf_dir):
    b = views.beats(spark, sf_dir).withColumnRenamed("record_id", "c_custkey")
    d = segments.beats_by_record(views.table(spark, sf_dir, "customer"), b, "c_custkey", ["us", "symbol"])
    return d.select("c_custkey", F.size("us").cast("long").alias("n_beats"), F.concat_ws(",", "symbol").alias("symbols"))


@registered(
    """WITH f AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN source || '_topk' ELSE source || '-' || lang END AS file_base FROM documents),
r AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN source ELSE source || '-' || lang END || CASE WHEN doc_id % 5 = 0 THEN '_seg_all_denoise' ELSE '' END AS record_id FROM documents),
c AS (SELECT record_id, unnest([record_id, record_id || '_topk', replace(record_id, '_seg_all_denoise', ''), replace(record_id, '_seg_all_denoise', '') || '_topk']) AS file_base, unnest([0, 1, 2, 3]) AS priority FROM r)
SELECT record_id, file_base FROM c JOIN f USING (file_base) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY priority) = 1"""
)
def score_name_resolve(spark, sf_dir):
    d, i = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    there = d.select(F.when(i % 3 == 0, F.concat("source", F.lit("_topk"))).otherwise(F.concat_ws("-", "source", "lang")).alias("file_base"))
    name = F.when(i % 2 == 0, F.col("source")).otherwise(F.concat_ws("-", "source", "lang"))
    records = d.select(F.concat(name, F.when(i % 5 == 0, files.DENOISED).otherwise("")).alias("record_id")).distinct()
    return files.resolved_names(records, there)


_HOURS = f"WITH {views.BEATS_SQL} SELECT record_id, seg_index, count(*)::BIGINT AS n_beats, count(*) FILTER (symbol = 'S')::BIGINT AS n_s FROM beats GROUP BY ALL"


@registered("SELECT label::VARCHAR AS record_id, vec_id::INTEGER AS seg_index, 64 AS n_samples, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings WHERE vec_id % 3 = 1")
def segment_scan(spark, sf_dir):
    """Waveforms written as the segment table, apart by lead, and one lead read back."""
    v, folder = views.table(spark, sf_dir, "embeddings"), shared_folder(spark, "segments")
    lead = F.element_at(F.array(*map(F.lit, ("II", "V1", "V5"))), (F.col("vec_id") % 3 + 1).cast("int"))
    d = v.select(F.col("label").cast("string").alias("record_id"), F.col("vec_id").cast("int").alias("seg_index"), lead.alias("lead"), F.lit(0).alias("lead_pos"), F.col("embedding").alias("samples"))
    files.write_records({"segments": d}, folder)
    back = files.read_records(spark, folder, "segments").where("lead = 'V1'")
    return back.select("record_id", "seg_index", F.size("samples").alias("n_samples"), F.round(arrays.total(F.col("samples")), 5).alias("total"))


@registered(f"WITH {views.EVENTS_SQL} SELECT user_id::VARCHAR || '_' || floor(us / 86400000000)::INTEGER AS record_name FROM ev GROUP BY user_id, floor(us / 86400000000) HAVING count(DISTINCT event_type) = 5")
def record_list(spark, sf_dir):
    """The list of complete records, made where there is none, and read."""
    path = shared_folder(spark, "record-list")
    made = lambda: completeness_division(spark, sf_dir).select(F.concat_ws("_", "user_id", "day").alias("record_name"))
    files.listed_records(spark, path, made)
    return files.listed_records(spark, path, made)


@registered(_HOURS)
def incremental_ingest(spark, sf_dir):
    """New event files become beats; a second run finds nothing to do."""
    schema = views.table(spark, sf_dir, "events").schema
    folder = shared_folder(spark, "ingest")

    def beats(batch):
        symbol = F.when(F.col("event_type") == "error", "S").otherwise(F.col("event_type"))
        us = views.micros("ts") - F.lit(views.START_US)
        return batch.select(F.col("user_id").alias("record_id"), F.floor(us / views.HOUR_US).cast("int").alias("seg_index"), symbol.alias("symbol"))

    for _ in range(2):
        ingest.ingest_new_files(spark, f"{sf_dir}/events.parquet", schema, f"{folder}/beats", f"{folder}/checkpoint", beats)
    done = spark.read.parquet(f"{folder}/beats")
    return done.groupBy("record_id", "seg_index").agg(F.count(F.lit(1)).alias("n_beats"), F.count_if(F.col("symbol") == "S").alias("n_s"))


@registered(
    f"""WITH {views.EVENTS_SQL}, w AS (SELECT event_type, (us // 10000000)::BIGINT AS window_no, count(*)::BIGINT AS n_events FROM ev GROUP BY ALL)
SELECT * FROM w WHERE (window_no + 1) * 10000000 <= (SELECT max(us) FROM ev) - 60000000"""
)
def window_stream(spark, sf_dir):
    """Ten-second windows, as a stream: those that the watermark, a minute late, has closed."""
    schema = views.table(spark, sf_dir, "events").schema
    folder = shared_folder(spark, "windows")
    build = lambda e: ingest.tumbling_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "10 seconds", "1 minute", ["event_type"])
    ingest.run_windows(spark, f"{sf_dir}/events.parquet", schema, f"{folder}/counts", f"{folder}/checkpoint", build)
    d = spark.read.parquet(f"{folder}/counts")
    return d.select("event_type", ((F.unix_micros("window_start") - F.lit(views.START_US)) / 10_000_000).cast("long").alias("window_no"), "n_events")


def _log(spark, folder: str) -> RunLog:
    return RunLog(spark, folder, ["method", "fill"], "split_seed", ["val_best_auc", "test_auc"])


@registered(scoring.ORACLES["runs_segseed_agg"])
def run_log_stream(spark, sf_dir):
    """The run log as a stream of several files, a batch each; the aggregates after the last one."""
    folder = shared_folder(spark, "runs")
    rows = scoring.runs(spark, sf_dir)
    rows.repartition(4).write.parquet(f"{folder}/log")
    log = _log(spark, folder)
    log.take_new(f"{folder}/log", rows.schema, files_a_batch=1)
    return log.by_split(log.last())


_ARRIVALS = 3


def _overall_after(arrival: int) -> str:
    runs = scoring._RUNS.replace("FROM orders", f"FROM orders WHERE o_orderkey % {_ARRIVALS} <= {arrival}")
    return f"SELECT {arrival} AS arrival, * FROM (WITH {runs} {scoring._agg('method, fill', 'n_runs')})"


@registered(" UNION ALL ".join(_overall_after(i) for i in range(_ARRIVALS)))
def run_log_growth(spark, sf_dir):
    """The answers over all runs while the log grows: part after part arrives, and the stream goes on
    from where it stopped."""
    folder = shared_folder(spark, "growth")
    rows = scoring.runs(spark, sf_dir, also=[(F.col("o_orderkey") % _ARRIVALS).cast("int").alias("part")])
    log = _log(spark, folder)
    for part in range(_ARRIVALS):
        experiments.append_runs(rows.where(F.col("part") == part).drop("part"), f"{folder}/log", decimals=12)
        log.take_new(f"{folder}/log", rows.drop("part").schema)
    return log.answers("overall").withColumnRenamed("batch", "arrival").drop("runs_seen")
