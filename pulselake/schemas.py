"""Schemas of the normalised tables; nothing is inferred."""

from __future__ import annotations

#: The columns of the normalised tables.
HEADER_LINES = "record_name string, line_no int, line string"
RECORDS = (
    "record_id string, pid string, age int, gender string, fs double, n_sig int, sig_len bigint, base_time string, base_date string, sig_name array<string>, "
    "fmt array<string>, adc_gain array<float>, baseline array<int>, units array<string>, adc_res array<int>, adc_zero array<int>"
)
SEGMENTS = "record_id string, seg_index int, lead string, lead_pos int, samples array<float>"
BEATS = "record_id string, sample bigint, symbol string, subtype int, chan int, num int, aux_note string"
FIDUCIALS = "record_id string, seg_index int, wave string, beat_no int, sample int"
TABLES = {"header_lines": HEADER_LINES, "records": RECORDS, "segments": SEGMENTS, "beats": BEATS, "fiducials": FIDUCIALS}

#: The names in a report.
FAMILY_FIELDS = ("Isolated", "Couplets", "BigeminalCycles", "Runs", "LongestRunBeats", "LongestRunBPM", "LongestRunTimestamp", "FastestRunBeats", "FastestRunBPM", "FastestRunTimestamp")
GENERAL_FIELDS = ("QRScomplexes", "VentricularBeats", "SupraventricularBeats", "PacedBeats", "BBBeats", "JunctionalBeats", "AberrantBeats", "NoisePercentage", "AFAFLPercentage")


def _texts(names: tuple[str, ...]) -> str:
    return "struct<" + ", ".join(f"{n}: string" for n in names) + ">"


REPORT = f"`Holter Report` struct<PatientInfo: struct<PID: string, Age: string, Gender: string>, General: {_texts(GENERAL_FIELDS)}, Ventriculars: {_texts(FAMILY_FIELDS)}, Supraventriculars: {_texts(FAMILY_FIELDS)}>"

#: The metadata summary's columns.
META_FEATURES = (
    "DurationHours", "QRScomplexes", "SupraventricularBeats", "VentricularBeats", "NoisePercentage", "AverageRate", "MaximumRate", "MinimumRate", "TachycardiaBeats", "TachycardiaPercentage",
    "SV_Isolated", "SV_Couplets", "SV_Runs", "SV_TotalBeats", "SV_BigeminalCycles", "V_Isolated", "V_Couplets", "V_Runs", "V_TotalBeats",
)
META = "File string, Label int, Age double, Gender string, " + ", ".join(f"{n} double" for n in META_FEATURES)
SPLITS = "PID string, file_path string, split string, label string"
SCORES = "time string, score string"
BAG_CACHE = "file_path string, label int, selected_keys array<string>, method string, radius int, seg_per_record int, fill string, upsample_factor int, created_at string, seed int, split string"
