"""Clinical reports: patient ids, ages and the flattened counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FAMILY_FIELDS, REPORT

ROOT = "Holter Report"
_COUNTED, _TEXT = FAMILY_FIELDS[:4], FAMILY_FIELDS[4:]


def parsed(reports: DataFrame, text: str) -> DataFrame:
    """``report``; unreadable text is an empty report."""
    return reports.withColumn("report", F.from_json(text, REPORT, {"mode": "PERMISSIVE"}))


def last_token(name: Column) -> Column:
    return F.element_at(F.split(name, "_"), -1)


def patient_id(name: Column) -> Column:
    """The last token of three or more, else the whole name."""
    return F.when(F.size(F.split(name, "_")) >= 3, last_token(name)).otherwise(name)


def with_patient_id(reports: DataFrame, name: str) -> DataFrame:
    """PID in the report becomes the name's last token, if the report has its root."""
    r = F.col("report")[ROOT]
    info = F.coalesce(r["PatientInfo"], F.struct(*(F.lit(None).cast("string").alias(n) for n in ("PID", "Age", "Gender"))))
    fixed = F.when(r.isNotNull(), F.struct(r.withField("PatientInfo", info.withField("PID", last_token(F.col(name)))).alias(ROOT))).otherwise(F.col("report"))
    return reports.withColumn("report", fixed)


def age(text: Column) -> Column:
    """Digits only, else -1."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).otherwise(F.lit(-1))


def gender(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _missing(text: Column, default: str) -> Column:
    return F.coalesce(text, F.lit(default))


def family(general: Column, fields: Column, total: str) -> dict[str, Column]:
    """Counts of one family: the total is 0 if it is no number; the others keep their text beside
    the number; missing texts are Unknown."""
    text = _missing(general[total], "0")
    out = {"total": F.coalesce(_int(text), F.lit(0)), "total_beats": _int(text)}
    for name in _COUNTED:
        value = _missing(fields[name], "0")
        out |= {name: _int(value), f"{name}_raw": value}
    return out | {name: _missing(fields[name], "Unknown") for name in _TEXT}


def flat_rows(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Flat rows of all reports in one pass; ``rejected`` are those in which a family's total is no
    number, and then the other columns are null."""
    r = F.col("report")[ROOT]
    general = r["General"]
    columns = {"ann_len": F.coalesce(_int(_missing(general["QRScomplexes"], "0")), F.lit(0))}
    for prefix, fields, total in (("v", "Ventriculars", "VentricularBeats"), ("sv", "Supraventriculars", "SupraventricularBeats")):
        columns |= {f"{prefix}_{n}": c for n, c in family(general, r[fields], total).items()}
    for name in ("PacedBeats", "BBBeats", "JunctionalBeats", "AberrantBeats"):
        value = _missing(general[name], "0")
        columns |= {name: _int(value), f"{name}_raw": value}
    columns |= {n: _missing(general[n], "Unknown") for n in ("NoisePercentage", "AFAFLPercentage")}
    flat = reports.select(*keys, *(c.alias(n) for n, c in columns.items()))
    sound = F.col("v_total_beats").isNotNull() & F.col("sv_total_beats").isNotNull()
    return flat.select(*keys, (~sound).alias("rejected"), *(F.when(sound, F.col(n)).alias(n) for n in columns))


def flattened(reports: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Flat rows, and the keys of the rejected ones."""
    rows = flat_rows(reports, keys)
    return rows.where(~F.col("rejected")).drop("rejected"), rows.where("rejected").select(*keys)
