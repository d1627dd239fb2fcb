"""Waveform intervals, amplitudes and axes from fiducial points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import lagged

#: The pairs of waves behind each feature (a peak and its baseline for amplitudes, from and to for intervals).
AMPLITUDES = {
    "p_amp": [("P_Peak", "P_Onset", 1.0)], "q_amp": [("Q_Peak", "P_Onset", 1.0)], "r_amp": [("R_Peak", "Q_Peak", 0.5), ("R_Peak", "S_Peak", 0.5)],
    "s_amp": [("S_Peak", "P_Onset", 1.0)], "t_amp": [("T_Peak", "T_Onset", 1.0)],
}
INTERVALS = {
    "p_dur": ("P_Onset", "P_Offset"), "pr_seg": ("P_Offset", "Q_Peak"), "qrs_dur": ("Q_Peak", "S_Peak"), "st_seg": ("S_Peak", "T_Onset"), "t_dur": ("T_Onset", "T_Offset"),
    "pr_int": ("P_Onset", "Q_Peak"), "qt_int": ("Q_Peak", "T_Offset"),
}
AXES = {"p_axis": "P_Peak", "r_axis": "R_Peak", "t_axis": "T_Peak"}
#: So many points of a wave or fewer say nothing.
FEW = 3


def wave_beats(points: DataFrame, keys: list[str], wave: str, beat: str, columns: list[str], waves: list[str]) -> DataFrame:
    """One row for each beat of a group: of each wave its point (a struct), and as ``next_<wave>``
    that of the beat after it.  A missing point is a struct of nulls; no point is null."""
    at = F.explode(F.array(F.struct(F.lit(False).alias("next"), F.col(beat).alias("beat")), F.struct(F.lit(True).alias("next"), (F.col(beat) - 1).alias("beat"))))
    both = points.select(*keys, wave, F.struct(*columns).alias("point"), at.alias("at"))
    one = lambda w, n: F.max(F.when((F.col(wave) == w) & (F.col("at.next") == F.lit(n)), F.col("point")))
    return both.groupBy(*keys, F.col("at.beat").alias(beat)).agg(*(one(w, False).alias(w) for w in waves), *(one(w, True).alias(f"next_{w}") for w in waves))


def _mean(value: Column) -> Column:
    """The mean without nulls and NaN; null if none is left."""
    return F.avg(F.when(~F.isnan(value), value))


def paired_mean(a: str, b: str, value: str) -> Column:
    """Of :func:`wave_beats`: the mean of b's less a's values, beat by beat; only if both waves have
    equally many points, and more than three (missing ones count)."""
    gate = (F.count(a) == F.count(b)) & (F.count(a) > FEW)
    return F.when(gate, _mean((F.col(b)[value] - F.col(a)[value]).cast("double")))


def successive_mean(a: str, b: str, value: str) -> Column:
    """Mean of the next beat's b less a; a and b the same wave gives the steps within it."""
    gate = (F.count(a) == F.count(b)) & (F.count(a) - 1 > FEW)
    return F.when(gate, _mean((F.col(f"next_{b}")[value] - F.col(a)[value]).cast("double")))


def axis_mean(wave: str, one: str, two: str) -> Column:
    """Mean electrical axis in degrees over the points that are there."""
    return _mean(F.degrees(F.atan2(F.col(wave)[two], F.col(wave)[one])))


def with_amplitudes(points: DataFrame, segments: DataFrame, keys: list[str], sample: str, leads: dict[str, str]) -> DataFrame:
    """``points`` with the samples of their segment's leads at each point: column name to lead.

    ``segments`` has ``keys, lead, samples``; a point without a sample, outside the segment, or of
    a lead that is not there has a null."""
    wanted = segments.where(F.col("lead").isin(*leads.values()))
    by_lead = [F.first(F.when(F.col("lead") == lead, F.col("samples")), ignorenulls=True).alias(f"__{name}") for name, lead in leads.items()]
    joined = points.join(wanted.groupBy(*keys).agg(*by_lead), keys, "left")
    return joined.withColumns({name: F.get(F.col(f"__{name}"), F.col(sample)).cast("double") for name in leads}).drop(*(f"__{n}" for n in leads))


def corrected_qt(qt: Column, rr: Column) -> tuple[Column, Column]:
    """Bazett's and Fridericia's corrections; null unless the beat interval is positive."""
    sound = (rr > 0) & ~F.isnan(rr)
    return F.when(sound, qt / F.sqrt(rr)), F.when(sound, qt / F.pow(rr, F.lit(1.0 / 3.0)))


def features(beats: DataFrame, keys: list[str], rate: float, sample: str = "sample", lead_one: str | None = "lead_1", lead_two: str = "lead_2", names: dict[str, str] | None = None, dummy: bool = False) -> DataFrame:
    """The 19 features of each group from its :func:`wave_beats`; all null with three R peaks or
    fewer, or if ``dummy``.

    Points are structs of the sample and the leads' amplitudes there; without the first lead
    the axes are null.  ``names`` maps a wave to the column of its points."""
    if dummy:
        return dummy_features(beats.select(*keys).distinct(), keys)
    at = lambda w: (names or {}).get(w, w)
    out: dict[str, Column] = {}
    for name, pairs in AMPLITUDES.items():
        terms = [weight * paired_mean(at(base), at(peak), lead_two) for peak, base, weight in pairs]
        out[name] = sum(terms[1:], terms[0])
    for name, (a, b) in INTERVALS.items():
        out[name] = paired_mean(at(a), at(b), sample) / rate
    out["rr_int"] = successive_mean(at("R_Peak"), at("R_Peak"), sample) / rate
    out["tp_seg"] = successive_mean(at("T_Offset"), at("P_Onset"), sample) / rate
    axes = {name: axis_mean(at(wave), lead_one, lead_two) if lead_one else F.lit(None).cast("double") for name, wave in AXES.items()}
    d = beats.groupBy(*keys).agg(F.count(at("R_Peak")).alias("__r"), *(c.alias(n) for n, c in (out | axes).items()))
    columns = {n: F.col(n) for n in out} | dict(zip(("qtc_baz", "qtc_frid"), corrected_qt(F.col("qt_int"), F.col("rr_int")), strict=True)) | {n: F.col(n) for n in axes}
    return d.select(*keys, *(F.when(F.col("__r") > FEW, c).alias(n) for n, c in columns.items()))


def dummy_features(groups: DataFrame, keys: list[str]) -> DataFrame:
    """The same columns without the work."""
    names = [*AMPLITUDES, *INTERVALS, "rr_int", "tp_seg", "qtc_baz", "qtc_frid", *AXES]
    return groups.select(*keys, *(F.lit(None).cast("double").alias(n) for n in names))


def successive_intervals(points: DataFrame, keys: list[str], order: str, sample: str) -> DataFrame:
    """Each point's distance from the one before it, in groups of any size."""
    d = lagged(points, keys, [order], {"__before": sample})
    return d.withColumn("interval", F.col(sample) - F.col("__before")).drop("__before")


def ordered_points(points: DataFrame, keys: list[str], sample: str, label: str) -> DataFrame:
    """Samples and labels of each group's points as two arrays in order; missing points go."""
    rows = F.sort_array(F.collect_list(F.when(F.col(sample).isNotNull(), F.struct(sample, label))))
    return points.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.transform("rows", lambda r: r[sample]).alias("fsample"), F.transform("rows", lambda r: r[label]).alias("fiducial"))
