"""Record headers: id repair, parsing, lead names and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that mean nothing, and the standard leads.
NAMELESS = ("mars export", "unnamed", "")
TWELVE = ("I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6")
THREE = ("V5", "V1", "II")


#: White space as patterns know it.
_SPACE = " \t\n\x0b\f\r"


def _tokens(lines: DataFrame) -> DataFrame:
    """``lines`` with ``__t``, the line's tokens: one empty token for a blank line."""
    return lines.withColumn("__t", F.split(F.btrim("line", F.lit(_SPACE)), r"\s+"))


def repaired_lines(lines: DataFrame) -> DataFrame:
    """``record_name, line_no, line``: the first line's first token becomes the record's name, and
    a first token ``X.SIG`` of a later one ``<record>.SIG``; white space collapses, blank lines stay."""
    head = F.col("__t")[0]
    first = F.when(F.col("line_no") == 0, F.col("record_name")).when(head.rlike(r"(?i)^[^.]*\.SIG$"), F.concat("record_name", F.lit(".SIG"))).otherwise(head)
    rest = F.slice("__t", 2, F.greatest(F.size("__t") - 1, F.lit(0)))
    blank = (F.size("__t") == 1) & (head == "")
    d = _tokens(lines).withColumn("line", F.when(blank, F.col("line")).otherwise(F.concat_ws(" ", first, rest)))
    return d.select("record_name", "line_no", "line")


def parsed_headers(lines: DataFrame) -> DataFrame:
    """One row per record from its lines: ``n_sig, fs, sig_len`` of the first, and of each later
    line, in order, file, format, gain, resolution, zero and lead name as arrays.

    ``rejected``: the first line is missing, its number of signals is none, or not all of their
    lines are there."""
    d = _tokens(lines).where(F.trim("line") != "").withColumnRenamed("__t", "t")
    at = lambda i: F.get("t", F.lit(i))
    signal = F.struct("line_no", at(0).alias("file"), at(1).alias("fmt"), at(2).alias("gain"), at(3).alias("adc_res"), at(4).alias("adc_zero"), at(8).alias("name"))
    first = F.struct(at(1).alias("n_sig"), at(2).alias("fs"), at(3).alias("sig_len"), at(4).alias("base_time"), at(5).alias("base_date"))
    g = d.groupBy("record_name").agg(F.max(F.when(F.col("line_no") == 0, first)).alias("h"), F.sort_array(F.collect_list(F.when(F.col("line_no") > 0, signal))).alias("s"))
    each = lambda name: F.transform("s", lambda x: F.coalesce(x[name], F.lit("")))
    number = lambda name, kind: F.expr(f"transform(s, x -> coalesce(try_cast(x.{name} as {kind}), 0))")
    n_sig = F.expr("try_cast(h.n_sig as int)")
    return g.select(
        "record_name", F.coalesce(n_sig, F.lit(0)).alias("n_sig"), F.expr("try_cast(split(h.fs, '/')[0] as double)").alias("fs"), F.expr("try_cast(h.sig_len as bigint)").alias("sig_len"),
        F.coalesce("h.base_time", F.lit("")).alias("base_time"), F.coalesce("h.base_date", F.lit("")).alias("base_date"), each("file").alias("file_name"), each("fmt").alias("fmt"),
        F.expr("transform(s, x -> coalesce(try_cast(regexp_extract(x.gain, '^[-+0-9.eE]+', 0) as float), 0f))").alias("adc_gain"), number("adc_res", "int").alias("adc_res"), number("adc_zero", "int").alias("adc_zero"), each("name").alias("sig_name"),
        (n_sig.isNull() | (F.size("s") < n_sig)).alias("rejected"),
    )


def lead_names(names: Column) -> Column:
    """If all names are the same one that means nothing: the standard ones, or lead0, lead1, ..."""
    n = F.size(names)
    nameless = (F.size(F.array_distinct(names)) == 1) & F.lower(names[0]).isin(*NAMELESS)
    numbered = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("lead"), i.cast("string")))
    standard = F.when(n == 12, F.array(*map(F.lit, TWELVE))).when(n == 3, F.array(*map(F.lit, THREE))).otherwise(numbered)
    return F.when((n > 0) & nameless, standard).otherwise(names)


def with_defaults(headers: DataFrame) -> DataFrame:
    """Empty text for what is missing."""
    return headers.withColumns({c: F.coalesce(c, F.lit("")) for c, t in headers.dtypes if t == "string"})
