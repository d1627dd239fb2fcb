"""Classification metrics of all runs in one job each, grouped by run keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouped import null_safe_join
from ..functions.ranges import numbered, running_sums


def predicted(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, 1).otherwise(0)


def _by_score(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score: what the ranking metrics need of ties."""
    return rows.groupBy(*keys, "p").agg(F.count_if(F.col("y") == 1).cast("double").alias("pos"), F.count_if(F.col("y") != 1).cast("double").alias("neg"))


def auroc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve with ties at half; null for one class."""
    d = running_sums(_by_score(rows, keys), keys, "p", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return d.groupBy(*keys).agg(F.try_divide(wins, F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auroc"))


def average_precision(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Step-wise average precision with tied scores as one step; null without positives."""
    d = running_sums(_by_score(rows, keys), keys, F.desc("p"), ["pos", "neg"])
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    return d.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * tp / (tp + fp)), F.nullif(F.sum("pos"), F.lit(0.0))).alias("ap"))


def confusion(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """``y`` by ``pred_0, pred_1``."""
    d = rows.withColumn("yhat", predicted(F.col("p"), threshold))
    counts = d.groupBy(*keys, "y").pivot("yhat", [0, 1]).count()
    return counts.select(*keys, "y", F.coalesce("0", F.lit(0)).alias("pred_0"), F.coalesce("1", F.lit(0)).alias("pred_1"))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))


def _cells(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    yes, hat = F.col("y") == 1, F.col("p") >= threshold
    cells = {"tp": yes & hat, "fp": ~yes & hat, "fn": yes & ~hat, "tn": ~yes & ~hat}
    return rows.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in cells.items()))


def binary_metrics(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where a denominator is."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return _cells(rows, keys, threshold).select(
        *keys, _share(tp + tn, tp + fp + fn + tn).alias("accuracy"), _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"), _share(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def class_report(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of each class, with accuracy and both averages."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    cells = _cells(rows, keys, threshold)
    one = lambda name, a, b, c: F.struct(F.lit(name).alias("class"), _share(a, a + b).alias("precision"), _share(a, a + c).alias("recall"), _share(2 * a, 2 * a + b + c).alias("f1"), (a + c).alias("support"))
    classes = cells.withColumn("c", F.explode(F.array(one("0", tn, fn, fp), one("1", tp, fp, fn)))).select(*keys, "c.*")
    names = ("precision", "recall", "f1")
    macro = classes.groupBy(*keys).agg(*(F.avg(n).alias(n) for n in names), F.sum("support").alias("support")).withColumn("class", F.lit("macro avg"))
    weighted = classes.groupBy(*keys).agg(*(_share(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names), F.sum("support").alias("support")).withColumn("class", F.lit("weighted avg"))
    accuracy = _share(tp + tn, tp + fp + fn + tn)
    overall = cells.select(*keys, F.lit("accuracy").alias("class"), *(accuracy.alias(n) for n in names), (tp + fp + fn + tn).alias("support"))
    return classes.unionByName(overall).unionByName(macro).unionByName(weighted)


def evaluate(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """One row of all metrics for each run."""
    return null_safe_join(null_safe_join(auroc(rows, keys), average_precision(rows, keys), keys), binary_metrics(rows, keys, threshold), keys)


def evaluation_report(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """The whole report of each run as one table: ``keys, section, item, measure, value``, with the
    metrics, the report of each class and the confusion matrix."""
    def long(d: DataFrame, section: str, item: Column, measures: list[str]) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures)))
        return d.select(*keys, F.lit(section).alias("section"), item.alias("item"), each.alias("m")).select(*keys, "section", "item", "m.*")

    metrics = long(evaluate(rows, keys, threshold), "metrics", F.lit("all"), ["auroc", "ap", "accuracy", "precision", "recall", "f1"])
    classes = long(class_report(rows, keys, threshold), "classes", F.col("class"), ["precision", "recall", "f1", "support"])
    return metrics.unionByName(classes).unionByName(long(confusion(rows, keys, threshold), "confusion", F.col("y").cast("string"), ["pred_0", "pred_1"]))


#: Epochs of a group that are folded as one, and pieces that are composed as one.
SPAN, FAN = 512, 64


def _piece_outcomes(rows: Column, last: Column, least_gain: float, patience: int) -> Column:
    """Of a piece's epochs in order (with as many of the next piece as patience looks ahead): what
    follows from a gain at each of the first ``patience``.

    A gain at an epoch leads to the next one within the patience, wherever it came from, so outcomes
    are found from behind: that of the next gain, or the end.  ``at`` is the gain's epoch in the next
    piece, null where the run ends in this one."""
    none = F.lit(None)
    out = lambda at, best, epoch, stop, stopped: F.struct(at.cast("long").alias("at"), best.cast("double").alias("best"), epoch.cast("long").alias("best_epoch"), stop.cast("long").alias("stop"), stopped.cast("boolean").alias("stopped"))
    kept = "array<struct<epoch:bigint,v:double,out:struct<at:bigint,best:double,best_epoch:bigint,stop:bigint,stopped:boolean>>>"

    def step(ahead: Column, row: Column) -> Column:
        gain = F.get(F.filter(ahead, lambda later: F.coalesce(later["v"] > row["v"] + least_gain, F.lit(False))), 0)
        ends = out(none, row["v"], row["epoch"], row["epoch"] + F.size(ahead), F.size(ahead) >= patience)
        here = F.when(row["epoch"] > last, out(row["epoch"], none, none, none, none)).when(gain.isNotNull(), gain["out"]).otherwise(ends)
        return F.slice(F.concat(F.array(F.struct(row["epoch"].alias("epoch"), row["v"].alias("v"), here.alias("out"))), ahead), 1, patience)

    return F.transform(F.aggregate(F.reverse(rows), F.array().cast(kept), step), lambda e: F.struct(e["epoch"].alias("epoch"), e["out"].alias("out")))


def _composed(pieces: Column) -> Column:
    """The outcomes of the first piece, carried through those after it."""
    follow = lambda e, piece: F.get(F.filter(piece["outcomes"], lambda x: x["epoch"] == e["out"]["at"]), 0)["out"]
    step = lambda found, piece: F.transform(found, lambda e: F.struct(e["epoch"].alias("epoch"), F.when(e["out"]["at"].isNull(), e["out"]).otherwise(follow(e, piece)).alias("out")))
    return F.aggregate(F.slice(pieces, 2, F.size(pieces)), F.get(pieces, 0)["outcomes"], step)


def best_epoch(log: DataFrame, keys: list[str], order: list[str], metric: str, least_gain: float = 0.001, patience: int = 30) -> DataFrame:
    """A running best that counts only gains of more than ``least_gain``, from 0 on, until
    ``patience`` epochs bring none: best value (null if none), best epoch and the epoch of the stop.

    Missing values bring no gain.  A group is folded in pieces of SPAN epochs, each a function of the
    epoch at which the gain before it led there; the functions are composed FAN at a time, so that no
    group of any length is in one row."""
    v = F.when(~F.isnan(metric), F.col(metric).cast("double"))
    epochs = numbered(log.select(*keys, *order, v.alias("__v")), keys, list(order), "__epoch").select(*keys, "__epoch", "__v")
    longest = epochs.agg(F.coalesce(F.max("__epoch"), F.lit(0))).first()[0]
    starts = epochs.where("__epoch = 1").select(*keys, F.lit(0).cast("long").alias("__epoch"), F.lit(0.0).alias("__v"))
    span = max(SPAN, patience)
    piece = F.floor(F.col("__epoch") / span)
    seen_by = F.when((F.col("__epoch") % span < patience) & (F.col("__epoch") >= span), F.array(piece, piece - 1)).otherwise(F.array(piece))
    d = epochs.unionByName(starts).withColumn("__piece", F.explode(seen_by))
    rows = F.sort_array(F.collect_list(F.struct(F.col("__epoch").alias("epoch"), F.col("__v").alias("v"))))
    d = d.groupBy(*keys, "__piece").agg(rows.alias("__rows"))
    d = d.select(*keys, "__piece", _piece_outcomes(F.col("__rows"), (F.col("__piece") + 1) * span - 1, least_gain, patience).alias("outcomes"))
    pieces = longest // span + 1
    while pieces > 1:
        several = F.sort_array(F.collect_list(F.struct("__piece", "outcomes")))
        d = d.groupBy(*keys, F.floor(F.col("__piece") / FAN).alias("__piece")).agg(several.alias("__pieces"))
        d = d.select(*keys, "__piece", _composed(F.col("__pieces")).alias("outcomes"))
        pieces = -(-pieces // FAN)
    d = d.withColumn("s", F.get("outcomes", 0)["out"])
    found = F.col("s.best_epoch") > 0
    return d.select(*keys, F.when(found, F.col("s.best")).alias("best"), F.when(found, F.col("s.best_epoch")).cast("int").alias("best_epoch"), F.col("s.stop").cast("int").alias("stop_epoch"), F.col("s.stopped").alias("stopped"))
