"""Measures of binary classifiers, from counts. Scores are first counted by value, so windows run over distinct scores,
and running totals are taken in buckets of the score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logforge.functions.ordered import in_ranges, running_totals


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted", keys: Sequence[str] = ()) -> DataFrame:
    """Counts of the four cases, for each of the keys."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    return df.groupBy(*keys).agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def metrics(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Accuracy, and precision, recall and F1 of the positive class; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    out = {"accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}
    return counts.select("*", *[F.round(v, digits).alias(k) for k, v in out.items()])


def class_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    c = confusion(df, label, predicted)
    own = c.select("*", F.lit(1).alias("class"), (F.col("tp") + F.col("fn")).alias("support"))
    other = c.select(F.col("tp").alias("tn"), F.col("fn").alias("fp"), F.col("fp").alias("fn"), F.col("tn").alias("tp"),
                     F.lit(0).alias("class"), (F.col("tn") + F.col("fp")).alias("support"))
    return metrics(own.unionByName(other)).select("class", "precision", "recall", "f1", "support")


def _by_score(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores, highest first, with positives and negatives at or over each, and in total, within keys. Running
    totals are taken in ranges of the scores that are of one size, however near each other scores are."""
    n = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    n = in_ranges(n, F.desc("score"))
    run = running_totals(n, F.col("range"), [F.desc("score")], {"tp": F.col("p"), "fp": F.col("q")}, keys).drop("range")
    total = n.groupBy(*keys).agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    return run.join(F.broadcast(total), list(keys)) if keys else run.crossJoin(F.broadcast(total))  # a row for each of few keys


def _previous(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the values of the next higher score, 0 for the highest: what the row itself adds is taken off."""
    own = {"tp": "p", "fp": "q"}
    return df.withColumns({f"before_{n}": F.col(n) - F.col(own[n]) for n in names})


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, tpr, fpr) at each distinct score."""
    return _by_score(df, label, score).select("score", _ratio(F.col("tp"), F.col("pos")).alias("tpr"), _ratio(F.col("fp"), F.col("neg")).alias("fpr"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by trapezoids, ties included; null with one class only. One row for each of the keys."""
    step = F.col("q") * (F.col("tp") + F.col("before_tp")) / 2.0
    return _previous(_by_score(df, label, score, keys), ["tp"]).groupBy(*keys).agg(F.try_divide(F.sum(step), F.first("pos") * F.first("neg")).alias("auc"))


def pr_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return _by_score(df, label, score).select("score", _ratio(F.col("tp"), F.col("pos")).alias("recall"), _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Sum of the gains in recall times the precision there; null without positives. One row for each of the keys."""
    gain = F.col("p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return _by_score(df, label, score, keys).where("pos > 0").groupBy(*keys).agg(F.sum(gain).alias("average_precision"))


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score", low: float = 0.01, high: float = 0.99, steps: int = 200) -> DataFrame:
    """(threshold, f1) for evenly spaced thresholds, predicting 1 at or over them: one pass over the rows, which are
    counted by how many thresholds they reach."""
    at = [low + (high - low) * k / (steps - 1) for k in range(steps)]
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in at]), lambda t: t <= F.col(score)))
    n = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(reached.alias("k")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    spine = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    down = Window.partitionBy().orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # steps + 1 rows
    run = spine.join(n, "k", "left").select("k", F.sum(F.coalesce("p", F.lit(0))).over(down).alias("tp"), F.sum(F.coalesce("q", F.lit(0))).over(down).alias("fp"),
                                            F.sum(F.coalesce("p", F.lit(0))).over(Window.partitionBy()).alias("pos"))
    threshold = F.get(F.array(*[F.lit(t) for t in at]), F.col("k") - 1)
    return run.where("k > 0").select(threshold.alias("threshold"), _ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first of the thresholds with the highest F1."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)
