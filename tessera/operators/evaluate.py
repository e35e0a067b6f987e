"""Evaluation of predictions: metrics, confusion matrix, ROC / AUC, residuals.

Every metric is an aggregate over the prediction rows.  Class-level metrics
first count (label, prediction) pairs - at most classes^2 rows leave the map
side - and ROC points are built from per-score counts with the bucketed
prefix sum, so no step needs a global single-task window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import ratio_or_zero, stack_rows
from tessera.functions.ranking import prefix_sums

# Metric names and display labels of the metric table.
CLASSIFICATION_METRICS = [("accuracy", "Accuracy"), ("precision", "Precision"),
                          ("recall", "Recall"), ("f1", "F1 Score")]
REGRESSION_METRICS = [("mse", "MSE"), ("rmse", "RMSE"), ("mae", "MAE"), ("r2", "R² Score")]


def _rows_if(cond: Column, weight: str | None) -> Column:
    """The count of rows that meet a condition, each standing for ``weight`` rows where that is given."""
    return F.count_if(cond) if weight is None else F.coalesce(F.sum(F.when(cond, F.col(weight))), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, pred: str, positive=1, weight: str | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 for one positive label (0 on a zero denominator)."""
    y, p = F.col(label), F.col(pred)
    pos = F.lit(positive)
    one = df.agg(_rows_if(F.lit(True), weight).alias("n"), _rows_if(y == p, weight).alias("ok"),
                 _rows_if((y == pos) & (p == pos), weight).alias("tp"),
                 _rows_if((y != pos) & (p == pos), weight).alias("fp"),
                 _rows_if((y == pos) & (p != pos), weight).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.select(ratio_or_zero(F.col("ok"), F.col("n")).alias("accuracy"),
                      ratio_or_zero(tp, tp + fp).alias("precision"),
                      ratio_or_zero(tp, tp + fn).alias("recall"),
                      ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"))


def class_counts(df: DataFrame, label: str, pred: str, weight: str | None = None) -> DataFrame:
    """(cls, support, predicted, tp) over the union of labels seen in either column."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight).cast("bigint")
    pairs = df.groupBy(F.col(label).alias("_y"), F.col(pred).alias("_p")).agg(n.alias("_n"))
    per = pairs.select(F.inline(F.array(
        F.struct(F.col("_y").alias("cls"), F.col("_n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0).alias("tp")),
        F.struct(F.col("_p").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("_n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")))))
    return per.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])


def weighted_metrics(df: DataFrame, label: str, pred: str, weight: str | None = None) -> DataFrame:
    """accuracy and support-weighted precision / recall / f1 (multiclass average)."""
    cc = class_counts(df, label, pred, weight)
    s, p, tp = F.col("support"), F.col("predicted"), F.col("tp")
    per = cc.select(s, tp, ratio_or_zero(tp, p).alias("prec"), ratio_or_zero(tp, s).alias("rec"),
                    ratio_or_zero(2 * tp, s + p).alias("f1c"))
    n = F.sum("support")
    return per.agg(ratio_or_zero(F.sum("tp"), n).alias("accuracy"),
                   ratio_or_zero(F.sum(F.col("support") * F.col("prec")), n).alias("precision"),
                   ratio_or_zero(F.sum(F.col("support") * F.col("rec")), n).alias("recall"),
                   ratio_or_zero(F.sum(F.col("support") * F.col("f1c")), n).alias("f1"))


def classification_metrics(df: DataFrame, label: str, pred: str, n_classes: int, positive=1) -> DataFrame:
    """Binary metrics when the whole target has two labels, weighted otherwise."""
    return binary_metrics(df, label, pred, positive) if n_classes <= 2 else weighted_metrics(df, label, pred)


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """mse, rmse, mae, r2 (r2 = 1 - SSE/SST; SST = 0 gives 1 if SSE = 0 else 0)."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    one = df.agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
                 F.sum((y - p) * (y - p)).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"))
    r2 = (F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("sse") / F.col("sst")))
    return one.select("mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def metric_table(metrics: DataFrame, classification: bool) -> DataFrame:
    """(position, metric, value) in display order."""
    names = CLASSIFICATION_METRICS if classification else REGRESSION_METRICS
    return stack_rows(metrics, [{"position": F.lit(i + 1), "metric": F.lit(label), "value": F.col(k)}
                                for i, (k, label) in enumerate(names)])


def confusion_long(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(actual, predicted, count) dense over the labels seen in either column, zeros included."""
    pairs = df.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))
    labels = pairs.select(F.array_sort(F.array_distinct(F.flatten(F.collect_list(
        F.array("actual", "predicted"))))).alias("_l"))  # classes^2 pairs at most
    grid = labels.select(F.explode("_l").alias("actual"), "_l").select("actual", F.explode("_l").alias("predicted"))
    return grid.join(pairs, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def _score_counts(df: DataFrame, label: Column, score: Column, positive, groups: Sequence[Column] = ()) -> DataFrame:
    return (df.where(score.isNotNull() & label.isNotNull())
            .groupBy(*groups, score.cast("double").alias("score"))
            .agg(F.count_if(label == F.lit(positive)).alias("tp"), F.count_if(label != F.lit(positive)).alias("fp")))


def roc_curve(df: DataFrame, label: str, score: str, positive=1, drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score, descending, plus the
    origin (threshold NULL).  ``drop_intermediate`` keeps the first and last
    points and those where the step to the next point changes."""
    counts = _score_counts(df, F.col(label), F.col(score), positive)
    cum = prefix_sums(counts, "score", ["tp", "fp"], descending=True, lead=["tp", "fp"] if drop_intermediate else (),
                      materialize=True)  # per-score counts: computed once, not once per branch
    totals = cum.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))  # from the materialised counts: no rescan
    pts = cum.crossJoin(F.broadcast(totals))  # one row
    if drop_intermediate:
        first = (F.col("tp_cum") == F.col("tp")) & (F.col("fp_cum") == F.col("fp"))
        last = F.col("tp_next").isNull()
        changes = (F.col("tp_next") != F.col("tp")) | (F.col("fp_next") != F.col("fp"))
        pts = pts.where(first | last | changes)
    rate = lambda c, tot: (F.col(c) / F.nullif(F.col(tot), F.lit(0))).cast("double")
    points = pts.select(F.col("score").alias("threshold"), rate("fp_cum", "N").alias("fpr"),
                        rate("tp_cum", "P").alias("tpr"))
    origin = totals.select(F.lit(None).cast("double").alias("threshold"),
                           (F.lit(0.0) / F.nullif(F.col("N"), F.lit(0))).alias("fpr"),
                           (F.lit(0.0) / F.nullif(F.col("P"), F.lit(0))).alias("tpr"))
    return origin.unionByName(points)


def _auc_from_counts(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    cum = prefix_sums(counts, "score", ["tp"], groups=groups, descending=True, materialize=True)
    area = F.sum(F.col("fp") * (2 * (F.col("tp_cum") - F.col("tp")) + F.col("tp")))
    return cum.groupBy(*groups).agg(
        (area / F.nullif(2.0 * F.sum("tp") * F.sum("fp"), F.lit(0.0))).alias("auc"))


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Trapezoid area under the ROC curve (NULL when one class is absent)."""
    return _auc_from_counts(_score_counts(df, F.col(label), F.col(score), positive))


def roc_one_vs_rest(df: DataFrame, label: str, probability: str, class_names: Sequence[str]) -> DataFrame:
    """Per class (one-vs-rest on the class code): class_index, class_name, auc and
    the curve label ``name (AUC = x.xxx)``; ``probability`` is an array column."""
    long = df.select(F.col(label).alias("_y"), F.posexplode(probability).alias("class_index", "_s"))
    counts = _score_counts(long, (F.col("_y") == F.col("class_index")).cast("int"), F.col("_s"), 1,
                           groups=[F.col("class_index")])
    auc = _auc_from_counts(counts, ["class_index"])
    names = F.element_at(F.array(*[F.lit(n) for n in class_names]), F.col("class_index") + 1)
    return auc.select(F.col("class_index").cast("int"), names.alias("class_name"), "auc",
                      F.format_string("%s (AUC = %.3f)", names, F.col("auc")).alias("curve_label"))


def roc_curves_one_vs_rest(df: DataFrame, label: str, probability: str, class_names: Sequence[str],
                           drop_intermediate: bool = True) -> DataFrame:
    """(class_index, class_name, threshold, fpr, tpr): the points of each class's one-vs-rest curve, as ``roc_curve`` gives
    them, with the origin (threshold NULL)."""
    long = df.select(F.col(label).alias("_y"), F.posexplode(probability).alias("class_index", "_s"))
    counts = _score_counts(long, (F.col("_y") == F.col("class_index")).cast("int"), F.col("_s"), 1,
                           groups=[F.col("class_index")])
    cum = prefix_sums(counts, "score", ["tp", "fp"], groups=["class_index"], descending=True,
                      lead=["tp", "fp"] if drop_intermediate else (), materialize=True)
    totals = cum.groupBy("class_index").agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))  # one row per class
    pts = cum.join(totals, "class_index")
    if drop_intermediate:
        first = (F.col("tp_cum") == F.col("tp")) & (F.col("fp_cum") == F.col("fp"))
        changes = (F.col("tp_next") != F.col("tp")) | (F.col("fp_next") != F.col("fp"))
        pts = pts.where(first | F.col("tp_next").isNull() | changes)
    rate = lambda c, tot: (c / F.nullif(F.col(tot), F.lit(0))).cast("double")
    points = pts.select("class_index", F.col("score").alias("threshold"), rate(F.col("fp_cum"), "N").alias("fpr"), rate(F.col("tp_cum"), "P").alias("tpr"))
    origin = totals.select("class_index", F.lit(None).cast("double").alias("threshold"), rate(F.lit(0.0), "N").alias("fpr"), rate(F.lit(0.0), "P").alias("tpr"))
    names = F.element_at(F.array(*[F.lit(n) for n in class_names]), F.col("class_index") + 1)
    return origin.unionByName(points).select(F.col("class_index").cast("int"), names.alias("class_name"), "threshold", "fpr", "tpr")


def residuals(df: DataFrame, label: str, pred: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.col(pred).alias("Predicted"), (F.col(label) - F.col(pred)).alias("Residual"))


def actual_vs_predicted_line(df: DataFrame, label: str) -> DataFrame:
    """Identity-line end points of the actual-vs-predicted chart."""
    return df.agg(F.min(label).cast("double").alias("line_min"), F.max(label).cast("double").alias("line_max"),
                  F.count(label).alias("n_points"))


def feature_importance_topk(importances: DataFrame, k: int = 10) -> DataFrame:
    """(feature, importance, position): the k largest, position 1 = smallest of them
    (the order the bar chart draws them)."""
    from pyspark.sql import Window
    top = importances.orderBy(F.desc("importance"), F.asc("feature")).limit(k)  # TakeOrderedAndProject
    return top.withColumn("position", F.row_number().over(Window.orderBy("importance", F.desc("feature"))))
