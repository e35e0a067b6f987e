"""Queries over a run-history table (one row per training / evaluation run).

The history keeps the nested shape of a run: scalar fields, the feature list
as ``array<string>``, metrics as ``map<string,double>`` (keys differ between
classification and regression runs) and parameters as ``map<string,string>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("target", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
])
SCALARS = ["model_id", "timestamp", "model_name", "model_type", "dataset_name", "target"]

# Display names of the history table columns.
DISPLAY_COLUMNS = [("model_name", "Model"), ("timestamp", "Trained At"), ("dataset_name", "Dataset"),
                   ("target", "Target"), ("features_used", "Features"), ("parameters", "Parameters")]
DIGEST_WIDTH = 30


def metric_names(history: DataFrame) -> list[str]:
    """Metric keys in order of first appearance (by timestamp, then map position).
    Driver-side list, bounded by the number of distinct metric names."""
    keys = (history.select("timestamp", F.posexplode(F.map_keys("metrics")).alias("pos", "key"))
            .groupBy("key").agg(F.min(F.struct("timestamp", "pos")).alias("first")).collect())
    return [r.key for r in sorted(keys, key=lambda r: (r.first[0] or "", r.first[1], r.key))]


def history_wide(history: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Scalars + n_features + one ``metric_<name>`` column per metric (NULL when absent)."""
    names = list(metrics) if metrics is not None else metric_names(history)
    return history.select(*SCALARS, F.size("features").alias("n_features"),
                          *[F.col("metrics")[k].alias(f"metric_{k}") for k in names])


def get_model(history: DataFrame, model_id: str) -> DataFrame:
    """The entry with this id (at most one row; empty when unknown)."""
    return history.where(F.col("model_id") == model_id).limit(1)


def compare_models(history: DataFrame, model_ids: Sequence[str], metrics: Sequence[str] | None = None) -> DataFrame:
    """One row per requested id in the given order (duplicates kept, unknown
    ids dropped): pos, model_id, model_name, dataset, timestamp + raw metric names."""
    names = list(metrics) if metrics is not None else metric_names(history)
    spark = history.sparkSession
    ids = spark.createDataFrame(list(enumerate(model_ids)), "pos int, model_id string")
    j = F.broadcast(ids).join(history, "model_id")  # the id list is the caller's, bounded
    return j.select("pos", "model_id", "model_name", F.col("dataset_name").alias("dataset"), "timestamp",
                    *[F.col("metrics")[k].alias(k) for k in names])


def base_name(model_name: Column) -> Column:
    return F.split_part(model_name, F.lit("_"), F.lit(1))


def filter_history(history: DataFrame, base_names: Sequence[str] | None = None,
                   datasets: Sequence[str] | None = None, targets: Sequence[str] | None = None) -> DataFrame:
    cond = F.lit(True)
    if base_names is not None:
        cond &= base_name(F.col("model_name")).isin(list(base_names))
    if datasets is not None:
        cond &= F.col("dataset_name").isin(list(datasets))
    if targets is not None:
        cond &= F.col("target").isin(list(targets))
    return history.where(cond)


def sort_history(wide: DataFrame, metric_column: str, ascending: bool = False) -> DataFrame:
    """Adds ``position`` in the order of ``metric_column`` (missing last, id breaks ties).
    The run history holds one row per training run, so this window is small."""
    key = F.asc_nulls_last(metric_column) if ascending else F.desc_nulls_last(metric_column)
    return wide.withColumn("position", F.row_number().over(Window.orderBy(key, "model_id")).cast("int"))


def delete_model(history: DataFrame, model_id: str) -> DataFrame:
    """History without the entry (anti-filter; ids are unique)."""
    return history.where(F.col("model_id") != model_id)


def run_name(name: Column, ts: Column) -> Column:
    """``name_YYYYmmdd_HHMMSS``."""
    return F.concat_ws("_", name, F.date_format(ts, "yyyyMMdd_HHmmss"))


def digest(history: DataFrame) -> DataFrame:
    """model_id, features_used, parameters: sorted features joined by '+', cut
    at 30 characters with '...' when the joined list is longer; parameters
    ``k=v`` in map order joined by '+', cut the same way (the cut test uses the
    joined text's length for both)."""
    feats = F.array_join(F.array_sort("features"), "+")
    raw = F.array_join(F.col("features"), "+")
    params = F.array_join(F.transform(F.map_entries("parameters"),
                                      lambda e: F.concat(e["key"], F.lit("="), e["value"])), "+")
    cut = lambda s, full: F.concat(F.substring(s, 1, DIGEST_WIDTH),
                                   F.when(F.length(full) > DIGEST_WIDTH, F.lit("...")).otherwise(F.lit("")))
    return history.select("model_id", cut(feats, raw).alias("features_used"), cut(params, params).alias("parameters"))


def display(wide: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Renamed / reordered present columns; timestamp as ``YYYY-MM-DD HH:MM:SS``;
    ``metric_x_y`` shown as ``X Y``."""
    df = wide if extra is None else wide.join(extra, "model_id", "left")
    cols = []
    for c, label in DISPLAY_COLUMNS:
        if c in df.columns:
            v = F.date_format(F.to_timestamp(c), "yyyy-MM-dd HH:mm:ss") if c == "timestamp" else F.col(c)
            cols.append(v.alias(label))
    for c in df.columns:
        if c.startswith("metric_"):
            cols.append(F.col(c).alias(c[len("metric_"):].replace("_", " ").title()))
    return df.select(*cols)
