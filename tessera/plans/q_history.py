"""Registered run-history queries.

The history they query is derived from the tables: one evaluation run per
``l_linenumber`` segment of lineitem (segments 1-4 score the binary price
rule, 5-7 the price-on-quantity regression), so its work grows with lineitem.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tessera.operators import evaluate as E  # noqa: F401
from tessera.operators import history as H
from tessera.plans.registry import query, rounded, table
from tessera.session import shared_dir
from tessera.sources.history_store import HistoryStore

METRICS = ["accuracy", "precision", "recall", "f1", "mse", "rmse", "mae", "r2"]


def _uuid_of(text):
    h = F.md5(text)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def segment_runs(spark, sf):
    li = table(spark, sf, "lineitem")
    d = li.select(F.col("l_linenumber").alias("seg"), (F.col("l_quantity") > 25).cast("int").alias("y"),
                  (F.col("l_extendedprice") > 38000).cast("int").alias("p"),
                  (F.col("l_extendedprice") / 1000.0).alias("ry"), F.col("l_quantity").alias("rx"), "l_shipdate")
    fit = d.agg(F.regr_slope("ry", "rx").alias("b"), F.regr_intercept("ry", "rx").alias("a"))
    d = d.crossJoin(F.broadcast(fit)).withColumn("rp", F.col("a") + F.col("b") * F.col("rx"))
    err = F.col("ry") - F.col("rp")
    s = d.groupBy("seg").agg(
        F.max("l_shipdate").alias("ts"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("y") == F.col("p")).alias("ok"),
        F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"),
        F.count_if((F.col("y") != 1) & (F.col("p") == 1)).alias("fp"),
        F.count_if((F.col("y") == 1) & (F.col("p") != 1)).alias("fn"),
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.sum(err * err).alias("sse"),
        (F.var_pop("ry") * F.count("ry")).alias("sst"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    r = lambda c: F.round(c.cast("double"), 6)
    cls_m = F.create_map(F.lit("accuracy"), r(F.col("ok") / F.col("n")),
                         F.lit("precision"), r(F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0))),
                         F.lit("recall"), r(F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0))),
                         F.lit("f1"), r(F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))))
    reg_m = F.create_map(F.lit("mse"), r(F.col("mse")), F.lit("rmse"), r(F.sqrt("mse")), F.lit("mae"), r(F.col("mae")),
                         F.lit("r2"), r(1 - F.col("sse") / F.col("sst")))
    cls = F.col("seg") <= 4
    return s.select(
        _uuid_of(F.concat(F.lit("run-"), F.col("seg").cast("string"))).alias("model_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        H.run_name(F.when(cls, "Rule Classifier").otherwise("Linear Regression"), F.col("ts")).alias("model_name"),
        F.when(cls, "Classification").otherwise("Regression").alias("model_type"),
        F.when(F.col("seg") % 2 == 1, "lineitem").otherwise("lineitem_even").alias("dataset_name"),
        F.when(cls, F.array(F.lit("l_extendedprice"))).otherwise(
            F.array(*[F.lit(x) for x in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])).alias("features"),
        F.when(cls, "l_quantity_gt_25").otherwise("l_extendedprice").alias("target"),
        F.when(cls, cls_m).otherwise(reg_m).alias("metrics"),
        F.when(cls, F.create_map(F.lit("threshold"), F.lit("38000"), F.lit("positive"), F.lit("1"))).otherwise(
            F.create_map(F.lit("fit_intercept"), F.lit("true"), F.lit("scale"), F.lit("0.001"))).alias("parameters"))


def _id_sql(seg):
    h = f"md5('run-' || {seg})"
    return (f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), "
            f"substr({h}, 21, 12))")


RUNS_SQL = f"""
WITH d AS (SELECT l_linenumber AS seg, CAST(l_quantity > 25 AS INTEGER) AS y,
                  CAST(l_extendedprice > 38000 AS INTEGER) AS p, l_extendedprice / 1000.0 AS ry,
                  l_quantity AS rx, l_shipdate FROM lineitem),
fit AS (SELECT regr_slope(ry, rx) AS b, regr_intercept(ry, rx) AS a FROM d),
e AS (SELECT d.*, ry - (a + b * rx) AS err FROM d, fit),
s AS (SELECT seg, max(l_shipdate) AS ts, count(*) AS n, count_if(y = p) AS ok,
             count_if(y = 1 AND p = 1) AS tp, count_if(y <> 1 AND p = 1) AS fp, count_if(y = 1 AND p <> 1) AS fn,
             avg(err * err) AS mse, avg(abs(err)) AS mae, sum(err * err) AS sse,
             var_pop(ry) * count(ry) AS sst FROM e GROUP BY seg),
runs AS (
  SELECT {_id_sql('seg')} AS model_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
         CASE WHEN seg <= 4 THEN 'Rule Classifier' ELSE 'Linear Regression' END || '_' || strftime(ts, '%Y%m%d_%H%M%S')
           AS model_name,
         CASE WHEN seg <= 4 THEN 'Classification' ELSE 'Regression' END AS model_type,
         CASE WHEN seg % 2 = 1 THEN 'lineitem' ELSE 'lineitem_even' END AS dataset_name,
         CASE WHEN seg <= 4 THEN ['l_extendedprice'] ELSE ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'] END
           AS features,
         CASE WHEN seg <= 4 THEN 'l_quantity_gt_25' ELSE 'l_extendedprice' END AS target,
         CASE WHEN seg <= 4 THEN 'threshold=38000+positive=1' ELSE 'fit_intercept=true+scale=0.001' END AS params,
         CASE WHEN seg <= 4 THEN round(ok / n, 6) END AS metric_accuracy,
         CASE WHEN seg <= 4 THEN round(coalesce(tp / nullif(tp + fp, 0), 0), 6) END AS metric_precision,
         CASE WHEN seg <= 4 THEN round(coalesce(tp / nullif(tp + fn, 0), 0), 6) END AS metric_recall,
         CASE WHEN seg <= 4 THEN round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) END AS metric_f1,
         CASE WHEN seg > 4 THEN round(mse, 6) END AS metric_mse,
         CASE WHEN seg > 4 THEN round(sqrt(mse), 6) END AS metric_rmse,
         CASE WHEN seg > 4 THEN round(mae, 6) END AS metric_mae,
         CASE WHEN seg > 4 THEN round(1 - sse / sst, 6) END AS metric_r2,
         seg
  FROM s)"""
_WIDE_COLS = ("model_id, timestamp, model_name, model_type, dataset_name, target, "
              "CAST(len(features) AS INTEGER) AS n_features, " + ", ".join(f"metric_{m}" for m in METRICS))


def _wide(spark, sf):
    return H.history_wide(segment_runs(spark, sf), METRICS)


@query("hist_wide", f"{RUNS_SQL} SELECT {_WIDE_COLS} FROM runs")
def hist_wide(spark, sf):
    return H.history_wide(segment_runs(spark, sf))


def _seg_id(seg):
    import hashlib
    h = hashlib.md5(f"run-{seg}".encode()).hexdigest()
    return "-".join((h[0:8], h[8:12], h[12:16], h[16:20], h[20:32]))


@query("hist_get", f"""{RUNS_SQL}
SELECT model_id, timestamp, model_name, model_type, dataset_name, target,
       array_to_string(features, ',') AS features, CAST(4 AS INTEGER) AS n_metrics
FROM runs WHERE model_id = '{_seg_id(3)}'""")
def hist_get(spark, sf):
    h = H.get_model(segment_runs(spark, sf), _seg_id(3))
    return h.select(*H.SCALARS, F.array_join("features", ",").alias("features"), F.size("metrics").alias("n_metrics"))


_COMPARE_IDS = [_seg_id(5), _seg_id(2), "00000000-0000-0000-0000-000000000000", _seg_id(2)]


@query("hist_compare", f"""{RUNS_SQL}
SELECT CAST(i.pos AS INTEGER) AS pos, r.model_id, model_name, dataset_name AS dataset, timestamp,
       {", ".join(f"metric_{m} AS {m}" for m in METRICS)}
FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(_COMPARE_IDS))}) AS i(pos, model_id)
JOIN runs r ON r.model_id = i.model_id""")
def hist_compare(spark, sf):
    return H.compare_models(segment_runs(spark, sf), _COMPARE_IDS, METRICS)


@query("hist_filter", f"""{RUNS_SQL}
SELECT {_WIDE_COLS} FROM runs
WHERE split_part(model_name, '_', 1) IN ('Linear Regression') AND dataset_name IN ('lineitem')
  AND target IN ('l_extendedprice')""")
def hist_filter(spark, sf):
    h = H.filter_history(segment_runs(spark, sf), ["Linear Regression"], ["lineitem"], ["l_extendedprice"])
    return H.history_wide(h, METRICS)


@query("hist_sorted", f"""{RUNS_SQL}
SELECT {_WIDE_COLS},
       CAST(row_number() OVER (ORDER BY metric_accuracy DESC NULLS LAST, model_id) AS INTEGER) AS position
FROM runs""")
def hist_sorted(spark, sf):
    return H.sort_history(_wide(spark, sf), "metric_accuracy", ascending=False)


@query("hist_delete", f"""{RUNS_SQL}
SELECT model_id, model_name FROM runs WHERE model_id <> '{_seg_id(4)}'""")
def hist_delete(spark, sf):
    return H.delete_model(segment_runs(spark, sf), _seg_id(4)).select("model_id", "model_name")


@query("hist_run_name", f"""{RUNS_SQL}
SELECT model_id, model_type || '_' || strftime(CAST(timestamp AS TIMESTAMP), '%Y%m%d_%H%M%S') AS run_name
FROM runs""")
def hist_run_name(spark, sf):
    h = segment_runs(spark, sf)
    return h.select("model_id", H.run_name(F.col("model_type"), F.to_timestamp("timestamp")).alias("run_name"))


_DIGEST_FEATS = ("substr(array_to_string(list_sort(features), '+'), 1, 30) || "
                 "CASE WHEN length(array_to_string(features, '+')) > 30 THEN '...' ELSE '' END")
_DIGEST_PARAMS = "substr(params, 1, 30) || CASE WHEN length(params) > 30 THEN '...' ELSE '' END"


@query("hist_digest", f"""{RUNS_SQL}
SELECT model_id, {_DIGEST_FEATS} AS features_used, {_DIGEST_PARAMS} AS parameters FROM runs""")
def hist_digest(spark, sf):
    return H.digest(segment_runs(spark, sf))


_TITLES = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1", "mse": "Mse",
           "rmse": "Rmse", "mae": "Mae", "r2": "R2"}


@query("hist_display", f"""{RUNS_SQL}
SELECT model_name AS "Model", strftime(CAST(timestamp AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS "Trained At",
       dataset_name AS "Dataset", target AS "Target", {_DIGEST_FEATS} AS "Features",
       {_DIGEST_PARAMS} AS "Parameters", {", ".join(f'metric_{m} AS "{t}"' for m, t in _TITLES.items())}
FROM runs""")
def hist_display(spark, sf):
    runs = segment_runs(spark, sf)
    return H.display(H.history_wide(runs, METRICS), extra=H.digest(runs))


def _store(spark, name):
    return HistoryStore(spark, os.path.join(shared_dir(spark), f"history-{name}-{os.urandom(4).hex()}"))


@query("hist_scan", f"{RUNS_SQL} SELECT {_WIDE_COLS} FROM runs")
def hist_scan(spark, sf):
    """Write the derived runs to a history store in the shared folder and scan them back."""
    store = _store(spark, "scan")
    store.append_runs(segment_runs(spark, sf))
    return H.history_wide(store.read(), METRICS)


@query("hist_append", f"""{RUNS_SQL},
o AS (SELECT o_totalprice / 1000.0 AS y FROM orders)
SELECT model_name, model_type, dataset_name, target, CAST(len(features) AS INTEGER) AS n_features,
       {", ".join(f"metric_{m}" for m in METRICS)} FROM runs WHERE seg <> 1
UNION ALL
SELECT 'Baseline_zero', 'Regression', 'orders', 'o_totalprice', 1, {", ".join({
    "mse": "round(avg(y * y), 6)", "rmse": "round(sqrt(avg(y * y)), 6)", "mae": "round(avg(abs(y)), 6)",
    "r2": "round(1 - sum(y * y) / (var_pop(y) * count(y)), 6)"}.get(m, "NULL") for m in METRICS)} FROM o""")
def hist_append(spark, sf):
    """Append the derived runs plus one recorded run, delete one, read the result."""
    store = _store(spark, "append")
    store.append_runs(segment_runs(spark, sf))
    m = E.regression_metrics(table(spark, sf, "orders").select(
        (F.col("o_totalprice") / 1000.0).alias("y"), F.lit(0.0).alias("p")), "y", "p").first().asDict()
    store.add_model({"model_name": "Baseline_zero", "model_type": "Regression"}, m, "orders", ["o_totalprice"],
                    "o_totalprice", {"constant": 0.0})
    store.delete_model(_seg_id(1))
    return rounded(H.history_wide(store.read(), METRICS).drop("model_id", "timestamp"))
