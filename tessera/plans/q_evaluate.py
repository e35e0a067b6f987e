"""Registered evaluation queries over rule-based scorers (exact oracles, no training)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import correlate as C
from tessera.operators import evaluate as E
from tessera.operators import prepare as K
from tessera.operators import split as S
from tessera.plans.q_prepare import LI_KEY, P_BRANDS, P_TYPES
from tessera.plans.registry import query, rounded, table

_KEY_SQL = ", ".join(LI_KEY)


# ---- binary scorer: y = quantity above 25, score = extended price, pred = score above 38000
def _binary(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*LI_KEY, (F.col("l_quantity") > 25).cast("int").alias("y"),
                     F.col("l_extendedprice").alias("score"),
                     (F.col("l_extendedprice") > 38000).cast("int").alias("pred"))


_BIN_SQL = f"""SELECT {_KEY_SQL}, CAST(l_quantity > 25 AS INTEGER) AS y, l_extendedprice AS score,
                      CAST(l_extendedprice > 38000 AS INTEGER) AS pred FROM lineitem"""


@query("eval_classification_binary", f"""
WITH b AS ({_BIN_SQL}),
c AS (SELECT count(*) AS n, count_if(y = pred) AS ok, count_if(y = 1 AND pred = 1) AS tp,
             count_if(y <> 1 AND pred = 1) AS fp, count_if(y = 1 AND pred <> 1) AS fn FROM b)
SELECT round(coalesce(ok / nullif(n, 0), 0), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def eval_classification_binary(spark, sf):
    return rounded(E.binary_metrics(_binary(spark, sf), "y", "pred"))


# ---- 3-class scorer on the return flag
def _multi(spark, sf):
    li = table(spark, sf, "lineitem")
    pred = (F.when(F.col("l_discount") >= 0.05, "A").when(F.col("l_tax") >= 0.04, "N").otherwise("R"))
    return li.select(*LI_KEY, "l_returnflag", pred.alias("pred"))


_MULTI_SQL = f"""SELECT {_KEY_SQL}, l_returnflag,
  CASE WHEN l_discount >= 0.05 THEN 'A' WHEN l_tax >= 0.04 THEN 'N' ELSE 'R' END AS pred FROM lineitem"""


@query("eval_classification_weighted", f"""
WITH m AS ({_MULTI_SQL}),
pairs AS (SELECT l_returnflag AS y, pred AS p, count(*) AS n FROM m GROUP BY ALL),
cls AS (SELECT y AS c FROM pairs UNION SELECT p FROM pairs),
per AS (SELECT c,
          coalesce((SELECT sum(n) FROM pairs WHERE y = c), 0) AS s,
          coalesce((SELECT sum(n) FROM pairs WHERE p = c), 0) AS pr,
          coalesce((SELECT sum(n) FROM pairs WHERE y = c AND p = c), 0) AS tp FROM cls),
r AS (SELECT s, tp, coalesce(tp / nullif(pr, 0), 0) AS prec, coalesce(tp / nullif(s, 0), 0) AS rec,
             coalesce(2 * tp / nullif(s + pr, 0), 0) AS f1c FROM per)
SELECT round(sum(tp) / sum(s), 6) AS accuracy, round(sum(s * prec) / sum(s), 6) AS precision,
       round(sum(s * rec) / sum(s), 6) AS recall, round(sum(s * f1c) / sum(s), 6) AS f1 FROM r""")
def eval_classification_weighted(spark, sf):
    return rounded(E.weighted_metrics(_multi(spark, sf), "l_returnflag", "pred"))


@query("eval_confusion", f"""
WITH m AS ({_MULTI_SQL}),
l AS (SELECT l_returnflag AS c FROM m UNION SELECT pred FROM m)
SELECT a.c AS actual, p.c AS predicted, count(m.l_returnflag) AS count
FROM l a CROSS JOIN l p LEFT JOIN m ON m.l_returnflag = a.c AND m.pred = p.c
GROUP BY a.c, p.c""")
def eval_confusion(spark, sf):
    return E.confusion_long(_multi(spark, sf), "l_returnflag", "pred")


# ---- regression scorer: price / 1000 on quantity, fitted in the same plan
def _regression(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_KEY, (F.col("l_extendedprice") / 1000.0).alias("y"),
                                             F.col("l_quantity").alias("x"))
    fit = li.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    scored = li.crossJoin(F.broadcast(fit)).withColumn("pred", F.col("a") + F.col("b") * F.col("x"))
    return S.with_split(scored, LI_KEY)


_SPLIT_SQL = ("('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), "
              "CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), '42')), 1, 8))::BIGINT")
_REG_SQL = f"""
WITH li AS (SELECT {_KEY_SQL}, l_extendedprice / 1000.0 AS y, l_quantity AS x FROM lineitem),
fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM li)
SELECT li.*, a + b * x AS pred, {_SPLIT_SQL} < {S.test_threshold(0.2)} AS is_test FROM li, fit"""


@query("eval_regression", f"""
WITH r AS ({_REG_SQL})
SELECT round(avg((y - pred) * (y - pred)), 6) AS mse, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
       round(avg(abs(y - pred)), 6) AS mae,
       round(CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum((y - pred) * (y - pred)) = 0 THEN 1.0 ELSE 0.0 END
                  ELSE 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y)) END, 6) AS r2
FROM r""")
def eval_regression(spark, sf):
    return rounded(E.regression_metrics(_regression(spark, sf), "y", "pred"))


@query("eval_metric_table", f"""
WITH r AS ({_REG_SQL} ), t AS (SELECT * FROM r WHERE is_test),
m AS (SELECT avg((y - pred) * (y - pred)) AS mse, avg(abs(y - pred)) AS mae,
             1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y)) AS r2 FROM t)
SELECT * FROM (VALUES (1, 'MSE'), (2, 'RMSE'), (3, 'MAE'), (4, 'R² Score')) AS k(position, metric),
LATERAL (SELECT round(CASE k.position WHEN 1 THEN mse WHEN 2 THEN sqrt(mse) WHEN 3 THEN mae ELSE r2 END, 6)
         AS value FROM m)""")
def eval_metric_table(spark, sf):
    test = _regression(spark, sf).where("is_test")
    return rounded(E.metric_table(E.regression_metrics(test, "y", "pred"), classification=False))


@query("pred_table", f"""
WITH r AS ({_REG_SQL})
SELECT {_KEY_SQL}, round(y, 6) AS Actual, round(pred, 6) AS Predicted FROM r WHERE is_test""")
def pred_table(spark, sf):
    test = _regression(spark, sf).where("is_test")
    return rounded(test.select(*LI_KEY, F.col("y").alias("Actual"), F.col("pred").alias("Predicted")))


@query("eval_actual_vs_pred", f"""
WITH r AS ({_REG_SQL})
SELECT round(min(y), 6) AS line_min, round(max(y), 6) AS line_max, count(y) AS n_points FROM r WHERE is_test""")
def eval_actual_vs_pred(spark, sf):
    return rounded(E.actual_vs_predicted_line(_regression(spark, sf).where("is_test"), "y"))


@query("eval_residuals", f"""
WITH r AS ({_REG_SQL})
SELECT {_KEY_SQL}, round(pred, 6) AS Predicted, round(y - pred, 6) AS Residual FROM r WHERE is_test""")
def eval_residuals(spark, sf):
    return rounded(E.residuals(_regression(spark, sf).where("is_test"), "y", "pred", keep=LI_KEY))


# ---- ROC / AUC on the binary scorer
_ROC_CTE = f"""
b AS ({_BIN_SQL}),
c AS (SELECT CAST(score AS DOUBLE) AS score, count_if(y = 1) AS tp, count_if(y <> 1) AS fp FROM b GROUP BY 1),
s AS (SELECT score, tp, fp,
             sum(tp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp_cum,
             sum(fp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp_cum,
             lead(tp) OVER (ORDER BY score DESC) AS tp_next, lead(fp) OVER (ORDER BY score DESC) AS fp_next,
             row_number() OVER (ORDER BY score DESC) AS rn FROM c),
t AS (SELECT sum(tp) AS P, sum(fp) AS N FROM c)"""


@query("eval_roc", f"""
WITH {_ROC_CTE}
SELECT CAST(NULL AS DOUBLE) AS threshold, round(0.0 / nullif(N, 0), 6) AS fpr, round(0.0 / nullif(P, 0), 6) AS tpr
FROM t
UNION ALL
SELECT score, round(fp_cum / nullif(N, 0), 6), round(tp_cum / nullif(P, 0), 6) FROM s, t
WHERE rn = 1 OR tp_next IS NULL OR tp_next <> tp OR fp_next <> fp""")
def eval_roc(spark, sf):
    return rounded(E.roc_curve(_binary(spark, sf), "y", "score"))


@query("eval_auc", f"""
WITH {_ROC_CTE}
SELECT round(sum(fp * (2 * (tp_cum - tp) + tp)) / (2.0 * sum(tp) * sum(fp)), 6) AS auc FROM s""")
def eval_auc(spark, sf):
    return rounded(E.roc_auc(_binary(spark, sf), "y", "score"))


# ---- one-vs-rest ROC on normalised rule scores for the 3 return flags
_CLASSES = ["A", "N", "R"]


def _probabilities(spark, sf):
    li = table(spark, sf, "lineitem")
    enc = K.fit_label(li, "l_returnflag")
    s0 = 1 + F.col("l_discount") * 10
    s1 = 1 + F.col("l_tax") * 10
    s2 = F.col("l_quantity") / 50
    tot = (s0 + s1) + s2
    return li.select(enc.code(li).cast("int").alias("y"), F.array(s0 / tot, s1 / tot, s2 / tot).alias("probability")), enc


_OVR_SQL = f"""
WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
                  1 + l_discount * 10 AS s0, 1 + l_tax * 10 AS s1, l_quantity / 50 AS s2 FROM lineitem),
l AS ({" UNION ALL ".join(f"SELECT {i} AS k, CAST(y = {i} AS INTEGER) AS pos, s{i} / ((s0 + s1) + s2) AS score FROM p"
                          for i in range(3))}),
c AS (SELECT k, score, count_if(pos = 1) AS tp, count_if(pos <> 1) AS fp FROM l GROUP BY ALL),
s AS (SELECT k, tp, fp, sum(tp) OVER (PARTITION BY k ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp_cum FROM c),
a AS (SELECT k, sum(fp * (2 * (tp_cum - tp) + tp)) / (2.0 * sum(tp) * sum(fp)) AS auc FROM s GROUP BY k)
SELECT CAST(k AS INTEGER) AS class_index, ['A', 'N', 'R'][k + 1] AS class_name, round(auc, 6) AS auc,
       printf('%s (AUC = %.3f)', ['A', 'N', 'R'][k + 1], auc) AS curve_label FROM a"""


@query("eval_roc_multiclass", _OVR_SQL)
def eval_roc_multiclass(spark, sf):
    probs, enc = _probabilities(spark, sf)
    return rounded(E.roc_one_vs_rest(probs, "y", "probability", [str(c) for c in enc.classes]))


@query("eval_roc_curves", f"""
WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
                  1 + l_discount * 10 AS s0, 1 + l_tax * 10 AS s1, l_quantity / 50 AS s2 FROM lineitem),
l AS ({" UNION ALL ".join(f"SELECT {i} AS k, CAST(y = {i} AS INTEGER) AS pos, s{i} / ((s0 + s1) + s2) AS score FROM p"
                          for i in range(3))}),
c AS (SELECT k, score, count_if(pos = 1) AS tp, count_if(pos <> 1) AS fp FROM l GROUP BY ALL),
s AS (SELECT *, sum(tp) OVER w AS tp_cum, sum(fp) OVER w AS fp_cum, lead(tp) OVER (PARTITION BY k ORDER BY score DESC) AS tp_next,
             lead(fp) OVER (PARTITION BY k ORDER BY score DESC) AS fp_next, row_number() OVER w AS rn FROM c
      WINDOW w AS (PARTITION BY k ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT k, sum(tp) AS P, sum(fp) AS N FROM c GROUP BY k)
SELECT CAST(k AS INTEGER) AS class_index, ['A', 'N', 'R'][k + 1] AS class_name, CAST(NULL AS DOUBLE) AS threshold,
       round(0.0 / nullif(N, 0), 6) AS fpr, round(0.0 / nullif(P, 0), 6) AS tpr FROM t
UNION ALL
SELECT CAST(k AS INTEGER), ['A', 'N', 'R'][k + 1], round(score, 6), round(fp_cum / nullif(N, 0), 6), round(tp_cum / nullif(P, 0), 6)
FROM s JOIN t USING (k) WHERE rn = 1 OR tp_next IS NULL OR tp_next <> tp OR fp_next <> fp""")
def eval_roc_curves(spark, sf):
    probs, enc = _probabilities(spark, sf)
    return rounded(E.roc_curves_one_vs_rest(probs, "y", "probability", [str(c) for c in enc.classes]))


# ---- top-k feature importance: |corr| of each prepared part feature with the retail price
_IMP_FEATS = [("p_size", "p_size")] + [(f"p_type_{v}", f"CAST(p_type = '{v}' AS DOUBLE)") for v in P_TYPES] \
    + [(f"p_brand_{v}", f"CAST(p_brand = '{v}' AS DOUBLE)") for v in P_BRANDS]


@query("topk_importance", f"""
WITH i AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, abs(corr({e}, p_retailprice)) AS importance FROM part"
                               for n, e in _IMP_FEATS)}),
t AS (SELECT * FROM i ORDER BY importance DESC, feature LIMIT 10)
SELECT feature, round(importance, 6) AS importance,
       CAST(row_number() OVER (ORDER BY importance, feature DESC) AS INTEGER) AS position FROM t""")
def topk_importance(spark, sf):
    part = table(spark, sf, "part")
    fp = K.fit_prep(part, ["p_size"], ["p_type", "p_brand"], K.PrepConfig(numeric_scaler="none"))
    wide = fp.transform(part, keep=["p_retailprice"])
    names = fp.feature_names
    renamed = wide.toDF("p_retailprice", *[f"f{i}" for i in range(len(names))])
    corr = C.corr_with_target(renamed, [f"f{i}" for i in range(len(names))], "p_retailprice")
    mapping = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(f"f{i}"), F.lit(n))])
    imp = corr.select(mapping[F.col("feature")].alias("feature"), F.abs("correlation").alias("importance"))
    return rounded(E.feature_importance_topk(imp, 10).withColumn("position", F.col("position").cast("int")))
