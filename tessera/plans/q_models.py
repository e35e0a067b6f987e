"""Registered training / tuning queries (rows-only checks except the closed forms)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators.prepare import PrepConfig
from tessera.operators.split import key_hash, test_threshold
from tessera.plans import training as TR
from tessera.plans.q_prepare import LI_KEY
from tessera.plans.registry import query, rounded, table
from tessera.session import shared_dir

_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount"]
_LI_CAT = ["l_returnflag"]


def _orders_customers(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", "o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment", "o_orderstatus")


def train_orders_logistic(spark, sf, **kw):
    """Flagship: orders joined with customers -> prep -> hash split -> logistic regression."""
    return TR.train_model(_orders_customers(spark, sf), ["o_totalprice", "c_acctbal"],
                          ["o_orderpriority", "c_mktsegment"], "o_orderstatus", "Logistic Regression",
                          keys=["o_orderkey"], **kw)


def _metric_table(res):
    """The metrics of a finished fit (one row a metric), evaluated so that its cached training rows can go."""
    table_ = rounded(E.metric_table(res.metrics, res.is_classification))
    rows = table_.collect()
    res.release()
    return table_.sparkSession.createDataFrame(rows, table_.schema)


@query("train_logistic")
def train_logistic(spark, sf):
    return _metric_table(train_orders_logistic(spark, sf, params={"C": 1.0, "class_weight": "balanced"}))


def _li_classifier(spark, sf, model, params):
    return TR.train_model(table(spark, sf, "lineitem"), _LI_NUM, _LI_CAT, "l_linestatus", model, keys=LI_KEY,
                          params=params)


@query("train_rf_classifier")
def train_rf_classifier(spark, sf):
    return _metric_table(_li_classifier(spark, sf, "Random Forest", {"n_estimators": 20, "max_depth": 5}))


@query("train_gbt_classifier")
def train_gbt_classifier(spark, sf):
    return _metric_table(_li_classifier(spark, sf, "Gradient Boosting", {"n_estimators": 10, "max_depth": 3}))


@query("train_tree")
def train_tree(spark, sf):
    return _metric_table(_li_classifier(spark, sf, "Decision Tree", {"max_depth": 5, "criterion": "entropy"}))


@query("train_svm_linear")
def train_svm_linear(spark, sf):
    return _metric_table(_li_classifier(spark, sf, "Support Vector Machine", {"C": 1.0, "kernel": "linear"}))


@query("train_svm_rbf")
def train_svm_rbf(spark, sf):
    return _metric_table(_li_classifier(spark, sf, "Support Vector Machine", {"C": 1.0, "kernel": "rbf",
                                                                             "gamma": "scale"}))


def _li_regressor(spark, sf, model, params, **kw):
    li = table(spark, sf, "lineitem").withColumn("price_k", F.col("l_extendedprice") / 1000.0)
    return TR.train_model(li, ["l_quantity", "l_discount", "l_tax"], _LI_CAT, "price_k", model, keys=LI_KEY,
                          params=params, **kw)


@query("train_ridge")
def train_ridge(spark, sf):
    return _metric_table(_li_regressor(spark, sf, "Ridge Regression", {"alpha": 1.0}))


@query("train_lasso")
def train_lasso(spark, sf):
    return _metric_table(_li_regressor(spark, sf, "Lasso Regression", {"alpha": 0.01}))


@query("train_elasticnet")
def train_elasticnet(spark, sf):
    return _metric_table(_li_regressor(spark, sf, "ElasticNet", {"alpha": 0.01, "l1_ratio": 0.5}))


@query("train_rf_regressor")
def train_rf_regressor(spark, sf):
    return _metric_table(_li_regressor(spark, sf, "Random Forest Regressor", {"n_estimators": 20, "max_depth": 5}))


@query("train_gbt_regressor")
def train_gbt_regressor(spark, sf):
    return _metric_table(_li_regressor(spark, sf, "Gradient Boosting Regressor",
                                       {"n_estimators": 10, "max_depth": 3, "subsample": 0.9}))


@query("train_svr_linear")
def train_svr_linear(spark, sf):
    return _metric_table(_li_regressor(spark, sf, "SVR", {"C": 1.0, "epsilon": 0.1, "kernel": "linear"}))


_OLS_SPLIT = ("('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), "
              "CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), '{seed}')), 1, 8))::BIGINT")


@query("train_ols", f"""
SELECT round(regr_intercept(l_extendedprice / 1000.0, l_quantity), 6) AS intercept,
       round(regr_slope(l_extendedprice / 1000.0, l_quantity), 6) AS slope
FROM lineitem WHERE {_OLS_SPLIT.format(seed=42)} >= {test_threshold(0.2)}""")
def train_ols(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("price_k", F.col("l_extendedprice") / 1000.0)
    res = TR.train_model(li, ["l_quantity"], [], "price_k", "Linear Regression", keys=LI_KEY,
                         prep_config=PrepConfig(numeric_scaler="none"))
    m = res.model
    return rounded(spark.createDataFrame([(float(m.intercept), float(m.coefficients[0]))], "intercept double, slope double"))


@query("svr_against_ols", f"""
WITH t AS (SELECT l_extendedprice / 1000.0 AS y, l_quantity AS x FROM lineitem WHERE {_OLS_SPLIT.format(seed=42)} >= {test_threshold(0.2)}),
f AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM t)
SELECT count(*) AS n, round(avg(abs(y - a - b * x)), 6) AS ols_mae, true AS svr_mae_within_ols FROM t, f""")
def svr_against_ols(spark, sf):
    """A linear SVR minimises absolute errors beyond epsilon, so on its training rows its mean absolute error is at most that of least squares (plus epsilon)."""
    li = table(spark, sf, "lineitem").withColumn("price_k", F.col("l_extendedprice") / 1000.0)
    res = TR.train_model(li, ["l_quantity"], [], "price_k", "SVR", keys=LI_KEY, prep_config=PrepConfig(numeric_scaler="none"),
                         params={"C": 1.0, "epsilon": 0.1, "kernel": "linear"})
    t = li.where(key_hash(LI_KEY, 42) >= F.lit(test_threshold(0.2)))
    fit = t.agg(F.regr_intercept("price_k", "l_quantity").alias("a"), F.regr_slope("price_k", "l_quantity").alias("b"))
    e = t.crossJoin(F.broadcast(fit)).select(  # one row
        F.abs(F.col("price_k") - F.col("a") - F.col("b") * F.col("l_quantity")).alias("ols"),
        F.abs(F.col("price_k") - float(res.model.intercept) - float(res.model.coefficients[0]) * F.col("l_quantity")).alias("svr"))
    res.release()
    return rounded(e.agg(F.count(F.lit(1)).alias("n"), F.avg("ols").alias("ols_mae"), (F.avg("svr") <= F.avg("ols") + 0.1).alias("svr_mae_within_ols")))


def _cv_frame(spark, sf):
    li = table(spark, sf, "lineitem")
    h = key_hash(LI_KEY, 42)
    return (li.where(h >= F.lit(test_threshold(0.2)))
            .select((F.col("l_extendedprice") / 1000.0).alias("y"), F.col("l_quantity").alias("x"),
                    F.pmod(key_hash(LI_KEY, 43), F.lit(5)).cast("int").alias("fold")))


_CV_SQL = f"""
WITH t AS (SELECT l_extendedprice / 1000.0 AS y, l_quantity AS x,
                  CAST({_OLS_SPLIT.format(seed=43)} % 5 AS INTEGER) AS fold
           FROM lineitem WHERE {_OLS_SPLIT.format(seed=42)} >= {test_threshold(0.2)}),
folds AS (SELECT DISTINCT fold FROM t),
fit AS (SELECT f.fold, regr_slope(t.y, t.x) AS b1, regr_intercept(t.y, t.x) AS a1,
               sum(t.x * t.y) / sum(t.x * t.x) AS b0
        FROM folds f JOIN t ON t.fold <> f.fold GROUP BY f.fold),
sc AS (SELECT t.fold, -avg(power(t.y - a1 - b1 * t.x, 2)) AS s_true, -avg(power(t.y - b0 * t.x, 2)) AS s_false
       FROM t JOIN fit USING (fold) GROUP BY t.fold),
long AS (SELECT 'True' AS param_fit_intercept, fold, s_true AS score FROM sc
         UNION ALL SELECT 'False', fold, s_false FROM sc),
w AS (SELECT param_fit_intercept,
             {", ".join(f"max(CASE WHEN fold = {i} THEN score END) AS split{i}_test_score" for i in range(5))},
             avg(score) AS mean_test_score, stddev_pop(score) AS std_test_score FROM long GROUP BY ALL)"""


@query("cv_results_ols", f"""{_CV_SQL}
SELECT param_fit_intercept, {", ".join(f"round(split{i}_test_score, 6) AS split{i}_test_score" for i in range(5))},
       round(mean_test_score, 6) AS mean_test_score, round(std_test_score, 6) AS std_test_score,
       CAST(rank() OVER (ORDER BY mean_test_score DESC) AS INTEGER) AS rank_test_score FROM w""")
def cv_results_ols(spark, sf):
    return rounded(TR.cv_ols_closed_form(_cv_frame(spark, sf), "x", "y", "fold", 5))


@query("param_effect", f"""{_CV_SQL}
SELECT param_fit_intercept AS value, round(avg(mean_test_score), 6) AS mean_score,
       round(stddev_pop(mean_test_score), 6) AS std_score, count(*) AS n_candidates
FROM w GROUP BY ALL""")
def param_effect(spark, sf):
    cvr = TR.cv_ols_closed_form(_cv_frame(spark, sf), "x", "y", "fold", 5)
    return rounded(TR.param_effect(cvr, "fit_intercept"))


@query("tune_grid")
def tune_grid(spark, sf):
    res = train_orders_logistic(spark, sf, use_grid_search=True, cv=3,
                                custom_params={"C": [0.1, 1.0, 10.0], "class_weight": [None, "balanced"]})
    return rounded(res.cv_results.drop("params"))


@query("tune_random")
def tune_random(spark, sf):
    res = TR.train_model(table(spark, sf, "lineitem"), _LI_NUM, _LI_CAT, "l_linestatus", "Random Forest",
                         keys=LI_KEY, use_randomized_search=True, n_iter=3, cv=3,
                         custom_params={"n_estimators": [10, 20], "max_depth": [3, 5], "min_samples_leaf": [1, 4]})
    return rounded(res.cv_results.drop("params"))


_ORDERS_TEST = (f"(SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IS NOT NULL AND "
                f"('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), 1, 8))::BIGINT < {test_threshold(0.2)})")


@query("pred_proba", f"""
SELECT o_orderkey, true AS sums_to_one, true AS argmax_is_prediction FROM {_ORDERS_TEST}""")
def pred_proba(spark, sf):
    """Every held-out row's probabilities: do they add up to 1, and is the prediction the likeliest class?"""
    p = train_orders_logistic(spark, sf, params={"C": 1.0}).predictions
    total = F.aggregate("probability", F.lit(0.0), lambda s, v: s + v)
    chosen = F.element_at("probability", F.col("prediction").cast("int") + 1)
    return p.select("o_orderkey", (F.abs(total - 1) < 1e-9).alias("sums_to_one"), (chosen == F.array_max("probability")).alias("argmax_is_prediction"))


@query("model_save_load", f"SELECT o_orderkey, true AS equal FROM {_ORDERS_TEST}")
def model_save_load(spark, sf):
    """Train, save model + metadata to the shared folder, load, score the test rows."""
    from tessera.sources.model_io import load_model, save_model
    res = train_orders_logistic(spark, sf, params={"C": 1.0})
    path = save_model(res, os.path.join(shared_dir(spark), f"models-{os.urandom(4).hex()}"), "orders_logistic")
    loaded = load_model(spark, path)
    data = _orders_customers(spark, sf)
    test = data.where(key_hash(["o_orderkey"], 42) < F.lit(test_threshold(0.2)))
    again = loaded.transform(test, keep=["o_orderkey"]).select("o_orderkey", F.col("prediction").alias("again"))
    return res.predictions.join(again, "o_orderkey", "full").select("o_orderkey", F.col("prediction").eqNullSafe(F.col("again")).alias("equal"))


_EMB_SPLIT = ("('0x' || substr(md5(concat_ws('|', CAST(vec_id AS VARCHAR), '42')), 1, 8))::BIGINT")


_KNN_CTE = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label,
                  {_EMB_SPLIT} < {test_threshold(0.2)} AS is_test FROM embeddings),
q AS (SELECT * FROM e WHERE is_test), t AS (SELECT * FROM e WHERE NOT is_test),
d AS (SELECT q.vec_id AS qid, t.vec_id AS id, t.label AS tl,
             sqrt(list_sum(list_transform(list_zip(q.v, t.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS dist
      FROM q, t),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rn FROM d),
v AS (SELECT qid, tl, count(*) AS c FROM r WHERE rn <= 5 GROUP BY ALL)"""


@query("train_knn", f"""{_KNN_CTE},
b AS (SELECT qid, tl, row_number() OVER (PARTITION BY qid ORDER BY c DESC, tl) AS rk FROM v)
SELECT q.vec_id, q.label, b.tl AS prediction FROM b JOIN q ON q.vec_id = b.qid WHERE rk = 1""")
def train_knn(spark, sf):
    """5-nearest-neighbour vote (Euclidean, uniform) of the held-out embeddings."""
    from tessera.operators.knn import knn_vote
    test, nb = _held_out_neighbors(spark, sf)
    pred = knn_vote(nb, "qid", "tl")
    return test.select("vec_id", "label").join(pred.withColumnRenamed("qid", "vec_id"), "vec_id")


@query("knn_proba", f"""{_KNN_CTE}
SELECT qid AS vec_id, tl AS class, round(c / 5.0, 6) AS probability FROM v""")
def knn_proba(spark, sf):
    """Class probabilities of the same vote: every class's share of the five neighbours."""
    from tessera.operators.knn import knn_shares
    _, nb = _held_out_neighbors(spark, sf)
    return rounded(knn_shares(nb, "qid", "tl").select(F.col("qid").alias("vec_id"), F.col("tl").alias("class"), "probability"))


def _held_out_neighbors(spark, sf):
    from tessera.operators.knn import nearest_neighbors
    from tessera.operators.split import with_split
    e = with_split(table(spark, sf, "embeddings"), ["vec_id"]).withColumn(
        "vec", F.col("embedding").cast("array<double>"))
    train, test = e.where(~F.col("is_test")), e.where("is_test")
    nb = nearest_neighbors(train.select(F.col("vec_id").alias("id"), "vec", F.col("label").alias("tl")),
                           test.select(F.col("vec_id").alias("qid"), "vec"), 5, carry=("tl",))
    return test, nb
