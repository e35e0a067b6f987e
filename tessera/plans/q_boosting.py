"""Registered queries of multiclass boosting, kernel machines and their saved models."""

from __future__ import annotations

import os

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tessera.operators.boosting import SoftmaxBoosting
from tessera.operators.split import key_hash, test_threshold
from tessera.plans import training as TR
from tessera.plans.q_models import _ORDERS_TEST, _metric_table, _li_classifier, _li_regressor, _orders_customers
from tessera.plans.registry import query, rounded, table
from tessera.session import shared_dir

_ROUNDS, _RATE = 3, 0.3


@query("train_gbt_multiclass")
def train_gbt_multiclass(spark, sf):
    res = TR.train_model(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_linestatus"], "l_returnflag",
                         "Gradient Boosting", keys=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], params={"n_estimators": 5, "max_depth": 3})
    return _metric_table(res)


@query("train_svm_poly")
def train_svm_poly(spark, sf):
    return _metric_table(_li_classifier(spark, sf, "Support Vector Machine", {"C": 1.0, "kernel": "poly", "gamma": "scale"}))


@query("train_svr_poly")
def train_svr_poly(spark, sf):
    return _metric_table(_li_regressor(spark, sf, "SVR", {"C": 1.0, "epsilon": 0.1, "kernel": "poly", "gamma": 0.1}))


def _stump_sql() -> str:
    """The same rounds of stumps over the counts of (x0, x1, x2, class): each CTE triple is one round."""
    parts = ["""
WITH c AS (SELECT CAST(l_linestatus = 'O' AS INTEGER) AS x0, CAST(l_quantity > 25 AS INTEGER) AS x1, CAST(l_discount > 0.05 AS INTEGER) AS x2,
                  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, count(*)::DOUBLE AS n
           FROM lineitem WHERE l_linestatus IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY ALL),
cells AS (SELECT x0, x1, x2, sum(n) AS n FROM c GROUP BY ALL),
s0 AS (SELECT x0, x1, x2, k, raw FROM cells, (SELECT y AS k, ln(sum(n) / (SELECT sum(n) FROM c)) AS raw FROM c GROUP BY y))"""]
    for i in range(_ROUNDS):
        parts.append(f"""
p{i} AS (SELECT *, exp(raw) / sum(exp(raw)) OVER (PARTITION BY x0, x1, x2) AS p FROM s{i}),
r{i} AS (SELECT c.x0, c.x1, c.x2, k, n, CASE WHEN y = k THEN 1 ELSE 0 END - p AS r
         FROM c JOIN p{i} p ON c.x0 = p.x0 AND c.x1 = p.x1 AND c.x2 = p.x2),
g{i} AS (SELECT k, j, v, sum(n) AS n, sum(n * r) AS num, sum(n * abs(r) * (1 - abs(r))) AS den
         FROM (SELECT k, n, r, unnest([0, 1, 2]) AS j, unnest([x0, x1, x2]) AS v FROM r{i}) GROUP BY ALL),
b{i} AS (SELECT k, arg_max(j, gain) AS j FROM (SELECT k, j, sum(num * num / n) AS gain FROM g{i} GROUP BY k, j HAVING count(*) = 2) GROUP BY k),
s{i + 1} AS (SELECT x0, x1, x2, s.k, raw + {_RATE} * 2 / 3 * num / den AS raw
         FROM s{i} s JOIN b{i} b ON s.k = b.k JOIN g{i} g ON g.k = b.k AND g.j = b.j
              AND g.v = CASE b.j WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END)""")
    parts.append(f"""
e AS (SELECT x0, x1, x2, k, exp(raw) / sum(exp(raw)) OVER (PARTITION BY x0, x1, x2) AS p FROM s{_ROUNDS})
SELECT e.x0, e.x1, e.x2, CAST(any_value(cells.n) AS BIGINT) AS n_rows, round(max(CASE WHEN k = 0 THEN p END), 6) AS p_a,
       round(max(CASE WHEN k = 1 THEN p END), 6) AS p_n, round(max(CASE WHEN k = 2 THEN p END), 6) AS p_r
FROM e JOIN cells ON e.x0 = cells.x0 AND e.x1 = cells.x1 AND e.x2 = cells.x2 GROUP BY e.x0, e.x1, e.x2""")
    return ",".join(parts[:-1]) + "," + parts[-1]


@query("gbt_stump_proba", _stump_sql())
def gbt_stump_proba(spark, sf):
    """Three rounds of stumps a class on two-valued features: every row scored, one output row a combination."""
    yes = lambda c: c.cast("int")
    li = table(spark, sf, "lineitem").select(
        yes(F.col("l_linestatus") == "O").alias("x0"), yes(F.col("l_quantity") > 25).alias("x1"), yes(F.col("l_discount") > 0.05).alias("x2"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag").isNotNull(), 2).alias("label")).dropna()
    rows = li.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in ("x0", "x1", "x2")])))
    model = SoftmaxBoosting(3, n_estimators=_ROUNDS, learning_rate=_RATE, max_depth=1).fit(rows)
    p = model.transform(rows).withColumn("p", vector_to_array("probability"))
    return rounded(p.groupBy("x0", "x1", "x2").agg(F.count(F.lit(1)).alias("n_rows"), *[F.max(F.col("p")[k]).alias(f"p_{c}") for k, c in enumerate("anr")]))


@query("model_save_load_kernel", f"""
SELECT model, o_orderkey, true AS equal FROM {_ORDERS_TEST}, (SELECT unnest(['boosting', 'poly']) AS model)""")
def model_save_load_kernel(spark, sf):
    """Boosting of three classes and a kernel machine: saved, loaded, every held-out row scored as before."""
    from tessera.sources.model_io import load_model, save_model
    base = os.path.join(shared_dir(spark), f"models-{os.urandom(4).hex()}")
    data = _orders_customers(spark, sf).withColumn("is_open", (F.col("o_orderstatus") == "O").cast("int"))
    test = data.where(key_hash(["o_orderkey"], 42) < F.lit(test_threshold(0.2)))
    out = None
    for name, model, target, params in (("boosting", "Gradient Boosting", "o_orderstatus", {"n_estimators": 3, "max_depth": 2}),
                                        ("poly", "Support Vector Machine", "is_open", {"C": 0.01, "kernel": "poly"})):
        res = TR.train_model(data, ["o_totalprice", "c_acctbal"], [], target, model, keys=["o_orderkey"], params=params)
        loaded = load_model(spark, save_model(res, base, name))
        again = loaded.transform(test, keep=["o_orderkey"]).select("o_orderkey", F.col("prediction").alias("again"))
        both = res.predictions.join(again, "o_orderkey", "full").select(
            F.lit(name).alias("model"), "o_orderkey", F.col("prediction").eqNullSafe(F.col("again")).alias("equal"))
        out = both if out is None else out.unionByName(both)
    return out
