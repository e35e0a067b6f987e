"""Registered queries of the linear models fitted from sufficient statistics, each with a closed form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.gram import linear_search, newton_logistic
from tessera.operators.split import key_hash, test_threshold
from tessera.plans.q_models import _OLS_SPLIT
from tessera.plans.q_prepare import LI_KEY
from tessera.plans.registry import query, rounded, table

_TRAIN = test_threshold(0.2)
_ALPHAS = [0.1, 10.0, 1000.0]
_SCORES = ", ".join(f"round(max(CASE WHEN fold = {i} THEN score END), 6) AS split{i}_test_score" for i in range(5))


def _folds(spark, sf):
    li = table(spark, sf, "lineitem").where(key_hash(LI_KEY, 42) >= F.lit(_TRAIN))
    return li.select((F.col("l_extendedprice") / 1000.0).alias("y"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("x2"),
                     F.pmod(key_hash(LI_KEY, 43), F.lit(5)).cast("int").alias("fold"))


_SUMS_SQL = f"""
WITH t AS (SELECT l_extendedprice / 1000.0 AS y, l_quantity AS x1, l_discount * 100 AS x2, CAST({_OLS_SPLIT.format(seed=43)} % 5 AS INTEGER) AS fold
           FROM lineitem WHERE {_OLS_SPLIT.format(seed=42)} >= {_TRAIN}),
f AS (SELECT DISTINCT fold FROM t),
c AS (SELECT f.fold, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v11, var_pop(x2) AS v22,
             covar_pop(x1, x2) AS v12, covar_pop(x1, y) AS v1y, covar_pop(x2, y) AS v2y FROM f JOIN t ON t.fold <> f.fold GROUP BY f.fold)"""


def _searched(frame, *params):
    return rounded(frame.select(*[F.col(f"param_{p}").cast("double").alias(p) for p in params], *[f"split{i}_test_score" for i in range(5)], "mean_test_score", "std_test_score", "rank_test_score"))


def _table_sql(params: str) -> str:
    return (f"SELECT {params}, {_SCORES}, round(avg(score), 6) AS mean_test_score, round(stddev_pop(score), 6) AS std_test_score, "
            f"CAST(rank() OVER (ORDER BY avg(score) DESC) AS INTEGER) AS rank_test_score FROM s GROUP BY {params}")


@query("tune_ridge", f"""{_SUMS_SQL},
w AS (SELECT c.*, a.alpha, (v11 + alpha / n) * (v22 + alpha / n) - v12 * v12 AS det FROM c, (SELECT unnest({_ALPHAS}::DOUBLE[]) AS alpha) a),
b AS (SELECT *, ((v22 + alpha / n) * v1y - v12 * v2y) / det AS b1, ((v11 + alpha / n) * v2y - v12 * v1y) / det AS b2 FROM w),
s AS (SELECT b.alpha, t.fold, -avg(power(y - my - b1 * (x1 - m1) - b2 * (x2 - m2), 2)) AS score FROM t JOIN b USING (fold) GROUP BY ALL)
{_table_sql("alpha")}""")
def tune_ridge(spark, sf):
    """Five-fold search over ridge penalties on two features."""
    return _searched(linear_search(_folds(spark, sf), ["x1", "x2"], "y", "fold", [{"alpha": a} for a in _ALPHAS])[0], "alpha")


_NET = [(0.5, 1.0), (0.5, 0.2), (5.0, 1.0), (100.0, 0.7), (1000.0, 1.0)]


@query("tune_elasticnet", f"""{_SUMS_SQL},
a AS (SELECT unnest({[a for a, _ in _NET]}::DOUBLE[]) AS alpha, unnest({[r for _, r in _NET]}::DOUBLE[]) AS l1_ratio),
b AS (SELECT c.*, a.*, sign(v1y) * greatest(abs(v1y) - alpha * l1_ratio, 0) / (v11 + alpha * (1 - l1_ratio)) AS b1 FROM c, a),
s AS (SELECT b.alpha, b.l1_ratio, t.fold, 1 - sum(power(y - my - b1 * (x1 - m1), 2)) / (count(*) * var_pop(y)) AS score FROM t JOIN b USING (fold) GROUP BY ALL)
{_table_sql("alpha, l1_ratio")}""")
def tune_elasticnet(spark, sf):
    """Five-fold search over lasso and elastic net penalties on one feature, scored by R2."""
    cands = [{"alpha": a, "l1_ratio": r} for a, r in _NET]
    return _searched(linear_search(_folds(spark, sf), ["x1"], "y", "fold", cands, scoring="r2")[0], "alpha", "l1_ratio")


_STEPS = 5


def _newton_sql() -> str:
    """Newton steps for an intercept and one coefficient, each a common table expression."""
    out = f"""
WITH t AS (SELECT o_totalprice / 100000.0 AS x, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders
           WHERE ('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), 1, 8))::BIGINT >= {_TRAIN}),
w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"""
    for k in range(_STEPS):
        out += f""",
q{k} AS (SELECT x, y, 1 / (1 + exp(-(a + b * x))) AS q FROM t, w{k}),
h{k} AS (SELECT sum(q - y) AS g0, sum((q - y) * x) + max(b) AS g1, sum(q * (1 - q)) AS h00, sum(q * (1 - q) * x) AS h01,
         sum(q * (1 - q) * x * x) + 1 AS h11 FROM q{k}, w{k}),
w{k + 1} AS (SELECT a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM w{k}, h{k})"""
    return out + f"""
SELECT round(a, 6) AS intercept, round(b, 6) AS coefficient,
       round((SELECT -sum(y * ln(1 / (1 + exp(-(a + b * x)))) + (1 - y) * ln(1 - 1 / (1 + exp(-(a + b * x))))) FROM t) + b * b / 2, 4) AS loss FROM w{_STEPS}"""


@query("train_logistic_newton", _newton_sql())
def train_logistic_newton(spark, sf):
    """Penalised logistic regression of a finished order on its price, by five Newton steps."""
    o = table(spark, sf, "orders").where(key_hash(["o_orderkey"], 42) >= F.lit(_TRAIN))
    rows = o.select((F.col("o_totalprice") / 100000.0).alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    fit = newton_logistic(rows, ["x"], "y", C=1.0, steps=_STEPS, tolerance=0.0)
    return spark.createDataFrame([(round(fit.intercept, 6), round(float(fit.coefficients[0]), 6), round(fit.loss, 4))], "intercept double, coefficient double, loss double")
