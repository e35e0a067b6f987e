"""Registered correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import correlate as C
from tessera.plans.registry import query, rounded, table

CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_gross"]
_BASE_SQL = "SELECT *, l_extendedprice * (1 + l_tax) AS l_gross FROM lineitem"


def _base(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("l_gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _long_sql(pairs, src="b"):
    return _union([f"SELECT '{a}' AS index, '{b}' AS variable, round(corr({a}, {b}), 6) AS correlation FROM {src}"
                   for a, b in pairs])


_ALL_PAIRS = [(a, b) for a in CORR_COLS for b in CORR_COLS]


@query("corr_long", f"WITH b AS ({_BASE_SQL}) {_long_sql(_ALL_PAIRS)}")
def corr_long(spark, sf):
    return rounded(C.corr_long(_base(spark, sf), CORR_COLS))


_MATRIX_SQL = f"""
WITH b AS ({_BASE_SQL}), l AS ({_long_sql(_ALL_PAIRS)})
SELECT index AS column_name,
       {", ".join(f"max(CASE WHEN variable = '{c}' THEN correlation END) AS {c}" for c in CORR_COLS)}
FROM l GROUP BY index"""


@query("corr_matrix", _MATRIX_SQL)
def corr_matrix(spark, sf):
    return rounded(C.corr_matrix(_base(spark, sf), CORR_COLS))


_LOWER = [(a, b) for i, a in enumerate(CORR_COLS) for j, b in enumerate(CORR_COLS) if i > j]


@query("corr_lower_triangle", f"WITH b AS ({_BASE_SQL}) {_long_sql(_LOWER)}")
def corr_lower_triangle(spark, sf):
    return rounded(C.corr_lower_triangle(_base(spark, sf), CORR_COLS))


_HIGH_SQL = f"""
WITH b AS ({_BASE_SQL}), p AS ({_union([
    f"SELECT '{b}' AS feature_a, '{a}' AS feature_b, abs(corr({a}, {b})) AS abs_corr FROM b"
    for i, a in enumerate(CORR_COLS) for j, b in enumerate(CORR_COLS) if i < j])})
SELECT feature_a, feature_b, round(abs_corr, 6) AS abs_corr FROM p WHERE abs_corr > 0.95"""


@query("corr_high_pairs", _HIGH_SQL)
def corr_high_pairs(spark, sf):
    return rounded(C.high_corr_pairs(_base(spark, sf), CORR_COLS))


_TARGET_FEATS = ["l_quantity", "l_discount", "l_tax", "l_gross"]
_TARGET_SQL = f"""
WITH b AS ({_BASE_SQL}), c AS ({_union([
    f"SELECT '{f}' AS feature, corr({f}, l_extendedprice) AS correlation FROM b" for f in _TARGET_FEATS])})
SELECT feature, round(correlation, 6) AS correlation,
       CAST(row_number() OVER (ORDER BY correlation DESC NULLS LAST, feature) AS INTEGER) AS position
FROM c"""


@query("corr_with_target", _TARGET_SQL)
def corr_with_target(spark, sf):
    return rounded(C.corr_with_target(_base(spark, sf), _TARGET_FEATS + ["l_extendedprice"], "l_extendedprice"))


SPEARMAN_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SPEARMAN_SQL = f"""
WITH r AS (SELECT {", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in SPEARMAN_COLS)}
  FROM lineitem)
{_long_sql([(a, b) for a in SPEARMAN_COLS for b in SPEARMAN_COLS], src="r")}"""


@query("corr_spearman", _SPEARMAN_SQL)
def corr_spearman(spark, sf):
    return rounded(C.spearman_long(table(spark, sf, "lineitem"), SPEARMAN_COLS))
