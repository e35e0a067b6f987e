"""Registered profiling queries (roles, summaries, missing values, outliers, counts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.plans.registry import LINEITEM_GAPS_SQL, lineitem_gaps, query, rounded, table

LI_STATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


_DESCRIBE_SQL = _union([f"""
SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
       round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max
FROM lineitem""" for c in LI_STATS])


@query("profile_describe", _DESCRIBE_SQL)
def profile_describe(spark, sf):
    return rounded(P.describe(table(spark, sf, "lineitem"), LI_STATS))


_LI_TYPES = [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
             ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
             ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "categorical"),
             ("l_linestatus", "categorical"), ("l_shipdate", "none")]
_ROLES_SQL = f"""
WITH cols(column_name, position, base_role) AS (VALUES
  {", ".join(f"('{c}', {i}, '{r}')" for i, (c, r) in enumerate(_LI_TYPES))}),
nd AS ({_union([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM lineitem"
                 for c, r in _LI_TYPES if r == 'numeric'])}),
j AS (
  SELECT c.column_name, CAST(c.position AS INTEGER) AS position, c.base_role, nd.n_distinct,
         CASE WHEN c.base_role = 'numeric' AND nd.n_distinct < 10 THEN 1 ELSE 0 END AS moved
  FROM cols c LEFT JOIN nd USING (column_name))
SELECT column_name, position, base_role, n_distinct,
       CASE WHEN moved = 1 THEN 'categorical' ELSE base_role END AS role,
       CAST(row_number() OVER (PARTITION BY CASE WHEN moved = 1 THEN 'categorical' ELSE base_role END
                               ORDER BY moved, position) - 1 AS INTEGER) AS role_position
FROM j"""


@query("profile_roles", _ROLES_SQL)
def profile_roles(spark, sf):
    return P.roles_frame(table(spark, sf, "lineitem"))


_TASK_TARGETS = ["l_returnflag", "l_linestatus", "l_quantity", "l_tax", "l_extendedprice", "l_linenumber"]
_TASK_SQL = _union([f"""
SELECT '{t}' AS target, count(DISTINCT {t}) AS n_distinct,
       CASE WHEN {'TRUE' if t in ('l_returnflag', 'l_linestatus') else 'FALSE'} OR count(DISTINCT {t}) < 10
            THEN 'classification' ELSE 'regression' END AS task
FROM lineitem""" for t in _TASK_TARGETS])


@query("profile_task_type", _TASK_SQL)
def profile_task_type(spark, sf):
    return P.task_types(table(spark, sf, "lineitem"), _TASK_TARGETS)


_NUNIQUE_SQL = _union([f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS position, "
                       f"count(DISTINCT {c}) AS n_distinct FROM lineitem" for i, c in enumerate(LI_ALL)])


@query("profile_nunique", _NUNIQUE_SQL)
def profile_nunique(spark, sf):
    return P.distinct_counts(table(spark, sf, "lineitem"))


_OVERVIEW_SQL = """
SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns, CAST(6 AS BIGINT) AS n_numeric,
       CAST(4 AS BIGINT) AS n_categorical,
       CAST(8 * (count(l_orderkey) + count(l_partkey) + count(l_suppkey) + count(l_quantity)
                 + count(l_extendedprice) + count(l_discount) + count(l_tax) + count(l_shipdate))
            + 4 * count(l_linenumber)
            + coalesce(sum(strlen(l_returnflag)), 0) + coalesce(sum(strlen(l_linestatus)), 0) AS BIGINT)
         AS payload_bytes
FROM lineitem"""


@query("profile_overview", _OVERVIEW_SQL)
def profile_overview(spark, sf):
    li = table(spark, sf, "lineitem")
    return P.overview(li, P.infer_roles(li))


_CAT_COLS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax"]
_CATEGORICAL_SQL = f"""
WITH g AS ({LINEITEM_GAPS_SQL}),
long AS ({_union([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM g" for c in _CAT_COLS])}),
cnt AS (SELECT column_name, value, count(*) AS n FROM long GROUP BY ALL),
best AS (SELECT column_name, value, n,
                row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rk
         FROM cnt WHERE value IS NOT NULL)
SELECT c.column_name,
       count(c.value) AS unique_count,
       max(CASE WHEN b.rk = 1 THEN b.value END) AS most_common,
       max(CASE WHEN b.rk = 1 THEN b.n END) AS most_common_count,
       CAST(coalesce(sum(CASE WHEN c.value IS NULL THEN c.n END), 0) AS BIGINT) AS missing
FROM cnt c LEFT JOIN best b ON b.column_name = c.column_name AND b.value = c.value
GROUP BY c.column_name"""


@query("profile_categorical", _CATEGORICAL_SQL)
def profile_categorical(spark, sf):
    return P.categorical_summary(lineitem_gaps(spark, sf), _CAT_COLS)


_MISSING_SQL = f"""
WITH g AS ({LINEITEM_GAPS_SQL})
SELECT * FROM ({_union([f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS missing FROM g" for c in LI_ALL])})
WHERE missing > 0"""


@query("profile_missing", _MISSING_SQL)
def profile_missing(spark, sf):
    return P.missing_counts(lineitem_gaps(spark, sf), LI_ALL)


_HINT_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
_HINT_CAT = ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax"]
_MISSING_HINT_SQL = f"""
WITH g AS ({LINEITEM_GAPS_SQL}),
s AS (SELECT count(*) AS n_rows,
             greatest({", ".join(f"count_if({c} IS NULL)" for c in _HINT_NUM)}) AS mx_num,
             greatest({", ".join(f"count_if({c} IS NULL)" for c in _HINT_CAT)}) AS mx_cat FROM g),
r AS (SELECT 'numeric' AS role, mx_num AS max_missing, n_rows FROM s
      UNION ALL SELECT 'categorical', mx_cat, n_rows FROM s)
SELECT role, max_missing, n_rows,
       CASE WHEN role = 'categorical' THEN 'most_frequent'
            WHEN max_missing / n_rows < 0.2 THEN 'knn' ELSE 'median' END AS suggested_strategy
FROM r WHERE max_missing > 0"""


@query("profile_missing_hint", _MISSING_HINT_SQL)
def profile_missing_hint(spark, sf):
    return P.missing_hint(lineitem_gaps(spark, sf), _HINT_NUM, _HINT_CAT)


_EV_COLS = ["value", "user_id"]
_BOUNDS_SQL = _union([f"""
SELECT '{c}' AS column_name, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1,
       CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3 FROM events""" for c in _EV_COLS])
_FLAGS_SQL = f"""
WITH b AS (SELECT column_name, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
           FROM ({_BOUNDS_SQL})),
n AS ({_union([f"SELECT '{c}' AS column_name, count_if({c} < b.lower OR {c} > b.upper) AS n_outliers "
               f"FROM events, b WHERE b.column_name = '{c}'" for c in _EV_COLS])})
SELECT b.column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower,
       round(upper, 6) AS upper, n_outliers, n_outliers > 0 AS has_outliers
FROM b JOIN n USING (column_name)"""


@query("outlier_iqr_flags", _FLAGS_SQL)
def outlier_iqr_flags(spark, sf):
    return rounded(P.outlier_flags(table(spark, sf, "events"), _EV_COLS))


_ROWS_SQL = f"""
WITH b AS (SELECT * FROM ({_BOUNDS_SQL})),
v AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b WHERE column_name = 'value'),
u AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b WHERE column_name = 'user_id')
SELECT event_id, event_type, value, user_id,
       CAST((value < v.lo OR value > v.hi) AS INTEGER)
       + CAST((user_id < u.lo OR user_id > u.hi) AS INTEGER) AS n_outlier_features
FROM events, v, u
WHERE value < v.lo OR value > v.hi OR user_id < u.lo OR user_id > u.hi"""


@query("outlier_iqr_rows", _ROWS_SQL)
def outlier_iqr_rows(spark, sf):
    return P.outlier_rows(table(spark, sf, "events"), _EV_COLS, ["event_id", "event_type", "value", "user_id"])


_HINT_SQL = f"""
WITH f AS ({_FLAGS_SQL}),
p AS (SELECT *, CASE column_name {" ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(_EV_COLS))} END AS pos FROM f)
SELECT bool_or(has_outliers) AS has_outliers,
       coalesce(string_agg(CASE WHEN has_outliers THEN column_name END, ',' ORDER BY pos), '') AS outlier_features,
       CASE WHEN bool_or(has_outliers) THEN 'robust' ELSE 'standard' END AS suggested_scaler,
       CASE WHEN bool_or(has_outliers) THEN 'median' ELSE 'mean' END AS suggested_imputer
FROM p"""


@query("outlier_hint", _HINT_SQL)
def outlier_hint(spark, sf):
    return P.outlier_hint(table(spark, sf, "events"), _EV_COLS)


_AN_NUM = ["l_quantity", "l_extendedprice", "l_discount"]
_AN_CAT = ["l_returnflag", "l_linestatus"]
_ANALYSIS_SQL = f"""
WITH g AS ({LINEITEM_GAPS_SQL}),
b AS ({_union([f"SELECT '{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM g"
               for c in _AN_NUM])}),
f AS (SELECT feature, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM b),
n AS ({_union([f"SELECT '{c}' AS feature, count_if({c} < f.lower OR {c} > f.upper) AS n_outliers "
               f"FROM g, f WHERE f.feature = '{c}'" for c in _AN_NUM])}),
num AS (SELECT f.*, n.n_outliers FROM f JOIN n USING (feature))
SELECT feature, 'numeric' AS role, metric, round(value, 6) AS value FROM (
  SELECT feature, 'q1' AS metric, q1 AS value FROM num UNION ALL
  SELECT feature, 'q3', q3 FROM num UNION ALL
  SELECT feature, 'lower', lower FROM num UNION ALL
  SELECT feature, 'upper', upper FROM num UNION ALL
  SELECT feature, 'n_outliers', CAST(n_outliers AS DOUBLE) FROM num)
UNION ALL
{_union([f"SELECT '{c}', '{'numeric' if c in _AN_NUM else 'categorical'}', 'missing', "
         f"CAST(count_if({c} IS NULL) AS DOUBLE) FROM g" for c in _AN_NUM + _AN_CAT])}"""


@query("profile_analysis", _ANALYSIS_SQL)
def profile_analysis(spark, sf):
    return rounded(P.analyze(lineitem_gaps(spark, sf), _AN_NUM, _AN_CAT))


_VC_SQL = """
SELECT column_name, value, count(*) AS count FROM (
  SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)
WHERE value IS NOT NULL GROUP BY ALL"""


@query("agg_value_counts", _VC_SQL)
def agg_value_counts(spark, sf):
    return P.value_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("agg_counts_by_target",
       "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL")
def agg_counts_by_target(spark, sf):
    return P.counts_by_target(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("distinct_values", """
SELECT DISTINCT column_name, value FROM (
  SELECT 'p_brand' AS column_name, p_brand AS value FROM part
  UNION ALL SELECT 'p_type', p_type FROM part) WHERE value IS NOT NULL""")
def distinct_values(spark, sf):
    return P.distinct_values(table(spark, sf, "part"), ["p_brand", "p_type"])


@query("src_named_table", """
SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def src_named_table(spark, sf):
    from tessera.sources.tables import load_table
    nation = load_table(spark, f"{sf}/nation.parquet")
    region = load_table(spark, f"{sf}/region.parquet")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_name", "r_name")


_CSV_SQL = """
SELECT * FROM (VALUES
  ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'),
  ('o_orderdate', 'string'), ('o_orderpriority', 'string'), ('o_flag', 'boolean')) AS t(column_name, inferred_type)
JOIN (SELECT 'o_totalprice' AS column_name, count_if(o_orderkey % 7 = 0) AS n_missing FROM orders
      UNION ALL SELECT 'o_orderpriority', count_if(o_orderkey % 11 = 0) FROM orders
      UNION ALL SELECT c, 0 FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_orderdate'),
                                         ('o_flag')) AS v(c)) m USING (column_name)"""


@query("src_csv_roundtrip", _CSV_SQL)
def src_csv_roundtrip(spark, sf):
    """orders written as CSV with missing-value tokens, read back with type inference:
    one row per column with the inferred type and the number of missing values."""
    import os

    from tessera.session import shared_dir
    from tessera.sources.csv import read_csv
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    out = o.select("o_orderkey", "o_custkey", "o_orderstatus",
                   F.when(k % 7 == 0, F.lit("NA")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
                   F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
                   F.when(k % 11 == 0, F.lit("null")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
                   F.when(k % 2 == 0, "True").otherwise("False").alias("o_flag"))
    path = os.path.join(shared_dir(spark), f"csv-{os.urandom(4).hex()}")
    out.write.mode("overwrite").option("header", True).csv(path)
    back = read_csv(spark, path)
    types = {f.name: f.dataType.simpleString() for f in back.schema.fields}
    one = back.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in back.columns])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("inferred_type"), F.col(c).alias("n_missing"))
        for c in back.columns])))


@query("preview_topn", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10""")
def preview_topn(spark, sf):
    o = table(spark, sf, "orders")
    return P.preview(o, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], 10, key=["o_orderkey"])


@query("feature_projection", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders""")
def feature_projection(spark, sf):
    """Roles of orders (o_orderstatus has 3 values -> categorical; timestamp in
    neither), target o_orderstatus removed from the features."""
    o = table(spark, sf, "orders")
    return P.feature_projection(o, P.infer_roles(o), "o_orderstatus")


@query("reshape_unpivot", """
SELECT o_orderkey, variable, value FROM (
  SELECT o_orderkey, 'o_totalprice' AS variable, CAST(o_totalprice AS DOUBLE) AS value FROM orders
  UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders)""")
def reshape_unpivot(spark, sf):
    return P.unpivot_long(table(spark, sf, "orders"), ["o_orderkey"], ["o_totalprice", "o_custkey"])
