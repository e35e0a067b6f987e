"""Registered feature-preparation and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import prepare as K
from tessera.operators import split as S
from tessera.plans.registry import LINEITEM_GAPS_SQL, lineitem_gaps, query, rounded, table

LI_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_KEY_SQL = ", ".join(LI_KEY)


def _imputed(spark, sf, strategy, cols, fill=None):
    g = lineitem_gaps(spark, sf)
    fills = K.impute_values(g, cols, strategy, fill)
    return rounded(K.impute(g, fills, keep=LI_KEY))


@query("impute_mean", f"""
WITH g AS ({LINEITEM_GAPS_SQL})
SELECT {_KEY_SQL}, round(coalesce(l_quantity, avg(l_quantity) OVER ()), 6) AS l_quantity,
       round(coalesce(l_discount, avg(l_discount) OVER ()), 6) AS l_discount FROM g""")
def impute_mean(spark, sf):
    return _imputed(spark, sf, "mean", ["l_quantity", "l_discount"])


@query("impute_median", f"""
WITH g AS ({LINEITEM_GAPS_SQL}),
s AS (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_discount, 0.5) AS md FROM g)
SELECT {_KEY_SQL}, round(coalesce(l_quantity, mq), 6) AS l_quantity,
       round(coalesce(l_discount, md), 6) AS l_discount FROM g, s""")
def impute_median(spark, sf):
    return _imputed(spark, sf, "median", ["l_quantity", "l_discount"])


def _mode_sql(c):
    return (f"(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


@query("impute_most_frequent", f"""
WITH g AS ({LINEITEM_GAPS_SQL})
SELECT {_KEY_SQL}, round(coalesce(l_quantity, {_mode_sql('l_quantity')}), 6) AS l_quantity,
       coalesce(l_returnflag, {_mode_sql('l_returnflag')}) AS l_returnflag FROM g""")
def impute_most_frequent(spark, sf):
    return _imputed(spark, sf, "most_frequent", ["l_quantity", "l_returnflag"])


@query("impute_constant", f"""
WITH g AS ({LINEITEM_GAPS_SQL})
SELECT {_KEY_SQL}, round(coalesce(l_quantity, 0.0), 6) AS l_quantity,
       coalesce(l_returnflag, 'missing_value') AS l_returnflag FROM g""")
def impute_constant(spark, sf):
    g = lineitem_gaps(spark, sf)
    fills = {**K.impute_values(g, ["l_quantity"], "constant", 0.0),
             **K.impute_values(g, ["l_returnflag"], "constant", "missing_value")}
    return rounded(K.impute(g, fills, keep=LI_KEY))


SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("scale_standard", f"""
SELECT {_KEY_SQL}, {", ".join(
    f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}"
    for c in SCALE_COLS)} FROM lineitem""")
def scale_standard(spark, sf):
    li = table(spark, sf, "lineitem")
    fp = K.fit_prep(li, SCALE_COLS, [], K.PrepConfig(numeric_scaler="standard"))
    return rounded(fp.transform(li, keep=LI_KEY))


@query("scale_robust", f"""
WITH s AS (SELECT {", ".join(
    f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS i_{c}"
    for c in SCALE_COLS)} FROM lineitem)
SELECT {_KEY_SQL}, {", ".join(f"round(({c} - m_{c}) / coalesce(nullif(i_{c}, 0), 1), 6) AS {c}"
                              for c in SCALE_COLS)} FROM lineitem, s""")
def scale_robust(spark, sf):
    li = table(spark, sf, "lineitem")
    fp = K.fit_prep(li, SCALE_COLS, [], K.PrepConfig(numeric_scaler="robust"))
    return rounded(fp.transform(li, keep=LI_KEY))


# The categories of part.p_type / p_brand / orders columns in the
# test tables (the oracle SQL spells out the one-hot columns; Spark derives them).
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
P_BRANDS = sorted(f"Brand#{i}" for i in range(1, 26))
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


def _onehot_sql(c, values):
    return ", ".join(f"CAST(coalesce({c} = '{v}', FALSE) AS DOUBLE) AS \"{c}_{v}\"" for v in values)


@query("encode_onehot", f"SELECT p_partkey, {_onehot_sql('p_type', P_TYPES)} FROM part")
def encode_onehot(spark, sf):
    part = table(spark, sf, "part")
    fp = K.fit_prep(part, [], ["p_type"])
    return fp.transform(part, keep=["p_partkey"])


_NAMES = ["p_size", "p_retailprice"] + [f"p_type_{v}" for v in P_TYPES] + [f"p_brand_{v}" for v in P_BRANDS]


@query("feature_names", "SELECT * FROM (VALUES " + ", ".join(
    f"(CAST({i} AS INTEGER), '{n}')" for i, n in enumerate(_NAMES)) + ") AS t(position, feature_name)")
def feature_names(spark, sf):
    part = table(spark, sf, "part")
    fp = K.fit_prep(part, ["p_size", "p_retailprice"], ["p_type", "p_brand"])
    return spark.createDataFrame(list(enumerate(fp.feature_names)), "position int, feature_name string")


_PREP_NUM = ["l_quantity", "l_extendedprice", "l_discount"]
_PREP_SQL = f"""
WITH g AS ({LINEITEM_GAPS_SQL}),
f AS (SELECT {_KEY_SQL}, {", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in _PREP_NUM)},
             coalesce(l_returnflag, {_mode_sql('l_returnflag')}) AS l_returnflag, l_linestatus FROM g)
SELECT {_KEY_SQL}, {", ".join(
    f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}"
    for c in _PREP_NUM)}, {_onehot_sql('l_returnflag', ['A', 'N', 'R'])}, {_onehot_sql('l_linestatus', ['F', 'O'])}
FROM f"""


@query("prep_features", _PREP_SQL)
def prep_features(spark, sf):
    g = lineitem_gaps(spark, sf)
    fp = K.fit_prep(g, _PREP_NUM, ["l_returnflag", "l_linestatus"])
    return rounded(fp.transform(g, keep=LI_KEY))


_SPLIT_HASH_SQL = "('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), 1, 8))::BIGINT"
_HOLDOUT_SQL = f"""
WITH o AS (SELECT *, {_SPLIT_HASH_SQL} < {S.test_threshold(0.2)} AS is_test FROM orders),
tr AS (SELECT * FROM o WHERE NOT is_test AND o_orderpriority <> '5-LOW'),
s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM tr)
SELECT o_orderkey, round((o_totalprice - m) / coalesce(nullif(sd, 0), 1), 6) AS o_totalprice,
       {_onehot_sql('o_orderpriority', PRIORITIES[:4])}, {_onehot_sql('o_orderstatus', STATUSES)}
FROM o, s WHERE is_test"""


@query("prep_transform_holdout", _HOLDOUT_SQL)
def prep_transform_holdout(spark, sf):
    orders = S.with_split(table(spark, sf, "orders"), ["o_orderkey"])
    train = orders.where(~F.col("is_test") & (F.col("o_orderpriority") != "5-LOW"))
    fp = K.fit_prep(train, ["o_totalprice"], ["o_orderpriority", "o_orderstatus"])
    return rounded(fp.transform(orders.where("is_test"), keep=["o_orderkey"]))


@query("encode_label", f"""
SELECT {_KEY_SQL},
       CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS returnflag_code,
       CAST(dense_rank() OVER (ORDER BY l_linenumber) - 1 AS DOUBLE) AS linenumber_code
FROM lineitem""")
def encode_label(spark, sf):
    li = table(spark, sf, "lineitem")
    rf, ln = K.fit_label(li, "l_returnflag"), K.fit_label(li, "l_linenumber")
    return li.select(*LI_KEY, rf.code(li).alias("returnflag_code"), ln.code(li).alias("linenumber_code"))


@query("split_hash", f"SELECT o_orderkey, {_SPLIT_HASH_SQL} < {S.test_threshold(0.2)} AS is_test FROM orders")
def split_hash(spark, sf):
    return S.with_split(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


@query("cv_folds", f"SELECT o_orderkey, CAST({_SPLIT_HASH_SQL} % 5 AS INTEGER) AS fold FROM orders")
def cv_folds(spark, sf):
    return S.with_folds(table(spark, sf, "orders"), ["o_orderkey"], 5).select("o_orderkey", "fold")


@query("cv_folds_stratified", f"""
SELECT o_orderkey, o_orderstatus,
       CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_SPLIT_HASH_SQL}, o_orderkey) - 1) % 5
            AS INTEGER) AS fold
FROM orders""")
def cv_folds_stratified(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.with_stratified_folds(o, ["o_orderkey"], "o_orderstatus", 5)


def _nan_dist_sql(cols):
    cnt = " + ".join(f"CAST(r.{c} IS NOT NULL AND o.{c} IS NOT NULL AS INTEGER)" for c in cols)
    ss = " + ".join(f"coalesce((r.{c} - o.{c}) * (r.{c} - o.{c}), 0.0)" for c in cols)
    return f"CASE WHEN ({cnt}) > 0 THEN sqrt(CAST({len(cols)} AS DOUBLE) / ({cnt}) * ({ss})) END"


_KNN_COLS = ["n", "q", "t"]
_KNN_SQL = f"""
WITH d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n, CAST(quality AS DOUBLE) AS q, CAST(toxic AS DOUBLE) AS t
           FROM documents LEFT JOIN labels USING (doc_id)),
pairs AS ({" UNION ALL ".join(
    f"SELECT '{f}' AS f, r.doc_id AS rid, o.doc_id AS did, o.{f} AS v, {_nan_dist_sql(_KNN_COLS)} AS dist "
    f"FROM d r, d o WHERE r.{f} IS NULL AND o.{f} IS NOT NULL" for f in _KNN_COLS)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY f, rid ORDER BY dist, did) AS rk FROM pairs WHERE dist IS NOT NULL),
imp AS (SELECT f, rid, avg(v) AS v FROM ranked WHERE rk <= 5 GROUP BY ALL),
m AS (SELECT avg(n) AS mn, avg(q) AS mq, avg(t) AS mt FROM d)
SELECT d.doc_id, round(coalesce(d.n, i_n.v, mn), 6) AS n_chars, round(coalesce(d.q, i_q.v, mq), 6) AS quality,
       round(coalesce(d.t, i_t.v, mt), 6) AS toxic
FROM d CROSS JOIN m
LEFT JOIN imp i_n ON i_n.f = 'n' AND i_n.rid = d.doc_id
LEFT JOIN imp i_q ON i_q.f = 'q' AND i_q.rid = d.doc_id
LEFT JOIN imp i_t ON i_t.f = 't' AND i_t.rid = d.doc_id"""


@query("impute_knn", _KNN_SQL)
def impute_knn(spark, sf):
    """5-nearest-donor imputation (nan-Euclidean) of the labels of unlabelled documents."""
    from tessera.operators.knn import knn_impute
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(knn_impute(docs, "doc_id", ["n_chars", "quality", "toxic"], k=5))
