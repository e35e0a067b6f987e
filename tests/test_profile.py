import datetime

import numpy as np
import pytest

from tessera.operators import profile as P


@pytest.fixture
def role_edges(spark):
    rows = []
    for i in range(30):
        rows.append((i % 9, i % 10, i % 11, float(i) * 1.5, i % 2 == 0, datetime.datetime(2024, 1, 1 + i % 5),
                     "ab"[i % 2]))
    return spark.createDataFrame(rows, "c9 bigint, c10 bigint, c11 int, x double, flag boolean, ts timestamp, s string")


def test_roles_threshold_and_order(role_edges):
    roles = P.infer_roles(role_edges)
    assert roles.numeric == ["c10", "c11", "x"]
    assert roles.categorical == ["flag", "s", "c9"]  # moved numeric goes to the end; timestamp in neither


def test_task_types(role_edges):
    t = {r.target: r.task for r in P.task_types(role_edges, ["c9", "c10", "s"]).collect()}
    assert t == {"c9": "classification", "c10": "regression", "s": "classification"}


def test_describe_matches_numpy(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    r = P.describe(df, ["a"]).first()
    x = np.array([v for v in vals if v is not None and v == v])
    assert r["count"] == len(x)
    assert r["mean"] == pytest.approx(x.mean())
    assert r["std"] == pytest.approx(x.std(ddof=1))
    assert [r.p25, r.p50, r.p75] == pytest.approx(list(np.percentile(x, [25, 50, 75])))


def test_categorical_summary_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "s string")
    r = P.categorical_summary(df, ["s"]).first()
    assert (r.unique_count, r.most_common, r.most_common_count, r.missing) == (3, "a", 2, 1)


def test_missing_counts_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), None), (None, "y")], "a double, s string")
    got = {r.column_name: r.missing for r in P.missing_counts(df, ["a", "s"]).collect()}
    assert got == {"a": 2, "s": 1}


def test_outliers_strict_fences(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k bigint, v double")
    f = P.outlier_flags(df, ["v"]).first()
    q1, q3 = np.percentile(vals, [25, 75])
    assert (f.q1, f.q3) == (q1, q3)
    assert f.n_outliers == sum(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) for v in vals)
    assert [r.k for r in P.outlier_rows(df, ["v"], ["k"]).collect()] == [4]
    h = P.outlier_hint(df, ["v"]).first()
    assert (h.has_outliers, h.outlier_features, h.suggested_scaler) == (True, "v", "robust")


def test_target_removed_from_features(role_edges):
    roles = P.infer_roles(role_edges)
    assert "x" not in roles.without("x").features and "x" in roles.features
    proj = P.feature_projection(role_edges, roles, "s", keep=["x"])
    assert "s" not in proj.columns and proj.columns[0] == "x"


def test_sketch_roles_agree_with_exact(spark):
    from pyspark.sql import functions as F
    df = spark.range(5000).select((F.col("id") % 9).alias("few"), (F.col("id") % 10).alias("ten"), F.col("id").alias("many"))
    exact = {r.column_name: r.role for r in P.roles_frame(df).collect()}
    roles = P.infer_roles(df)
    assert exact == {"few": "categorical", "ten": "numeric", "many": "numeric"}
    assert roles.numeric == ["ten", "many"] and roles.categorical == ["few"]


def test_overview_payload(spark):
    df = spark.createDataFrame([(1, 2.0, "ab"), (2, None, "héllo"), (3, 4.0, None)], "a bigint, b double, s string")
    r = P.overview(df, P.ColumnRoles(["a", "b"], ["s"])).first()
    assert (r.n_rows, r.n_columns, r.n_numeric, r.n_categorical) == (3, 3, 2, 1)
    assert r.payload_bytes == 3 * 8 + 2 * 8 + len("ab".encode()) + len("héllo".encode())
