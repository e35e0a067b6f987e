import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.ranking import prefix_sums
from tessera.operators import evaluate as E


def test_prefix_sums_match_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "k": rng.permutation(3000).astype(float),
                        "v": rng.integers(0, 5, 3000)})
    df = spark.createDataFrame(pdf)
    out = prefix_sums(df, "k", ["v"], groups=["g"], lead=["v"], buckets=16).toPandas().sort_values(["g", "k"])
    exp = pdf.sort_values(["g", "k"])
    assert (out["v_cum"].to_numpy() == exp.groupby("g")["v"].cumsum().to_numpy()).all()
    nxt = exp.groupby("g")["v"].shift(-1)
    assert np.allclose(out["v_next"].fillna(-1).to_numpy(), nxt.fillna(-1).to_numpy())
    desc = prefix_sums(df, "k", ["v"], descending=True, inclusive=False, buckets=16).toPandas().sort_values(
        "k", ascending=False)
    assert (desc["v_cum"].to_numpy() == desc["v"].cumsum().shift(1, fill_value=0).to_numpy()).all()


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1)], "y int, p int")
    r = E.binary_metrics(df, "y", "p").first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    assert r.accuracy == pytest.approx(2 / 3)


def test_weighted_metrics_by_hand(spark):
    y = ["a", "a", "b", "b", "c", "c", "c"]
    p = ["a", "b", "b", "b", "a", "c", "c"]
    r = E.weighted_metrics(spark.createDataFrame(list(zip(y, p)), "y string, p string"), "y", "p").first()
    prec = {"a": 0.5, "b": 2 / 3, "c": 1.0}
    rec = {"a": 0.5, "b": 1.0, "c": 2 / 3}
    sup = {"a": 2, "b": 2, "c": 3}
    wp = sum(sup[c] * prec[c] for c in sup) / 7
    wr = sum(sup[c] * rec[c] for c in sup) / 7
    wf = sum(sup[c] * 2 * prec[c] * rec[c] / (prec[c] + rec[c]) for c in sup) / 7
    assert (r.precision, r.recall, r.f1) == pytest.approx((wp, wr, wf))
    conf = E.confusion_long(spark.createDataFrame(list(zip(y, p)), "y string, p string"), "y", "p")
    assert conf.count() == 9 and conf.agg(F.sum("count")).first()[0] == 7


def test_roc_ties_and_auc_brute_force(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) + 0.3 * y, 1)  # many tied scores
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    roc = E.roc_curve(df, "y", "s", drop_intermediate=False).toPandas()
    assert len(roc) == len(np.unique(s)) + 1
    pos, neg = s[y == 1], s[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert E.roc_auc(df, "y", "s").first().auc == pytest.approx(brute)
    dropped = E.roc_curve(df, "y", "s").toPandas()
    assert len(dropped) <= len(roc)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    r = E.regression_metrics(df, "y", "p").first()
    e = np.array([-0.5, 0.0, 1.0])
    assert r.mse == pytest.approx((e ** 2).mean()) and r.mae == pytest.approx(np.abs(e).mean())
    assert r.r2 == pytest.approx(1 - (e ** 2).sum() / 2.0)


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4)], "y int, s double")
    assert E.roc_auc(df, "y", "s").first().auc is None


def test_prefix_sums_small_and_bucketed_paths_agree(spark):
    import tessera.functions.ranking as R
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 2000), "k": rng.permutation(2000).astype(float),
                        "v": rng.integers(0, 5, 2000)})
    df = spark.createDataFrame(pdf)
    small = R.prefix_sums(df, "k", ["v"], groups=["g"], lead=["v"], materialize=True).toPandas()
    big = R.prefix_sums(df, "k", ["v"], groups=["g"], lead=["v"], buckets=16).toPandas()
    key = ["g", "k"]
    a, b = small.sort_values(key).reset_index(drop=True), big.sort_values(key).reset_index(drop=True)
    assert (a["v_cum"] == b["v_cum"]).all() and a["v_next"].fillna(-1).equals(b["v_next"].fillna(-1))


def test_one_vs_rest_auc_brute_force(spark):
    rng = np.random.default_rng(12)
    y = rng.integers(0, 3, 300)
    raw = rng.random((300, 3)) + np.eye(3)[y] * 0.4
    prob = np.round(raw / raw.sum(axis=1, keepdims=True), 2)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": list(prob)}))
    got = {r.class_index: r for r in E.roc_one_vs_rest(df, "y", "p", ["a", "b", "c"]).collect()}
    for k in range(3):
        pos, neg = prob[y == k, k], prob[y != k, k]
        brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
        assert got[k].auc == pytest.approx(brute)
        assert got[k].curve_label == f"{'abc'[k]} (AUC = {got[k].auc:.3f})"
        assert 0.0 <= got[k].auc <= 1.0
