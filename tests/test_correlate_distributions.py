import numpy as np
import pandas as pd
import pytest

from tessera.operators import correlate as C
from tessera.operators import distributions as V


@pytest.fixture
def corr_frame(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"a": a, "b": 2 * a, "c": -a + rng.normal(scale=1e-3, size=300),
                        "d": rng.integers(0, 5, 300).astype(float)})
    return spark.createDataFrame(pdf), pdf


def test_high_pairs_and_long(corr_frame):
    df, pdf = corr_frame
    pairs = {(r.feature_a, r.feature_b) for r in C.high_corr_pairs(df, ["a", "b", "c", "d"]).collect()}
    assert pairs == {("b", "a"), ("c", "a"), ("c", "b")}
    long = C.corr_long(df, ["a", "d"]).toPandas()
    assert len(long) == 4
    assert long.set_index(["index", "variable"]).loc[("a", "d"), "correlation"] == pytest.approx(pdf.a.corr(pdf.d))


def test_spearman_matches_pandas(corr_frame):
    df, pdf = corr_frame
    got = C.spearman_long(df, ["a", "d"]).toPandas().set_index(["index", "variable"])
    assert got.loc[("a", "d"), "correlation"] == pytest.approx(pdf.a.rank().corr(pdf.d.rank()))


def test_histogram_equal_matches_numpy(spark):
    x = np.random.default_rng(5).gamma(2.0, size=1000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = V.histogram_equal(df, "x", 20).toPandas().sort_values("bin")
    counts, edges = np.histogram(x, bins=20)
    full = np.zeros(20, dtype=int)
    full[got["bin"].to_numpy() - 1] = got["count"].to_numpy()
    assert (full == counts).all()


def test_kde_matches_direct_formula(spark):
    x = np.random.default_rng(6).normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = V.kde(df, "x").toPandas().sort_values("grid_index")
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 200)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert np.allclose(got["x"], grid) and np.allclose(got["density"], dens)
    assert np.trapezoid(dens, grid) == pytest.approx(1.0, abs=1e-3)


def test_box_stats(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 50.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = V.box_stats(df, "v").first()
    q1, q3 = np.percentile(vals, [25, 75])
    assert (r.q1, r.q3, r.whisker_low, r.whisker_high, r.n_outliers) == (q1, q3, 1.0, 5.0, 1)


def test_scatter_pairs_all_or_first_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "a double, b double, c double, d double, e double, f double")
    assert V.scatter_pairs(df, list("abcdef")).count() == 36
    assert V.scatter_pairs(df, list("abcdef"), max_features=5).count() == 25


def test_scatter_hash_sample_is_deterministic(spark):
    df = spark.range(4000).selectExpr("id AS k", "CAST(id AS DOUBLE) AS a", "CAST(id * 2 AS DOUBLE) AS b")
    s1 = V.scatter_pairs(df, ["a", "b"], keep=["k"], sample_fraction=0.25)
    s2 = V.scatter_pairs(df.repartition(5), ["a", "b"], keep=["k"], sample_fraction=0.25)
    n = s1.count()
    assert abs(n / 4 - 1000) < 120 and sorted(s1.collect()) == sorted(s2.collect())


def test_kde_prebinned_close_to_exact(spark):
    x = np.random.default_rng(8).normal(size=5000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    exact = V.kde(df, "x").toPandas().sort_values("grid_index")
    binned = V.kde(df, "x", prebin=512).toPandas().sort_values("grid_index")
    assert np.allclose(exact["x"], binned["x"])
    assert np.max(np.abs(exact["density"].to_numpy() - binned["density"].to_numpy())) < 2e-3


def test_spearman_pairwise_complete(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": np.round(rng.normal(size=300), 1), "b": rng.normal(size=300),
                        "c": rng.integers(0, 6, 300).astype(float)})
    pdf.loc[rng.random(300) < 0.15, "a"] = np.nan
    pdf.loc[rng.random(300) < 0.15, "b"] = np.nan
    got = C.spearman_long(spark.createDataFrame(pdf), ["a", "b", "c"]).toPandas().set_index(["index", "variable"])
    for x in "abc":
        for y in "abc":
            sub = pdf[[x, y]].dropna() if x != y else pdf[[x]].dropna()
            exp = 1.0 if x == y else sub[x].rank().corr(sub[y].rank())
            assert got.loc[(x, y), "correlation"] == pytest.approx(exp)


def test_nice_histogram_properties(spark):
    x = np.random.default_rng(13).lognormal(size=2000) * 37.0
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    h = V.histogram_nice(df, "x").toPandas().sort_values("bin_start")
    step = (h.bin_end - h.bin_start).iloc[0]
    mant = step / 10 ** np.floor(np.log10(step))
    assert min(abs(mant - m) for m in (1, 2, 5, 10)) < 1e-9
    assert h["count"].sum() == 2000
    assert (h.bin_end.max() - h.bin_start.min()) / step <= 30 + 1e-9
    assert h.bin_start.min() <= x.min() and x.max() <= h.bin_end.max()
