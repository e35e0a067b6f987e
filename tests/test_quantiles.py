import numpy as np
import pandas as pd

from tessera.operators.quantiles import quantile_arrays


def test_distributed_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, 3000)
    a = np.round(rng.gamma(2.0, size=3000), 1)  # many ties
    b = rng.normal(size=3000)
    a[:1000] = 7.0  # a hot value
    pdf = pd.DataFrame({"g": g, "a": a, "b": b})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    dist = {r.g: r for r in quantile_arrays(df, ["a", "b"], probs, groups=["g"]).collect()}
    for k in range(3):
        sub = pdf[pdf.g == k]
        assert np.allclose(dist[k]["_q0"], np.percentile(sub.a, [p * 100 for p in probs]))
        assert np.allclose(dist[k]["_q1"], np.percentile(sub.b, [p * 100 for p in probs]))
    one = quantile_arrays(df, ["a"], [0.5]).first()
    assert one["_q0"][0] == np.median(a)


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 2000), "a": np.round(rng.normal(size=2000), 2)})
    df = spark.createDataFrame(pdf)
    got = {r.g: r["_q0"] for r in quantile_arrays(df, ["a"], [0.1, 0.5, 0.99], groups=["g"]).collect()}
    for k in range(2):
        assert np.allclose(got[k], np.percentile(pdf[pdf.g == k].a, [10, 50, 99]))
