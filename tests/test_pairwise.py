"""Pairwise support vector machines against numpy: coupled probabilities, votes, absent classes, saved models."""

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from tessera.operators.pairwise import PairwiseSVM, couple, pairs_of
from tessera.plans import training as TR
from tessera.session import shared_dir
from tessera.sources.model_io import load_model, save_model


def _couple(r):
    """Probabilities from the bordered system, r[i][j] in full."""
    k = len(r)
    q = -r.T * r
    for i in range(k):
        q[i, i] = sum(r[s, i] ** 2 for s in range(k) if s != i)
    border = np.block([[q, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
    return np.linalg.solve(border, np.r_[np.zeros(k), 1.0])[:k]


def _matrix(flat, k):
    r = np.zeros((k, k))
    for (i, j), v in zip(pairs_of(k), flat):
        v = min(max(v, 1e-7), 1 - 1e-7)
        r[i, j], r[j, i] = v, 1 - v
    return r


def test_coupling_matches_linear_algebra(spark):
    rng = np.random.default_rng(3)
    for k in (2, 3, 5):
        n = len(pairs_of(k))
        rows = [(i, [float(v) for v in rng.random(n)]) for i in range(40)] + [(40, [0.0] * n), (41, [1.0] * n), (42, [0.5] * n)]
        out = couple(spark.createDataFrame([*rows, (43, [None] * n), (44, None)], "id int, r array<double>"), "r", k, "p")
        got = {r.id: r.p for r in out.collect()}
        for i, flat in rows:
            np.testing.assert_allclose(got[i], _couple(_matrix(flat, k)), atol=1e-9)
        assert got[43] is None and got[44] is None
        np.testing.assert_allclose(got[42], [1 / k] * k, atol=1e-12)


def _blobs(spark, n=300):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 3, n)
    X = np.array([[0, 0], [4, 0], [0, 4]])[y] + rng.normal(size=(n, 2))
    return X, y, spark.createDataFrame([(i, Vectors.dense(x.tolist()), float(c)) for i, (x, c) in enumerate(zip(X, y))], ["id", "features", "label"])


def test_votes_and_probabilities(spark):
    X, y, df = _blobs(spark)
    model = PairwiseSVM(LinearSVC(regParam=0.01, maxIter=30), 4).fit(df)  # class 3 has no rows
    rows = model.transform(df).withColumn("p", vector_to_array("probability")).orderBy("id").collect()
    wins = {pair: X @ np.array(w) + c > 0 for pair, w, c in zip(pairs_of(4), model.weights, model.intercepts)}
    votes = np.array([[sum(won[i] if c == a else not won[i] for (a, b), won in wins.items() if c in (a, b)) for c in range(4)] for i in range(len(y))])
    assert [r.prediction for r in rows] == votes.argmax(axis=1).tolist()
    assert np.mean([r.prediction == c for r, c in zip(rows, y)]) > 0.9
    p = np.array([r.p for r in rows])
    assert p.shape == (len(y), 4) and (p >= 0).all() and p[:, 3].max() < 0.01
    np.testing.assert_allclose(p.sum(axis=1), 1.0)
    assert np.mean(p.argmax(axis=1) == y) > 0.9
    assert model.coefficientMatrix.toArray().tolist() == model.weights
    empty = PairwiseSVM(LinearSVC(), 3).fit(df.where("false"))
    again = empty.transform(df).select(vector_to_array("probability").alias("p"), "prediction").first()
    assert again.prediction == 0.0 and np.allclose(again.p, 1 / 3)


def test_training_saves_three_classes(spark):
    X, y, _ = _blobs(spark, 200)
    df = spark.createDataFrame([(i, float(a), float(b), "xyz"[c]) for i, ((a, b), c) in enumerate(zip(X, y))], "id long, a double, b double, t string")
    res = TR.train_model(df, ["a", "b"], [], "t", "Support Vector Machine", keys=["id"], params={"C": 1.0, "kernel": "linear"})
    assert res.feature_importances.count() == 2
    test = res.predictions.collect()
    assert test and all(len(r.probability) == 3 and abs(sum(r.probability) - 1) < 1e-9 for r in test)
    assert res.metrics.first().accuracy > 0.8
    loaded = load_model(spark, save_model(res, shared_dir(spark), "pairwise"))
    again = {r.id: (r.prediction, r.p) for r in loaded.transform(df, keep=["id"]).select("id", "prediction", vector_to_array("probability").alias("p")).collect()}
    assert all(again[r.id] == (r.prediction, list(r.probability)) for r in test)
