"""Multiclass boosting against numpy, kernel maps against their kernels, saved models against the fitted ones."""

import json

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import boosting
from tessera.operators.boosting import SoftmaxBoosting, SoftmaxBoostingModel
from tessera.plans import training as TR
from tessera.session import shared_dir
from tessera.sources.model_io import load_model, save_model


def _rows(spark, n=240, seed=5):
    rng = np.random.default_rng(seed)
    X = rng.integers(0, 2, size=(n, 4)).astype(float)
    y = (X[:, 0] + X[:, 1] * X[:, 2] + (rng.random(n) < 0.15)).astype(int).clip(0, 2)
    rows = [(i, Vectors.dense(x.tolist()), int(c)) for i, (x, c) in enumerate(zip(X, y))]
    return X, y, spark.createDataFrame(rows, ["id", "features", "label"])


def _leaf_of(tree, x):
    while "leaf" not in tree:
        tree = tree["left" if x[tree["feature"]] <= tree["threshold"] else "right"]
    return tree["leaf"]


def test_rounds_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CHECKPOINT_EVERY", 2)  # the third round starts from written scores
    X, y, df = _rows(spark)
    model = SoftmaxBoosting(3, n_estimators=3, learning_rate=0.2, max_depth=2).fit(df)
    raw = np.tile(np.log(np.bincount(y, minlength=3) / len(y)), (len(y), 1))
    for trees in model.rounds:
        p = np.exp(raw) / np.exp(raw).sum(axis=1, keepdims=True)
        for k, (tree, steps) in enumerate(trees):
            r = (y == k) - p[:, k]
            gain = [sum(r[X[:, j] == v].sum() ** 2 / max((X[:, j] == v).sum(), 1) for v in (0, 1)) for j in range(4)]
            assert gain[tree["feature"]] == pytest.approx(max(gain))
            leaf = np.array([_leaf_of(tree, x) for x in X])
            for i, step in enumerate(steps):
                q = r[leaf == i]
                assert step == pytest.approx(0.2 * 2 / 3 * q.sum() / (np.abs(q) * (1 - np.abs(q))).sum())
            raw[:, k] += np.array(steps)[leaf]
    want = np.exp(raw) / np.exp(raw).sum(axis=1, keepdims=True)
    got = {r.id: r for r in model.transform(df).collect()}
    for i in range(len(y)):
        assert np.allclose(got[i].probability.toArray(), want[i]) and got[i].prediction == want[i].argmax()
    again = SoftmaxBoostingModel.from_state(model.state()).transform(df)
    assert {r.id: r.rawPrediction for r in again.collect()} == {i: r.rawPrediction for i, r in got.items()}
    assert sum(model.featureImportances.toArray()) == pytest.approx(1) and model.featureImportances[3] < 0.2


def test_odd_tables(spark):
    _, _, df = _rows(spark)
    none = SoftmaxBoosting(3, n_estimators=2).fit(df.limit(0))
    assert np.allclose(none.transform(df).first().probability.toArray(), 1 / 3)
    one = SoftmaxBoosting(3, n_estimators=2, subsample=0.5).fit(df.withColumn("label", F.when(F.col("id") % 2 == 0, 1)))
    first = one.transform(df).first()
    assert first.prediction == 1 and first.probability[1] > 0.9


def test_kernel_maps(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(12, 3))
    df = spark.createDataFrame([(Vectors.dense(x.tolist()),) for x in X], ["features"])
    poly = np.array([r[0] for r in TR.kernel_map("poly", 0.7, 3, 1.0, 1)(df).select(vector_to_array("features")).collect()])
    assert poly.shape[1] == 10 and np.allclose(poly @ poly.T, (0.7 * X @ X.T) ** 3)
    rbf = np.array([r[0] for r in TR.kernel_map("rbf", 0.1, 3, 1.0, 1)(df).select(vector_to_array("features")).collect()])
    assert TR.FeatureMap(**json.loads(json.dumps(TR.kernel_map("rbf", 0.1, 3, 1.0, 1).state())))(df).collect() == TR.kernel_map("rbf", 0.1, 3, 1.0, 1)(df).collect()
    near = np.exp(-0.1 * ((X[:, None] - X[None]) ** 2).sum(axis=2))
    assert np.abs(rbf @ rbf.T - near).max() < 0.5 and np.abs(rbf @ rbf.T - near).mean() < 0.12


@pytest.mark.parametrize("model, params, classes", [
    ("Gradient Boosting", {"n_estimators": 2, "max_depth": 2}, 3), ("Support Vector Machine", {"C": 0.01, "kernel": "poly"}, 2), ("K-Nearest Neighbors", {"n_neighbors": 3}, 3)])
def test_saved_models_score_alike(spark, model, params, classes):
    X, y, df = _rows(spark)
    flat = df.withColumn("v", vector_to_array("features")).select("id", *[(F.col("v")[j] + F.col("id") % 7 / 10).alias(f"f{j}") for j in range(3)],
                                                                  F.least("label", F.lit(classes - 1)).alias("label_"))
    res = TR.train_model(flat, ["f0", "f1", "f2"], [], "label_", model, keys=["id"], params=params, is_classification=True)
    path = save_model(res, shared_dir(spark) + "/saved-models", model.replace(" ", "") + params.get("kernel", ""))
    loaded = load_model(spark, path).transform(flat, keep=["id"]).withColumn("p", vector_to_array("probability"))
    want = {r.id: r for r in res.predictions.collect()}
    got = {r.id: r for r in loaded.collect()}
    assert want and all(got[i].prediction == r.prediction and np.allclose(got[i].p, r.probability) for i, r in want.items())
    assert all(len(r.probability) == classes and sum(r.probability) == pytest.approx(1) for r in want.values())
