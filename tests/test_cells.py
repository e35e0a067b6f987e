"""Trees over counted cells against the same trees over their rows."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import cells as CE
from tessera.operators.boosting import SoftmaxBoosting
from tessera.plans import training as TR
from tessera.session import shared_dir
from tessera.sources.model_io import load_model, save_model


@pytest.fixture
def always(monkeypatch):
    monkeypatch.setattr(CE, "LEAST_ROWS", 0)
    monkeypatch.setattr(CE, "MOST_CELLS", 1.0)


def _flat(spark, n=600, values=7):
    rng = np.random.default_rng(11)
    x = rng.integers(0, values, size=(n, 3)) / 10
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.1, size=n) > 0.45).astype(int)
    return spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "k long, f0 double, f1 double, f2 double, y int")


def test_thresholds_and_cells(spark):
    assert CE.split_points(np.array([3.0, 1, 1, 2])) == [1.5, 2.5] and CE.split_points(np.array([4.0, 4])) == []
    many = CE.split_points(np.random.default_rng(1).permutation(1000) / 7)
    assert len(many) == 31 and np.abs(np.diff(np.searchsorted(np.arange(1000) / 7, many)) - 1000 / 32).max() <= 1
    assert CE.bins_of(np.array([[1.0], [1.5], [1.6], [9.0]]), [[1.5, 2.5]])[:, 0].tolist() == [0, 0, 1, 2]
    x = np.random.default_rng(2).integers(0, 3, size=(200, 14)).astype(float)
    x[100:] = x[:100]  # 14 features fill more than one word
    df = spark.createDataFrame([(Vectors.dense(v), int(v[0] > 0)) for v in x], ["features", "label"])
    got = {tuple(r.features.toArray()): r.n for r in CE.count_cells(df, [[0.5, 1.5]] * 14, ["label"]).collect()}
    want, counts = np.unique(x, axis=0, return_counts=True)
    assert got == {tuple(w): c for w, c in zip(want, counts)}


def test_softmax_boosting_of_cells_is_that_of_rows(spark, monkeypatch):
    df = _flat(spark).select(F.array("f0", "f1", "f2").alias("x"), F.least(F.col("y") + (F.col("f2") > 0.4).cast("int"), F.lit(2)).alias("label"))
    df = df.select(TR.array_to_vector("x").alias("features"), "label")
    fit = lambda: SoftmaxBoosting(3, n_estimators=3, max_depth=2, min_leaf=5).fit(df)
    rows = fit()
    monkeypatch.setattr(CE, "LEAST_ROWS", 0)
    monkeypatch.setattr(CE, "MOST_CELLS", 1.0)
    seen = []
    monkeypatch.setattr(CE, "count_cells", lambda *a, f=CE.count_cells: seen.append(f(*a)) or seen[-1])
    cells = fit()
    assert seen and seen[0].agg(F.sum("n")).first()[0] == 600 and seen[0].count() < 600
    p = [np.array([r[0] for r in m.transform(df).select(vector_to_array("probability")).collect()]) for m in (rows, cells)]
    assert np.allclose(*p)


@pytest.mark.parametrize("model, params", [("Random Forest", {"n_estimators": 1, "bootstrap": False, "max_depth": 3, "min_samples_leaf": 4}),
                                           ("Gradient Boosting", {"n_estimators": 3, "max_depth": 2, "min_samples_leaf": 4})])
def test_classifiers_of_cells_are_those_of_rows(spark, monkeypatch, model, params):
    df = _flat(spark)
    train = lambda: TR.train_model(df, ["f0", "f1", "f2"], [], "y", model, keys=["k"], params=params)
    rows = {r.k: r for r in train().predictions.collect()}
    monkeypatch.setattr(CE, "LEAST_ROWS", 0)
    monkeypatch.setattr(CE, "MOST_CELLS", 1.0)
    res = train()
    cells = {r.k: r for r in res.predictions.collect()}
    assert res.feature_map.kernel == "bins" and rows.keys() == cells.keys()
    assert all(np.allclose(cells[k].probability, r.probability) for k, r in rows.items())


def test_forest_of_cells_search_and_saving(spark, always):
    df = _flat(spark, 3000)
    res = TR.train_model(df, ["f0", "f1", "f2"], [], "y", "Random Forest", keys=["k"], use_grid_search=True, cv=2,
                         custom_params={"n_estimators": [4], "max_depth": [1, 4], "class_weight": [None, "balanced"]})
    scores = {(r.param_max_depth, r.param_class_weight): r.mean_test_score for r in res.cv_results.collect()}
    assert len(scores) == 4 and scores["4", "None"] > 0.8 and res.model.getNumTrees == 4
    assert res.metrics.first().accuracy > 0.8 and sum(v.importance for v in res.feature_importances.collect()) == pytest.approx(1)
    loaded = load_model(spark, save_model(res, shared_dir(spark) + "/saved-models", "cells")).transform(df, keep=["k"])
    again = {r.k: r for r in loaded.collect()}
    want = res.predictions.collect()
    assert want and all(again[r.k].prediction == r.prediction and np.allclose(again[r.k].probability.toArray(), r.probability) for r in want)


def test_weighted_scores_are_those_of_the_rows(spark):
    rows = [(0, 0, 3), (0, 1, 1), (1, 1, 4), (1, 0, 2)]
    few = spark.createDataFrame([(float(a), float(b), float(n)) for a, b, n in rows], "label double, prediction double, n double")
    all_ = spark.createDataFrame([(float(a), float(b)) for a, b, n in rows for _ in range(n)], "label double, prediction double")
    for name, (task, _, _) in TR.SCORING.items():
        if task:
            assert TR.score_by_name(few, name, "n") == pytest.approx(TR.score_by_name(all_, name)), name


def test_draws_are_poisson_and_repeatable(spark):
    cells = spark.createDataFrame([(5.0, i % 2, [i]) for i in range(400)], "n double, label int, code array<bigint>")
    draw = lambda d: np.array([r[0] for r in d.orderBy("code").select(CE.draws_of(20, 7)).collect()])
    w = draw(cells)
    assert w.shape == (400, 20) and abs(w.mean() - 5) < 0.15 and abs(w.var() - 5) < 0.4
    assert (w == draw(cells.repartition(7))).all()
