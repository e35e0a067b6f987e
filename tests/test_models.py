import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.prepare import PrepConfig
from tessera.operators.split import with_split
from tessera.plans import training as TR
from tessera.session import shared_dir
from tessera.sources.model_io import load_model, save_model


def _reg100(spark):
    rng = np.random.default_rng(42)
    X = rng.normal(size=(100, 5))
    y = X[:, :3] @ np.array([1.5, -1.0, 2.0]) + rng.normal(scale=0.1, size=100) + 3.0
    pdf = pd.DataFrame(X, columns=[f"feature_{i}" for i in range(5)]).assign(target=y, k=np.arange(100))
    return spark.createDataFrame(pdf), pdf


def _cls100(spark):
    rng = np.random.default_rng(42)
    X = rng.normal(size=(100, 5))
    y = ((X[:, 0] + 0.5 * X[:, 1] - X[:, 2] + rng.normal(scale=0.3, size=100)) > 0).astype(int)
    pdf = pd.DataFrame(X, columns=[f"feature_{i}" for i in range(5)]).assign(target=y, k=np.arange(100))
    return spark.createDataFrame(pdf)


FEATS = [f"feature_{i}" for i in range(5)]


def test_ridge_matches_closed_form(spark):
    df, pdf = _reg100(spark)
    alpha = 10.0
    res = TR.train_model(df, FEATS, [], "target", "Ridge Regression", keys=["k"], params={"alpha": alpha},
                         prep_config=PrepConfig(numeric_scaler="none"))
    train_keys = {r.k for r in with_split(df, ["k"]).where("NOT is_test").select("k").collect()}
    t = pdf[pdf.k.isin(train_keys)]
    X, y = t[FEATS].to_numpy(), t.target.to_numpy()
    Xc, yc = X - X.mean(axis=0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(5), Xc.T @ yc)
    assert np.allclose(res.model.coefficients.toArray(), w, rtol=1e-4, atol=1e-6)


def test_ols_and_metric_keys(spark):
    df, _ = _reg100(spark)
    res = TR.train_model(df, FEATS, [], "target", "Linear Regression", keys=["k"])
    m = res.metrics.first().asDict()
    assert set(m) == {"mse", "rmse", "mae", "r2"} and m["r2"] > 0.9
    assert res.feature_importances.count() == 5


def test_logistic_grid_search(spark):
    df = _cls100(spark)
    res = TR.train_model(df, FEATS, [], "target", "Logistic Regression", keys=["k"], use_grid_search=True, cv=3,
                         custom_params={"C": [0.1, 1.0], "class_weight": [None, "balanced"]})
    assert set(res.metrics.first().asDict()) == {"accuracy", "precision", "recall", "f1"}
    cvr = res.cv_results.toPandas()
    assert len(cvr) == 4 and cvr.rank_test_score.min() == 1
    assert res.best_params in [{"C": c, "class_weight": w} for c in (0.1, 1.0) for w in (None, "balanced")]
    effect = TR.param_effect(res.cv_results, "C").count()
    assert effect == 2


def test_random_search_and_trees(spark):
    df = _cls100(spark)
    res = TR.train_model(df, FEATS, [], "target", "Decision Tree", keys=["k"], use_randomized_search=True,
                         n_iter=2, cv=2, custom_params={"max_depth": [2, 3, 4], "criterion": ["gini", "entropy"]})
    assert res.cv_results.count() == 2
    assert res.feature_importances.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_unknown_model(spark):
    df = _cls100(spark)
    with pytest.raises(ValueError):
        TR.train_model(df, FEATS, [], "target", "Nope", keys=["k"])


def test_save_load_round_trip(spark):
    df = _cls100(spark)
    res = TR.train_model(df, FEATS, [], "target", "Logistic Regression", keys=["k"])
    path = save_model(res, os.path.join(shared_dir(spark), f"m-{os.urandom(3).hex()}"), "lr")
    loaded = load_model(spark, path)
    a = res.transform(df, keep=["k"]).select("k", "prediction").orderBy("k").collect()
    b = loaded.transform(df, keep=["k"]).select("k", "prediction").orderBy("k").collect()
    assert a == b
    with pytest.raises(RuntimeError):
        load_model(spark, path + "-missing")


def test_cv_ols_closed_form(spark):
    df, pdf = _reg100(spark)
    d = df.select(F.col("feature_0").alias("x"), F.col("target").alias("y"), (F.col("k") % 4).cast("int").alias("fold"))
    cvr = {r.param_fit_intercept: r for r in TR.cv_ols_closed_form(d, "x", "y", "fold", 4).collect()}
    scores = []
    for f in range(4):
        tr, te = pdf[pdf.k % 4 != f], pdf[pdf.k % 4 == f]
        b, a = np.polyfit(tr.feature_0, tr.target, 1)
        scores.append(-np.mean((te.target - a - b * te.feature_0) ** 2))
    assert cvr["True"].mean_test_score == pytest.approx(np.mean(scores))


def test_stream_scoring_matches_batch(spark):
    from tessera.streaming.scoring import score_stream, to_table
    df = _cls100(spark)
    res = TR.train_model(df, FEATS, [], "target", "Logistic Regression", keys=["k"])
    base = os.path.join(shared_dir(spark), f"stream-{os.urandom(3).hex()}")
    df.write.parquet(os.path.join(base, "in"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(base, "in"))
    q = to_table(score_stream(res, stream, keep=["k"]), "scored_test", os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("scored_test").collect())
    exp = sorted(tuple(r) for r in res.transform(df, keep=["k"]).select("k", "prediction").collect())
    assert got == exp


def test_csv_reader_tokens_and_types(spark):
    from tessera.sources.csv import read_csv, write_predictions_csv
    base = os.path.join(shared_dir(spark), f"csv-{os.urandom(3).hex()}")
    os.makedirs(base)
    with open(os.path.join(base, "t.csv"), "w") as f:
        f.write("a,b,c,d,e\n1,1.5,x,True,NA\n2,NaN,NA,False,\n3,,null,true,N/A\n")
    df = read_csv(spark, os.path.join(base, "t.csv"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "string", "boolean", "double"]
    assert df.where("b IS NULL").count() == 2 and df.where("c IS NULL").count() == 2
    write_predictions_csv(df, os.path.join(base, "pred"), "a", "b")
    assert spark.read.option("header", True).csv(os.path.join(base, "pred")).columns == ["Actual", "Predicted"]


def test_svm_probability_and_history_record(spark):
    from tessera.operators.history import history_wide
    from tessera.sources.history_store import HistoryStore
    df = _cls100(spark)
    res = TR.train_model(df, FEATS, [], "target", "Support Vector Machine", keys=["k"],
                         params={"C": 1.0, "kernel": "linear"})
    probs = res.predictions.select("probability").collect()
    assert all(abs(sum(r.probability) - 1.0) < 1e-9 for r in probs)
    store = HistoryStore(spark, os.path.join(shared_dir(spark), f"rec-{os.urandom(3).hex()}"))
    TR.record_run(store, res, "cls100")
    row = history_wide(store.read()).first()
    assert row.model_name.startswith("Support Vector Machine_") and row.model_type == "Classification"
    assert row.n_features == 5 and row.metric_accuracy is not None


def test_grid_search_stratified_folds_for_classifiers(spark):
    df = _cls100(spark)
    res = TR.train_model(df, FEATS, [], "target", "Logistic Regression", keys=["k"], use_grid_search=True, cv=3,
                         custom_params={"C": [1.0]})
    assert res.cv_results.count() == 1


def test_save_load_calibrated_svm(spark):
    df = _cls100(spark)
    res = TR.train_model(df, FEATS, [], "target", "Support Vector Machine", keys=["k"], params={"kernel": "linear"})
    path = save_model(res, os.path.join(shared_dir(spark), f"svm-{os.urandom(3).hex()}"), "svm")
    loaded = load_model(spark, path)
    a = res.transform(df, keep=["k"]).select("k", "probability").orderBy("k").collect()
    b = loaded.transform(df, keep=["k"]).select("k", "probability").orderBy("k").collect()
    assert a == b


def test_release_cached_rows(spark):
    df = _cls100(spark)
    res = TR.train_model(df, FEATS, [], "target", "Decision Tree", keys=["k"], params={"max_depth": 3})
    assert res.cached.is_cached
    res.release()
    assert res.cached is None


def test_scores_by_name(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (2, 2)]
    pred = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "label double, prediction double")
    want = {"accuracy": 4 / 6, "precision": 2 / 4, "recall": 1.0, "f1": 2 * 0.5 / 1.5, "recall_weighted": 4 / 6,
            "precision_weighted": (1 + 0.5 + 1) / 3, "f1_weighted": (2 / 3 + 2 / 3 + 2 / 3) / 3,
            "neg_mean_squared_error": -2 / 6, "neg_root_mean_squared_error": -(2 / 6) ** 0.5, "neg_mean_absolute_error": -2 / 6, "r2": 1 - 2 / 4}
    assert set(want) == set(TR.SCORING)
    for name, value in want.items():
        assert abs(TR.score_by_name(pred, name) - value) < 1e-12, name
    assert TR.check_scoring(None, True) == "accuracy" and TR.check_scoring(None, False) == "neg_mean_squared_error"
    for name, task in (("r2", True), ("f1", False), ("other", True)):
        with pytest.raises(ValueError, match="scoring"):
            TR.check_scoring(name, task)


def test_kernel_maps_are_matrices_not_an_expression_a_coordinate(spark):
    """100 written-out cosines make one method too long to be compiled: the map of a row was interpreted."""
    from pyspark.ml.linalg import Vectors
    x = np.random.default_rng(2).normal(size=(40, 3))
    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["i", "features"])
    for kernel in ("rbf", "poly"):
        fmap = TR.kernel_map(kernel, 0.2, 3, 1.0, 7)
        out = fmap(df)
        assert "COS(" not in out._jdf.queryExecution().toString() and out.columns == ["i", "features"]
        z = np.array([r.features.toArray() for r in out.orderBy("i").collect()])
        if kernel == "poly":
            assert np.allclose(z @ z.T, (0.2 * x @ x.T) ** 3)
        else:
            w, b = np.array(fmap.weights), np.array(fmap.offsets)
            assert np.allclose(z, np.cos(x @ w.T + b) * np.sqrt(2 / len(b)))


def test_linear_machines_run_few_tasks_a_pass(spark):
    """A solver's pass over few rows needs one task a core, not one a shuffle partition."""
    few = spark.range(1000).repartition(64)
    cores = spark.sparkContext.defaultParallelism
    assert TR.for_passes(few, 1000).rdd.getNumPartitions() == cores
    assert TR.for_passes(few, cores * TR.PASS_ROWS + 1).rdd.getNumPartitions() == cores + 1
    assert TR.for_passes(few, 10 ** 12).rdd.getNumPartitions() == 64
