import numpy as np
import pandas as pd
import pytest

from tessera.operators import gram


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)) * [1, 3, 0.5, 2] + [0, 5, 1, -2]
    y = x @ [1.5, -0.4, 0.0, 0.2] + 3 + rng.normal(size=400)
    return x, y, rng.integers(0, 4, 400)


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y, fold = data
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, fold=fold)
    pdf.loc[len(pdf)] = [np.nan, 0, 0, 0, 1, 0]
    return spark.createDataFrame(pdf).selectExpr("nanvl(a, null) a", "b", "c", "d", "y", "cast(fold as int) fold")


def direct(x, y, alpha, l1_ratio=None, fit_intercept=True, normalize=False):
    """Ridge by the normal equations, the others by subgradient optimality (proximal gradient steps to the end)."""
    mx, my = (x.mean(axis=0), y.mean()) if fit_intercept else (np.zeros(x.shape[1]), 0.0)
    z, t = x - mx, y - my
    size = np.sqrt((z ** 2).sum(axis=0)) if normalize and fit_intercept else np.ones(x.shape[1])
    z = z / size
    if l1_ratio is None:
        w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ t)
    else:
        n, w = len(z), np.zeros(z.shape[1])
        rate = 1 / (np.linalg.eigvalsh(z.T @ z / n).max() + alpha * (1 - l1_ratio))
        for _ in range(20_000):
            g = z.T @ (z @ w - t) / n + alpha * (1 - l1_ratio) * w
            w = w - rate * g
            w = np.sign(w) * np.maximum(np.abs(w) - rate * alpha * l1_ratio, 0)
    w = w / size
    return my - mx @ w, w


CANDIDATES = [{"alpha": 0.0}, {"alpha": 5.0}, {"alpha": 5.0, "fit_intercept": False}, {"alpha": 0.3, "normalize": True}, {"alpha": 0.2, "l1_ratio": 1.0},
              {"alpha": 0.5, "l1_ratio": 0.3}, {"alpha": 0.002, "l1_ratio": 1.0, "normalize": True}, {"alpha": 100.0, "l1_ratio": 1.0}]


@pytest.mark.parametrize("scoring", gram.SCORING)
def test_search_equals_direct_fits(frame, data, scoring):
    x, y, fold = data
    table, best, fit = gram.linear_search(frame, list("abcd"), "y", "fold", CANDIDATES, scoring)
    rows = table.collect()
    scores = []
    for r, c in [(next(r for r in rows if r["params"] == {k: str(v) for k, v in c.items()}), c) for c in CANDIDATES]:
        want = []
        for f in range(4):
            b, w = direct(x[fold != f], y[fold != f], **c)
            e = y[fold == f] - b - x[fold == f] @ w
            mse = (e ** 2).mean()
            want.append({"r2": 1 - mse / y[fold == f].var(), "neg_mean_squared_error": -mse}.get(scoring, -np.sqrt(mse)))
            assert r[f"split{f}_test_score"] == pytest.approx(want[-1], abs=1e-6)
        scores.append(np.mean(want))
    assert best == CANDIDATES[int(np.argmax(scores))]
    b, w = direct(x, y, **best)
    assert fit.intercept == pytest.approx(b, abs=1e-6) and np.allclose(fit.coefficients, w, atol=1e-6)
    told = frame.dropna().select(fit.predict(list("abcd")).alias("p")).toPandas()["p"]
    assert np.allclose(told, b + x @ w, atol=1e-5)


def test_a_large_lasso_penalty_drops_all(frame):
    _, _, fit = gram.linear_search(frame, list("abcd"), "y", "fold", [{"alpha": 1e6, "l1_ratio": 1.0}])
    assert (fit.coefficients == 0).all()


def test_unknown_scoring_and_no_rows(frame):
    with pytest.raises(ValueError, match="scoring"):
        gram.linear_search(frame, ["a"], "y", "fold", [{"alpha": 1.0}], "accuracy")
    with pytest.raises(ValueError, match="no rows"):
        gram.linear_search(frame.limit(0), ["a"], "y", "fold", [{"alpha": 1.0}])
    with pytest.raises(ValueError, match="no rows"):
        gram.newton_logistic(frame.limit(0), ["a"], "fold")


def test_newton_reaches_the_optimum(spark, data):
    x, _, fold = data
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1, -0.5, 0.3, 0] + 2)))).astype(int)
    u = rng.uniform(0.5, 2, 400)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(y=y, u=u))
    for weight, c in ((None, 1.0), ("u", 0.05)):
        fit = gram.newton_logistic(df, list("abcd"), "y", C=c, weight=weight)
        w = np.array([fit.intercept, *fit.coefficients])
        z = np.column_stack([np.ones(400), x])
        q = 1 / (1 + np.exp(-z @ w))
        slope = c * z.T @ ((u if weight else 1) * (q - y)) + w * [0, 1, 1, 1, 1]
        assert np.abs(slope).max() < 1e-6 and fit.steps < 15
        told = df.select(fit.probability(list("abcd")).alias("p")).toPandas()["p"]
        assert np.allclose(told, q)
    apart = spark.createDataFrame([(float(i), int(i > 5)) for i in range(10)], "x double, y int")
    assert gram.newton_logistic(apart, ["x"], "y", C=10.0).coefficients[0] > 0  # separable, held by the penalty
