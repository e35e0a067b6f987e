"""Linear SVR reaches the optimum of its objective."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tessera.plans.svr import LinearSVR


def _frame(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y, strict=True)], ["features", "label"])


def _objective(x, y, w, b, c, eps):
    return 0.5 * w @ w + c * np.maximum(np.abs(y - x @ w - b) - eps, 0).sum()


def test_noise_free_line_is_recovered(spark):
    x = np.linspace(0, 10, 500)[:, None]
    y = 50 + 3 * x[:, 0]
    m = LinearSVR(C=1.0, epsilon=0.1).fit(_frame(spark, x, y))
    assert m.intercept == pytest.approx(50, abs=0.2) and m.coefficients[0] == pytest.approx(3, abs=0.05)
    r = y - x[:, 0] * m.coefficients[0] - m.intercept
    assert 1 - (r ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.999


def test_no_nearby_point_is_better(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = 200 + x @ np.array([5.0, -2.0, 0.0]) + rng.standard_t(2, size=400)
    m = LinearSVR(C=0.5, epsilon=0.2).fit(_frame(spark, x, y))
    w, b = m.coefficients.toArray(), m.intercept
    best = _objective(x, y, w, b, 0.5, 0.2)
    for _ in range(300):
        d = rng.normal(size=4) * 10 ** rng.uniform(-3, 0)
        assert _objective(x, y, w + d[:3], b + d[3], 0.5, 0.2) >= best * (1 - 2e-3)


def test_unfinished_fit_raises(spark):
    x = np.arange(20.0)[:, None]
    with pytest.raises(RuntimeError, match="did not converge"):
        LinearSVR(maxIter=1).fit(_frame(spark, x, np.sin(x[:, 0]) * 30))


def test_a_step_is_one_pass_and_memory_one_block(spark):
    """56 features (the cubic map of six): curvature is summed by matrices, so rows are not widened to 57 x 57 numbers each."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 56))
    y = x @ rng.normal(size=56) + 0.05 * rng.normal(size=6000)
    passes, whole = [], LinearSVR._sums
    est = LinearSVR(C=1.0, epsilon=0.1)
    est._sums = lambda *a: passes.append(1) or whole(est, *a)
    m = est.fit(_frame(spark, x, y))
    assert np.abs(y - x @ m.coefficients.toArray() - m.intercept).max() < 0.3 and 4 < len(passes) < 80


def test_rows_without_a_target_are_left_out(spark):
    df = _frame(spark, np.arange(60.0)[:, None], 2 * np.arange(60.0)).selectExpr("features", "CASE WHEN label % 3 > 0 THEN label END AS label")
    m = LinearSVR().fit(df)
    assert m.coefficients[0] == pytest.approx(2.0, abs=0.05)
