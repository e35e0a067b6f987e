"""The block-wise fit of kernel machines against Spark's ``LinearSVC``, and its passes against plain sums."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors

from tessera.operators import hinge as H
from tessera.operators.pairwise import PairwiseSVM
from tessera.plans import training as TR


def _rows(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), 50 + 9 * rng.normal(size=n), rng.integers(0, 2, n), np.ones(n)])
    y = (x[:, 0] + 0.1 * (x[:, 1] - 50) + rng.normal(size=n) > 0).astype(float)
    w = rng.choice([0.5, 1.0, 2.0], n)
    df = spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w)], ["features", "label", "w"]).repartition(3)
    return x, y, w, df


@pytest.mark.parametrize("kernel", ["poly", "rbf"])
def test_steps_are_those_of_spark(spark, kernel):
    x, _, _, df = _rows(spark)
    svc = LinearSVC(regParam=0.01, standardization=False, maxIter=7, weightCol="w")
    fmap = TR.kernel_map(kernel, "scale", 4, float(x.var()), 3)
    want, got = svc.fit(fmap(df)), H.fit_svc(svc, df, fmap)
    np.testing.assert_allclose(got.coefficients.toArray(), want.coefficients.toArray(), rtol=1e-6, atol=1e-9)
    assert got.intercept == pytest.approx(want.intercept, rel=1e-6, abs=1e-9)
    assert got.numFeatures == want.numFeatures and got.getWeightCol() == "w"


def test_kernel_passes_read_input_features_and_are_few(spark, monkeypatch):
    """A hundred coordinates a row were kept, and every step size took a job."""
    x, _, _, df = _rows(spark, 900)
    passes, widths, whole = [], [], H._Rows.changes

    def seen(self, points):
        passes.append(len(points))
        widths.extend(self.blocks.map(lambda b: len(b[0]) // max(len(b[1]), 1)).distinct().collect())
        return whole(self, points)

    monkeypatch.setattr(H._Rows, "changes", seen)
    fmap = TR.kernel_map("rbf", "scale", 4, float(x.var()), 3)
    svc = LinearSVC(regParam=0.01, standardization=False, maxIter=5, tol=0.0)
    model = TR.fit_svc(svc, df, fmap)
    assert model.numFeatures == TR.RFF_COMPONENTS and set(widths) == {4} and 5 <= len(passes) <= 14


def test_changes_are_the_sums_of_rows_that_cross(spark):
    rng = np.random.default_rng(8)
    x, y, w = rng.normal(size=(7000, 3)) * [1, 1e6, 1e-3], rng.choice([-1.0, 1.0], 7000), rng.choice([1.0, 3.0], 7000)
    x[:40, 1] = 1e38  # leaves single precision in a product
    fmap = TR.kernel_map("poly", 1e-4, 3, 1.0, 1)
    blocks = spark.sparkContext.parallelize([(np.ascontiguousarray(x[i:i + 900].T).tobytes(), (y * w)[i:i + 900].tobytes(), 0) for i in range(0, 7000, 900)], 3)
    z = fmap.components(x)
    c = rng.normal(size=z.shape[1]) / np.median(np.abs(z), axis=0) / z.shape[1]
    points = [(c, 0.3), (c * 1.01, 0.3), (c, 0.3 + 1e-9), (c * -2, 0.1)]
    inside = [(1 - y * ((z * a).sum(axis=1) + b) > 0) * w for a, b in points]
    got = H._Rows(blocks, fmap).changes(points)
    for k in (1, 2, 3):
        moved = inside[k] - inside[0]
        want = np.concatenate([[moved.sum(), moved @ y], (moved * y) @ z])
        size = np.concatenate([[1, 1], np.abs(moved) @ np.abs(z) + 1e-300])
        assert (np.abs(got[:, k - 1] - want) <= 1e-9 * size).all()


def test_rows_that_spark_refuses_are_refused(spark):
    svc = LinearSVC(standardization=False)
    rows = [(Vectors.dense([1.0, 2.0]), 0.0), (Vectors.dense([2.0, 1.0]), 1.0)]
    for bad in ((Vectors.dense([float("nan"), 1.0]), 1.0), (Vectors.dense([1.0, 1.0]), 2.0)):
        df = spark.createDataFrame([*rows, bad], ["features", "label"])
        with pytest.raises(Exception):
            H.fit_svc(svc, df, TR.kernel_map("poly", "auto", 2, 1.0, 1))


def test_pairs_take_the_map_inside(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 240)
    x = np.array([[0, 0], [3, 0], [0, 3]])[y] + rng.normal(size=(240, 2))
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    fmap = TR.kernel_map("poly", "auto", 2, 1.0, 1)
    svc = LinearSVC(regParam=0.01, standardization=False, maxIter=4)
    inside, before = PairwiseSVM(svc, 3).fit(df, fmap), PairwiseSVM(svc, 3).fit(fmap(df))
    np.testing.assert_allclose(inside.weights, before.weights, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(inside.calibration, before.calibration, rtol=1e-4, atol=1e-6)
