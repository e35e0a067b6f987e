"""Linear epsilon-insensitive support vector regression.

Spark ML has no SVR, so the primal objective ``0.5 ||w||^2 + C * sum(max(0, |y - w.x - b| - epsilon))``
is minimised here.  The hinge's corner is rounded over a width ``mu`` and each rounded problem is solved
by Newton steps with a line search, warm-started while ``mu`` shrinks.  Rounding changes the objective
by at most ``C * n * mu / 2``, so the last ``mu`` bounds the distance from the optimum.  The rows are kept as blocks
of matrices, and each step is one distributed sum over them (feature-sized on the driver): the losses of the line
search, and gradient and curvature at the full step, which is the next point unless a shorter one is better.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of the rounded corner, as shares of the target's mean absolute deviation.
WIDTHS = (1.0, 0.1, 0.01, 0.001)
#: Step sizes compared in one line search.
STEPS = tuple(0.5 ** k for k in range(12))
#: Rows of a block.
BLOCK_ROWS = 4096


def _linear(x: Column, theta: np.ndarray) -> Column:
    """w.x + b for theta = (w, b)."""
    w = F.array(*[F.lit(float(v)) for v in theta[:-1]])
    return F.aggregate(F.zip_with(x, w, lambda a, c: a * c), F.lit(float(theta[-1])), lambda s, v: s + v)


def _pack(batches):
    """Batches of rows (x, y) as blocks: the matrix of x with a column of ones, and y, in bytes."""
    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        if not len(y):
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        for at in range(0, len(y), BLOCK_ROWS):
            part = np.column_stack([x[at:at + BLOCK_ROWS], np.ones(len(y[at:at + BLOCK_ROWS]))])
            yield pa.RecordBatch.from_pydict({"x": pa.array([part.tobytes()], pa.binary()), "y": pa.array([y[at:at + BLOCK_ROWS].tobytes()], pa.binary())})


class LinearSVRModel:
    def __init__(self, w: np.ndarray, b: float, features_col: str, prediction_col: str = "prediction"):
        self.coefficients = Vectors.dense(w)
        self.intercept = float(b)
        self.features_col = features_col
        self.prediction_col = prediction_col

    def transform(self, df: DataFrame) -> DataFrame:
        theta = np.append(self.coefficients.toArray(), self.intercept)
        return df.withColumn(self.prediction_col, _linear(vector_to_array(self.features_col), theta))


class LinearSVR:
    def __init__(self, C: float = 1.0, epsilon: float = 0.1, maxIter: int = 60, featuresCol: str = "features",
                 labelCol: str = "label", tol: float = 1e-4):
        """``maxIter`` Newton steps at most per width; ``tol`` is the predicted decrease, as a share of the objective, at which
        a width is done.  A fit that needs more steps raises."""
        self.C, self.epsilon, self.max_iter, self.tol = C, epsilon, maxIter, tol
        self.features_col, self.label_col = featuresCol, labelCol

    def fit(self, df: DataFrame) -> LinearSVRModel:
        rows = df.select(vector_to_array(self.features_col).alias("x"), F.col(self.label_col).cast("double").alias("y")).where(F.col("y").isNotNull())
        d = rows.select(F.size("x").alias("d")).first()
        if d is None:
            raise ValueError("SVR needs at least one row")
        blocks = rows.mapInArrow(_pack, "x binary, y binary").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(rows.select("y"), blocks, d[0])  # the vectors are not computed again for y
        finally:
            blocks.unpersist()

    def _fit(self, y: DataFrame, blocks: DataFrame, d: int) -> LinearSVRModel:
        med = y.agg(F.percentile_approx("y", 0.5, 1000)).first()[0]
        spread = y.agg(F.avg(F.abs(F.col("y") - med))).first()[0] or 1.0
        theta = np.append(np.zeros(d), med)
        for width in WIDTHS:
            theta = self._solve(blocks, theta, width * spread)
        return LinearSVRModel(theta[:-1], theta[-1], self.features_col)

    def _sums(self, blocks: DataFrame, theta: np.ndarray, step: np.ndarray, mu: float):
        """Summed losses at ``theta`` plus every share STEPS of ``step``, then gradient and curvature of the loss at the full step."""
        epsilon, p = self.epsilon, len(theta)

        def add(batches):
            total = np.zeros(len(STEPS) + p + p * p)
            for batch in batches:
                for bx, by in zip(batch.column("x"), batch.column("y"), strict=True):
                    y = np.frombuffer(by.as_buffer())
                    x = np.frombuffer(bx.as_buffer()).reshape(len(y), p)
                    r, move = y - x @ theta, x @ step
                    for i, s in enumerate(STEPS):
                        t = np.maximum(np.abs(r - s * move) - epsilon, 0.0)
                        total[i] += np.where(t < mu, t * t / (2 * mu), t - mu / 2).sum()
                    r = r - move
                    t = np.abs(r) - epsilon
                    total[len(STEPS):len(STEPS) + p] += x.T @ (np.sign(r) * np.clip(t / mu, 0.0, 1.0))
                    bent = x[(t > 0) & (t < mu)]
                    total[len(STEPS) + p:] += (bent.T @ bent / mu).ravel()
            yield pa.RecordBatch.from_pydict({"s": pa.array([total])})

        told = blocks.mapInArrow(add, "s array<double>").select(array_to_vector("s").alias("s"))
        sums = told.agg(Summarizer.sum(F.col("s"))).first()[0].toArray()
        return sums[:len(STEPS)], sums[len(STEPS):len(STEPS) + p], sums[len(STEPS) + p:].reshape(p, p)

    def _solve(self, blocks: DataFrame, theta: np.ndarray, mu: float) -> np.ndarray:
        ridge = np.append(np.ones(len(theta) - 1), 0.0)
        value_of = lambda t, loss: 0.5 * float(t[:-1] @ t[:-1]) + self.C * loss
        losses, slope, bend = self._sums(blocks, theta, np.zeros_like(theta), mu)
        value = value_of(theta, losses[0])
        for _ in range(self.max_iter):
            grad = ridge * theta - self.C * slope
            hess = np.diag(ridge) + self.C * bend
            step = -np.linalg.solve(hess + 1e-9 * (1 + np.trace(hess)) * np.eye(len(theta)), grad)
            if -grad @ step <= self.tol * (abs(value) + 1e-12):
                return theta
            tried = [theta + s * step for s in STEPS]
            losses, slope, bend = self._sums(blocks, theta, step, mu)
            values = [value_of(t, v) for t, v in zip(tried, losses, strict=True)]
            best = int(np.argmin(values))
            if values[best] >= value - 1e-12 * abs(value):
                return theta  # no step size lowers the objective: the optimum, to rounding
            theta, value = tried[best], values[best]
            if best:
                _, slope, bend = self._sums(blocks, theta, np.zeros_like(theta), mu)
        raise RuntimeError(f"SVR did not converge in {self.max_iter} Newton steps at width {mu:g}; raise maxIter or tol")
