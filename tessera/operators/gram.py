"""Linear models from sufficient statistics: one grouped aggregate answers every candidate of a search.

The sums of products of the features, the target and 1 (the Gram matrix) per fold are all that least squares, ridge, lasso and elastic
net need of the rows: a fold's training Gram matrix is the total less the fold's, and the held-out squared error is a quadratic
form in the fold's own.  So a search of any number of candidates reads the table once, and what reaches the driver is
folds x features^2 numbers.  Logistic regression needs one such aggregate per Newton step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores that are functions of the Gram matrix.
SCORING = ("neg_mean_squared_error", "neg_root_mean_squared_error", "r2")
#: Coordinate descent ends when no coefficient moves by more than this share of the largest, or after so many rounds.
MOVE, MOST_ROUNDS = 1e-12, 100_000


@dataclass
class LinearFit:
    intercept: float
    coefficients: np.ndarray

    def predict(self, columns: Sequence[str]) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(columns, self.coefficients, strict=True):
            out = out + F.col(c).cast("double") * float(w)
        return out


def gram_matrices(df: DataFrame, features: Sequence[str], target: str, fold: str) -> dict[int, np.ndarray]:
    """fold -> the (p + 2) x (p + 2) sums of products of 1, the features and the target.  Rows with a null in any of them are left out."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(target).cast("double")]
    n = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i + 1)]
    out = {}
    for r in df.dropna(subset=[*features, target]).groupBy(F.col(fold).alias("_fold")).agg(*sums).collect():  # one row per fold
        g = np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1):
                g[i, j] = g[j, i] = r[f"s{i}_{j}"]
        out[r["_fold"]] = g
    return out


def fit_gram(g: np.ndarray, alpha: float = 0.0, l1_ratio: float | None = None, fit_intercept: bool = True, normalize: bool = False) -> LinearFit:
    """The model of a Gram matrix.  ``l1_ratio`` None: squared error + alpha |w|^2 (alpha 0: least squares); else half the mean squared error
    + alpha (l1_ratio |w|_1 + (1 - l1_ratio) / 2 |w|^2).  ``normalize`` divides the centred features by their length first (with an intercept only)."""
    n, p = g[0, 0], len(g) - 2
    mean = g[0, 1:] / n if fit_intercept else np.zeros(p + 1)
    centred = g[1:, 1:] - n * np.outer(mean, mean)
    a, b = centred[:p, :p].copy(), centred[:p, p].copy()
    scale = np.ones(p)
    if normalize and fit_intercept:
        scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
        a, b = a / np.outer(scale, scale), b / scale
    if l1_ratio is None:
        w = np.linalg.lstsq(a + alpha * np.eye(p), b, rcond=None)[0]
    else:
        a, b, w = a / n, b / n, np.zeros(p)
        for _ in range(MOST_ROUNDS):
            before = w.copy()
            for j in range(p):
                rest = b[j] - a[j] @ w + a[j, j] * w[j]
                size = a[j, j] + alpha * (1 - l1_ratio)
                w[j] = np.sign(rest) * max(abs(rest) - alpha * l1_ratio, 0.0) / size if size > 0 else 0.0
            if np.abs(w - before).max(initial=0.0) <= MOVE * max(np.abs(w).max(initial=0.0), 1e-300):
                break
        else:
            raise RuntimeError("coordinate descent did not converge")
    w = w / scale
    return LinearFit(float(mean[p] - mean[:p] @ w), w)


def score_gram(g: np.ndarray, fit: LinearFit, scoring: str) -> float:
    """The score of ``fit`` on the rows of a Gram matrix."""
    if scoring not in SCORING:
        raise ValueError(f"scoring must be one of {SCORING}, not {scoring!r}")
    c = np.array([-fit.intercept, *(-fit.coefficients), 1.0])
    n, squares = g[0, 0], max(float(c @ g @ c), 0.0)
    if scoring == "r2":
        spread = g[-1, -1] - g[0, -1] ** 2 / n
        return 1 - squares / spread if spread > 0 else 0.0
    return -squares / n if scoring == "neg_mean_squared_error" else -float(np.sqrt(squares / n))


def linear_search(df: DataFrame, features: Sequence[str], target: str, fold: str, candidates: Sequence[dict],
                  scoring: str = "neg_mean_squared_error") -> tuple[DataFrame, dict, LinearFit]:
    """(cross-validation table, best candidate, its fit on all rows) over ``candidates`` with the arguments of ``fit_gram``.

    The table has params, param_<name>, split<i>_test_score, mean_test_score, std_test_score and rank_test_score, one row a candidate."""
    from tessera.plans.training import cv_results_frame
    by_fold = gram_matrices(df, features, target, fold)
    if not by_fold:
        raise ValueError("no rows to fit")
    total, order = sum(by_fold.values()), sorted(by_fold)
    scores = np.array([[score_gram(by_fold[f], fit_gram(total - by_fold[f], **c), scoring) for f in order] for c in candidates])
    best = candidates[int(scores.mean(axis=1).argmax())]
    return cv_results_frame(df.sparkSession, list(candidates), scores), best, fit_gram(total, **best)


@dataclass
class LogisticFit:
    intercept: float
    coefficients: np.ndarray
    loss: float
    steps: int

    def probability(self, columns: Sequence[str]) -> Column:
        return 1 / (1 + F.exp(-LinearFit(self.intercept, self.coefficients).predict(columns)))


def newton_logistic(df: DataFrame, features: Sequence[str], label: str, C: float = 1.0, steps: int = 25, tolerance: float = 1e-9,
                    weight: str | None = None) -> LogisticFit:
    """Binary logistic regression by Newton steps (iterated weighted least squares): |w|^2 / 2 + C times the (weighted) log loss, the intercept free.

    A step is one aggregate: the gradient and the matrix of second derivatives are sums over rows.  Steps end when no coefficient moves by
    more than ``tolerance``, or after ``steps``.  A step that raises the loss is halved.  ``label`` is 0 or 1; rows with nulls are left out."""
    rows = df.dropna(subset=[*features, label, *([weight] if weight else [])])
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    y, u, p = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0), len(features) + 1
    penalty = np.array([0.0] + [1.0] * (p - 1))

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = F.lit(0.0)
        for c, v in zip(x, w, strict=True):
            z = z + c * F.lit(float(v))
        told = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], y.alias("y"), u.alias("u"), z.alias("z"))
        q = 1 / (1 + F.exp(-F.col("z")))
        loss = F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("y") * F.col("z")
        curve = F.col("u") * q * (1 - q)
        r = told.agg(F.sum(F.col("u") * loss).alias("loss"), *[F.sum(F.col("u") * (q - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(p)],
                     *[F.sum(curve * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(p) for j in range(i + 1)]).first()
        if r.loss is None:
            raise ValueError("no rows to fit")
        h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)])
        return C * r.loss + 0.5 * float((penalty * w) @ w), C * np.array([r[f"g{i}"] for i in range(p)]) + penalty * w, C * h + np.diag(penalty)

    w = np.zeros(p)
    loss, slope, curve = sums(w)
    done = 0
    while done < steps:
        step = np.linalg.lstsq(curve, slope, rcond=None)[0]
        done += 1
        for _ in range(40):
            new = sums(w - step)
            if new[0] <= loss + 1e-12 * abs(loss):
                break
            step = step / 2
        w, (loss, slope, curve) = w - step, new
        if np.abs(step).max() <= tolerance * max(1.0, np.abs(w).max()):
            break
    return LogisticFit(float(w[0]), w[1:], loss, done)
