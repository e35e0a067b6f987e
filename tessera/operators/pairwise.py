"""Support vector machines of three or more classes: one linear margin for every pair of classes.

A row's class is the one most pairs vote for.  Its class probabilities couple the calibrated probabilities of the pairs:
with ``r[i][j]`` the probability of class i among i and j, they minimise the sum of ``(r[j][i] p[i] - r[i][j] p[j])^2``
over all pairs under ``sum(p) = 1``, one small linear system a row, solved in SQL functions.
"""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.hinge import fit_svc

#: Pair probabilities stay this far from 0 and 1, so that every system has one solution.
LEAST = 1e-7
#: Pairs fitted at the same time.
PARALLEL = 4


def solve(equations: Column, n: int) -> Column:
    """Solutions of ``n`` equations (rows of n coefficients and a right side) with a positive definite matrix."""
    def clear(rows: Column, k: Column) -> Column:
        pivot = F.get(rows, k)
        return F.transform(rows, lambda row, i: F.when(i == k, row).otherwise(
            F.zip_with(row, pivot, lambda a, b: a - F.get(row, k) / F.get(pivot, k) * b)))

    cleared = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), equations, clear)
    return F.transform(cleared, lambda row, i: F.get(row, F.lit(n)) / F.get(row, i))


def pairs_of(classes: int) -> list[tuple[int, int]]:
    return list(itertools.combinations(range(classes), 2))


def couple(df: DataFrame, pairwise: str, classes: int, output: str) -> DataFrame:
    """Add the array ``output`` of class probabilities, from the array ``pairwise`` that holds, for every pair i < j in
    the order of ``pairs_of``, the probability of class i among i and j.  A null in it makes the result null."""
    at = {pair: k for k, pair in enumerate(pairs_of(classes))}
    near = F.transform(pairwise, lambda p: F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1 - LEAST)), F.lit(LEAST))))
    df = df.withColumn("__r", near)

    def r(i: int, j: int) -> Column:
        return F.col("__r")[at[i, j]] if i < j else 1 - F.col("__r")[at[j, i]]

    # Q p = -b and sum(p) = 1 have the direction of (Q + 1)^-1 1, whose matrix is positive definite
    rows = [F.array(*[1 + sum(r(s, i) * r(s, i) for s in range(classes) if s != i) if i == j else 1 - r(j, i) * r(i, j)
                      for j in range(classes)], F.lit(1.0)) for i in range(classes)]
    df = df.withColumn("__x", solve(F.array(*rows), classes))
    total = F.aggregate("__x", F.lit(0.0), lambda s, v: s + v)
    return df.withColumn(output, F.when(total.isNotNull(), F.transform("__x", lambda v: v / total))).drop("__r", "__x")


class PairwiseSVMModel:
    """For every pair of classes a margin (weights, intercept; above 0 votes for the first, 0 is half a vote each) and its calibration (a, b)."""

    def __init__(self, classes: int, weights: list, intercepts: list, calibration: list, features_col: str = "features"):
        self.classes, self.weights, self.intercepts, self.calibration, self.features_col = classes, weights, intercepts, calibration, features_col

    def state(self) -> dict:
        return {"classes": self.classes, "weights": self.weights, "intercepts": self.intercepts, "calibration": self.calibration}

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        return DenseMatrix(len(self.weights), len(self.weights[0]), [v for w in self.weights for v in w], isTransposed=True)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with rawPrediction (votes), probability (vectors) and prediction; equal votes go to the smaller class."""
        x = F.col("__f")
        margins = [F.aggregate(F.zip_with(x, F.lit([float(v) for v in w]), lambda a, b: a * b), F.lit(float(c)), lambda s, v: s + v) if any(w) else F.lit(float(c))
                   for w, c in zip(self.weights, self.intercepts)]
        out = df.withColumn("__f", vector_to_array(self.features_col)).withColumn("__m", F.array(*margins)).drop("__f")
        win = {pair: (F.signum(F.col("__m")[k]) + 1) / 2 for k, pair in enumerate(pairs_of(self.classes))}
        votes = [sum(won if c == i else 1 - won for (i, j), won in win.items() if c in (i, j)) for c in range(self.classes)]
        chances = [1 / (1 + F.exp(-(F.col("__m")[k] * a + b))) for k, (a, b) in enumerate(self.calibration)]
        out = couple(out.withColumn("__v", F.array(*votes)).withColumn("__c", F.array(*chances)), "__c", self.classes, "__p")
        return (out.withColumn("rawPrediction", array_to_vector("__v")).withColumn("probability", array_to_vector("__p"))
                .withColumn("prediction", (F.array_position("__v", F.array_max("__v")) - 1).cast("double")).drop("__m", "__v", "__c", "__p"))


class PairwiseSVM:
    """Estimator of ``classes`` classes coded 0, 1, ...: ``svc`` (a ``LinearSVC``) is fitted to the rows of each pair of classes.

    Rows with a null label are left out.  A class without rows loses against every class that has some; two such
    classes are even.  Pairs are fitted by a few threads, each fit distributed over its rows."""

    def __init__(self, svc, classes: int, featuresCol: str = "features", labelCol: str = "label"):
        self.svc, self.classes, self.features_col, self.label_col = svc, classes, featuresCol, labelCol

    def fit(self, df: DataFrame, fmap=None) -> PairwiseSVMModel:
        """``fmap`` maps the features of ``df`` for a kernel."""
        from tessera.plans.training import PlattScaled
        label = F.col(self.label_col)
        rows = df.where(label.isNotNull())
        found = {int(r[0]) for r in rows.select(label).distinct().collect()}  # one row a class
        one = rows.select(self.features_col).first()
        width = one[0].size if one else 1
        if fmap and one:
            width = fmap.components(one[0].toArray()[None, :]).shape[1]
        svc = self.svc.copy().setLabelCol("label").setFeaturesCol(self.features_col)

        def fit_pair(pair: tuple[int, int]):
            i, j = pair
            if i not in found or j not in found:
                side = (i in found) - (j in found)
                return [0.0] * width, float(side), (0.0, 16.0 * side)
            two = rows.where(label.isin(i, j)).withColumn("label", (label == i).cast("double"))
            model = fit_svc(svc, two, fmap) if fmap else svc.fit(two)
            scaled = PlattScaled.fit(model, two, fmap)
            return [float(v) for v in model.coefficients.toArray()], float(model.intercept), (scaled.a, scaled.b)

        with ThreadPoolExecutor(max_workers=PARALLEL) as pool:
            fitted = list(pool.map(fit_pair, pairs_of(self.classes)))
        return PairwiseSVMModel(self.classes, [f[0] for f in fitted], [f[1] for f in fitted], [list(f[2]) for f in fitted], self.features_col)
