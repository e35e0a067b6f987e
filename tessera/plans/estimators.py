"""Model catalogue: the classifier / regressor names, their default search grids,
and the mapping of each grid parameter onto a Spark ML estimator.

Penalty scaling follows the objectives: a C-penalised loss becomes
``regParam = 1 / (C n)``; a ridge penalty ``alpha ||w||^2`` on the summed loss
becomes ``regParam = alpha / n * std(y)`` because Spark scales the L2 term by
the label's standard deviation; an L1 penalty on the mean loss maps as is.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import classification as C
from pyspark.ml import regression as R

# Model catalogue and default parameter grids.
CLASSIFICATION_GRIDS: dict[str, dict[str, list]] = {
    "Logistic Regression": {
        "C": [0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l2"], "solver": ["lbfgs", "liblinear"],
        "class_weight": [None, "balanced"]},
    "Random Forest": {
        "n_estimators": [50, 100, 200, 300], "max_depth": [None, 10, 20, 30], "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4], "bootstrap": [True, False], "class_weight": [None, "balanced", "balanced_subsample"]},
    "Gradient Boosting": {
        "n_estimators": [50, 100, 200, 300], "learning_rate": [0.01, 0.05, 0.1, 0.2], "max_depth": [3, 5, 7, 9],
        "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    "Support Vector Machine": {
        "C": [0.1, 1.0, 10.0, 100.0], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", "auto", 0.1, 0.01],
        "probability": [True], "class_weight": [None, "balanced"]},
    "K-Nearest Neighbors": {
        "n_neighbors": [3, 5, 7, 9, 11], "weights": ["uniform", "distance"],
        "algorithm": ["auto", "ball_tree", "kd_tree", "brute"], "leaf_size": [20, 30, 40], "p": [1, 2]},
    "Decision Tree": {
        "max_depth": [None, 5, 10, 15, 20], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
        "criterion": ["gini", "entropy"], "class_weight": [None, "balanced"]},
}
REGRESSION_GRIDS: dict[str, dict[str, list]] = {
    "Linear Regression": {"fit_intercept": [True, False], "normalize": [False, True], "copy_X": [True],
                          "n_jobs": [None, -1]},
    "Ridge Regression": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0],
                         "solver": ["auto", "svd", "cholesky", "lsqr", "sparse_cg", "sag", "saga"],
                         "fit_intercept": [True, False], "normalize": [False, True]},
    "Lasso Regression": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0], "fit_intercept": [True, False],
                         "normalize": [False, True], "selection": ["cyclic", "random"]},
    "ElasticNet": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9],
                   "fit_intercept": [True, False], "normalize": [False, True], "selection": ["cyclic", "random"]},
    "Random Forest Regressor": {
        "n_estimators": [50, 100, 200, 300], "max_depth": [None, 10, 20, 30], "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4], "bootstrap": [True, False]},
    "Gradient Boosting Regressor": {
        "n_estimators": [50, 100, 200, 300], "learning_rate": [0.01, 0.05, 0.1, 0.2], "max_depth": [3, 5, 7, 9],
        "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4], "subsample": [0.8, 0.9, 1.0]},
    "SVR": {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", "auto", 0.1, 0.01],
            "epsilon": [0.1, 0.2, 0.5]},
}
# Library defaults used when a parameter is not given.
MAX_TREE_DEPTH = 30          # deepest tree Spark builds; stands in for "no limit"
DEFAULTS = {"C": 1.0, "n_estimators": 100, "learning_rate": 0.1, "max_depth_gb": 3, "min_samples_leaf": 1,
            "min_samples_split": 2, "alpha": 1.0, "l1_ratio": 0.5, "epsilon": 0.1, "n_neighbors": 5}
# Parameters that only steer a single-machine solver; they do not change the Spark fit.
ENGINE_ONLY = {"solver", "penalty", "copy_X", "n_jobs", "selection", "algorithm", "leaf_size", "normalize",
               "probability"}


def grid(model_name: str, is_classification: bool, custom: dict | None = None) -> dict[str, list]:
    grids = CLASSIFICATION_GRIDS if is_classification else REGRESSION_GRIDS
    if model_name not in grids:
        raise ValueError(f"unknown model {model_name!r}")
    return custom or grids[model_name]


def candidates(param_grid: dict[str, list]) -> list[dict]:
    keys = list(param_grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[param_grid[k] for k in keys])]


def sample_candidates(param_grid: dict[str, list], n_iter: int, seed: int) -> list[dict]:
    """n_iter combinations drawn without replacement (all when the grid is smaller)."""
    allc = candidates(param_grid)
    if len(allc) <= n_iter:
        return allc
    return [allc[i] for i in sorted(random.Random(seed).sample(range(len(allc)), n_iter))]


@dataclass(frozen=True)
class FitContext:
    """Training-set facts the parameter mapping needs."""
    n_rows: int
    n_classes: int
    label_std: float = 1.0
    n_features: int = 1
    feature_var: float = 1.0
    features_col: str = "features"
    label_col: str = "label"
    seed: int = 42


def _depth(v) -> int:
    return MAX_TREE_DEPTH if v is None else min(int(v), MAX_TREE_DEPTH)


def _leaf(p: dict) -> int:
    leaf = int(p.get("min_samples_leaf", DEFAULTS["min_samples_leaf"]))
    split = int(p.get("min_samples_split", DEFAULTS["min_samples_split"]))
    return max(leaf, math.ceil(split / 2))


def weight_column(p: dict) -> str | None:
    return "_w_balanced" if p.get("class_weight") in ("balanced", "balanced_subsample") else None


def make_estimator(model_name: str, is_classification: bool, params: dict, ctx: FitContext):
    """A Spark ML estimator, or one of this library, for one candidate."""
    p = {k: v for k, v in params.items() if k not in ENGINE_ONLY}
    base = {"featuresCol": ctx.features_col, "labelCol": ctx.label_col}
    w = weight_column(p)
    n = max(ctx.n_rows, 1)
    if is_classification:
        if model_name == "Logistic Regression":
            est = C.LogisticRegression(**base, regParam=1.0 / (float(p.get("C", DEFAULTS["C"])) * n),
                                       elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-4)
        elif model_name == "Random Forest":
            est = C.RandomForestClassifier(**base, numTrees=int(p.get("n_estimators", DEFAULTS["n_estimators"])),
                                           maxDepth=_depth(p.get("max_depth")), minInstancesPerNode=_leaf(p),
                                           bootstrap=bool(p.get("bootstrap", True)), seed=ctx.seed)
        elif model_name == "Gradient Boosting":
            rounds = int(p.get("n_estimators", DEFAULTS["n_estimators"]))
            rate = float(p.get("learning_rate", DEFAULTS["learning_rate"]))
            depth = _depth(p.get("max_depth", DEFAULTS["max_depth_gb"]))
            if ctx.n_classes <= 2:
                est = C.GBTClassifier(**base, maxIter=rounds, stepSize=rate, maxDepth=depth, minInstancesPerNode=_leaf(p), seed=ctx.seed)
            else:
                from tessera.operators.boosting import SoftmaxBoosting
                est = SoftmaxBoosting(ctx.n_classes, rounds, rate, depth, _leaf(p), seed=ctx.seed, **base)
            w = None
        elif model_name == "Support Vector Machine":
            svc = C.LinearSVC(**base, regParam=1.0 / (float(p.get("C", DEFAULTS["C"])) * n),
                              standardization=False, maxIter=100)
            if w:
                svc.setWeightCol(w)
            est = svc
            if ctx.n_classes > 2:
                from tessera.operators.pairwise import PairwiseSVM
                est = PairwiseSVM(svc, ctx.n_classes, **base)
            w = None
        elif model_name == "Decision Tree":
            est = C.DecisionTreeClassifier(**base, maxDepth=_depth(p.get("max_depth")), minInstancesPerNode=_leaf(p),
                                           impurity=p.get("criterion", "gini"), seed=ctx.seed)
        elif model_name == "K-Nearest Neighbors":
            from tessera.operators.knn import KNNClassifier
            est = KNNClassifier(k=int(p.get("n_neighbors", DEFAULTS["n_neighbors"])),
                                weights=p.get("weights", "uniform"), p=int(p.get("p", 2)), **base)
            w = None
        else:
            raise ValueError(f"unknown model {model_name!r}")
    else:
        if model_name == "Linear Regression":
            est = R.LinearRegression(**base, regParam=0.0, fitIntercept=bool(p.get("fit_intercept", True)),
                                     solver="normal")
        elif model_name == "Ridge Regression":
            l2 = float(p.get("alpha", DEFAULTS["alpha"])) / n * ctx.label_std
            est = R.LinearRegression(**base, regParam=l2, elasticNetParam=0.0, standardization=False,
                                     fitIntercept=bool(p.get("fit_intercept", True)), solver="normal")
        elif model_name in ("Lasso Regression", "ElasticNet"):
            alpha = float(p.get("alpha", DEFAULTS["alpha"]))
            rho = 1.0 if model_name == "Lasso Regression" else float(p.get("l1_ratio", DEFAULTS["l1_ratio"]))
            l1, l2 = alpha * rho, alpha * (1 - rho) * ctx.label_std
            est = R.LinearRegression(**base, regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2) if l1 + l2 else 0.0,
                                     standardization=False, fitIntercept=bool(p.get("fit_intercept", True)),
                                     solver="l-bfgs", maxIter=1000, tol=1e-10)
        elif model_name == "Random Forest Regressor":
            est = R.RandomForestRegressor(**base, numTrees=int(p.get("n_estimators", DEFAULTS["n_estimators"])),
                                          maxDepth=_depth(p.get("max_depth")), minInstancesPerNode=_leaf(p),
                                          bootstrap=bool(p.get("bootstrap", True)), seed=ctx.seed,
                                          featureSubsetStrategy="all")
        elif model_name == "Gradient Boosting Regressor":
            est = R.GBTRegressor(**base, maxIter=int(p.get("n_estimators", DEFAULTS["n_estimators"])),
                                 stepSize=float(p.get("learning_rate", DEFAULTS["learning_rate"])),
                                 maxDepth=_depth(p.get("max_depth", DEFAULTS["max_depth_gb"])),
                                 minInstancesPerNode=_leaf(p), subsamplingRate=float(p.get("subsample", 1.0)),
                                 seed=ctx.seed)
        elif model_name == "SVR":
            from tessera.plans.svr import LinearSVR
            est = LinearSVR(C=float(p.get("C", DEFAULTS["C"])), epsilon=float(p.get("epsilon", DEFAULTS["epsilon"])),
                            **base)
        else:
            raise ValueError(f"unknown model {model_name!r}")
    if w and hasattr(est, "setWeightCol"):
        est.setWeightCol(w)
    return est
