"""End-to-end training: target encoding, hash split, preparation, optional
grid / randomized search with k-fold cross-validation, refit, prediction,
metrics and feature importances.

The search runs every (candidate, fold) fit as its own Spark job from a small
thread pool - the same scheme as Spark's CrossValidator(parallelism) - so each
fit is data-parallel and several fits share the cluster.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import evaluate as E
from tessera.operators.cells import bins_of, few_cells, fit_forest, leaf_share
from tessera.operators.hinge import EPS, fit_svc, rough_sums
from tessera.operators.prepare import FittedPrep, LabelEncoding, PrepConfig, fit_label, fit_prep
from tessera.operators.split import key_hash, test_threshold, with_stratified_folds
from tessera.plans import estimators as M

# Number of random Fourier components for the rbf kernel map.
RFF_COMPONENTS = 100
POLY_DEGREE = 3
#: Rows of a task in a solver that passes over them hundreds of times.
PASS_ROWS = 500_000
#: Classifiers of trees that are fitted to counted cells where these are few.
CELL_MODELS = ("Random Forest", "Gradient Boosting")


@dataclass
class TrainResult:
    model: object
    prep: FittedPrep
    label: LabelEncoding
    model_name: str
    is_classification: bool
    best_params: dict
    metrics: DataFrame
    predictions: DataFrame
    feature_importances: DataFrame | None
    cv_results: DataFrame | None
    feature_names: list
    feature_map: object = None
    cached: object = None

    def release(self) -> None:
        """Drop the cached training rows once predictions / metrics are no longer needed."""
        if self.cached is not None:
            self.cached.unpersist()
            self.cached = None

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Score new rows (batch or streaming): prep projection + model."""
        x = self.prep.assemble(df, keep=keep)
        if self.feature_map is not None:
            x = self.feature_map(x)
        return self.model.transform(x)


# ---------------------------------------------------------------- kernel feature maps

class FeatureMap:
    """Features standing in for an SVM kernel, as plain numbers that are saved with a model.

    ``poly``: all monomials of degree 3, weighted so that their inner product is (gamma <x, y>)^3 exactly.
    ``rbf``: random Fourier features, whose inner product estimates exp(-gamma |x - y|^2).
    ``bins``: no kernel, each feature's bin between thresholds (``weights``) for trees fitted to counted cells."""

    def __init__(self, kernel: str, n_features: int, gamma: float, weights=None, offsets=None):
        self.kernel, self.n_features, self.gamma, self.weights, self.offsets = kernel, n_features, gamma, weights, offsets

    def state(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_monomials"}

    def components(self, x: np.ndarray) -> np.ndarray:
        """The mapped rows of a matrix of features, one coordinate after the other."""
        out = []
        if self.kernel == "bins":
            return bins_of(x, self.weights).astype(float)
        if self.kernel == "poly":
            for powers in itertools.combinations_with_replacement(range(self.n_features), POLY_DEGREE):
                orders = math.factorial(POLY_DEGREE) / math.prod(math.factorial(powers.count(j)) for j in set(powers))
                out.append(math.prod((x[:, j] for j in powers), start=math.sqrt(orders * self.gamma ** POLY_DEGREE)))
        else:
            scale = math.sqrt(2.0 / len(self.weights))
            out = [np.cos(sum((x[:, j] * w[j] for j in range(self.n_features)), np.full(len(x), b))) * scale
                   for w, b in zip(self.weights, self.offsets)]
        return np.column_stack(out)

    def rough(self, xt: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the mapped features with each column of coefficients ``c``, in single precision, of features given a coordinate
        after the other; and the most that a sum is off."""
        x = xt.astype(np.float32)
        if self.kernel == "poly":
            powers, orders = self._monomials
            z, pairs = np.empty((len(powers), x.shape[1]), dtype=np.float32), {}
            for k, (i, j, l) in enumerate(powers):
                if (i, j) not in pairs:
                    pairs[i, j] = x[i] * x[j]
                np.multiply(pairs[i, j], x[l], out=z[k])
            return rough_sums(z, c * np.sqrt(np.array(orders) * self.gamma ** POLY_DEGREE)[:, None])
        w, c = np.column_stack([self.weights, self.offsets]), c * math.sqrt(2.0 / len(self.weights))
        x = np.vstack([x, np.ones((1, x.shape[1]), dtype=np.float32)])
        z = w.astype(np.float32) @ x
        np.cos(z, out=z)
        most = np.abs(c).max(axis=1)  # a cosine moves at most as far as its angle, and is at most 1
        error = ((len(w[0]) + 4) * (most @ np.abs(w))).astype(np.float32) @ np.abs(x)
        return c.astype(np.float32).T @ z, EPS * (error + np.float32((len(c) + 24) * most.sum()))

    @functools.cached_property
    def _monomials(self) -> tuple[list, list]:
        """The triples of coordinates, and in how many orders each is multiplied."""
        powers = list(itertools.combinations_with_replacement(range(self.n_features), POLY_DEGREE))
        return powers, [math.factorial(POLY_DEGREE) / math.prod(math.factorial(p.count(j)) for j in set(p)) for p in powers]

    def __call__(self, df: DataFrame) -> DataFrame:
        @F.arrow_udf("array<double>")
        def mapped(v: pa.Array) -> pa.Array:
            m = self.components(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), self.n_features))
            return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())

        return df.withColumn("features", array_to_vector(mapped(vector_to_array("features"))))

    def margin(self, coefficients: np.ndarray, intercept: float) -> Column:
        """The mapped features' margin of a linear machine."""
        @F.arrow_udf("double")
        def of(v: pa.Array) -> pa.Array:
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), self.n_features)
            return pa.array(self.components(x) @ coefficients + intercept)

        return of(vector_to_array("features"))


def kernel_map(kernel: str, gamma, n_features: int, feature_var: float, seed: int) -> FeatureMap | None:
    """The feature map of an SVM kernel; None for the linear one."""
    if kernel == "linear":
        return None
    g = (1.0 / (n_features * feature_var) if gamma == "scale" and feature_var > 0
         else 1.0 / n_features if gamma in ("scale", "auto") else float(gamma))
    if kernel == "poly":
        return FeatureMap("poly", n_features, g)
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * g), size=(RFF_COMPONENTS, n_features))
    b = rng.uniform(0, 2 * math.pi, size=RFF_COMPONENTS)
    return FeatureMap("rbf", n_features, g, w.tolist(), b.tolist())


class PlattScaled:
    """A binary margin classifier with a logistic calibration of its margin
    (probability = sigmoid(a * margin + b), a and b fitted on the training rows by
    Spark's LogisticRegression on the one margin feature)."""

    def __init__(self, model, a: float, b: float):
        self.model, self.a, self.b = model, a, b
        self.coefficients = getattr(model, "coefficients", None)

    @classmethod
    def fit(cls, model, train: DataFrame, fmap: FeatureMap | None = None) -> "PlattScaled":
        """``train`` as the model takes it, or its features before their map ``fmap``."""
        from pyspark import StorageLevel
        from pyspark.ml.classification import LogisticRegression
        if fmap is None:
            margin = model.transform(train).select(vector_to_array("rawPrediction")[1].alias("m"), "label")
        else:  # the mapped features stay in their task, and the margins are computed once
            margin = train.select(fmap.margin(model.coefficients.toArray(), model.intercept).alias("m"), "label").persist(StorageLevel.MEMORY_AND_DISK)
        lr = LogisticRegression(featuresCol="m", labelCol="label", regParam=0.0, maxIter=100).fit(margin.withColumn("m", array_to_vector(F.array("m"))))
        if fmap is not None:
            margin.unpersist()
        return cls(model, float(lr.coefficients[0]), float(lr.intercept))

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        p1 = 1.0 / (1.0 + F.exp(-(F.lit(self.a) * vector_to_array("rawPrediction")[1] + F.lit(self.b))))
        return out.withColumn("probability", array_to_vector(F.array(1.0 - p1, p1)))


# ---------------------------------------------------------------- metrics / scoring

#: Scores that a search can maximise, larger is better: name -> (task, column of the metrics, sign).
SCORING = {
    "accuracy": (True, "accuracy", 1), "precision": (True, "precision", 1), "recall": (True, "recall", 1), "f1": (True, "f1", 1),
    "precision_weighted": (True, "precision", 1), "recall_weighted": (True, "recall", 1), "f1_weighted": (True, "f1", 1),
    "neg_mean_squared_error": (False, "mse", -1), "neg_root_mean_squared_error": (False, "rmse", -1),
    "neg_mean_absolute_error": (False, "mae", -1), "r2": (False, "r2", 1),
}


def check_scoring(scoring: str | None, is_classification: bool) -> str:
    """The score's name; without one accuracy or the negative mean squared error."""
    name = scoring or ("accuracy" if is_classification else "neg_mean_squared_error")
    if name not in SCORING or SCORING[name][0] != is_classification:
        known = sorted(k for k, v in SCORING.items() if v[0] == is_classification)
        raise ValueError(f"scoring {name!r} does not fit the task; known: {known}")
    return name


def score_by_name(pred: DataFrame, scoring: str, weight: str | None = None) -> float:
    """One score of predictions (label, prediction); ``weight`` names the column of the rows that a row stands for.  precision, recall and f1 are those of class 1, the _weighted ones averages over classes."""
    task, column, sign = SCORING[scoring]
    if not task:
        found = E.regression_metrics(pred, "label", "prediction")
    elif scoring.endswith("_weighted") or scoring == "accuracy":
        found = E.weighted_metrics(pred, "label", "prediction", weight)
    else:
        found = E.binary_metrics(pred, "label", "prediction", 1.0, weight)
    return sign * (found.first()[column] or 0.0)


def importances_of(model, names: Sequence[str]) -> list[float] | None:
    m = model.stages[-1] if hasattr(model, "stages") else model
    m = getattr(m, "model", m)  # calibrated wrapper
    if hasattr(m, "featureImportances"):
        return list(m.featureImportances.toArray())
    if hasattr(m, "coefficientMatrix") and m.coefficientMatrix.numRows > 1:
        return list(np.abs(m.coefficientMatrix.toArray()).mean(axis=0))
    if hasattr(m, "coefficients"):
        v = np.asarray(m.coefficients.toArray())
        return list(np.abs(v)) if getattr(m, "numClasses", 0) else list(v)
    return None


# ---------------------------------------------------------------- training

def fold_stats(train: DataFrame, is_classification: bool) -> dict:
    """fold -> (rows, label standard deviation, balanced class weights) of the training rows outside that fold; None: of
    all training rows.  One grouped aggregate; the table has folds x classes rows (regression: one per fold)."""
    by = ["_fold", "label"] if is_classification else ["_fold"]
    cells = train.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("m"), F.coalesce(F.var_pop("label"), F.lit(0.0)).alias("v")).collect()
    out = {}
    for without in (None, *{c["_fold"] for c in cells}):
        rest = [c for c in cells if without is None or c["_fold"] != without]
        n = sum(c.n for c in rest)
        mean = sum(c.n * c.m for c in rest) / n if n else 0.0
        sd = math.sqrt(sum(c.n * (c.v + (c.m - mean) ** 2) for c in rest) / n) if n else 0.0
        weights = None
        if is_classification:
            counts: dict = {}
            for c in rest:
                counts[c.label] = counts.get(c.label, 0) + c.n
            weights = F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), F.lit(n / (len(counts) * c)))])
        out[without] = (n, sd, weights)
    return out


def for_passes(rows: DataFrame, n: int) -> DataFrame:
    """``n`` cached rows in fewer partitions for a solver of many short passes: one a core, more for many rows; nothing is shuffled."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PASS_ROWS)))


def train_model(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str,
                model_name: str, keys: Sequence[str], is_classification: bool | None = None,
                test_size: float = 0.2, random_state: int | None = 42, cv: int = 5, use_grid_search: bool = False,
                use_randomized_search: bool = False, n_iter: int = 10, custom_params: dict | None = None,
                params: dict | None = None, prep_config: PrepConfig | None = None, fit_on: str = "train",
                parallelism: int = 4, scoring: str | None = None) -> TrainResult:
    """``scoring`` names the score that a search maximises (SCORING)."""
    from pyspark import StorageLevel
    if random_state is None:  # a split of its own for this run
        random_state = int.from_bytes(os.urandom(3), "big")
    # the projected training columns are read by every fitting pass below: scan / join them once
    needed = list(dict.fromkeys([*keys, *numeric, *categorical, target]))
    # ... with each row's side of the split, whose hash is dear
    h = key_hash(keys, random_state)
    source = (df.select(*needed).where(F.col(target).isNotNull()).withColumn("_is_test", h < F.lit(test_threshold(test_size)))
              .persist(StorageLevel.MEMORY_AND_DISK))
    label = fit_label(source, target)
    task_cls = label.task == "classification"
    if is_classification is None:
        is_classification = task_cls
    scoring = check_scoring(scoring, is_classification)
    searching = (use_grid_search or use_randomized_search)
    base = source
    if is_classification and searching:
        # stratified folds for classifiers (rank within label by hash, bucketed - no single-task window)
        base = with_stratified_folds(base, keys, target, cv, random_state + 1, output="_fold")
    else:
        base = base.withColumn("_fold", F.pmod(key_hash(keys, random_state + 1), F.lit(cv)).cast("int"))
    unfolded = source  # the preparation does not read the folds
    if prep_config is not None and prep_config.numeric_imputer == "knn" and numeric:
        # k nearest donors over the whole table (the donors' own split does not matter to the rule)
        from tessera.operators.knn import knn_impute
        keyed = base.withColumn("_rowkey", F.concat_ws("|", *[F.col(c).cast("string") for c in keys]))
        filled = knn_impute(keyed, "_rowkey", list(numeric), k=prep_config.knn_neighbors)
        base = unfolded = keyed.drop(*numeric).join(filled, "_rowkey").drop("_rowkey")
        prep_config = prep_config.update(numeric_imputer="mean")
    fit_rows = unfolded.where(~F.col("_is_test")) if fit_on == "train" else unfolded
    prep = fit_prep(fit_rows, numeric, categorical, prep_config)
    base = base.withColumn("label", label.code(base))
    data = prep.assemble(base, keep=[*keys, "_is_test", "_fold", "label"])
    n_classes = len(label.classes) if task_cls else 0
    # iterative fits run one task per cached partition: even partitions, at least one per core
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    data = data.repartition(parts).persist()
    train = data.where(~F.col("_is_test"))
    test = data.where(F.col("_is_test"))
    data.count()  # data is now cached in full; the projected source is no longer needed
    folds = fold_stats(train, is_classification)
    source.unpersist()
    names = prep.feature_names
    fvar = 1.0
    if model_name in ("Support Vector Machine", "SVR"):
        fvar = train.select(F.explode(vector_to_array("features")).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0

    counted = {}

    def count(without=None):
        """The counted cells (label, _held: of the fold left out) for a search's or the last fit; None: fit rows."""
        if model_name in CELL_MODELS and is_classification and (model_name == "Random Forest" or n_classes == 2):
            rest = train if without is None else train.where(F.col("_fold") != without)
            held = F.lit(False) if without is None else F.col("_fold") == without
            counted[without] = few_cells(train.withColumn("_held", held), folds[without][0], ["label", "_held"], random_state, rest)

    def fit_cells(est, cand, without):
        """A tree model of the counted cells and its map of features to bins; None where the rows are to be fitted."""
        if not counted.get(without):
            return None
        n, _, weights = folds[without]
        cells, thresholds = counted[without]
        cells = cells.where(~F.col("_held"))
        fmap = FeatureMap("bins", len(names), 0.0, thresholds)
        if model_name == "Random Forest":
            factor = weights[F.col("label")] if M.weight_column(cand) else None
            if factor is not None and est.getMinInstancesPerNode() > 1:
                return None  # a leaf's rows are not known from such weights
            return fit_forest(est, cells, factor), fmap
        est = est.copy().setWeightCol("n").setMinWeightFractionPerNode(leaf_share(est.getMinInstancesPerNode(), n)).setMinInstancesPerNode(1)
        return est.fit(cells), fmap

    def fit(cand, rows, without=None):
        n, sd, weights = folds[without]
        context = M.FitContext(n_rows=n, n_classes=max(n_classes, 2), label_std=sd or 1.0,
                               n_features=len(names), feature_var=fvar, seed=random_state)
        est = M.make_estimator(model_name, is_classification, cand, context)
        found = fit_cells(est, cand, without)
        if found is not None:
            return found
        if weights is not None:
            rows = rows.withColumn("_w_balanced", weights[F.col("label")])
        fmap = (kernel_map(cand.get("kernel", "rbf"), cand.get("gamma", "scale"), len(names), fvar, random_state)
                if model_name in ("Support Vector Machine", "SVR") else None)
        if model_name == "Support Vector Machine":
            rows = for_passes(rows, n)
            if fmap:
                return (fit_svc(est, rows, fmap) if n_classes <= 2 else est.fit(rows, fmap)), fmap
        x = fmap(rows) if fmap else rows
        return est.fit(x), fmap

    cv_results = None
    best = dict(params or {})
    if searching:
        pg = M.grid(model_name, is_classification, custom_params)
        cands = (M.sample_candidates(pg, n_iter, random_state) if use_randomized_search else M.candidates(pg))
        def run(job):
            ci, f = job
            model, fmap = fit(cands[ci], train.where(F.col("_fold") != f), f)
            if fmap is not None and fmap.kernel == "bins":  # a cell's rows have one prediction
                return ci, f, score_by_name(model.transform(counted[f][0].where("_held")), scoring, "n")
            hold = train.where(F.col("_fold") == f)
            return ci, f, score_by_name(model.transform(fmap(hold) if fmap else hold), scoring)

        for f in range(cv):
            count(f)
        jobs = [(ci, f) for ci in range(len(cands)) for f in range(cv)]
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            scores = list(pool.map(run, jobs))
        table = np.zeros((len(cands), cv))
        for ci, f, s in scores:
            table[ci, f] = s
        means, stds = table.mean(axis=1), table.std(axis=1)
        best_i = int(np.argmax(means))
        best = cands[best_i]
        cv_results = cv_results_frame(df.sparkSession, cands, table)
    count()
    model, fmap = fit(best, train)
    for found in counted.values():
        if found:
            found[0].unpersist()
    if model_name == "Support Vector Machine" and n_classes == 2:
        few = for_passes(train, folds[None][0])
        model = PlattScaled.fit(model, few, fmap)
    pred = model.transform(fmap(test) if fmap else test)
    out_cols = [*keys, "label", "prediction"]
    if "probability" in pred.columns:
        pred = pred.withColumn("probability", vector_to_array("probability"))
        out_cols.append("probability")
    predictions = pred.select(*out_cols)
    if is_classification:
        metrics = E.classification_metrics(predictions, "label", "prediction", n_classes, positive=1.0)
    else:
        metrics = E.regression_metrics(predictions, "label", "prediction")
    imp = importances_of(model, names)
    imp_df = None
    if imp is not None and len(imp) == len(names):
        imp_df = df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, imp)],
                                                 "feature string, importance double")
    return TrainResult(model, prep, label, model_name, is_classification, best, metrics, predictions, imp_df,
                       cv_results, names, fmap, data)


def cv_results_frame(spark, cands: list[dict], table: np.ndarray) -> DataFrame:
    """params (map), param_<k> (text), split<i>_test_score, mean / std (population) and
    rank (1 = best, ties share the lowest rank)."""
    keys = sorted({k for c in cands for k in c})
    k = table.shape[1]
    means, stds = table.mean(axis=1), table.std(axis=1)
    rows = []
    for i, c in enumerate(cands):
        rows.append(({kk: str(v) for kk, v in c.items()}, *[str(c[kk]) if kk in c else None for kk in keys],
                     *[float(s) for s in table[i]], float(means[i]), float(stds[i])))
    schema = T.StructType([T.StructField("params", T.MapType(T.StringType(), T.StringType()))]
                          + [T.StructField(f"param_{kk}", T.StringType()) for kk in keys]
                          + [T.StructField(f"split{f}_test_score", T.DoubleType()) for f in range(k)]
                          + [T.StructField("mean_test_score", T.DoubleType()),
                             T.StructField("std_test_score", T.DoubleType())])
    out = spark.createDataFrame(rows, schema)  # one row per candidate
    return out.withColumn("rank_test_score", F.rank().over(Window.orderBy(F.desc("mean_test_score"))).cast("int"))


def param_effect(cv_results: DataFrame, param: str, score: str = "mean_test_score") -> DataFrame:
    """Mean / std / count of the score per value of one parameter; empty when the
    parameter takes a single value (nothing to compare)."""
    col = f"param_{param}" if not param.startswith("param_") else param
    g = cv_results.groupBy(F.col(col).alias("value")).agg(F.avg(score).alias("mean_score"),
                                                          F.stddev_pop(score).alias("std_score"),
                                                          F.count(F.lit(1)).alias("n_candidates"))
    n_values = F.count(F.lit(1)).over(Window.partitionBy())  # one row per parameter value
    return g.withColumn("_nv", n_values).where("_nv > 1").drop("_nv")


def cv_ols_closed_form(df: DataFrame, x: str, y: str, fold: str, k: int) -> DataFrame:
    """Cross-validated univariate least squares (fit_intercept True / False) from
    sufficient statistics: per-fold sums, complement = total - fold, so every
    fold's fit costs one grouped aggregate.  Score = negative held-out MSE.

    Returns the CV results table: param_fit_intercept, split<i>_test_score,
    mean_test_score, std_test_score, rank_test_score."""
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    per = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(X).alias("sx"), F.sum(Y).alias("sy"),
                               F.sum(X * X).alias("sxx"), F.sum(X * Y).alias("sxy"), F.sum(Y * Y).alias("syy"))
    tot = per.agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy", "syy")])
    j = per.crossJoin(F.broadcast(tot))  # k rows x one row
    c = {s: F.col(f"t_{s}") - F.col(s) for s in ("n", "sx", "sy", "sxx", "sxy")}
    slope_i = (c["n"] * c["sxy"] - c["sx"] * c["sy"]) / (c["n"] * c["sxx"] - c["sx"] * c["sx"])
    icpt_i = (c["sy"] - slope_i * c["sx"]) / c["n"]
    slope_0 = c["sxy"] / c["sxx"]

    def held_out_mse(a, b):  # mean over the fold of (y - a - b x)^2, expanded in sums
        return (F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + a * a * F.col("n")
                + 2 * a * b * F.col("sx") + b * b * F.col("sxx")) / F.col("n")

    long = j.select(F.col(fold).alias("fold"), F.inline(F.array(
        F.struct(F.lit("True").alias("param_fit_intercept"), (-held_out_mse(icpt_i, slope_i)).alias("score")),
        F.struct(F.lit("False").alias("param_fit_intercept"), (-held_out_mse(F.lit(0.0), slope_0)).alias("score")))))
    wide = long.groupBy("param_fit_intercept").agg(
        *[F.max(F.when(F.col("fold") == i, F.col("score"))).alias(f"split{i}_test_score") for i in range(k)],
        F.avg("score").alias("mean_test_score"), F.stddev_pop("score").alias("std_test_score"))
    return wide.withColumn("rank_test_score", F.rank().over(Window.orderBy(F.desc("mean_test_score"))).cast("int"))


def record_run(store, result: TrainResult, dataset_name: str, features: Sequence[str] | None = None) -> str:
    """Append a trained run to a HistoryStore: name ``<model>_<YYYYmmdd_HHMMSS>``,
    type Classification / Regression, the metric row and the chosen parameters."""
    import datetime
    stamp = datetime.datetime.now().strftime("%Y%m%d_%H%M%S")
    metrics = {k: float(v) for k, v in result.metrics.first().asDict().items() if v is not None}
    return store.add_model({"model_name": f"{result.model_name}_{stamp}",
                            "model_type": "Classification" if result.is_classification else "Regression"},
                           metrics, dataset_name, list(features or result.prep.numeric + result.prep.categorical),
                           result.label.column, result.best_params)
