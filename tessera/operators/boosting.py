"""Gradient boosting for any number of classes: one tree a class and round on the softmax residuals.

Every round fits one regression tree a class (Spark's ``DecisionTreeRegressor``) to ``1[label = class] - probability``;
one grouped aggregate then gives all leaves of the round their Newton step.  Fitted trees are kept as plain splits
and score inside one projection, so a model is a few numbers.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cells import few_cells, leaf_share
from tessera.session import shared_dir

#: Rounds between two checkpoints of the scores.
CHECKPOINT_EVERY = 10


def read_tree(model) -> dict:
    """A fitted Spark tree as ``{"feature", "threshold", "left", "right"}``, its leaves numbered from 0 as ``{"leaf"}``."""
    leaves = iter(range(model.numNodes))

    def walk(node) -> dict:
        if node.subtreeDepth() == 0:
            return {"leaf": next(leaves)}
        split = node.split()
        return {"feature": split.featureIndex(), "threshold": float(split.threshold()),
                "left": walk(node.leftChild()), "right": walk(node.rightChild())}

    return walk(model._call_java("rootNode"))


def on_values(tree: dict, thresholds: list) -> dict:
    """A tree over bins (``cells``) as the same tree over the features' values."""
    if "leaf" in tree:
        return tree
    return {"feature": tree["feature"], "threshold": float(thresholds[tree["feature"]][int(tree["threshold"])]),
            "left": on_values(tree["left"], thresholds), "right": on_values(tree["right"], thresholds)}


def tree_sql(tree: dict, x: str, leaf=lambda i: str(i)) -> str:
    """One tree as SQL text over the array column ``x``; ``leaf`` writes a leaf by its number."""
    if "leaf" in tree:
        return leaf(tree["leaf"])
    sides = (tree_sql(tree[s], x, leaf) for s in ("left", "right"))
    return "CASE WHEN {}[{}] <= {!r}D THEN {} ELSE {} END".format(x, tree["feature"], tree["threshold"], *sides)


def softmax(raw: Column) -> Column:
    """Probabilities of an array of scores, the largest score subtracted first."""
    grown = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
    return F.transform(grown, lambda v: v / F.aggregate(grown, F.lit(0.0), lambda s, e: s + e))


_TABLES = "array<struct<feature array<int>, threshold array<double>, left array<int>, right array<int>, step array<double>>>"


def node_table(tree: dict, steps: list[float]) -> dict:
    """A tree as parallel lists over its nodes (feature -1: a leaf, with its step) and its depth."""
    out: dict = {"feature": [], "threshold": [], "left": [], "right": [], "step": [], "depth": 0}

    def add(node: dict, depth: int) -> int:
        at = len(out["feature"])
        leaf = "leaf" in node
        out["depth"] = max(out["depth"], depth)
        for name, v in (("feature", -1 if leaf else node["feature"]), ("threshold", 0.0 if leaf else node["threshold"]),
                        ("left", at), ("right", at), ("step", steps[node["leaf"]] if leaf else 0.0)):
            out[name].append(v)
        if not leaf:
            out["left"][at] = add(node["left"], depth + 1)
            out["right"][at] = add(node["right"], depth + 1)
        return at

    add(tree, 0)
    return out


class SoftmaxBoostingModel:
    """Start scores and, per round and class, a tree with its leaves' steps (``rounds[i][k] = (tree, steps)``)."""

    def __init__(self, start: list[float], rounds: list, importances: list[float], features_col: str = "features"):
        self.start, self.rounds, self.features_col = start, rounds, features_col
        self.featureImportances = Vectors.dense(importances)

    def state(self) -> dict:
        return {"start": self.start, "rounds": self.rounds, "importances": list(self.featureImportances.toArray())}

    @classmethod
    def from_state(cls, state: dict, features_col: str = "features") -> "SoftmaxBoostingModel":
        return cls(state["start"], state["rounds"], state["importances"], features_col)

    def raw(self, x: str) -> Column:
        """The classes' scores over the array column ``x``: every tree is a table of nodes, walked from node 0 to a leaf.

        The tables are one constant of the plan, so the plan stays as small for hundreds of trees as for one."""
        per_class = []
        for k, start in enumerate(self.start):
            tables = [node_table(*r[k]) for r in self.rounds]
            depth = max((t.pop("depth") for t in tables), default=0)
            trees = F.from_json(F.lit(json.dumps(tables)), _TABLES)

            def down(t: Column, n: Column) -> Column:
                inner = F.when(F.get(F.col(x), t["feature"][n]) <= t["threshold"][n], t["left"][n]).otherwise(t["right"][n])
                return F.when(t["feature"][n] < 0, n).otherwise(inner)

            def step(t: Column, depth=depth) -> Column:
                return t["step"][F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), lambda n, _: down(t, n))]

            per_class.append(F.aggregate(trees, F.lit(start), lambda s, t: s + step(t)))
        return F.array(*per_class)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with rawPrediction, probability (vectors) and prediction; ties go to the smallest class."""
        out = df.withColumn("_x", vector_to_array(self.features_col)).withColumn("_raw", self.raw("_x"))
        out = out.withColumn("prediction", (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double"))
        return (out.withColumn("rawPrediction", array_to_vector("_raw")).withColumn("probability", array_to_vector(softmax(F.col("_raw"))))
                .drop("_x", "_raw"))


class SoftmaxBoosting:
    """Estimator of ``classes`` classes coded 0, 1, ... in ``labelCol``.

    Scores start at the logarithms of the class shares (a class without rows at -log of the row count + 1).  A leaf's step is
    ``learning_rate * (K - 1) / K * sum(r) / sum(|r| (1 - |r|))`` over its residuals r, 0 where the denominator vanishes.
    Rows with a null label are left out; without rows the model answers class 0 with equal probabilities.
    ``subsample`` below 1 grows each round's trees on a random share of the rows; the steps use all rows.
    Where the rows have few different bins (``cells``), each round works on the counted cells; otherwise on the rows.
    The scores are checkpointed every ``CHECKPOINT_EVERY`` rounds and computed from there, so the plan never grows and
    lost executors cost the scores of a few trees.
    """

    def __init__(self, classes: int, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, min_leaf: int = 1,
                 subsample: float = 1.0, seed: int = 42, featuresCol: str = "features", labelCol: str = "label"):
        self.classes, self.n_estimators, self.learning_rate, self.max_depth = classes, n_estimators, learning_rate, max_depth
        self.min_leaf, self.subsample, self.seed, self.features_col, self.label_col = min_leaf, subsample, seed, featuresCol, labelCol

    def fit(self, df: DataFrame) -> SoftmaxBoostingModel:
        shared_dir(df.sparkSession)
        K = self.classes
        rows = df.where(F.col(self.label_col).isNotNull()).select(
            F.col(self.features_col).alias("features"), F.col(self.label_col).cast("int").alias("y"))
        counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
        total = sum(counts.values())
        if not total:
            return SoftmaxBoostingModel([0.0] * K, [], [], self.features_col)
        start = [float(np.log(counts[k] / total)) if counts.get(k) else -float(np.log(total + 1)) for k in range(K)]
        counted = few_cells(rows, total, ["y"], self.seed) if self.subsample >= 1 else None  # a share of the rows is drawn by row
        base = rows.withColumn("n", F.lit(1.0)) if counted is None else counted[0].select("features", "y", "n")
        # weights are given to the trees for cells only, whose least leaf is a share of the rows' number
        least = {"minInstancesPerNode": self.min_leaf} if counted is None else {
            "weightCol": "n", "minWeightFractionPerNode": leaf_share(self.min_leaf, total)}
        base = base.withColumn("raw", F.array(*[F.lit(s) for s in start])).persist(StorageLevel.MEMORY_AND_DISK)
        rounds, gains = [], 0.0
        with ThreadPoolExecutor(max_workers=K) as pool:
            for i in range(self.n_estimators):
                since = rounds[i - i % CHECKPOINT_EVERY:i]
                if i and not since:  # the scores of the last rounds are written; the plan starts from them
                    after = self._scored(base, rounds[i - CHECKPOINT_EVERY:i]).checkpoint().persist(StorageLevel.MEMORY_AND_DISK)
                    after.count()
                    base.unpersist()
                    base = after
                p = self._scored(base, since).withColumn("p", softmax(F.col("raw")))
                res = p.select("features", "n", *[((F.col("y") == k).cast("double") - F.col("p")[k]).alias(f"r{k}") for k in range(K)])
                res = res.persist(StorageLevel.MEMORY_AND_DISK)
                grow = res.sample(self.subsample, self.seed + i) if self.subsample < 1 else res
                fitted = list(pool.map(lambda k, g=grow: DecisionTreeRegressor(
                    featuresCol="features", labelCol=f"r{k}", maxDepth=self.max_depth, **least,
                    maxMemoryInMB=512, seed=self.seed).fit(g), range(K)))
                trees = [read_tree(m) for m in fitted]
                gains = gains + sum(m.featureImportances.toArray() for m in fitted)
                # all leaves of the round in one aggregate of classes x leaves rows
                met = res.withColumn("x", vector_to_array("features")).select(F.inline(F.array(*[
                    F.struct(F.lit(k).alias("k"), F.expr(tree_sql(t, "x")).alias("leaf"), F.col(f"r{k}").alias("r"), "n") for k, t in enumerate(trees)])))
                size = F.abs("r")
                sums = {(s.k, s.leaf): (s.num, s.den) for s in met.groupBy("k", "leaf").agg(
                    F.sum(F.col("n") * F.col("r")).alias("num"), F.sum(F.col("n") * size * (1 - size)).alias("den")).collect()}
                res.unpersist()
                rounds.append([(tree, [self._step(*sums.get((k, j), (0.0, 0.0))) for j in range((fitted[k].numNodes + 1) // 2)])
                               for k, tree in enumerate(trees)])
        base.unpersist()
        if counted is not None:
            counted[0].unpersist()
            rounds = [[(on_values(tree, counted[1]), steps) for tree, steps in r] for r in rounds]
        whole = float(np.sum(gains))
        importances = [float(g / whole) for g in gains] if whole > 0 else [0.0] * len(np.atleast_1d(gains))
        return SoftmaxBoostingModel(start, rounds, importances, self.features_col)

    def _step(self, num: float, den: float) -> float:
        return float(self.learning_rate * (self.classes - 1) / self.classes * num / den) if den > 1e-150 else 0.0

    def _scored(self, base: DataFrame, since: list) -> DataFrame:
        """``base`` with the steps of the rounds ``since`` added to its scores."""
        if not since:
            return base
        more = SoftmaxBoostingModel([0.0] * self.classes, since, [], "features").raw("x")
        return base.withColumn("x", vector_to_array("features")).withColumn("d", more).select(
            "features", "y", "n", F.zip_with("raw", "d", lambda a, b: a + b).alias("raw"))
