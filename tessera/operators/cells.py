"""Rows of equal bins counted once, for trees: a tree tells rows apart by the bins of their features alone.

Thresholds are found as Spark's trees find them (the same rule over a sample of the same size); one grouped count over all
rows then leaves a weighted row for every combination of bins and label.  The trees fitted to it are those of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a feature and sampled rows that Spark's trees take by default.
MAX_BINS = 32
SAMPLE_ROWS = 10_000
#: Fewer rows are fitted as they are; so are rows that have more cells than this share of them.
LEAST_ROWS = 1_000_000
MOST_CELLS = 0.25
#: Cells of one task in a fit; more tasks than needed only cost their starts.
TASK_CELLS = 20_000
#: Bins of five bits in one 64-bit word.
PER_WORD = 12


def split_points(values: np.ndarray) -> list[float]:
    """Thresholds of one feature: between all neighbours if they are few, else near equal counts."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) < MAX_BINS:
        return middles.tolist()
    stride = len(values) / MAX_BINS
    out, target, before = [], stride, int(counts[0])
    for i in range(1, len(found)):
        after = before + int(counts[i])
        if abs(before - target) < abs(after - target):
            out.append(float(middles[i - 1]))
            target += stride
        before = after
    return out


def find_thresholds(rows: DataFrame, n: int, seed: int, features: str = "features") -> list[list[float]]:
    """Every feature's thresholds from a sample of some SAMPLE_ROWS of the ``n`` rows."""
    some = rows.sample(SAMPLE_ROWS / n, seed) if n > SAMPLE_ROWS else rows
    x = np.array([r[0] for r in some.select(vector_to_array(features)).collect()])
    return [split_points(x[:, j]) for j in range(x.shape[1])] if len(x) else []


def bins_of(x: np.ndarray, thresholds: list) -> np.ndarray:
    """A matrix of features as a matrix of bins; bin i holds values above threshold i - 1, up to threshold i."""
    return np.column_stack([np.searchsorted(np.asarray(t, dtype=float), x[:, j], side="left") for j, t in enumerate(thresholds)])


def count_cells(rows: DataFrame, thresholds: list, by: Sequence[str], features: str = "features") -> DataFrame:
    """(features: bins as a vector, ``by``, n: rows, code: the bins in 64-bit words), one row a cell."""
    d = len(thresholds)
    words = -(-d // PER_WORD)

    @F.arrow_udf("array<bigint>")
    def packed(v: pa.Array) -> pa.Array:
        b = bins_of(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), d), thresholds).astype(np.int64)
        code = np.column_stack([sum(b[:, j] << (5 * (j - w * PER_WORD)) for j in range(w * PER_WORD, min(d, (w + 1) * PER_WORD))) for w in range(words)])
        return pa.ListArray.from_arrays(np.arange(0, code.size + 1, words, dtype=np.int32), code.ravel())

    coded = rows.select(*by, packed(vector_to_array(features)).alias("code"))
    cells = coded.groupBy(*by, *[F.col("code")[w].alias(f"_c{w}") for w in range(words)]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    bins = [F.shiftright(f"_c{j // PER_WORD}", 5 * (j % PER_WORD)).bitwiseAND(F.lit(31)).cast("double") for j in range(d)]
    return cells.select(array_to_vector(F.array(*bins)).alias("features"), *by, "n", F.array(*[f"_c{w}" for w in range(words)]).alias("code"))


def few_cells(rows: DataFrame, n: int, by: Sequence[str], seed: int, fit_rows: DataFrame | None = None) -> tuple[DataFrame, list] | None:
    """The cached cells of ``rows`` and their thresholds, found over ``fit_rows``; None where counting them gains little."""
    if n < LEAST_ROWS:
        return None
    thresholds = find_thresholds(rows if fit_rows is None else fit_rows, n, seed)
    if not thresholds:
        return None
    cells = count_cells(rows, thresholds, by).persist(StorageLevel.MEMORY_AND_DISK)
    found = cells.count()
    if found > MOST_CELLS * n:
        cells.unpersist()
        return None
    few = cells.coalesce(-(-found // TASK_CELLS)).persist(StorageLevel.MEMORY_AND_DISK)
    few.count()
    cells.unpersist()
    return few, thresholds


def leaf_share(leaf: int, weight: float) -> float:
    """Spark's least share of the weight in a leaf that stands for ``leaf`` rows of weight 1."""
    return min(max(leaf - 0.5, 0.0) / weight, 0.499999) if weight > 0 else 0.0


def draws_of(trees: int, seed: int, label: str = "label") -> Column:
    """How often each of ``trees`` bootstrap samples draws a cell's n rows: Poisson(n), seeded by the cell."""
    @F.arrow_udf("array<double>")
    def drawn(n: pa.Array, y: pa.Array, code: pa.Array) -> pa.Array:
        out = [np.random.default_rng([seed, int(k), *map(int, c)]).poisson(m, trees).astype(float)
               for m, k, c in zip(n.to_pylist(), y.to_pylist(), code.to_pylist())]
        return pa.array(out, pa.list_(pa.float64()))

    return drawn("n", F.col(label).cast("bigint"), "code")


def fit_forest(est, cells: DataFrame, weight: Column | None = None, parallelism: int = 8):
    """A random forest of ``est`` over cells: every tree takes its own draws of their rows as weights.

    ``weight`` is a factor of a row's weight (class weights)."""
    trees, label, leaf = est.getNumTrees(), est.getLabelCol(), est.getMinInstancesPerNode()
    drawn = draws_of(trees, est.getSeed(), label) if est.getBootstrap() else F.array_repeat("n", trees)
    kept = cells.select("features", label, drawn.alias("w"), (F.lit(1.0) if weight is None else weight).alias("f"))
    kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
    sums = kept.agg(*[F.sum(F.col("w")[t]).alias(f"s{t}") for t in range(trees)]).first()
    subset = est.getFeatureSubsetStrategy()
    one = est.copy().setNumTrees(1).setBootstrap(False).setWeightCol("w").setMinInstancesPerNode(1)
    one.setFeatureSubsetStrategy("sqrt" if subset == "auto" and trees > 1 else subset)

    def grow(t: int):
        rows = kept.select("features", label, (F.col("w")[t] * F.col("f")).alias("w")).where("w > 0")
        share = leaf_share(leaf, sums[f"s{t}"] or 0.0) if weight is None else 0.0
        return one.copy().setSeed(est.getSeed() + t).setMinWeightFractionPerNode(share).fit(rows)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        grown = list(pool.map(grow, range(trees)))
    kept.unpersist()
    sc = cells.sparkSession.sparkContext
    first = grown[0]
    joined = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, trees)
    for t, m in enumerate(grown):
        joined[t] = m._call_java("trees")[0]
    model = type(first)(sc._jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        first.uid, joined, first.numFeatures, first.numClasses))
    return est._copyValues(model)
