"""Fits Spark's ``LinearSVC`` to kernel features; rows are kept as blocks of their few input features and mapped inside the passes.

The objective and the minimiser are those of ``LinearSVC`` (limited-memory BFGS steps that stay in their orthant, a backtracking
line search, features scaled and centred), so the steps are the same to rounding.  A pass costs less: hinge loss and gradient follow
from the sums of weight, label and features over the rows inside the margin, and between two points these sums change only by rows
that enter or leave it.  Margins in single precision, with a bound of their error, tell the rows that surely stay on their side; the
others are computed again in double precision.  The step sizes a line search may ask for next share a pass.

Linear machines stay with ``LinearSVC``: many rows of few values lie on the margin to rounding, and its steps hang on these roundings.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK_ROWS = 5000
#: Step pairs that the minimiser keeps, tries of a line search, its growth and the bounds of a step size.
MEMORY, TRIES, GROW, LEAST_STEP, MOST_STEP = 10, 20, 2.1, 1e-10, 1e10
#: Step sizes of a pass once a line search has a course.
AHEAD = 5
#: Half the distance of neighbouring single-precision numbers around 1.
EPS = 2.0 ** -24


def _pack(batches):
    """Batches of rows (x, y, w) as blocks: the matrix of x, a coordinate after the other, and the weights, negative in class 0; ``bad`` counts rows that no fit takes."""
    for batch in batches:
        y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "w"))
        if not len(y):
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        fits = np.isin(y, (0.0, 1.0)) & (w >= 0) & np.isfinite(w) & np.isfinite(x).all(axis=1)
        bad, keep = int((~fits).sum()), fits & (w > 0)
        x, s = x[keep], np.where(y > 0, w, -w)[keep]
        for at in range(0, max(len(s), 1), BLOCK_ROWS):
            part = np.ascontiguousarray(x[at:at + BLOCK_ROWS].T)
            yield pa.RecordBatch.from_pydict({"x": pa.array([part.tobytes()], pa.binary()), "s": pa.array([s[at:at + BLOCK_ROWS].tobytes()], pa.binary()),
                                              "bad": pa.array([bad], pa.int64())})
            bad = 0


def _blocks(packed):
    """(features a coordinate after the other, labels of -1 and 1, weights, bad rows) of each block."""
    for x, s, bad in packed:
        s = np.frombuffer(s)
        yield np.frombuffer(x).reshape(-1, len(s)) if len(s) else None, np.sign(s), np.abs(s), bad


def merged(parts: list[dict]) -> dict:
    """Moments of several sets of rows as those of all."""
    out = parts[0]
    for b in parts[1:]:
        total = out["w"] + b["w"]
        shift = b["mean"] - out["mean"]
        out = {"mean": out["mean"] + shift * (b["w"] / total), "m2": out["m2"] + b["m2"] + shift * shift * (out["w"] * b["w"] / total),
               "low": np.minimum(out["low"], b["low"]), "high": np.maximum(out["high"], b["high"]),
               "yz": out["yz"] + b["yz"], "w": total, "w2": out["w2"] + b["w2"], "y": out["y"] + b["y"]}
    return out


def rough_sums(z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of features ``z`` (single precision, a coordinate after the other) with each column of coefficients, and the most that a
    sum is off where a feature is off by some roundings of its own size."""
    most = np.abs(c).max(axis=1).astype(np.float32)
    return c.astype(np.float32).T @ z, np.float32((len(c) + 16) * EPS) * (most @ np.abs(z))


class _Rows:
    """The blocks of the rows and what passes over them sum up."""

    def __init__(self, blocks: RDD, fmap):
        self.blocks, self.fmap = blocks, fmap

    def moments(self) -> dict | None:
        """Weighted mean, squared deviations, extremes and signed sums of the mapped features; None where ``LinearSVC`` would raise."""
        fmap = self.fmap

        def add(packed):
            found, bad = [], 0
            for xt, y, w, unfit in _blocks(packed):
                bad += unfit
                if xt is None:
                    continue
                z = fmap.components(xt.T)
                mean = (w @ z) / w.sum()
                part = {"mean": mean, "m2": w @ (z - mean) ** 2, "low": z.min(axis=0), "high": z.max(axis=0), "yz": (w * y) @ z,
                        "w": w.sum(), "w2": w @ w, "y": w @ y}
                found = [merged([*found, part])]
            yield bad, found

        told = self.blocks.mapPartitions(add).collect()  # one row a task
        parts = [part for _, found in told for part in found]
        if not parts or any(bad for bad, _ in told):
            return None
        out = merged(parts)
        return out if all(np.isfinite(v).all() for v in out.values()) else None

    def changes(self, points: list[tuple[np.ndarray, float]]) -> np.ndarray:
        """For each point after the first (coefficients, intercept): sums of weight, label and label times features over the rows that
        are inside its margin (y m < 1) and were not inside that of the first point, less those of rows that left it."""
        fmap = self.fmap
        c = np.column_stack([p[0] for p in points])
        b = np.array([p[1] for p in points])

        def exact(total, x, y, w):
            z = fmap.components(x)
            # summed row by row: a row's side at a point is the same in every pass
            inside = np.array([1 - y * ((z * ck).sum(axis=1) + bk) > 0 for ck, bk in zip(c.T.copy(), b)])
            moved = (inside[1:].astype(float) - inside[0]) * w
            total[0] += moved.sum(axis=1)
            total[1] += moved @ y
            total[2:] += z.T @ (moved * y).T

        def add(packed):
            total, kept, n = np.zeros((c.shape[0] + 2, c.shape[1] - 1)), [], 0
            b32, room = b.astype(np.float32)[:, None], np.float32(16 * EPS * (1 + np.abs(b).max()))
            for xt, y, w, _ in _blocks(packed):
                if xt is None:
                    continue
                with np.errstate(all="ignore"):  # what leaves single precision is computed again
                    m, error = fmap.rough(xt, c)
                    m += b32
                    m *= y.astype(np.float32)
                    # on the same side of 1 at all points, and surely so
                    error = 2 * (error + room)
                    low, high = m.min(axis=0), m.max(axis=0)
                    again = np.flatnonzero(~((high < 1 - error) | (low > 1 + error)))
                if len(again):
                    kept.append((xt[:, again].T, y[again], w[again]))
                    n += len(again)
                if n >= BLOCK_ROWS:
                    exact(total, *(np.concatenate(v) for v in zip(*kept)))
                    kept, n = [], 0
            if kept:
                exact(total, *(np.concatenate(v) for v in zip(*kept)))
            yield total

        return sum(self.blocks.mapPartitions(add).collect())  # one small matrix a task


class _Objective:
    """Mean hinge loss and its squared penalty, with gradient, in scaled and centred coordinates."""

    def __init__(self, rows: _Rows, moments: dict, penalty: float):
        spread = moments["w"] - moments["w2"] / moments["w"]
        sd = np.sqrt(np.maximum(moments["m2"] / spread, 0.0)) if spread > 0 else np.zeros_like(moments["m2"])
        sd = np.where(moments["low"] == moments["high"], 0.0, sd)
        self.inverse = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd != 0)
        self.rows, self.total, self.centre = rows, moments["w"], moments["mean"] * self.inverse
        self.penalty = np.append(penalty * self.inverse ** 2, 0.0)
        self.at = np.zeros(len(sd) + 1)
        #: weight, label and label times features of the rows inside the margin: all at 0
        self.sums = np.concatenate([[moments["w"], moments["y"]], moments["yz"]])

    def plain(self, t: np.ndarray) -> tuple[np.ndarray, float]:
        """Coefficients and intercept for the rows as they are."""
        return t[:-1] * self.inverse, float(t[-1] - t[:-1] @ self.centre)

    def told(self, t: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray]:
        c, b = self.plain(t)
        loss = (sums[0] - c @ sums[2:] - b * sums[1]) / self.total
        slope = -np.append(self.inverse * sums[2:] - self.centre * sums[1], sums[1]) / self.total
        return loss + 0.5 * float(self.penalty @ (t * t)), slope + self.penalty * t

    def values(self, points: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(value, gradient, sums) at each point, in one pass."""
        changes = self.rows.changes([self.plain(t) for t in (self.at, *points)])
        return [(*self.told(t, self.sums + change), self.sums + change) for t, change in zip(points, changes.T)]


class _NoStep(Exception):
    pass


def _direction(grad: np.ndarray, pairs: list) -> np.ndarray:
    """Downhill by the kept pairs of steps and gradient changes, newest first; coordinates that point uphill rest."""
    d, shares = grad.copy(), []
    if pairs and not pairs[0][0] @ pairs[0][1] >= 0:
        raise _NoStep
    with np.errstate(all="ignore"):
        for s, y in pairs:
            shares.append((s @ d) / (s @ y))
            if np.isnan(shares[-1]):
                raise _NoStep
            d = d - shares[-1] * y
        if pairs:
            s, y = pairs[0]
            d = d * ((s @ y) / (y @ y))
        for (s, y), share in zip(reversed(pairs), reversed(shares)):
            d = d + (share - (y @ d) / (s @ y)) * s
    return np.where(-d * grad < 0, -d, 0.0)


def _step(x: np.ndarray, grad: np.ndarray, d: np.ndarray, size: float) -> np.ndarray:
    """``x`` moved along ``d``; a coordinate that would leave its orthant becomes 0."""
    moved = x + d * size
    return np.where(np.sign(moved) == np.where(x != 0, np.sign(x), np.sign(-grad)), moved, 0.0)


def _search(f: _Objective, x: np.ndarray, value: float, grad: np.ndarray, d: np.ndarray, first: bool):
    """The point a backtracking line search accepts, with its value, gradient and sums."""
    known: dict = {}
    slope, shrink = float(grad @ d), 0.1 if first else 0.5
    size = 0.5 / float(np.linalg.norm(grad)) if first else 1.0

    def at(size: float, last: float | None):
        if size not in known:
            sizes = [size] if last else [size, size * shrink, size * GROW]
            while last and len(sizes) < AHEAD:
                sizes.append(sizes[-1] * last)
            sizes = [s for s in dict.fromkeys(sizes) if s not in known]
            known.update(zip(sizes, f.values([_step(x, grad, d, s) for s in sizes])))
        return known[size]

    # the search compares the old value with itself first, so a direction downhill shrinks once unseen
    found, last = None, None
    for k in range(TRIES):
        tried = value if found is None else found[0]
        if tried > value + size * slope * 1e-4:
            factor = shrink
        else:
            steep = float((found or at(size, last))[1] @ d)
            factor = GROW if steep < 0.9 * slope else shrink if steep > -0.9 * slope else 1.0
        if factor == 1.0:
            break
        if not LEAST_STEP <= size * factor <= MOST_STEP:
            raise _NoStep
        if k == TRIES - 1:
            break  # the last try is taken as it is
        size, last = size * factor, None if found is None else factor
        found = at(size, last)
    return _step(x, grad, d, size), *at(size, last)


def minimise(f: _Objective, steps: int, tol: float) -> np.ndarray:
    """The point where at most ``steps`` steps from 0 end."""
    x, (value, grad) = f.at, f.told(f.at, f.sums)
    start, recent, pairs, done, failed = value, [np.inf], [], 0, False
    while done < steps:
        if len(recent) >= 2 and abs(value - max(recent)) <= tol * start:
            break
        if np.linalg.norm(grad) <= max(tol * value, 1e-8):
            break
        try:
            new, new_value, new_grad, sums = _search(f, x, value, grad, _direction(grad, pairs), done < 1)
        except _NoStep:
            if failed:
                break
            failed, pairs = True, []  # once more without the kept pairs
            continue
        pairs = [(new - x, new_grad - grad), *pairs][:MEMORY]
        recent = [*recent, new_value][-20:]
        x, value, grad, done, failed = new, new_value, new_grad, done + 1, False
        f.at, f.sums = new, sums
    return x


def _plain_svc(svc: LinearSVC) -> bool:
    """Whether the parameters are those that this fit knows; others go to Spark's own."""
    return svc.getFitIntercept() and not svc.getStandardization()


def fit_svc(svc: LinearSVC, rows: DataFrame, fmap) -> LinearSVCModel:
    """``svc.fit`` of the rows with their features mapped by ``fmap`` (a ``FeatureMap``)."""
    weight: Column = F.col(svc.getWeightCol()).cast("double") if svc.isSet(svc.weightCol) and svc.getWeightCol() else F.lit(1.0)
    packed = rows.select(vector_to_array(svc.getFeaturesCol()).alias("x"), F.col(svc.getLabelCol()).cast("double").alias("y"), weight.alias("w"))
    # kept as Python's own bytes: a pass reads them twice as fast as a cached table's
    blocks = packed.mapInArrow(_pack, "x binary, s binary, bad long").rdd.map(lambda r: (bytes(r.x), bytes(r.s), r.bad)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        data = _Rows(blocks, fmap)
        moments = data.moments() if _plain_svc(svc) else None
        if moments is None or moments["y"] == -moments["w"]:  # no rows, one class, numbers that are none: Spark's own errors
            return svc.fit(fmap(rows))
        f = _Objective(data, moments, svc.getRegParam())
        coefficients, intercept = f.plain(minimise(f, svc.getMaxIter(), svc.getTol()))
    finally:
        blocks.unpersist()
    sc = rows.sparkSession.sparkContext
    java = sc._jvm.org.apache.spark.ml.classification.LinearSVCModel(f"LinearSVC_{uuid.uuid4().hex[:20]}", _py2java(sc, Vectors.dense(coefficients)), intercept)
    return svc._copyValues(LinearSVCModel(java))
