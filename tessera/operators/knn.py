"""Exact k-nearest neighbours by pivots and blocks.

A few training rows are pivots.  Every training row belongs to the cell of its nearest pivot, and a cell with many rows is cut
into blocks of bounded size, so no join key ever holds more than a block.  A query first meets the blocks of its own cell; its k-th
distance there is a bound.  By the triangle inequality (Euclidean or Manhattan) a row x is farther than the bound r
if |d(q, p) - d(x, p)| > r for any pivot p: applied to the range of distances that a cell's rows have to each pivot it rules out
whole cells.  The second round joins every query with the blocks of the cells that are left.  Nothing nearer can be missed, so the
result is exact.

The k nearest are taken per (query, block), by numpy over the block's matrices, and then per query.  Queries that meet one block in
great number are salted, and the block's rows go to every salt.

Imputation compares rows with gaps, for which no such distance exists: it takes rounds of band joins on a coordinate
(|x_j - y_j| bounds the distance) of the different rows, and in the last round every row that is not settled meets every block of
the donors once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize, shared_dir

# Growth of the band per round, salt fan-out of the top-k step, sets of present coordinates visited one by one.
BAND_GROWTH = 4.0
SALTS = 16
MOST_MASKS = 64
#: Rows of a block, queries that share a copy of a block, pivots at most, and pairs whose distances are held at once.
BLOCK_ROWS, QUERY_SHARE, MOST_PIVOTS, CHUNK_PAIRS = 4096, 16384, 32, 1 << 21


def choose_pivots(train: DataFrame, vec: str, n: int, p: int) -> list[list[float]]:
    """At most MOST_PIVOTS training vectors far from each other: of a few hundred rows picked by hash, each next one is the farthest from
    those chosen before."""
    want = max(1, min(MOST_PIVOTS, round((n / 64) ** 0.5)))
    rows = train.select(F.col(vec).alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).orderBy(F.xxhash64("v")).limit(16 * want).collect()
    pool = [list(r.v) for r in rows]

    def apart(a: list[float], b: list[float]) -> float:
        return sum(abs(x - y) ** p for x, y in zip(a, b, strict=True))

    chosen, near = [], [float("inf")] * len(pool)
    while pool and len(chosen) < want:
        far = max(range(len(pool)), key=lambda i: near[i])
        if chosen and near[far] == 0:
            break
        chosen.append(pool[far])
        near = [min(d, apart(v, pool[far])) for d, v in zip(near, pool, strict=True)]
    return chosen


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length, without nulls, as a matrix."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _power(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Sum over the last axis of |a - b|^p, one coordinate after the other."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for j in range(a.shape[-1]):
        d = a[..., j] - b[..., j]
        total += np.abs(d) if p == 1 else d * d
    return total


def _to_pivots(vec: Column, pivots: list[list[float]], p: int) -> Column:
    at = np.array(pivots)

    @F.arrow_udf("array<double>")
    def apart(v: pa.Array) -> pa.Array:
        m = _matrix(v)
        d = np.hstack([_power(m, at[i:i + 1], p)[:, None] for i in range(len(at))]) if len(m) else np.zeros((0, len(at)))
        return pa.ListArray.from_arrays(np.arange(0, d.size + 1, len(at), dtype=np.int32), (d if p == 1 else np.sqrt(d)).ravel())

    return apart(vec)


def _nearest(pairs: DataFrame, k: int, carry: tuple[str, ...]) -> DataFrame:
    """The k nearest per query of those found in its blocks."""
    w = Window.partitionBy("_qid").orderBy("dist", "_id")  # at most k rows per query and block
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("_qid", "_id", "dist", "rank", *carry)


def _block_nearest(k: int, p: int, carry: tuple[str, ...]):
    """Function of (queries, rows) of one block: every query's k nearest rows there, ties by id.

    Euclidean distances are first estimated by one product of matrices; all rows whose estimate does not exceed the k-th one by more than
    rounding explains get their distance coordinate by coordinate, so the k nearest are exact."""
    def nearest(asked: pa.Table, dealt: pa.Table) -> pa.Table:
        dealt = dealt.take(pc.sort_indices(dealt, sort_keys=[("_id", "ascending")], null_placement="at_start"))
        found_q, found_t, found_d = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        if asked.num_rows and dealt.num_rows:
            q, t = _matrix(asked["_qv"]), _matrix(dealt["_tv"])
            r = asked["_r"].to_numpy()  # no bound: NaN
            bound = np.where(np.isnan(r), np.inf, r if p == 1 else r * r)
            qq, tt = (q * q).sum(axis=1), (t * t).sum(axis=1)
            step = max(1, CHUNK_PAIRS // len(t))
            for at in range(0, len(q), step):
                part, slack = q[at:at + step], 0.0
                if p == 1:
                    near = _power(part[:, None, :], t[None, :, :], 1)
                else:
                    near = qq[at:at + step, None] + tt - 2 * (part @ t.T)
                    slack = 1e-10 * (qq[at:at + step] + tt.max())
                near = np.where(np.isnan(near), np.inf, near)
                kth = np.partition(near, k - 1, axis=1)[:, k - 1] if len(t) > k else np.full(len(part), np.inf)
                qi, ti = np.nonzero(near <= (np.minimum(kth, bound[at:at + step]) + slack)[:, None])
                d = near[qi, ti] if p == 1 else np.zeros(len(qi))
                for j in range(t.shape[1] if p != 1 else 0):
                    e = part[qi, j] - t[ti, j]
                    d += e * e
                d = d if p == 1 else np.sqrt(d)
                order = np.lexsort((ti, d, qi))
                qi, ti, d = qi[order], ti[order], d[order]
                keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
                found_q.append(qi[keep] + at), found_t.append(ti[keep]), found_d.append(d[keep])
        qi, ti = pa.array(np.concatenate(found_q)), pa.array(np.concatenate(found_t))
        rows = dealt.select(["_id", *carry]).take(ti)
        return rows.add_column(0, asked.schema.field("_qid"), asked["_qid"].take(qi)).append_column("dist", pa.array(np.concatenate(found_d)))

    return nearest


def _meet(rows: DataFrame, visits: DataFrame, k: int, p: int, carry: tuple[str, ...]) -> DataFrame:
    """The k nearest rows in every block of the (query, cell) ``visits`` (_qid, _qv, _r, _cell, _blocks), not farther than _r."""
    load = visits.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_SHARE).cast("int").alias("_shares"))  # one row per cell
    dealt = rows.join(F.broadcast(load), "_cell").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    asked = visits.join(F.broadcast(load), "_cell").withColumn("_salt", F.pmod(F.xxhash64("_qid"), F.col("_shares")).cast("int"))
    asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    key = ["_cell", "_block", "_salt"]
    out = T.StructType([visits.schema["_qid"], rows.schema["_id"], *[rows.schema[c] for c in carry], T.StructField("dist", T.DoubleType())])
    return asked.select(*key, "_qid", "_qv", "_r").groupBy(*key).cogroup(dealt.select(*key, "_id", "_tv", *carry).groupBy(*key)).applyInArrow(
        _block_nearest(k, p, carry), out)


def nearest_neighbors(train: DataFrame, queries: DataFrame, k: int, id_col: str = "id", qid_col: str = "qid",
                      vec: str = "vec", p: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """(qid, id, dist, rank, carry...) for the k nearest training rows of every query
    (ties broken by training id).  ``vec`` is array<double>, of one length, in both frames; rows without a vector
    or with a null in it are left out."""
    shared_dir(train.sparkSession)
    t = train.select(F.col(id_col).alias("_id"), F.col(vec).alias("_tv"), *carry)
    q = queries.select(F.col(qid_col).alias("_qid"), F.col(vec).alias("_qv"))
    n = t.count()
    pivots = choose_pivots(t, "_tv", n, p)
    if not pivots:
        none = t.limit(0).crossJoin(q.limit(0)).select("_qid", "_id", F.lit(0.0).alias("dist"), F.lit(0).alias("rank"), *carry)
        return none.withColumnRenamed("_qid", qid_col).withColumnRenamed("_id", id_col)
    size = len(pivots[0])

    def whole(df: DataFrame, c: str) -> DataFrame:
        v = F.slice(c, 1, size)
        return df.withColumn(c, F.when(F.size(v) == size, v)).where(F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()))

    cell = lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int")
    t = whole(t, "_tv").withColumn("_td", _to_pivots(F.col("_tv"), pivots, p)).withColumn("_cell", cell(F.col("_td"))).persist(StorageLevel.MEMORY_AND_DISK)
    ranges = [x for i in range(len(pivots)) for x in (F.min(F.col("_td")[i]).alias(f"lo{i}"), F.max(F.col("_td")[i]).alias(f"hi{i}"))]
    cells = {r["_cell"]: r for r in t.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), *ranges).collect()}  # one row per pivot
    blocks = {c: -(-r.n // BLOCK_ROWS) for c, r in cells.items()}
    blocks_of = F.create_map(*[F.lit(x) for c, b in blocks.items() for x in (c, b)])
    rows = materialize(t.drop("_td").withColumn("_block", F.pmod(F.xxhash64("_id"), blocks_of[F.col("_cell")]).cast("int")))
    t.unpersist()
    q = whole(q, "_qv").withColumn("_qd", _to_pivots(F.col("_qv"), pivots, p)).withColumn("_own", cell(F.col("_qd")))
    q = materialize(q)

    first = q.withColumn("_cell", F.col("_own")).withColumn("_r", F.lit(None).cast("double")).withColumn("_blocks", blocks_of[F.col("_own")])
    top = materialize(_nearest(_meet(rows, first, k, p, carry), k, carry))
    bound = top.groupBy("_qid").agg(F.count(F.lit(1)).alias("_c"), F.max("dist").alias("_kth"))
    # rounding may part equal numbers, so the bound is a little wider
    r = F.when(F.col("_c") >= k, F.col("_kth") * (1 + 1e-9) + 1e-12)
    q = q.join(bound, "_qid", "left").withColumn("_r", r).drop("_c", "_kth")

    def may_hold(c: int) -> Column:
        """Whether a row of the cell may lie within the bound: its distance to every pivot differs little enough from the query's."""
        row, ok = cells[c], F.lit(True)
        for i in range(len(pivots)):
            d = F.col("_qd")[i]
            ok = ok & (d <= F.lit(row[f"hi{i}"]) + F.col("_r")) & (d >= F.lit(row[f"lo{i}"]) - F.col("_r"))
        return (F.col("_own") != c) & (F.col("_r").isNull() | ok)

    visits = F.filter(F.array(*[F.when(may_hold(c), F.lit(c)) for c in cells]), lambda c: c.isNotNull())
    second = q.withColumn("_cell", F.explode(visits)).withColumn("_blocks", blocks_of[F.col("_cell")])
    more = _nearest(_meet(rows, second, k, p, carry), k, carry)
    w = Window.partitionBy("_qid").orderBy("dist", "_id")  # at most 2 k rows per query
    out = top.drop("rank").unionByName(more.drop("rank")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = materialize(out.select("_qid", "_id", "dist", "rank", *carry))
    return out.withColumnRenamed("_qid", qid_col).withColumnRenamed("_id", id_col)


def knn_shares(neighbors: DataFrame, qid_col: str, label: str, weights: str = "uniform") -> DataFrame:
    """(qid, label, probability): every class's share of the neighbours' weights, for the classes among them.  ``distance``
    weights are 1/d; zero-distance neighbours, when present, take all the weight."""
    if weights == "distance":
        zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy(qid_col))  # k rows per query
        wcol = F.when(zero == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    else:
        wcol = F.lit(1.0)
    votes = neighbors.withColumn("_w", wcol).groupBy(qid_col, label).agg(F.sum("_w").alias("_s"))
    whole = F.sum("_s").over(Window.partitionBy(qid_col))  # at most k classes per query
    return votes.select(qid_col, label, (F.col("_s") / whole).alias("probability"))


def knn_vote(neighbors: DataFrame, qid_col: str, label: str, weights: str = "uniform") -> DataFrame:
    """(qid, prediction): weighted majority of the neighbours' labels (``knn_shares``), ties to the smallest label."""
    votes = knn_shares(neighbors, qid_col, label, weights)
    best = F.min(F.struct((-F.col("probability")).alias("neg"), F.col(label).alias("lab")))
    return votes.groupBy(qid_col).agg(best.lab.alias("prediction"))


class KNNClassifierModel:
    def __init__(self, train: DataFrame, k: int, weights: str, p: int, features_col: str, label_col: str, classes: int):
        self.train, self.k, self.weights, self.p = train, k, weights, p
        self.features_col, self.label_col, self.classes = features_col, label_col, classes

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with prediction and probability, the classes' shares of the neighbours' weights."""
        from pyspark.ml.functions import array_to_vector, vector_to_array
        q = df.withColumn("_qid", F.monotonically_increasing_id()).checkpoint()
        queries = q.select("_qid", vector_to_array(self.features_col).alias("vec"))
        nb = nearest_neighbors(self.train, queries, self.k, id_col="_tid", qid_col="_qid", p=self.p,
                               carry=("_tlabel",))
        pred = knn_vote(nb, "_qid", "_tlabel", self.weights)
        shares = knn_shares(nb, "_qid", "_tlabel", self.weights).groupBy("_qid").agg(F.map_from_entries(F.collect_list(F.struct("_tlabel", "probability"))).alias("_p"))
        per_class = F.array(*[F.coalesce(F.col("_p")[F.lit(float(c))], F.lit(0.0)) for c in range(self.classes)])
        return q.join(pred, "_qid").join(shares, "_qid").withColumn("probability", array_to_vector(per_class)).drop("_qid", "_p")


class KNNClassifier:
    """Estimator-shaped wrapper: fitting keeps the (cached) training rows."""

    def __init__(self, k: int = 5, weights: str = "uniform", p: int = 2, featuresCol: str = "features",
                 labelCol: str = "label"):
        self.k, self.weights, self.p = k, weights, p
        self.features_col, self.label_col = featuresCol, labelCol

    def fit(self, df: DataFrame) -> KNNClassifierModel:
        from pyspark.ml.functions import vector_to_array
        train = df.select(F.monotonically_increasing_id().alias("_tid"),
                          vector_to_array(self.features_col).alias("vec"),
                          F.col(self.label_col).cast("double").alias("_tlabel")).checkpoint()
        classes = int(train.agg(F.coalesce(F.max("_tlabel"), F.lit(-1.0))).first()[0]) + 1
        return KNNClassifierModel(train, self.k, self.weights, self.p, self.features_col, self.label_col, classes)


# --------------------------------------------------------------------------- KNN imputation

def nan_euclidean(a: Column, b: Column, p: int) -> Column:
    """sqrt(p / m * sum of squared differences over the m coordinates present in
    both arrays); NULL when no coordinate is shared."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), (x - y) * (x - y)))
    m = F.size(F.filter(both, lambda v: v.isNotNull()))
    ss = F.aggregate(both, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return F.when(m > 0, F.sqrt(F.lit(float(p)) / m * ss))


def _present(vec: str, p: int) -> Column:
    """The coordinates that are not null, as bits."""
    return sum((F.when(F.col(vec)[i].isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(p)), F.lit(0))


def _smallest_keys(rows: DataFrame, k: int) -> DataFrame:
    """(dvec, dids): every vector once, with the k smallest keys of its rows (structs, a key may be null)."""
    w1 = Window.partitionBy("dvec", F.pmod(F.xxhash64("did"), F.lit(SALTS))).orderBy("did")
    part = rows.dropDuplicates(["did", "dvec"]).withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    w2 = Window.partitionBy("dvec").orderBy("did")  # at most SALTS x k rows
    least = part.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k)
    return least.groupBy("dvec").agg(F.collect_list(F.struct("did")).alias("dids"))


def _nan_knn(donors: DataFrame, receivers: DataFrame, k: int, p: int) -> DataFrame:
    """(rvec, f, did, dist, v): the k nearest donors of every receiver (vector rvec missing coordinate f) among the rows that
    have f - valid distances only, ties by donor id - by rounds of band joins.

    ``donors`` has (did, dvec), ``receivers`` distinct (rvec, f); vectors are array<double> with NULLs for missing coordinates.
    Equal donors are one vector with its k smallest ids: no other id can be among the k nearest.  A receiver meets the donors that
    have the same coordinates as each other along one coordinate both have, the one with the most values: a band of width w there holds
    all donors nearer than w, as no distance is smaller than the difference of one coordinate."""
    donors = materialize(_smallest_keys(donors, k).withColumn("_m", _present("dvec", p)))
    told = donors.agg(F.count(F.lit(1)).alias("n"), F.collect_set("_m").alias("m"), *[  # at most 2^p sets of coordinates
        F.struct(F.approx_count_distinct(F.col("dvec")[i]), F.min(F.col("dvec")[i]), F.max(F.col("dvec")[i]),
                 F.percentile_approx(F.col("dvec")[i], [0.01, 0.99])).alias(f"c{i}") for i in range(p)]).first()
    n, masks = told.n, sorted(told.m)
    ranges, scales = [], []  # band widths are shares of the range of all but the outermost donors
    for i in range(p):
        _, low, high, mid = told[f"c{i}"]
        ranges.append((high - low if low is not None else 0.0) or 1.0)
        scales.append((mid[1] - mid[0] if mid else 0.0) or ranges[i])
    order = sorted(range(p), key=lambda i: -told[f"c{i}"][0])
    if len(masks) > MOST_MASKS:  # too many to visit one by one: all donors of a coordinate together, along every coordinate
        donors, masks = donors.withColumn("_m", F.lit(0)), [0]
        along = [F.when(F.col("rvec")[i].isNotNull(), F.struct(F.lit(0).alias("_m"), F.lit(i).alias("_j"))) for i in range(p)]
    else:
        along = [F.when(F.col("f").isin([i for i in range(p) if m >> i & 1]), F.coalesce(*[F.when(
            F.col("rvec")[i].isNotNull(), F.struct(F.lit(m).alias("_m"), F.lit(i).alias("_j"))) for i in order if m >> i & 1])) for m in masks if m]
    meets = F.filter(F.array(*along), lambda a: a.isNotNull()) if along else F.array()
    pending = materialize(receivers.withColumn("_along", meets).where(F.size("_along") > 0)) if along else receivers.limit(0)
    d_long = donors.select("dids", "dvec", "_m", F.posexplode("dvec").alias("_j", "_x")).where("_x IS NOT NULL")
    scale_of = F.array(*[F.lit(float(s)) for s in scales])
    out = None
    w, widest = 2.0 * k / max(n, 1), max((r / s for r, s in zip(ranges, scales, strict=True)), default=1.0)
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(-(-max(n, 1) // BLOCK_ROWS)))
    while along and not pending.isEmpty():
        last = w >= widest
        width = lambda j, w=w: w * F.get(scale_of, j)
        db = d_long.withColumn("_b", F.floor(F.col("_x") / width(F.col("_j"))))
        rl = pending.select("rvec", "f", F.inline("_along")).withColumn("_at", F.floor(F.get("rvec", F.col("_j")) / width(F.col("_j"))))
        rb = rl.withColumn("_b", F.explode(F.array(*[F.col("_at") + d for d in (-1, 0, 1)])))
        if last:  # every donor is a candidate: each receiver left goes to every block of donors, once
            db = donors.withColumn("_m", F.lit(0)).withColumn("_j", F.lit(0)).withColumn("_b", own("dvec"))
            rb = pending.select("rvec", "f", F.lit(0).alias("_m"), F.lit(0).alias("_j"), F.explode(
                F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // BLOCK_ROWS).cast("long"))).alias("_b"))
        pairs = (rb.select("rvec", "f", "_m", "_j", "_b").join(db.select("dids", "dvec", "_m", "_j", "_b"), ["_m", "_j", "_b"])
                 .withColumn("v", F.get("dvec", F.col("f"))).where("v IS NOT NULL"))
        if len(masks) == 1 and masks[0] == 0:
            pairs = pairs.dropDuplicates(["rvec", "f", "dvec"])
        pairs = pairs.select("rvec", "f", "dids", "v", nan_euclidean(F.col("rvec"), F.col("dvec"), p).alias("dist"),
                             F.pmod(F.xxhash64("dvec"), F.lit(SALTS)).alias("_salt")).where("dist IS NOT NULL")
        # the k nearest ids are among those of the first k vectors by (distance, smallest id)
        w1 = Window.partitionBy("rvec", "f", "_salt").orderBy("dist", "dids")
        part = pairs.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r")
        each = part.select("rvec", "f", "dist", "v", F.inline("dids"))
        w2 = Window.partitionBy("rvec", "f").orderBy("dist", "did")  # at most SALTS x k x k rows
        top = materialize(each.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k).select("rvec", "f", "did", "dist", "v"))
        if not last:
            stat = top.groupBy("rvec", "f").agg(F.count(F.lit(1)).alias("_c"), F.max("dist").alias("_kth"))
            least = F.array_min(F.transform("_along", lambda a: width(a["_j"])))
            ok = stat.join(pending.select("rvec", "f", least.alias("_minw")), ["rvec", "f"]).where(
                (F.col("_c") >= k) & (F.col("_kth") < F.col("_minw"))).select("rvec", "f")
            top, pending = top.join(ok, ["rvec", "f"]), materialize(pending.join(ok, ["rvec", "f"], "left_anti"))
        out = top if out is None else out.unionByName(top)
        if last:
            break
        w *= BAND_GROWTH
    if out is None:
        return receivers.limit(0).select("rvec", "f", F.lit(0).alias("did"), F.lit(0.0).alias("dist"), F.lit(0.0).alias("v"))
    return out


def knn_impute(df: DataFrame, key: str, cols: list[str], k: int = 5, donors: DataFrame | None = None) -> DataFrame:
    """key + ``cols`` with each missing value replaced by the mean of that column
    over the k nearest donors (nan-Euclidean distance over ``cols``, donors must
    have the column, ties by donor key); the column mean when no donor shares a
    coordinate or the key is null.  ``donors`` (default ``df``) is the fitted data.
    Rows with equal values have the same donors, so every different (row, missing
    column) is searched once, all in the same rounds."""
    shared_dir(df.sparkSession)
    fit = donors if donors is not None else df
    vec = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) + 0.0 for c in cols])
    base = df.select(F.col(key).alias("_key"), vec.alias("_vec"))
    fv = fit.select(F.col(key).alias("did"), vec.alias("dvec"))
    means_of = fv.agg(*[F.avg(F.col("dvec")[i]).alias(f"m{i}") for i in range(len(cols))]).first()
    gaps = F.exists("_vec", lambda v: v.isNull())
    sought = base.where(gaps & F.col("_key").isNotNull()).select(F.col("_vec").alias("rvec")).distinct()
    recv = sought.select("rvec", F.posexplode("rvec").alias("f", "_v")).where("_v IS NULL").drop("_v")
    nb = _nan_knn(fv, recv, k, len(cols))
    means = nb.groupBy("rvec", "f").agg(F.avg("v").alias("_m"))
    wide = means.groupBy(F.col("rvec").alias("_vec")).agg(*[F.max(F.when(F.col("f") == i, F.col("_m"))).alias(f"_imp{i}")
                                                            for i in range(len(cols))])  # one row per different row with gaps
    found = base.where(gaps).join(wide, "_vec", "left")
    imp = lambda i: F.when(F.col("_key").isNotNull(), F.col(f"_imp{i}"))
    filled = found.select(F.col("_key").alias(key), *[
        F.coalesce(F.col("_vec")[i], imp(i), F.lit(means_of[f"m{i}"]).cast("double")).alias(c)
        for i, c in enumerate(cols)])
    return base.where(~gaps).select(F.col("_key").alias(key), *[F.col("_vec")[i].alias(c) for i, c in enumerate(cols)]).unionByName(filled)
