import numpy as np
import pandas as pd
import pytest

from tessera.operators.knn import knn_vote, nearest_neighbors


@pytest.mark.parametrize(("p", "blocks", "share"), [(2, 4096, 16384), (1, 7, 3)])
def test_pivot_knn_is_exact_on_clusters(spark, monkeypatch, p, blocks, share):
    """Clusters, an outlying query, integer coordinates (many ties), blocks and salts of a few rows."""
    from tessera.operators import knn
    monkeypatch.setattr(knn, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(knn, "QUERY_SHARE", share)
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.integers(0, 6, (500, 4)) + c for c in (0, 20, 50)]).astype(float)
    queries = np.vstack([rng.integers(0, 6, (40, 4)) + 19, [[300.0] * 4], pts[:20], rng.normal(size=(20, 4)) * 30])
    train = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(pts)), "vec": list(pts)}))
    q = spark.createDataFrame(pd.DataFrame({"qid": np.arange(len(queries)), "vec": list(queries)}))
    got = nearest_neighbors(train, q, 6, p=p).toPandas()
    for i, qv in enumerate(queries):
        d = (np.abs(pts - qv) ** p).sum(axis=1) ** (1 / p)
        order = sorted(range(len(pts)), key=lambda j: (d[j], j))[:6]
        mine = got[got.qid == i].sort_values("rank")
        assert list(mine.id) == order and np.allclose(mine.dist, d[order])


def test_few_or_no_training_rows(spark):
    train = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 1.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(7, [0.0, 0.0]), (8, [9.0, 9.0])], "qid long, vec array<double>")
    got = nearest_neighbors(train, q, 5).toPandas().sort_values(["qid", "rank"])
    assert got[["qid", "id"]].to_numpy().tolist() == [[7, 1], [7, 2], [8, 2], [8, 1]]
    assert nearest_neighbors(train.limit(0), q, 5).count() == nearest_neighbors(train, q.limit(0), 5).count() == 0


def test_pivot_knn_is_exact_with_hot_cluster(spark):
    rng = np.random.default_rng(7)
    pts = rng.normal(size=(300, 3))
    pts[:100] = 0.5  # a third of the training points share one location
    labels = rng.integers(0, 3, 300)
    queries = np.vstack([rng.normal(size=(40, 3)) * 3, np.full((5, 3), 0.5)])
    train = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "vec": list(pts), "tl": labels}))
    q = spark.createDataFrame(pd.DataFrame({"qid": np.arange(len(queries)), "vec": list(queries)}))
    got = nearest_neighbors(train, q, 5, carry=("tl",)).toPandas()
    for i, qv in enumerate(queries):
        d = np.sqrt(((pts - qv) ** 2).sum(axis=1))
        order = sorted(range(300), key=lambda j: (d[j], j))[:5]
        mine = got[got.qid == i].sort_values("rank")
        assert list(mine.id) == order
    votes = knn_vote(nearest_neighbors(train, q, 5, carry=("tl",)), "qid", "tl").toPandas()
    assert len(votes) == len(queries)


def _brute_knn_impute(X, keys, k):
    n, p = X.shape
    out = X.copy()
    means = np.nanmean(X, axis=0)
    for r in range(n):
        for f in range(p):
            if not np.isnan(X[r, f]):
                continue
            cands = []
            for d in range(n):
                if np.isnan(X[d, f]):
                    continue
                both = ~np.isnan(X[r]) & ~np.isnan(X[d])
                if both.sum() == 0:
                    continue
                dist = np.sqrt(p / both.sum() * ((X[r, both] - X[d, both]) ** 2).sum())
                cands.append((dist, keys[d], X[d, f]))
            cands.sort()
            out[r, f] = np.mean([c[2] for c in cands[:k]]) if cands else means[f]
    return out


@pytest.mark.parametrize("blocks", [4096, 10])
def test_knn_impute_matches_brute_force(spark, monkeypatch, blocks):
    from tessera.operators import knn
    from tessera.operators.knn import knn_impute
    monkeypatch.setattr(knn, "BLOCK_ROWS", blocks)
    rng = np.random.default_rng(11)
    X = rng.normal(size=(120, 3)).round(1)
    X[rng.random((120, 3)) < 0.2] = np.nan
    X[7] = np.nan  # all missing -> column means
    keys = np.arange(120)
    pdf = pd.DataFrame(X, columns=["x", "y", "z"]).assign(k=keys)
    got = knn_impute(spark.createDataFrame(pdf), "k", ["x", "y", "z"], k=5).toPandas().sort_values("k")
    exp = _brute_knn_impute(X, keys, 5)
    assert np.allclose(got[["x", "y", "z"]].to_numpy(), exp)


def test_classifier_gives_probabilities(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from tessera.operators.knn import KNNClassifier
    rng = np.random.default_rng(5)
    pts, labels = rng.normal(size=(120, 3)), rng.integers(0, 3, 120)
    pts[:5] = pts[5]  # equal points: their distance is 0
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(120), "vec": list(pts), "label": labels.astype(float)})).withColumn("features", array_to_vector("vec"))
    for weights in ("uniform", "distance"):
        out = KNNClassifier(k=4, weights=weights).fit(df.where("i < 100")).transform(df).orderBy("i").toPandas()
        for i, row in out.iterrows():
            d = np.sqrt(((pts[:100] - pts[i]) ** 2).sum(axis=1))
            near = np.argsort(d, kind="stable")[:4]
            w = np.ones(4) if weights == "uniform" else (d[near] == 0).astype(float) if (d[near] == 0).any() else 1 / d[near]
            want = np.array([w[labels[near] == c].sum() for c in range(3)]) / w.sum()
            assert np.allclose(row.probability.toArray(), want) and row.prediction == want.argmax()


@pytest.mark.parametrize("p", [1, 2])
def test_a_block_gives_k_rows_a_query_not_a_row_a_pair(p):
    """500 queries against 4000 rows of 64 coordinates, many of them equal, in one block; ids in no order."""
    import pyarrow as pa

    from tessera.operators import knn
    rng = np.random.default_rng(1)
    vectors = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())
    rows, asked = rng.integers(0, 2, (4000, 64)).astype(float), rng.integers(0, 2, (500, 64)).astype(float)
    rows[:300] = asked[0]
    ids = rng.permutation(4000)
    got = knn._block_nearest(5, p, ("tl",))(
        pa.table({"_qid": np.arange(500), "_qv": vectors(asked), "_r": pa.array([None] * 500, pa.float64())}),
        pa.table({"_id": ids, "_tv": vectors(rows), "tl": ids % 3})).to_pandas()
    assert len(got) == 500 * 5 and (got.tl == got._id % 3).all()
    for i in (0, 1, 250, 499):
        d = (np.abs(rows - asked[i]) ** p).sum(axis=1) ** (1 / p)
        want = sorted(zip(d, ids))[:5]
        mine = got[got._qid == i]
        assert list(mine._id) == [w[1] for w in want] and np.allclose(mine.dist, [w[0] for w in want])


def test_rows_without_a_whole_vector_are_left_out(spark):
    train = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 1.0]), (3, None), (4, [0.0, None])], "id long, vec array<double>")
    q = spark.createDataFrame([(7, [0.0, 0.0]), (8, None), (9, [None, 0.0])], "qid long, vec array<double>")
    assert [(r.qid, r.id) for r in nearest_neighbors(train, q, 5).orderBy("rank").collect()] == [(7, 1), (7, 2)]


@pytest.mark.parametrize("masks", [64, 1])
def test_knn_impute_searches_equal_rows_once(spark, monkeypatch, masks):
    """Donors and rows with gaps in many copies, an outlier that stretches the range, a column of two values."""
    from tessera.operators import knn
    monkeypatch.setattr(knn, "MOST_MASKS", masks)
    rng = np.random.default_rng(13)
    X = np.column_stack([rng.integers(0, 12, 300), rng.integers(0, 2, 300), rng.integers(0, 2, 300)]).astype(float)
    X[:100, 1] = np.nan
    X[50:140, 2] = np.nan
    X[290:, 0] = np.nan
    X[200, 0] = 1e6
    keys = rng.permutation(300)
    asked = []
    whole = knn._nan_knn
    monkeypatch.setattr(knn, "_nan_knn", lambda donors, receivers, *a: asked.append(receivers.count()) or whole(donors, receivers, *a))
    got = knn.knn_impute(spark.createDataFrame(pd.DataFrame(X, columns=["x", "y", "z"]).assign(k=keys)), "k", ["x", "y", "z"], k=5).toPandas()
    exp = pd.DataFrame(_brute_knn_impute(X, keys, 5)).assign(k=keys).sort_values("k")
    assert np.allclose(got.sort_values("k")[["x", "y", "z"]].to_numpy(), exp[[0, 1, 2]].to_numpy())
    gaps = pd.DataFrame(X)[np.isnan(X).any(axis=1)].drop_duplicates()
    assert asked == [int(gaps.isna().sum().sum())]
