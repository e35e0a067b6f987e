"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Every word bucket has a sparse ternary index vector fixed by its number.  A word's context vector is the sum of the
index vectors of the words within two places of it, over the whole corpus.  Document vectors pool the unit context
vectors of their words, rare words weighing more.  A small numpy network is fitted on a bounded sample of labelled
documents, and its probabilities are calibrated by one temperature on labelled documents held out from the fit.

Words are hashed to 2^BITS buckets, so the vector table has a fixed size whatever the corpus; all counts are
taken over all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import col, remainder_of_id, scratch, small_batches, table
from tessera.llm.toxicity import bounded_sample

BITS, DIM, NONZERO, REACH, SEED = 14, 32, 4, 2, 5
#: At most so many labelled documents a class, in the order of a hash of their id; every CALIBRATE-th sets the temperature.
FIT_ROWS, CALIBRATE = 20_000, 5
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 24, 30, 3e-3, 1e-4, 256
#: Weight of a word is RARE / (RARE + its share of all words).
RARE = 1e-3
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
EXTRAS = 3


def index_vectors() -> np.ndarray:
    """(2^BITS, DIM) ternary vectors with NONZERO entries of +1 or -1 each, fixed by SEED."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((1 << BITS, DIM), dtype=np.float32)
    rows = np.arange(1 << BITS)
    places = rng.permuted(np.broadcast_to(np.arange(DIM), (1 << BITS, DIM)), axis=1)[:, :NONZERO]
    signs = rng.choice(np.array([-1, 1], dtype=np.float32), size=(1 << BITS, NONZERO))
    for j in range(NONZERO):
        out[rows, places[:, j]] = signs[:, j]
    return out


class Buckets(dict):
    """token -> bucket.  Letters are lower-cased; words in capitals are words of their own, digits become one zero a digit."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        word = re.sub(r"\d", "0", token.lower())
        if len(token) > 1 and token.isupper():
            word = "\x01" + word
        b = self[token] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        return b


def bucket_rows(texts: list[str | None], buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all tokens in order, number of tokens of each text)."""
    lists = [TOKEN.findall(t or "") for t in texts]
    n = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter((buckets[w] for x in lists for w in x), dtype=np.int64, count=int(n.sum())), n


def context_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n, vec binary float64[DIM]): occurrences and summed neighbours' index vectors of each bucket, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, buckets = index_vectors(), Buckets()
        size = 1 << BITS
        place = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
        sign = np.take_along_axis(index, place, axis=1).astype(np.float64)
        sums, count = np.zeros(size * DIM), np.zeros(size)
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                b, n = bucket_rows(batch.slice(i, 100).column(0).to_pylist(), buckets)
                count += np.bincount(b, minlength=size)
                owner = np.repeat(np.arange(len(n)), n)
                for reach in range(1, REACH + 1):
                    same = owner[reach:] == owner[:-reach]
                    left, right = b[:-reach][same], b[reach:][same]
                    for word, other in ((left, right), (right, left)):
                        for j in range(NONZERO):
                            np.add.at(sums, word * DIM + place[other, j], sign[other, j])
        used = np.flatnonzero(count)
        vec = sums.reshape(size, DIM)
        for i in range(0, len(used), 4096):
            some = used[i:i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some].astype(np.int64)), pa.array([vec[k].astype("<f4").tobytes() for k in some], pa.binary())],
                                             names=["bucket", "n", "vec"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for b, n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                add = np.frombuffer(v.as_buffer(), dtype="<f4").astype("<f8")
                sums[b] = sums[b] + add if b in sums else add
                count[b] = count.get(b, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(count.values()), pa.int64()),
                                          pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["bucket", "n", "vec"])

    schema = "bucket long, n long, vec binary"
    parts = docs.select(col(text_col).cast("string")).mapInArrow(run, schema)
    return parts.repartition("bucket").mapInArrow(merge, schema)  # at most 2^BITS / partitions buckets a task


def word_vectors(sums: DataFrame) -> np.ndarray:
    """(2^BITS, DIM) float32: weighted unit context vectors; zero for buckets without words.  At most 2^BITS rows are collected."""
    got = sums.toPandas()
    out = np.zeros((1 << BITS, DIM), dtype=np.float32)
    if len(got):
        vec = np.stack([np.frombuffer(v, dtype="<f8") for v in got["vec"]])
        vec = vec / (np.linalg.norm(vec, axis=1, keepdims=True) + 1e-9)
        share = got["n"].to_numpy(dtype=float) / got["n"].sum()
        out[got["bucket"].to_numpy()] = vec * (RARE / (RARE + share))[:, None]
    return out


def document_vectors(docs: DataFrame, vectors, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<float>): pooled word vectors, the shares of buckets that come once, of short tokens' repeats and the log length."""
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, buckets = vectors.value, Buckets()
        for batch in batches:
            for i in range(0, batch.num_rows, 50):
                part = batch.slice(i, 50)
                b, n = bucket_rows(part.column(1).to_pylist(), buckets)
                owner = np.repeat(np.arange(len(n)), n)
                pooled = np.zeros((len(n), DIM + EXTRAS), dtype=np.float32)
                key, times = np.unique(owner << BITS | b, return_counts=True)
                doc, word = key >> BITS, key & ((1 << BITS) - 1)
                full = np.flatnonzero(np.bincount(doc, minlength=len(n)))
                if len(full):
                    starts = np.searchsorted(doc, full)
                    pooled[full, :DIM] = np.add.reduceat(table_[word] * times[:, None].astype(np.float32), starts, axis=0) / n[full, None]
                    pooled[full, DIM] = np.diff(np.append(starts, len(doc))) / n[full]
                    pooled[full, DIM + 1] = np.maximum.reduceat(times, starts) / n[full]
                pooled[:, DIM + 2] = np.log1p(n) / 10
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(pooled), pa.list_(pa.float32()))], names=["doc_id", "x"])

    return docs.select(col(id_col), col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, x array<float>")


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = SEED, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Two-layer network (tanh, logistic) by Adam; every CALIBRATE-th row only sets the temperature.  A row's loss counts
    ``weight`` times (once without), in both."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(DIM + EXTRAS), np.ones(DIM + EXTRAS))
    rng = np.random.default_rng(seed)
    p = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
         "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    net = {**p, "mean": mean, "scale": scale, "temperature": np.ones(1)}
    if not len(x):
        net["w2"] = np.zeros(HIDDEN)
        return net
    z = (x - mean) / scale
    weight = np.ones(len(x)) if weight is None else weight / weight.mean()
    check = np.arange(len(x)) % CALIBRATE == CALIBRATE - 1
    fit = np.flatnonzero(~check)
    m, v, t = {k: 0 * a for k, a in p.items()}, {k: 0 * a for k, a in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for i in range(0, len(order), BATCH):
            rows = order[i:i + BATCH]
            h = np.tanh(z[rows] @ p["w1"] + p["b1"])
            err = weight[rows] * (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(err, p["w2"]) * (1 - h * h)
            g = {"w1": z[rows].T @ back + DECAY * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ err + DECAY * p["w2"], "b2": err.sum(keepdims=True)}
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    net.update(p)
    if check.any():
        logit, target = network_logits(x[check], net), y[check]
        temperatures = np.exp(np.linspace(-2, 3, 101))
        loss = [np.average(np.logaddexp(0, logit / s) - target * logit / s, weights=weight[check]) for s in temperatures]
        net["temperature"] = np.array([temperatures[int(np.argmin(loss))]])
    return net


def network_logits(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    return np.tanh(((x - net["mean"]) / net["scale"]) @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = 0,
                   folds: int = 5, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (calibrated probability of quality 1), predicted.

    ``labels`` has the id and ``quality``; ids whose crc32 modulo ``folds`` is ``held`` are never learned from.
    Ids labelled twice take the larger label; null labels and ids are not learned from.  A null, empty or
    tokenless text has a zero vector and gets the network's score for it.  Without any label the score is 0.5.
    Repeated rows are scored each time.  An empty table gives no rows.
    """
    spark = small_batches(docs).sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(scratch(context_sums(docs, text_col), "quality-context")))
    rows = scratch(document_vectors(docs, vectors, id_col, text_col), "quality-documents")
    seen = labels.select(col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"),
                         remainder_of_id(col(id_col), folds).alias("fold")).where(F.col("fold") != held)
    chosen = bounded_sample(seen, "quality", fit_rows)
    got = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["id"]).dropDuplicates(["doc_id"]).select("doc_id", "x", "quality", "weight")
    got = got.orderBy(F.xxhash64("doc_id")).toPandas()
    x = np.stack(got["x"].to_numpy()).astype(float) if len(got) else np.zeros((0, DIM + EXTRAS))
    net = spark.sparkContext.broadcast(fit_network(x, got["quality"].to_numpy(dtype=float), weight=got["weight"].to_numpy(dtype=float)))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            score = 1 / (1 + np.exp(-np.clip(network_logits(v, net.value) / net.value["temperature"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", (remainder_of_id(F.col("doc_id"), folds) == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
