"""Toxicity by class-conditional Kneser-Ney models.

Two character models of words, one of toxic and one of ordinary documents, share their backoff: the five-gram
counts belong to a class, and every lower order uses continuation counts (in how many different five-grams, four-grams, ...
a piece ends) of both classes together.  A rare or inflected expression is thus scored by the stem it shares with
known ones.  A document is scored by its length-normalised log-likelihoods under both models, the excess of its
most toxic words, and a logistic calibration fitted on labelled documents that were not counted.

The models are tables of fixed size (2^BITS buckets an order), so what is sent to the tasks has a proven bound.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import col, remainder_of_id, scratch, small_batches, table
from tessera.llm.minhash import mix64

ORDER, BITS, DISCOUNT = 5, 20, 0.75
#: At most so many labelled documents a class, taken in the order of a hash of their id, calibrate.  Counting has no bound.
FIT_ROWS = 10_000
#: A word adds to the excess what its log ratio has beyond this.
STRONG = 2.0
FEATURES = ("mean_ratio", "log_excess", "top_ratio", "excess_share", "log_words")
WORD = re.compile(r"[^\W\d_]+")
_B, _STEP, _MASK = 0x100000001B3, 0x9E3779B97F4A7C15 >> 3, (1 << 64) - 1
#: Powers of _B, modulo 2^64.
POWERS = [np.uint64(pow(_B, k, 1 << 64)) for k in range(ORDER)]


def words_in(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """64-bit hashes of the character n-grams, for n = 1 to ORDER, that end at each character of ^^^^word$ after the
    padding, and the number of the word each belongs to."""
    text = "".join(["^" * (ORDER - 1) + w + "$" for w in words])
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + ORDER
    owner = np.repeat(np.arange(len(words)), n - (ORDER - 1))
    first = np.repeat(np.cumsum(n) - n, n - (ORDER - 1))
    at = first + np.arange(len(owner)) - np.repeat(np.cumsum(n - ORDER + 1) - (n - ORDER + 1), n - (ORDER - 1)) + ORDER - 1
    out, h = [], np.zeros(len(owner), dtype=np.uint64)
    for k in range(ORDER):  # reading backwards: the k-gram's hash is a prefix sum
        h = h + (cp[at - k] + np.uint64(1)) * POWERS[k]
        out.append(mix64(h + np.uint64((k + 1) * _STEP & _MASK)))
    return out, owner


def contexts(words: list[str]) -> list[np.ndarray]:
    """Hashes of the characters before, for the n-grams of ``grams``: context of the k-gram has k - 1 characters."""
    text = "".join(["^" * (ORDER - 1) + w + "$" for w in words])
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + ORDER
    first = np.repeat(np.cumsum(n) - n, n - (ORDER - 1))
    at = first + np.arange(len(first)) - np.repeat(np.cumsum(n - ORDER + 1) - (n - ORDER + 1), n - (ORDER - 1)) + ORDER - 1
    out, h = [], np.zeros(len(first), dtype=np.uint64)
    for k in range(ORDER):
        out.append(mix64(h + np.uint64((k + 77) * _STEP & _MASK)))
        if k + 1 < ORDER:
            h = h + (cp[at - k - 1] + np.uint64(1)) * POWERS[k]
    return out


def class_words(docs: DataFrame, id_col: str, text_col: str, marked: DataFrame, may_be: Column | None = None) -> DataFrame:
    """(word, toxic, ordinary): the words of all documents, with their counts in the documents that ``marked`` (id, toxic; an id
    once) names.  Only documents that ``may_be`` (a condition on __id) allows are looked up there, the others' texts never move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())  # ordinary, toxic, no label
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[2 if toxic is None else toxic].update(words_in(text.as_py()))
            if sum(map(len, counts)) > 200_000:
                yield from told(counts)
                counts = (Counter(), Counter(), Counter())
        yield from told(counts)

    def told(counts: tuple[Counter, Counter, Counter]) -> Iterator[pa.RecordBatch]:
        words = list({**counts[0], **counts[1], **counts[2]})
        for i in range(0, len(words), 100_000):
            some = words[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([counts[1][w] for w in some], pa.int64()),
                                              pa.array([counts[0][w] for w in some], pa.int64())], names=["word", "toxic", "ordinary"])

    slim = docs.select(col(id_col).alias("__id"), col(text_col).cast("string").alias("__text"))
    asked = F.col("__id").isNotNull() if may_be is None else F.col("__id").isNotNull() & may_be
    rows = slim.where(asked).join(marked.select(F.col("id").alias("__id"), "toxic"), "__id", "left").select("__text", F.col("toxic").cast("int"))
    rows = rows.unionByName(slim.where(~asked).select("__text", F.lit(None).cast("int").alias("toxic")))
    counts = rows.mapInArrow(run, "word string, toxic long, ordinary long")
    return counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(h1..h5, c1..c5, toxic, ordinary): one row per five-gram, with the hashes of its endings and of their contexts."""
    cols = [f"{x}{k}" for k in range(1, ORDER + 1) for x in "hc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 20_000):
                part = batch.slice(i, 20_000)
                some = part.column(0).to_pylist()
                g, owner = grams(some)
                c = contexts(some)
                keys, first, inverse = np.unique(g[-1], return_index=True, return_inverse=True)
                sums = [np.bincount(inverse, weights=part.column(j).to_numpy()[owner], minlength=len(keys)).astype(np.int64) for j in (1, 2)]
                arrays = [x[k][first].view(np.int64) for k in range(ORDER) for x in (g, c)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (*arrays, *sums)], names=[*cols, "toxic", "ordinary"])

    schema = ", ".join(f"{c} long" for c in (*cols, "toxic", "ordinary"))
    rest = [c for c in cols if c != f"h{ORDER}"]
    parts = words.mapInArrow(run, schema)
    return parts.groupBy(f"h{ORDER}").agg(*[F.min(c).alias(c) for c in rest], F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _bucket(name: str):
    return F.col(name).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("bucket")


def _table(rows: DataFrame, values: list[str]) -> np.ndarray:
    """Collect at most 2^BITS rows (bucket, values...) as arrays of fixed size."""
    got = rows.toPandas()
    out = np.zeros((len(values), 1 << BITS), dtype=np.float32)
    for i, v in enumerate(values):
        out[i, got["bucket"].to_numpy(dtype=np.int64)] = got[v].to_numpy(dtype=np.float32)
    return out


def fit_models(five: DataFrame) -> dict[str, np.ndarray]:
    """Class counts of the five-grams and shared continuation counts of all lower orders, in buckets."""
    n = ORDER
    model = {"top": _table(five.groupBy(_bucket(f"h{n}")).agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o")), ["t", "o"])}
    told = five.groupBy(_bucket(f"c{n}")).agg(
        F.sum("toxic").alias("t"), F.sum("ordinary").alias("o"),
        F.sum((F.col("toxic") > 0).cast("int")).alias("kt"), F.sum((F.col("ordinary") > 0).cast("int")).alias("ko"))
    model["top_context"] = _table(told, ["t", "o", "kt", "ko"])
    grams_ = five
    for k in range(n - 1, 0, -1):
        keep = [f"{x}{j}" for j in range(1, k + 1) for x in "hc"]
        grams_ = grams_.groupBy(f"h{k}").agg(*[F.min(c).alias(c) for c in keep if c != f"h{k}"], F.count(F.lit(1)).alias("n"))
        grams_ = scratch(grams_, "grams")
        model[f"g{k}"] = _table(grams_.groupBy(_bucket(f"h{k}")).agg(F.sum("n").alias("n")), ["n"])[0]
        model[f"x{k}"] = _table(grams_.groupBy(_bucket(f"c{k}")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")), ["n", "k"])
    return model


def log_likelihoods(words: list[str], model: dict[str, np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each word under the toxic and the ordinary model, shape (2, words)."""
    mask = np.uint64((1 << BITS) - 1)
    g, owner = grams(words)
    c = [(x & mask).astype(np.int64) for x in contexts(words)]
    g = [(x & mask).astype(np.int64) for x in g]
    p = np.full(len(owner), 1e-4)  # an unseen character
    for k in range(1, ORDER):
        total, kinds = model[f"x{k}"][0][c[k - 1]].astype(np.float64), model[f"x{k}"][1][c[k - 1]]
        seen = np.maximum(model[f"g{k}"][g[k - 1]] - DISCOUNT, 0)
        p = np.where(total > 0, (seen + DISCOUNT * kinds * p) / np.maximum(total, 1), p)
    out = np.empty((2, len(words)))
    for j in range(2):
        total, kinds = model["top_context"][j][c[-1]].astype(np.float64), model["top_context"][2 + j][c[-1]]
        seen = np.maximum(model["top"][j][g[-1]] - DISCOUNT, 0)
        q = np.where(total > 0, (seen + DISCOUNT * kinds * p) / np.maximum(total, 1), p)
        out[j] = np.bincount(owner, weights=np.log(np.maximum(q, 1e-12)), minlength=len(words))
    return out


class WordScores:
    """Log-likelihoods by word, computed for many new words at a time and remembered for up to ``most`` of them."""

    def __init__(self, model: dict[str, np.ndarray], most: int = 200_000):
        self.model, self.most, self.place = model, most, {}
        self.values = np.zeros((2, 0))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.place) > self.most:
            self.place, self.values = {}, np.zeros((2, 0))
        new = list(dict.fromkeys(w for w in set(words) if w not in self.place))
        if new:
            found = [log_likelihoods(new[i:i + 20_000], self.model) for i in range(0, len(new), 20_000)]
            at = self.values.shape[1]
            self.values = np.concatenate([self.values, *found], axis=1)
            self.place.update(zip(new, range(at, at + len(new)), strict=True))
        return self.values[:, np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))]


def likelihood_features(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxic_ll, ordinary_ll, FEATURES) of every document; ``model`` is a broadcast of ``fit_models``."""
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    names = ["doc_id", "toxic_ll", "ordinary_ll", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(model.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                docs_ = [words_in(t.as_py()) for t in part.column(1)]
                n = np.array([len(d) for d in docs_], dtype=np.int64)
                ll = scores.of([w for d in docs_ for w in d])
                ratio = ll[0] - ll[1]
                owner = np.repeat(np.arange(len(n)), n)
                add = lambda v: np.bincount(owner, weights=v, minlength=len(n))  # noqa: E731, B023
                size = np.maximum(n, 1)
                top = np.zeros(len(n))
                np.maximum.at(top, owner, ratio)
                excess = add(np.maximum(ratio - STRONG, 0))
                cols = [add(ll[0]) / size, add(ll[1]) / size, add(ratio) / size, np.log1p(excess), top, 100 * excess / size, np.log1p(n)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in cols]], names=names)

    schema = f"doc_id {kind}, " + ", ".join(f"{c} double" for c in names[1:])
    return docs.select(col(id_col), col(text_col).cast("string")).mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a ridge-penalised logistic regression by Newton steps.  A row counts
    ``weight`` times (once without)."""
    if not len(y):
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1)
    weight = np.ones(len(y)) if weight is None else weight
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([*[ridge] * x.shape[1], 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def bounded_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(id, <label>, weight) of at most ``rows`` labelled ids a class, in the order of a hash of the id.  ``weight`` is how many
    labelled ids of its class an id stands for, so that weighted rows have the classes' shares of all labels."""
    one = labels.where(F.col("id").isNotNull() & F.col(label).isNotNull()).groupBy("id").agg(F.max(label).alias(label))
    size = {r[0]: r[1] for r in one.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    parts = [one.where(F.col(label) == v).orderBy(F.xxhash64("id"), "id").limit(rows)
             .withColumn("weight", F.lit(max(1.0, size.get(v, 0) / max(rows, 1)))) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = 2,
                    folds: int = 4, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, toxic_ll, ordinary_ll (mean per word).

    ``labels`` has the id and ``toxic``; ids whose crc32 modulo ``folds`` is ``held`` are never learned from, the next
    remainder calibrates and all others are counted by class.  The shared lower orders, which know no label, count all documents,
    held-out ones too.  Ids labelled twice take the larger label; null
    labels and ids are not learned from.  A null, empty or wordless text has no likelihoods (0) and gets the score of
    one, from the calibration.  Without any label the score is 0.5.  Repeated rows are scored each time.
    """
    spark = small_batches(docs).sparkSession
    seen = labels.select(col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"),
                         remainder_of_id(col(id_col), folds).alias("fold")).where(F.col("fold") != held)
    tune = (held + 1) % folds
    counted = seen.where((F.col("fold") != tune) & F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
    counted = scratch(counted.groupBy("id").agg(F.max("toxic").alias("toxic")), "toxic-counted")
    may_be = ~remainder_of_id(F.col("__id"), folds).isin(held, tune)
    five = scratch(gram_counts(class_words(docs, id_col, text_col, counted, may_be)), "toxic-grams")
    model = spark.sparkContext.broadcast(fit_models(five))
    feats = scratch(likelihood_features(docs, model, id_col, text_col), "toxic-features")
    chosen = bounded_sample(seen.where(F.col("fold") == tune), "toxic", fit_rows)
    got = feats.join(F.broadcast(chosen), feats["doc_id"] == chosen["id"]).dropDuplicates(["doc_id"]).select(*FEATURES, "toxic", "weight").toPandas()
    mean, scale, w = fit_logistic(got[list(FEATURES)].to_numpy(dtype=float), got["toxic"].to_numpy(dtype=float), weight=got["weight"].to_numpy(dtype=float))
    logit = F.lit(float(w[-1]))
    for f, m, s, v in zip(FEATURES, mean, scale, w, strict=False):
        logit = logit + (F.col(f) - float(m)) / float(s) * float(v)
    score = 1 / (1 + F.exp(-logit))
    return feats.select("doc_id", (remainder_of_id(F.col("doc_id"), folds) == held).alias("held_out"), score.alias("score"),
                        (score >= threshold).cast("int").alias("predicted"), "toxic_ll", "ordinary_ll")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
