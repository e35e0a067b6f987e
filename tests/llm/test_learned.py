"""Toxicity and quality scores: held-out accuracy, the models against plain versions, odd input."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_model, toxicity
from tessera.llm.common import scratch
from tests.llm import frames

BAD = ["grumplefoot", "grumpleton", "vexnar", "vexnaria"]


def _corpus(n=600, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = frames.sentence(rng, rng.randrange(20, 120)).split()
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if junk:
            words = [w + "$$$" for w in words]
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def _frames(spark, extra=()):
    docs, labels = _corpus()
    return (spark.createDataFrame([*docs, *extra], frames.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels)


def _held(i, folds, held):
    return zlib.crc32(str(i).encode()) % folds == held


def test_toxicity_finds_held_out_documents(spark):
    docs, labels, known = _frames(spark)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    truth = {i: t for i, _, t in known}
    held = [i for i in truth if _held(i, 4, 2)]
    assert all(got[i].held_out == _held(i, 4, 2) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    changed = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, changed).collect()}
    assert all(again[i] == pytest.approx(got[i].score, abs=1e-12) for i in again)  # held-out labels teach nothing


def test_toxicity_on_odd_rows_and_without_labels(spark):
    _, labels, _ = _frames(spark)
    odd = frames.odd_docs(spark, ("toxic", "fold", "id", "__id", "toxic_ll"))
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in frames.odd_rows())
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1 and all(0 <= r.score <= 1 for r in rows)
    none = labels.where("false")
    assert {r.score for r in toxicity.toxicity_scores(odd, none).collect()} == {0.5}
    assert toxicity.toxicity_scores(frames.empty_docs(spark), labels).count() == 0
    null_labels = labels.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("toxic"))
    assert toxicity.toxicity_scores(odd, null_labels).count() == odd.count()


def _plain_kneser_ney(counts, n=toxicity.ORDER, d=toxicity.DISCOUNT):
    """Log-likelihoods of a word under class counts (word -> (toxic, ordinary)), from dictionaries of strings."""
    five = [Counter(), Counter()]
    for w, c in counts.items():
        s = "^" * (n - 1) + w + "$"
        for i in range(len(s) - n + 1):
            for j in range(2):
                five[j][s[i:i + n]] += c[j]
    below = {n: set(five[0]) | set(five[1])}
    cont = {}
    for k in range(n - 1, 0, -1):
        cont[k] = Counter(g[1:] for g in below[k + 1])
        below[k] = set(cont[k])

    def score(word):
        s, out = "^" * (n - 1) + word + "$", [0.0, 0.0]
        for i in range(n - 1, len(s)):
            p = 1e-4
            for k in range(1, n):
                ctx = s[i - k + 1:i]
                after = [g for g in below[k] if g[:-1] == ctx]
                total = sum(cont[k][g] for g in after)
                if total:
                    p = (max(cont[k][s[i - k + 1:i + 1]] - d, 0) + d * len(after) * p) / total
            for j in range(2):
                ctx = s[i - n + 1:i]
                after = [g for g in five[j] if g[:-1] == ctx and five[j][g]]
                total = sum(five[j][g] for g in after)
                q = (max(five[j][s[i - n + 1:i + 1]] - d, 0) + d * len(after) * p) / total if total else p
                out[j] += math.log(max(q, 1e-12))
        return out

    return score


def test_models_equal_a_plain_kneser_ney(spark):
    counts = {"stone": (1, 9), "stones": (0, 4), "vexnar": (7, 0), "é漢": (1, 1), "on": (2, 30), "vex": (1, 2)}
    words = spark.createDataFrame([(w, *c) for w, c in counts.items()], "word string, toxic long, ordinary long")
    model = toxicity.fit_models(scratch(toxicity.gram_counts(words), "test-grams"))
    plain = _plain_kneser_ney(counts)
    for w in [*counts, "vexnaria", "stoned", "zzz", "漢", "x"]:
        assert toxicity.log_likelihoods([w], model)[:, 0] == pytest.approx(plain(w), rel=1e-4)


def test_all_documents_are_counted(spark):
    docs = spark.createDataFrame([(1, "bad bad on"), (2, "on"), (3, "other on"), (3, "other"), (None, "nobody"), (4, "unasked"), (5, None)], "doc_id long, text string")
    marked = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (9, 0)], "id long, toxic int")
    got = toxicity.class_words(docs.repartition(3), "doc_id", "text", marked, F.col("__id") != 4).collect()
    assert {r.word: (r.toxic, r.ordinary) for r in got} == {"bad": (2, 0), "on": (1, 1), "other": (0, 0), "nobody": (0, 0), "unasked": (0, 0)}
    five = toxicity.gram_counts(spark.createDataFrame(got)).collect()
    assert len(five) == len({("^^^^" + r.word + "$")[i:i + 5] for r in got for i in range(len(r.word) + 1)})
    assert not hasattr(toxicity, "COUNT_ROWS")


def test_quality_finds_held_out_documents(spark):
    docs, labels, known = _frames(spark)
    got = {r.doc_id: r for r in quality_model.quality_scores(docs, labels).collect()}
    truth = {i: q for i, q, _ in known}
    held = [i for i in truth if _held(i, 5, 0)]
    assert all(got[i].held_out == _held(i, 5, 0) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_quality_on_odd_rows_and_without_labels(spark):
    _, labels, _ = _frames(spark)
    odd = frames.odd_docs(spark, ("quality", "fold", "id", "x", "score"))
    rows = quality_model.quality_scores(odd, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in frames.odd_rows())
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert {r.score for r in quality_model.quality_scores(odd, labels.where("false")).collect()} == {0.5}
    assert quality_model.quality_scores(frames.empty_docs(spark), labels).count() == 0


def test_context_vectors_equal_brute_force(spark):
    texts = ["a b c a", None, "b", "A b! 12 c_d"]
    sums = quality_model.context_sums(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).toPandas()
    index, buckets = quality_model.index_vectors(), quality_model.Buckets()
    want, count = {}, Counter()
    for t in texts:
        b = [buckets[w] for w in quality_model.TOKEN.findall(t or "")]
        for i, x in enumerate(b):
            count[x] += 1
            near = [b[j] for j in range(max(0, i - 2), min(len(b), i + 3)) if j != i]
            want[x] = want.get(x, 0) + sum((index[y].astype(float) for y in near), np.zeros(quality_model.DIM))
    assert dict(zip(sums["bucket"], sums["n"], strict=True)) == count
    for b, v in zip(sums["bucket"], sums["vec"], strict=True):
        assert np.allclose(np.frombuffer(v, dtype="<f8"), want[b])


def test_network_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, quality_model.DIM + quality_model.EXTRAS))
    y = (rng.random(6000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality_model.fit_network(x[:4000], y[:4000])
    p = 1 / (1 + np.exp(-quality_model.network_logits(x[4000:], net) / net["temperature"]))
    for low in (0.0, 0.25, 0.5, 0.75):
        some = (p >= low) & (p < low + 0.25)
        assert abs(p[some].mean() - y[4000:][some].mean()) < 0.08


def test_a_capped_sample_keeps_the_class_shares(spark):
    rng = random.Random(4)
    # Texts that tell nothing: calibrated scores are near the share of the class, whatever the cap cuts.
    docs = spark.createDataFrame([(i, frames.sentence(rng, 40), "en", "s", 0) for i in range(1200)], frames.SCHEMA)
    labels = spark.createDataFrame([(i, int(rng.random() < 0.8), int(rng.random() < 0.1)) for i in range(1200)], "doc_id long, quality int, toxic int")
    sample = toxicity.bounded_sample(labels.select(F.col("doc_id").alias("id"), "toxic"), "toxic", 20).collect()
    assert Counter(r.toxic for r in sample) == {0: 20, 1: 20}
    assert {t: 20 * next(r.weight for r in sample if r.toxic == t) for t in (0, 1)} == pytest.approx({r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()})
    toxic = toxicity.toxicity_scores(docs, labels, fit_rows=20).agg(F.avg("score")).first()[0]
    assert toxic < 0.25  # 0.5 without weights
    x, y = np.random.default_rng(0).normal(size=(6000, quality_model.DIM + quality_model.EXTRAS)), np.arange(6000) % 2
    net = quality_model.fit_network(x, y.astype(float), weight=np.where(y == 1, 8.0, 2.0))
    assert (1 / (1 + np.exp(-quality_model.network_logits(x, net) / net["temperature"]))).mean() > 0.7
    quality = quality_model.quality_scores(docs, labels, fit_rows=100).agg(F.avg("score")).first()[0]
    assert quality > 0.65
