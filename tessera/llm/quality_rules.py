"""Quality rules: robust multivariate outliers per language and source, in SQL functions only.

Every document becomes a vector of transformed text statistics.  Per (language, source) the minimum covariance
determinant estimate of centre and scatter is found by concentration steps: from an estimate, keep the SUPPORT share of
documents nearest to it, re-estimate, and again, until the determinant falls no more for any pair.  There are two starts, coordinatewise
medians with quartile ranges, and mean with covariance; the smaller determinant wins.  A document whose squared Mahalanobis distance exceeds
the chi-square quantile is rejected.  Only per-document statistics (a few numbers) are shuffled, and groups only meet as partial sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import SPACE_CLASS, SPACES, WORD_CHAR, col, join_groups, keep_ids, scratch, table, whole_row, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Coordinates of the outlier vector, and what of each alone is no reason to reject: 4.5 % symbols, 30 % repeated lines, 20 % repeated
#: words, a mean word length off by a third.  Ordinary texts mostly have none of the first three, so their variance may be 0.
DIMS = ("x_symbols", "x_lines", "x_repeat", "x_length")
TOLERATED = {"x_symbols": math.sqrt(0.045), "x_lines": math.sqrt(0.30), "x_repeat": math.sqrt(0.20), "x_length": math.log(4 / 3)}
SUPPORT, QUANTILE, MIN_GROUP = 0.75, 0.999, 200
#: Steps end when no logarithm of a determinant falls by more than this, or after so many.
FALL, MOST_STEPS = 0.01, 30


def chi_square(x: float, freedom: int) -> float:
    """The distribution function, for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi_square_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < share else (low, middle)
    return low


#: Squared distance beyond which a document is an outlier, and the factor that makes the covariance of the SUPPORT share nearest to
#: the centre consistent with that of all, both for normal vectors.
CUTOFF = chi_square_quantile(QUANTILE, len(DIMS))
CONSISTENT = SUPPORT / chi_square(chi_square_quantile(SUPPORT, len(DIMS)), len(DIMS) + 2)
#: Smallest standard deviation of a coordinate: what is tolerated lies at the cutoff.
FLOOR = {d: t / math.sqrt(CUTOFF) for d, t in TOLERATED.items()}
#: Squared distances are ranked in steps of 1/16 of a power of two.
STEPS_PER_OCTAVE = 16


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with BASE columns and n_lines, the lines with words (long).  A null text counts as no words.

    n_repeat_words counts the words covered by an 8-word window that occurs twice or more in the text.
    Windows are compared by 64-bit hashes of their words' hashes; only texts with a repeated
    window go on to find its positions."""
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    df = docs.select(whole_row(docs).alias("__row"), F.coalesce(col(text_col), F.lit("")).alias("__text"))
    df = df.withColumn("__words", words_of(text))
    df = df.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w))).drop("__words")
    df = df.withColumn("n_words", F.size("__hashes").cast("long")).withColumn("__lines", lines)
    windows = F.transform(F.sequence(F.lit(1), F.size("__hashes") - (WINDOW - 1)),
                          lambda i: F.xxhash64(F.slice("__hashes", i, WINDOW)))
    df = df.withColumn("__windows", F.when(F.size("__hashes") > WINDOW, windows).otherwise(F.expr("cast(array() as array<bigint>)")))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__placed", F.when(repeats, placed)).drop("__hashes", "__windows")
    same = lambda a, b: F.get("__placed", a)["h"].eqNullSafe(F.get("__placed", b)["h"])
    at = F.transform(F.filter(F.transform("__placed", lambda x, k: F.struct(x["i"].alias("i"), (
        same(k, k + 1) | ((k > 0) & same(F.greatest(k - 1, F.lit(0)), k))).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"])
    df = df.withColumn("__at", F.sort_array(at)).drop("__placed")
    covered = F.aggregate(
        "__at", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda s: s["n"])
    return df.select(
        *[F.col("__row")[c].alias(c) for c in docs.columns if c not in (*BASE, "n_lines")], "n_words", F.size("__lines").cast("long").alias("n_lines"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def outlier_vector(stats: DataFrame) -> DataFrame:
    """Add DIMS: roots of the shares of symbols in characters, of repeated lines in lines and of repeated words in words, and the log of the mean
    word length, drawn towards five characters by 100 words so that short texts aren't outliers by chance."""
    w = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (stats.withColumn("x_symbols", F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))))
            .withColumn("x_lines", F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))))
            .withColumn("x_repeat", F.sqrt(F.col("n_repeat_words") / w))
            .withColumn("x_length", F.log((F.col("word_chars") + 500.0) / (w + 100.0))))


def _cholesky(cov: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    p, low = len(DIMS), {}
    for i in range(p):
        for j in range(i + 1):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
    return low


def _with_factor(est: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the covariances c of ``est`` (keys, __n, m, c) by the Cholesky factor l of the floored matrix."""
    p = range(len(DIMS))
    cov = {(i, j): F.col(f"c{i}{j}") + (F.lit(FLOOR[DIMS[i]] ** 2) if i == j else F.lit(0.0)) for i in p for j in p if j <= i}
    for (i, j), c in _cholesky(cov).items():
        est = est.withColumn(f"l{i}{j}", c)
    return est.select(*keys, "__n", *[f"m{i}" for i in p], *[f"l{i}{j}" for i in p for j in p if j <= i])


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution, from columns m, l and DIMS."""
    z: list[Column] = []
    for i, d in enumerate(DIMS):
        v = F.col(d) - F.col(f"m{i}")
        for j in range(i):
            v = v - F.col(f"l{i}{j}") * z[j]
        z.append(v / F.col(f"l{i}{i}"))
    total = z[0] * z[0]
    for v in z[1:]:
        total = total + v * v
    return total


def _log_determinant() -> Column:
    out = F.lit(0.0)
    for i in range(len(DIMS)):
        out = out + 2 * F.log(f"l{i}{i}")
    return out


def mcd_estimates(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """One estimate per key: __n, centre m, Cholesky factor l.  ``vectors`` has ``keys`` and DIMS.

    The first start uses mergeable quantile sketches.  A step adds up counts, sums and products per key, start and distance bin, and the
    bins up to the support share are the kept documents: no group is ever sorted or gathered, and a step reads the vectors once."""
    p = range(len(DIMS))
    pairs = [(i, j) for i in p for j in p if j <= i]
    sums = [F.count(F.lit(1)).alias("c"), *[F.sum(d).alias(f"s{i}") for i, d in enumerate(DIMS)],
            *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"p{i}{j}") for i, j in pairs]]
    mean = [F.col(f"s{i}") / F.col("c") for i in p]
    moments = [*[mean[i].alias(f"m{i}") for i in p], *[(F.col(f"p{i}{j}") / F.col("c") - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in pairs]]
    begun = vectors.groupBy(*keys).agg(*sums, *[F.percentile_approx(d, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, d in enumerate(DIMS)])
    begun = scratch(begun.withColumn("__n", F.col("c")), "mcd-start")
    middle = begun.select(*keys, "__n", F.lit(0).alias("__start"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in p],
                          *[(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in pairs])
    both = middle.unionByName(begun.select(*keys, "__n", F.lit(1).alias("__start"), *moments))
    est = scratch(_with_factor(both, [*keys, "__start"]).withColumn("__det", _log_determinant()), "mcd-estimate")
    total = begun.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    of = [*keys, "__start"]
    for _ in range(MOST_STEPS):
        near = join_groups(vectors, est, keys, "__n", total).withColumn("__bin", F.floor(F.log2(_distance() + 1e-9) * STEPS_PER_OCTAVE))
        cells = near.groupBy(*of, "__n", "__det", "__bin").agg(*sums)
        cells = cells.withColumn("__before", F.sum("c").over(W.partitionBy(*of).orderBy("__bin")) - F.col("c"))
        kept = cells.where(F.col("__before") < F.col("__n") * SUPPORT).groupBy(*of, "__n", "__det").agg(
            F.sum("c").alias("c"), *[F.sum(f"s{i}").alias(f"s{i}") for i in p], *[F.sum(f"p{i}{j}").alias(f"p{i}{j}") for i, j in pairs])
        scaled = [*moments[:len(DIMS)], *[(CONSISTENT * (F.col(f"p{i}{j}") / F.col("c") - mean[i] * mean[j])).alias(f"c{i}{j}") for i, j in pairs]]
        old = F.col("__det").alias("__old")
        new = _with_factor(kept.select(*of, "__n", old, *scaled), [*of, "__old"]).withColumn("__det", _log_determinant())
        new = scratch(new, "mcd-estimate")
        fall = new.agg(F.max(F.abs(F.col("__old") - F.col("__det")))).first()[0]
        est = new.drop("__old")
        if fall is None or fall < FALL:
            break
    names = [c for c in est.columns if c not in (*keys, "__det")]
    best = est.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("__det", "__start")).alias("e"))
    return scratch(best.select(*keys, *[F.col(f"e.{c}").alias(c) for c in names if c != "__start"]), "mcd-best")


def quality_verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without its text, with BASE, base_failed, distance2 and kept.

    kept is false if base_failed, else whether the squared Mahalanobis distance to the estimate of the
    document's (language, source) is at most CUTOFF.  Estimates are made from the documents that
    passed the base rules.  A pair with fewer than MIN_GROUP of those uses its language's estimate, a
    language with fewer uses that of all documents; with none at all nothing more is rejected.
    Null language or source: a value of its own.  Repeated rows each count.  An empty table gives no rows.
    """
    added = (*BASE, "n_lines", "base_failed", "distance2", "kept")
    carried = [c for c in docs.columns if c not in (*added, text_col)]
    slim = docs.select(F.struct(*[col(c) for c in carried]).alias("__doc"), col(text_col).alias("__body"),
                       F.coalesce(col(lang_col).cast("string"), F.lit("\0")).alias("__lang"),
                       F.coalesce(col(source_col).cast("string"), F.lit("\0")).alias("__source"))
    stats = text_statistics(slim, "__body").drop("__body").withColumn("base_failed", base_failed())
    stats = scratch(outlier_vector(stats), "quality-stats")
    good = stats.where(~F.col("base_failed"))
    pairs = good.groupBy("__lang", "__source").count()
    langs = pairs.groupBy("__lang").agg(F.sum("count").alias("__in_lang"))
    level = pairs.join(langs, "__lang").select(
        "__lang", "__source", F.col("count").alias("__n"),
        F.when(F.col("count") >= MIN_GROUP, F.concat_ws("\1", F.lit("pair"), "__lang", "__source"))
        .when(F.col("__in_lang") >= MIN_GROUP, F.concat_ws("\1", F.lit("lang"), "__lang")).otherwise("all").alias("__key"))
    level = scratch(level, "quality-levels")
    total = level.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    vectors = good.select("__lang", "__source", *DIMS)
    wide = level.groupBy("__key").agg(F.count(F.lit(1)).alias("__pairs")).where("__key = 'all' or __key like 'lang%'")
    pair_rows = join_groups(vectors, level.where("__key like 'pair%'"), ["__lang", "__source"], "__n", total).select("__key", *DIMS)
    lang_rows = vectors.withColumn("__key", F.concat_ws("\1", F.lit("lang"), "__lang")).select("__key", *DIMS)
    all_rows = vectors.withColumn("__key", F.lit("all")).select("__key", *DIMS)
    wide_rows = lang_rows.unionByName(all_rows).join(F.broadcast(wide.select("__key")), "__key", "left_semi")
    est = mcd_estimates(scratch(pair_rows.unionByName(wide_rows), "quality-vectors"), ["__key"])
    judged = level.join(est.drop("__n"), "__key")
    told = join_groups(good, judged, ["__lang", "__source"], "__n", total).withColumn("distance2", _distance())
    out = ["__doc", *added]
    told = told.withColumn("kept", F.col("distance2") <= CUTOFF).select(*out)
    failed = stats.where("base_failed").withColumn("distance2", F.lit(None).cast("double")).withColumn("kept", F.lit(False)).select(*out)
    return told.unionByName(failed).select(*[F.col("__doc")[c].alias(c) for c in carried], *added)


def quality_filter(docs: DataFrame, id_col: str = "doc_id", **cols: str) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns.  Rows of one id stay if all of them are kept; a null id is an id."""
    slim = docs.select(col(id_col).alias("doc_id"), *[col(cols.get(f"{c}_col", c)).alias(c) for c in ("text", "lang", "source")])
    kept = quality_verdicts(slim).groupBy("doc_id").agg(F.min("kept").alias("kept")).where("kept")
    return keep_ids(docs, id_col, kept)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_verdicts(docs).select("doc_id", *BASE, "base_failed", "kept", "distance2")
