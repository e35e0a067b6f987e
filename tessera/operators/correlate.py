"""Pearson / Spearman correlation in matrix, long and pair forms.

Pearson: one aggregate holding p(p-1)/2 + p ``corr`` buffers (each five
doubles) - one pass, one tiny shuffle, independent of the row count.  Spark's
``corr`` skips a row when either side is NULL, i.e. pairwise deletion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import is_float, nan_to_null, stack_rows
from tessera.functions.ranking import prefix_sums

# The default threshold for the high-correlation warning.
HIGH_CORR_THRESHOLD = 0.95


def _x(df: DataFrame, c: str) -> Column:
    x = F.col(c).cast("double")
    return nan_to_null(x) if is_float(df, c) else x


def _pair_aggs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = [F.corr(_x(df, a), _x(df, b)).alias(f"_c{i}_{j}")
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return df.agg(*aggs)


def _cell(i: int, j: int) -> Column:
    return F.col(f"_c{min(i, j)}_{max(i, j)}")


def corr_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(index, variable, correlation) for every ordered pair incl. the diagonal."""
    one = _pair_aggs(df, cols)
    return stack_rows(one, [{"index": F.lit(a), "variable": F.lit(b), "correlation": _cell(i, j)}
                            for i, a in enumerate(cols) for j, b in enumerate(cols)])


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Square matrix: one row per column, one correlation column per column."""
    one = _pair_aggs(df, cols)
    return stack_rows(one, [{"column_name": F.lit(a), **{b: _cell(i, j) for j, b in enumerate(cols)}}
                            for i, a in enumerate(cols)])


def corr_lower_triangle(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Strictly-lower cells (row index i > column index j): what the heat map shows."""
    one = _pair_aggs(df, cols)
    return stack_rows(one, [{"index": F.lit(a), "variable": F.lit(b), "correlation": _cell(i, j)}
                            for i, a in enumerate(cols) for j, b in enumerate(cols) if i > j])


def high_corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = HIGH_CORR_THRESHOLD) -> DataFrame:
    """(feature_a, feature_b, abs_corr): |r| > threshold, feature_a the later
    column of the pair; empty for fewer than two columns."""
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, abs_corr double")
    one = _pair_aggs(df, cols)
    out = stack_rows(one, [{"feature_a": F.lit(b), "feature_b": F.lit(a), "abs_corr": F.abs(_cell(i, j))}
                           for j, b in enumerate(cols) for i, a in enumerate(cols) if i < j])
    return out.where(F.col("abs_corr") > threshold)


def corr_with_target(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, correlation, position): descending by correlation, target excluded."""
    feats = [f for f in features if f != target]
    one = df.agg(*[F.corr(_x(df, f), _x(df, target)).alias(f"_t{i}") for i, f in enumerate(feats)])
    out = stack_rows(one, [{"feature": F.lit(f), "correlation": F.col(f"_t{i}")} for i, f in enumerate(feats)])
    from pyspark.sql import Window
    w = Window.orderBy(F.desc_nulls_last("correlation"), "feature")  # one row per feature
    return out.withColumn("position", F.row_number().over(w).cast("int"))


def _ranks_from_counts(counts: DataFrame) -> DataFrame:
    """(value, avg_rank) from (value, _n) counts: 1-based ranks, ties share their mean."""
    ranked = prefix_sums(counts, "value", ["_n"], inclusive=False, materialize=True)
    return ranked.select("value", (F.col("_n_cum") + (F.col("_n") + 1) / 2.0).alias("avg_rank"))


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """(value, avg_rank): 1-based ranks with ties sharing their mean rank.

    Values are counted first (a hot value is one row), then ranked with the
    bucketed prefix sum - no global single-task window.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    return _ranks_from_counts(counts)


def spearman_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Spearman correlation (index, variable, correlation), each pair over the rows
    where both columns are present (pairwise deletion).

    The (column, value) counts of all columns come from one pass and are
    materialised in the shared folder; they also tell whether any column has
    missing values.  Without gaps every column is ranked once from its slice of
    that table (distinct values only) and joined back on the value (AQE
    broadcasts small rank tables and splits a hot value's partition), then
    Pearson is taken over the ranks.  With gaps each pair is ranked over its own
    complete rows.
    """
    from tessera.session import materialize
    base = df.select(*[_x(df, c).alias(c) for c in cols])
    long = base.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))
                                          for c in cols])))
    counts = materialize(long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_n")))
    has_gaps = counts.where(F.col("value").isNull()).limit(1).count() > 0  # reads the checkpoint
    if has_gaps:
        return _spearman_pairwise(base, cols)
    ranked = base
    for i, c in enumerate(cols):
        r = _ranks_from_counts(counts.where(F.col("column_name") == c).drop("column_name"))
        ranked = ranked.join(r.select(F.col("value").alias(c), F.col("avg_rank").alias(f"_r{i}")), c)
    rk = ranked.select(*[F.col(f"_r{i}").alias(c) for i, c in enumerate(cols)])
    return corr_long(rk, cols)


def _spearman_pairwise(base: DataFrame, cols: Sequence[str]) -> DataFrame:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            sub = base.select(a, b).dropna() if a != b else base.select(a).dropna()
            if a == b:
                r = sub.join(average_ranks(sub, a).withColumnRenamed("value", a), a)
                one = r.agg(F.corr("avg_rank", "avg_rank").alias("correlation"))
            else:
                r = (sub.join(average_ranks(sub, a).select(F.col("value").alias(a), F.col("avg_rank").alias("_ra")), a)
                     .join(average_ranks(sub, b).select(F.col("value").alias(b), F.col("avg_rank").alias("_rb")), b))
                one = r.agg(F.corr("_ra", "_rb").alias("correlation"))
            pairs = [(a, b)] if a == b else [(a, b), (b, a)]
            parts.append(one.select(F.inline(F.array(*[
                F.struct(F.lit(x).alias("index"), F.lit(y).alias("variable"), F.col("correlation").alias("correlation"))
                for x, y in pairs]))))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out
