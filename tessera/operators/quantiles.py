"""Exact linear-interpolation quantiles that scale with the number of distinct values.

Spark's ``percentile`` keeps every distinct value of a group in one
aggregation buffer, and a global percentile merges in one task - fine for a
column with a bounded number of values, impossible for a continuous column
of 10^12 values.  The distributed path gives the same numbers:

1. count rows per (group, column, value) - a hot value is one row;
2. rank the distinct values with the bucketed prefix sum (rows before each value);
3. for quantile q with n values, the answer interpolates the values at
   ranks floor(q(n-1)) and ceil(q(n-1)); each distinct-value row checks
   arithmetically whether it holds one of those ranks (a projection after an
   equi-join with the per-group totals - no range join);
4. a small aggregate per (group, column, q) interpolates.

The number of distinct values of a column decides nothing: every size takes these steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import is_float, nan_to_null
from tessera.functions.ranking import prefix_sums


def _x(df: DataFrame, c: str) -> Column:
    x = F.col(c).cast("double")
    return nan_to_null(x) if is_float(df, c) else x


def quantiles_long(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., col_index, prob_index, value): exact linear-interpolation quantiles."""
    long = df.select(*groups, F.inline(F.array(*[
        F.struct(F.lit(i).alias("col_index"), _x(df, c).alias("v")) for i, c in enumerate(cols)])))
    counts = (long.where(F.col("v").isNotNull()).groupBy(*groups, "col_index", "v")
              .agg(F.count(F.lit(1)).alias("_n")))
    keys = [*groups, "col_index"]
    ranked = prefix_sums(counts, "v", ["_n"], groups=keys, inclusive=False, materialize=True)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))  # groups x columns rows
    j = ranked.join(totals, keys)
    picks = []
    for pi, q in enumerate(probs):
        pos = F.lit(float(q)) * (F.col("_total") - 1)
        for which, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            holds = (F.col("_n_cum") <= rank) & (rank < F.col("_n_cum") + F.col("_n"))
            picks.append(F.when(holds, F.struct(F.lit(pi).alias("prob_index"), F.lit(which).alias("which"),
                                                (pos - F.floor(pos)).alias("frac"), F.col("v").alias("v"))))
    hit = j.select(*keys, F.explode(F.filter(F.array(*picks), lambda s: s.isNotNull())).alias("_p"))
    agg = hit.groupBy(*keys, F.col("_p.prob_index").alias("prob_index")).agg(
        F.max(F.when(F.col("_p.which") == "lo", F.col("_p.v"))).alias("_lo"),
        F.max(F.when(F.col("_p.which") == "hi", F.col("_p.v"))).alias("_hi"),
        F.max("_p.frac").alias("_frac"))
    return agg.select(*keys, "prob_index",
                      (F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))).alias("value"))


def quantile_arrays(df: DataFrame, cols: Sequence[str], probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """One row per group (one row in all without groups) with ``_q<i>`` = array of the quantiles of column i, like
    ``percentile(col, probs)``; NULL for a column without values."""
    ql = quantiles_long(df, list(cols), probs, groups)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("prob_index", "value"))), lambda s: s["value"])
    per = ql.groupBy(*groups, "col_index").agg(ordered.alias("_arr"))  # len(probs) values per row
    wide = per.groupBy(*groups).agg(*[F.max(F.when(F.col("col_index") == i, F.col("_arr"))).alias(f"_q{i}") for i in range(len(cols))])
    return df.select(*groups).distinct().join(wide, list(groups), "left") if groups else wide
