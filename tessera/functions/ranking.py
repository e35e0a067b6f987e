"""Running sums in a global order without a single-task window.

A window with an ``orderBy`` and no ``partitionBy`` moves every row into one
task.  ``prefix_sums`` instead range-buckets the rows on approximate quantiles
of the order key (per group), prefix-sums the per-bucket totals (at most
``buckets`` rows per group) and runs the ordered window inside each bucket,
so the work is spread over ``groups x buckets`` tasks.  Callers aggregate to
distinct order keys first (ROC scores, rank values), so one hot key is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize as _materialize


def _bucket_of(cuts: Column, key: Column, n_cuts: int) -> Column:
    """Binary search in one expression: number of cut points <= key."""
    steps = []
    step = 1
    while step * 2 <= n_cuts:
        step *= 2
    while step >= 1:
        steps.append(step)
        step //= 2

    def probe(pos, st):
        nxt = pos + st
        return F.when((nxt <= F.size(cuts)) & (F.element_at(cuts, nxt) <= key), nxt).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), probe)


def prefix_sums(df: DataFrame, order: str | Column, sums: Sequence[str],
                groups: Sequence[str] = (), descending: bool = False,
                tiebreak: Sequence[str] = (), inclusive: bool = True,
                buckets: int | None = None, suffix: str = "_cum",
                lead: Sequence[str] = (), materialize: bool = False) -> DataFrame:
    """Add ``<c><suffix>`` = running sum of ``c`` per group in key order.

    ``inclusive=False`` gives the sum over strictly earlier rows.  Rows with a
    NULL key are dropped.  ``order`` must be numeric; ``(order, tiebreak)``
    should be unique per group for a deterministic result.  ``buckets``
    defaults to 4 x spark.sql.shuffle.partitions (16 .. 4096), so the ordered
    windows spread over the whole shuffle parallelism of the cluster.
    ``lead`` columns get ``<c>_next``: the value on the next row in key order
    (NULL on the last row of the group), also across bucket borders.
    The input feeds three branches (cut points, bucket totals, rows); with
    ``materialize`` it is checkpointed once to the shared folder instead of
    being recomputed - one scan of the source instead of three.  The cut points
    are always checkpointed, so that every branch sees the same buckets.
    """
    if buckets is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        buckets = max(16, min(4096, 4 * parts))
    key = F.col(order) if isinstance(order, str) else order
    key = key.cast("double")
    if descending:
        key = -key
    d = df.withColumn("_k", key).where(F.col("_k").isNotNull())
    if materialize:
        d = _materialize(d)
    probs = [i / buckets for i in range(1, buckets)]
    cuts = d.groupBy(*groups).agg(F.percentile_approx("_k", probs, 4 * buckets).alias("_cuts"))
    # the sketch depends on merge order, and rows and bucket totals must use the same cuts: computed once, kept
    cuts = _materialize(cuts)
    d = d.join(cuts, list(groups)) if groups else d.crossJoin(F.broadcast(cuts))  # ungrouped: one row
    d = d.withColumn("_b", _bucket_of(F.col("_cuts"), F.col("_k"), buckets - 1)).drop("_cuts")

    order_key = F.struct("_k", *tiebreak)
    firsts = [F.min_by(F.struct(*lead), order_key).alias("_first")] if lead else []
    tot = d.groupBy(*groups, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums], *firsts)
    wb = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    nxt = [F.lead("_first").over(Window.partitionBy(*groups).orderBy("_b")).alias("_nb")] if lead else []
    off = tot.select(*groups, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}")
                                      for c in sums], *nxt)
    d = d.join(off, [*groups, "_b"])
    end = 0 if inclusive else -1
    wr = (Window.partitionBy(*groups, "_b").orderBy("_k", *tiebreak)
          .rowsBetween(Window.unboundedPreceding, end))
    wl = Window.partitionBy(*groups, "_b").orderBy("_k", *tiebreak)
    out = d.select("*", *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(wr), F.lit(0))).alias(f"{c}{suffix}")
                          for c in sums],
                   *[F.coalesce(F.lead(c).over(wl), F.col("_nb")[c]).alias(f"{c}_next") for c in lead])
    return out.drop("_k", "_b", "_nb", *[f"_o_{c}" for c in sums])
