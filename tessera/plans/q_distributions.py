"""Registered distribution-data queries (histograms, KDE, box plots, scatter pairs)."""

from __future__ import annotations

from tessera.operators import distributions as V
from tessera.plans.registry import query, rounded, table

_LN10 = "ln(10)"


def _steps_sql(n):
    out, prev = [], "s0"
    for i in range(1, n + 1):
        out.append(f"s{i} AS (SELECT lo, hi, span, CASE WHEN ceil(span / step) > 30 THEN step * 10 ELSE step END "
                   f"AS step FROM {prev})")
        prev = f"s{i}"
    return out, prev


_STEPS, _LAST = _steps_sql(4)
_NICE_SQL = f"""
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
p AS (SELECT lo, hi, coalesce(nullif(hi - lo, 0), nullif(abs(lo), 0), 1.0) AS span FROM s),
s0 AS (SELECT lo, hi, span, pow(10.0, floor(ln(span) / {_LN10} + 0.5) - 2) AS step FROM p),
{", ".join(_STEPS)},
d5 AS (SELECT lo, hi, span, CASE WHEN span / (step / 5) <= 30 THEN step / 5 ELSE step END AS step FROM {_LAST}),
d2 AS (SELECT lo, hi, span, CASE WHEN span / (step / 2) <= 30 THEN step / 2 ELSE step END AS step FROM d5),
e AS (SELECT *, pow(10.0, -(CASE WHEN ln(step) >= 0 THEN 0 ELSE floor(-ln(step) / {_LN10}) + 1 END) - 1) AS eps
      FROM d2),
n AS (SELECT *, floor(lo / step + eps) * step AS v FROM e),
r AS (SELECT step, CASE WHEN lo < v THEN v - step ELSE v END AS start, ceil(hi / step) * step AS stop0 FROM n),
f AS (SELECT step, start, CASE WHEN stop0 = start THEN start + step ELSE stop0 END AS stop FROM r),
b AS (SELECT start + step * floor(1e-14 + (greatest(start, least(value, stop - step)) - start) / step) AS bin_start,
             step FROM events, f WHERE value IS NOT NULL)
SELECT round(bin_start, 6) AS bin_start, round(bin_start + step, 6) AS bin_end, count(*) AS count
FROM b GROUP BY bin_start, step"""


@query("dist_histogram_nice", _NICE_SQL)
def dist_histogram_nice(spark, sf):
    return rounded(V.histogram_nice(table(spark, sf, "events"), "value"))


_EQUAL_SQL = """
WITH s AS (SELECT min(o_totalprice) AS lo0, max(o_totalprice) AS hi0 FROM orders),
t AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
             CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM s),
u AS (SELECT lo, hi, (hi - lo) / 20 AS w FROM t),
i0 AS (SELECT o_totalprice AS x, lo, hi, w, least(floor((o_totalprice - lo) * (20 / (hi - lo))), 19) AS i
       FROM orders, u WHERE o_totalprice IS NOT NULL),
i1 AS (SELECT x, lo, hi, w, CASE WHEN x < i * w + lo THEN i - 1 ELSE i END AS i FROM i0),
i2 AS (SELECT x, lo, hi, w, CASE WHEN i <> 19 AND x >= (i + 1) * w + lo THEN i + 1 ELSE i END AS i FROM i1)
SELECT CAST(i + 1 AS INTEGER) AS bin, round(i * w + lo, 6) AS bin_lo,
       round(CASE WHEN i = 19 THEN hi ELSE (i + 1) * w + lo END, 6) AS bin_hi, count(*) AS count
FROM i2 GROUP BY i, lo, hi, w"""


@query("dist_histogram_equal", _EQUAL_SQL)
def dist_histogram_equal(spark, sf):
    return rounded(V.histogram_equal(table(spark, sf, "orders"), "o_totalprice"))


def _kde_sql(group: str | None):
    g = f"{group}, " if group else ""
    on = f"USING ({group})" if group else "ON TRUE"
    gb = f"GROUP BY {group}" if group else ""
    return f"""
WITH v AS (SELECT {g}value AS x FROM events WHERE value IS NOT NULL),
st AS (SELECT {g}count(*) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM v {gb}),
b AS (SELECT {g}n, sd * pow(n, -0.2) AS bw, lo, hi FROM st),
p AS (SELECT {g}n, bw, lo - 3.0 * bw AS g0, ((hi + 3.0 * bw) - (lo - 3.0 * bw)) / 199 AS gs FROM b),
c AS (SELECT {g}x, count(*) AS cnt FROM v GROUP BY ALL),
grid AS (SELECT range AS j FROM range(200))
SELECT {g}CAST(j AS INTEGER) AS grid_index, round(j * gs + g0, 6) AS x,
       round(sum(cnt * exp(-0.5 * pow(((j * gs + g0) - c.x) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM p JOIN c {on} CROSS JOIN grid
GROUP BY {g}j, gs, g0, n, bw"""


@query("dist_kde", _kde_sql(None))
def dist_kde(spark, sf):
    return rounded(V.kde(table(spark, sf, "events"), "value"))


@query("dist_kde_by_target", _kde_sql("event_type"))
def dist_kde_by_target(spark, sf):
    return rounded(V.kde(table(spark, sf, "events"), "value", groups=["event_type"]))


_BOX_SQL = """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL GROUP BY event_type),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence, count(*) AS n,
       round(min(CASE WHEN value BETWEEN lower_fence AND upper_fence THEN value END), 6) AS whisker_low,
       round(max(CASE WHEN value BETWEEN lower_fence AND upper_fence THEN value END), 6) AS whisker_high,
       count_if(NOT (value BETWEEN lower_fence AND upper_fence)) AS n_outliers
FROM events e JOIN f USING (event_type) WHERE value IS NOT NULL
GROUP BY f.event_type, q1, median, q3, iqr, lower_fence, upper_fence"""


@query("dist_box_stats", _BOX_SQL)
def dist_box_stats(spark, sf):
    return rounded(V.box_stats(table(spark, sf, "events"), "value", ["event_type"]))


@query("dist_box_outliers", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
           FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_id, event_type, value FROM events JOIN q USING (event_type)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def dist_box_outliers(spark, sf):
    return V.box_outliers(table(spark, sf, "events"), "value", ["event_type"], keep=["event_id"])


_SCATTER = ["o_totalprice", "o_custkey", "o_orderkey"]


@query("dist_scatter_pairs", " UNION ALL ".join(
    f"SELECT o_orderkey AS key, o_orderstatus, '{a}' AS x_name, '{b}' AS y_name, "
    f"CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM orders" for b in _SCATTER for a in _SCATTER))
def dist_scatter_pairs(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "key")
    o = o.withColumn("o_orderkey", o["key"])
    return V.scatter_pairs(o, _SCATTER, color="o_orderstatus", keep=["key"])
