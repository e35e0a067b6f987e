"""Table profiling: column roles, summaries, missing values, IQR outliers, counts.

All functions are lazy unless stated: they return DataFrames built from one
aggregate (partial + final aggregation, one shuffle of per-partition buffers)
followed by small projections over the one-row or per-column result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import (
    CATEGORICAL_TYPES, NUMERIC_TYPES, is_float, is_missing, nan_to_null, stack_rows,
)

# A numeric column with fewer distinct values than this is
# treated as categorical; the same rule decides classification vs regression.
CATEGORICAL_THRESHOLD = 10
# The IQR fence factor for outliers and box-plot whiskers.
IQR_FACTOR = 1.5


def _num(df: DataFrame, name: str) -> Column:
    c = F.col(name).cast("double")
    return nan_to_null(c) if is_float(df, name) else c


def _role_of(dtype: T.DataType) -> str:
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, CATEGORICAL_TYPES):
        return "categorical"
    return "none"


# --------------------------------------------------------------------------- roles

def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, position, n_distinct): exact distinct non-missing values."""
    cols = list(cols or df.columns)
    pos = {c: i for i, c in enumerate(df.columns)}
    exprs = [F.count_distinct(_num(df, c) if is_float(df, c) else F.col(c)).alias(f"_d{i}")
             for i, c in enumerate(cols)]
    one = df.agg(*exprs)
    return stack_rows(one, [{"column_name": F.lit(c), "position": F.lit(pos[c]),
                             "n_distinct": F.col(f"_d{i}")} for i, c in enumerate(cols)])


def roles_frame(df: DataFrame, threshold: int = CATEGORICAL_THRESHOLD) -> DataFrame:
    """Column roles: numeric by type unless it has < threshold distinct values,
    in which case it moves to the end of the categorical list.

    Columns: column_name, position, base_role, n_distinct, role, role_position.
    """
    fields = df.schema.fields
    numeric = [f.name for f in fields if _role_of(f.dataType) == "numeric"]
    base = F.create_map(*[x for f in fields for x in (F.lit(f.name), F.lit(_role_of(f.dataType)))])
    counts = distinct_counts(df, numeric) if numeric else None
    names = df.sparkSession.createDataFrame(
        [(f.name, i) for i, f in enumerate(fields)], "column_name string, position int")
    out = names.withColumn("base_role", base[F.col("column_name")])
    if counts is not None:
        out = out.join(F.broadcast(counts.drop("position")), "column_name", "left")  # one row per column
    else:
        out = out.withColumn("n_distinct", F.lit(None).cast("bigint"))
    moved = (F.col("base_role") == "numeric") & (F.col("n_distinct") < threshold)
    out = out.withColumn("role", F.when(moved, F.lit("categorical")).otherwise(F.col("base_role")))
    w = Window.partitionBy("role").orderBy(moved.cast("int"), F.col("position"))  # schema-sized
    return out.withColumn("role_position", (F.row_number().over(w) - 1).cast("int"))


@dataclass(frozen=True)
class ColumnRoles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)

    def without(self, target: str | None) -> "ColumnRoles":
        return ColumnRoles([c for c in self.numeric if c != target],
                           [c for c in self.categorical if c != target])

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical


# Above this sketch estimate a column is taken to have >= threshold distinct values
# (a distinct-count sketch does not overestimate a handful of values a hundredfold).
SKETCH_SURE = 1000


def infer_roles(df: DataFrame, threshold: int = CATEGORICAL_THRESHOLD) -> ColumnRoles:
    """Driver-side role lists.  Only "fewer than threshold distinct values?" matters,
    so one sketch pass (approx_count_distinct, no Expand) settles high-cardinality
    columns and an exact size(collect_set) - bounded by SKETCH_SURE values - is
    taken only for the columns whose estimate is small."""
    fields = [f for f in df.schema.fields if _role_of(f.dataType) != "none"]
    numeric = [f.name for f in fields if _role_of(f.dataType) == "numeric"]
    moved: set[str] = set()
    if numeric:
        est = df.agg(*[F.approx_count_distinct(_num(df, c)).alias(f"_a{i}") for i, c in enumerate(numeric)]).first()
        small = [c for i, c in enumerate(numeric) if est[f"_a{i}"] < SKETCH_SURE]
        if small:
            exact = df.agg(*[F.size(F.collect_set(_num(df, c))).alias(f"_e{i}") for i, c in enumerate(small)]).first()
            moved = {c for i, c in enumerate(small) if exact[f"_e{i}"] < threshold}
    return ColumnRoles([c for c in numeric if c not in moved],
                       [f.name for f in fields if _role_of(f.dataType) == "categorical"]
                       + [c for c in numeric if c in moved])


def task_types(df: DataFrame, targets: Sequence[str], threshold: int = CATEGORICAL_THRESHOLD) -> DataFrame:
    """(target, n_distinct, task): classification for text / boolean targets or
    numeric ones with fewer than ``threshold`` distinct values."""
    counts = distinct_counts(df, targets)
    kinds = F.create_map(*[x for t in targets for x in (F.lit(t), F.lit(_role_of(df.schema[t].dataType)))])
    kind = kinds[F.col("column_name")]
    task = F.when((kind != "numeric") | (F.col("n_distinct") < threshold), "classification").otherwise("regression")
    return counts.select(F.col("column_name").alias("target"), "n_distinct", task.alias("task"))


# --------------------------------------------------------------------------- overview

_FIXED_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
                T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8,
                T.TimestampNTZType: 8, T.DecimalType: 16}


def overview(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """One row: n_rows, n_columns, n_numeric, n_categorical, payload_bytes.

    payload_bytes re-aims the in-memory size: fixed width x non-null count for
    primitive columns plus the UTF-8 byte length of text values.
    """
    parts = []
    for f in df.schema.fields:
        width = _FIXED_WIDTH.get(type(f.dataType))
        if width is not None:
            parts.append(F.count(f.name) * F.lit(width))
        elif isinstance(f.dataType, T.StringType):
            parts.append(F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)))
    payload = sum(parts[1:], parts[0]) if parts else F.lit(0)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(len(roles.numeric)).cast("bigint").alias("n_numeric"),
        F.lit(len(roles.categorical)).cast("bigint").alias("n_categorical"),
        payload.cast("bigint").alias("payload_bytes"),
    )


# --------------------------------------------------------------------------- summaries

def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (linear interpolation), max.

    Moments and extremes are one aggregate over all columns (no Expand); the
    exact quartiles come from ``quantiles.quantile_arrays`` (values counted and
    ranked over all tasks); then one row per column.
    """
    from tessera.operators.quantiles import quantile_arrays
    aggs, schema = [], []
    for i, c in enumerate(cols):
        x = _num(df, c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        schema += [f"n{i} bigint", f"m{i} double", f"s{i} double", f"lo{i} double", f"hi{i} double"]
    row = df.agg(*aggs).first()
    moments = df.sparkSession.createDataFrame(
        [tuple(row[f"{k}{i}"] for i in range(len(cols)) for k in ("n", "m", "s", "lo", "hi"))], ", ".join(schema))
    qs = quantile_arrays(df, cols, [0.25, 0.5, 0.75])
    one = moments.crossJoin(qs.select(*[F.col(f"_q{i}").alias(f"q{i}") for i in range(len(cols))]))  # 1 x 1
    return stack_rows(one, [{
        "column_name": F.lit(c), "count": F.col(f"n{i}"), "mean": F.col(f"m{i}"), "std": F.col(f"s{i}"),
        "min": F.col(f"lo{i}"), "p25": F.col(f"q{i}")[0], "p50": F.col(f"q{i}")[1],
        "p75": F.col(f"q{i}")[2], "max": F.col(f"hi{i}")} for i, c in enumerate(cols)])


def _long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value string) for categorical columns, NULL kept."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 F.when(~is_missing(df, c), F.col(c).cast("string")).alias("value"))
        for c in cols])))


def categorical_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: unique_count, most_common (ties -> smallest text), its count, missing.

    Values are counted by (column, value) with map-side combine; the most
    common value is a min over struct(-count, value) - no window, no
    per-column task holding every distinct value.
    """
    counts = _long_values(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    best = F.min(F.when(present, F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))))
    return counts.groupBy("column_name").agg(
        F.count_if(present).alias("unique_count"),
        best.v.alias("most_common"),
        (-best.neg).alias("most_common_count"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
    )


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, count), missing values dropped."""
    return (_long_values(df, cols).where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))


def counts_by_target(df: DataFrame, feature: str, target: str) -> DataFrame:
    return df.groupBy(feature, target).agg(F.count(F.lit(1)).alias("count"))


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _long_values(df, cols).where(F.col("value").isNotNull()).distinct()


# --------------------------------------------------------------------------- missing values

def missing_counts(df: DataFrame, cols: Sequence[str], only_positive: bool = True) -> DataFrame:
    """(column_name, missing); NaN counts as missing."""
    one = df.agg(*[F.count_if(is_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    out = stack_rows(one, [{"column_name": F.lit(c), "missing": F.col(f"_m{i}")} for i, c in enumerate(cols)])
    return out.where("missing > 0") if only_positive else out


def missing_hint(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Per role with missing values: max_missing, n_rows, suggested_strategy
    (numeric: knn when the worst column misses < 20 % of rows, else median;
    categorical: most_frequent)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    rows = []
    for role, cols in (("numeric", numeric), ("categorical", categorical)):
        if not cols:
            continue
        mx = F.greatest(*[F.count_if(is_missing(df, c)) for c in cols]) if len(cols) > 1 \
            else F.count_if(is_missing(df, cols[0]))
        aggs.append(mx.alias(f"_mx_{role}"))
        rows.append(role)
    one = df.agg(*aggs)
    out = stack_rows(one, [{"role": F.lit(r), "max_missing": F.col(f"_mx_{r}"), "n_rows": F.col("n_rows")}
                           for r in rows])
    hint = (F.when(F.col("role") == "categorical", "most_frequent")
            .when(F.col("max_missing") / F.col("n_rows") < 0.2, "knn").otherwise("median"))
    return out.where("max_missing > 0").withColumn("suggested_strategy", hint)


# --------------------------------------------------------------------------- IQR outliers

def iqr_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with q1_<i>, q3_<i>, lower_<i>, upper_<i> per column index."""
    from tessera.operators.quantiles import quantile_arrays
    one = quantile_arrays(df, cols, [0.25, 0.75])
    sel = []
    for i, _ in enumerate(cols):
        q1, q3 = F.col(f"_q{i}")[0], F.col(f"_q{i}")[1]
        sel += [q1.alias(f"q1_{i}"), q3.alias(f"q3_{i}"),
                (q1 - IQR_FACTOR * (q3 - q1)).alias(f"lower_{i}"), (q3 + IQR_FACTOR * (q3 - q1)).alias(f"upper_{i}")]
    return one.select(*sel)


def _outlier_pred(df: DataFrame, c: str, i: int) -> Column:
    x = _num(df, c)
    return (x < F.col(f"lower_{i}")) | (x > F.col(f"upper_{i}"))


def outlier_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, q1, q3, lower, upper, n_outliers, has_outliers); strict fences."""
    bounds = iqr_bounds(df, cols)
    joined = df.crossJoin(F.broadcast(bounds))  # one-row stats
    one = joined.agg(*[F.first(f"{k}_{i}").alias(f"{k}_{i}") for i in range(len(cols))
                       for k in ("q1", "q3", "lower", "upper")],
                     *[F.count_if(_outlier_pred(df, c, i)).alias(f"n_{i}") for i, c in enumerate(cols)])
    out = stack_rows(one, [{"column_name": F.lit(c), "q1": F.col(f"q1_{i}"), "q3": F.col(f"q3_{i}"),
                            "lower": F.col(f"lower_{i}"), "upper": F.col(f"upper_{i}"),
                            "n_outliers": F.col(f"n_{i}")} for i, c in enumerate(cols)])
    return out.withColumn("has_outliers", F.col("n_outliers") > 0)


def outlier_rows(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows outside the fences of any column, with n_outlier_features."""
    bounds = iqr_bounds(df, cols)
    joined = df.crossJoin(F.broadcast(bounds))
    n = sum((F.coalesce(_outlier_pred(df, c, i), F.lit(False)).cast("int") for i, c in enumerate(cols)), F.lit(0))
    return joined.select(*keep, n.alias("n_outlier_features")).where("n_outlier_features > 0")


def outlier_hint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: has_outliers, outlier_features (comma list in column order),
    suggested scaler / imputer (robust / median when any outlier)."""
    flags = outlier_flags(df, cols)
    pos = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    one = flags.agg(
        F.max(F.col("has_outliers").cast("int")).cast("boolean").alias("has_outliers"),
        F.array_sort(F.collect_list(F.when(F.col("has_outliers"),
                                           F.struct(pos[F.col("column_name")].alias("p"),
                                                    F.col("column_name").alias("c"))))).alias("_f"))
    return one.select(
        "has_outliers",
        F.array_join(F.transform("_f", lambda s: s["c"]), ",").alias("outlier_features"),
        F.when(F.col("has_outliers"), "robust").otherwise("standard").alias("suggested_scaler"),
        F.when(F.col("has_outliers"), "median").otherwise("mean").alias("suggested_imputer"))


def analyze(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """The full characteristics analysis in long form (feature, role, metric, value):
    missing counts for every feature, quartiles / fences / outlier counts for numerics."""
    parts = []
    if numeric:
        flags = outlier_flags(df, numeric)
        parts.append(flags.select("column_name", F.lit("numeric").alias("role"), F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in ("q1", "q3", "lower", "upper", "n_outliers")]))))
    feats = [*numeric, *categorical]
    if feats:
        role = F.create_map(*[x for c in feats for x in (F.lit(c), F.lit("numeric" if c in numeric else "categorical"))])
        miss = missing_counts(df, feats, only_positive=False)
        parts.append(miss.select("column_name", role[F.col("column_name")].alias("role"),
                                 F.lit("missing").alias("metric"), F.col("missing").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("column_name", "feature")


# --------------------------------------------------------------------------- projections

def preview(df: DataFrame, cols: Sequence[str] | None, n: int = 10, key: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows of the selected columns (all when none) in key order;
    a top-n (TakeOrderedAndProject), not a full sort."""
    sel = list(cols) if cols else df.columns
    ordered = df.orderBy(*key) if key else df
    return ordered.select(*sel).limit(n)


def feature_projection(df: DataFrame, roles: ColumnRoles, target: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """keep + numeric + categorical features, the target removed from the features."""
    feats = roles.without(target).features
    return df.select(*keep, *[c for c in feats if c not in keep])


def unpivot_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable",
                 value: str = "value") -> DataFrame:
    """Wide -> long (one row per id and value column), values cast to double."""
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return casted.unpivot(list(ids), list(values), variable, value)
