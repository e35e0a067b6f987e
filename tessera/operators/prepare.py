"""Feature preparation: imputation, scaling, one-hot and label encoding.

``fit_prep`` runs the fitting aggregates (a handful of one-row jobs plus one
distinct-values job per categorical column, each bounded by the category
limit) and keeps the fitted state as plain Python values.  ``transform`` is
then a single stateless projection: it stays inside whole-stage codegen, needs
no join, and applies unchanged to a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import NUMERIC_TYPES, is_float, nan_to_null
from tessera.operators.profile import CATEGORICAL_THRESHOLD, IQR_FACTOR

# Fill values of the constant imputer when none is given.
DEFAULT_NUMERIC_FILL = 0.0
DEFAULT_TEXT_FILL = "missing_value"


@dataclass(frozen=True)
class PrepConfig:
    numeric_imputer: str = "mean"            # mean | median | most_frequent | constant | knn
    categorical_imputer: str = "most_frequent"  # most_frequent | constant
    numeric_scaler: str = "standard"         # standard | robust | none
    handle_outliers: bool = False            # clip numerics to the IQR fences before scaling
    numeric_fill: float = DEFAULT_NUMERIC_FILL
    categorical_fill: str = DEFAULT_TEXT_FILL
    knn_neighbors: int = 5
    max_categories: int | None = None        # raise beyond so many categories; None: no limit

    def update(self, **kw) -> "PrepConfig":
        return replace(self, **kw)


def _num(df: DataFrame, c: str) -> Column:
    x = F.col(c).cast("double")
    return nan_to_null(x) if is_float(df, c) else x


def _cat(df: DataFrame, c: str) -> Column:
    x = F.col(c)
    return nan_to_null(x) if is_float(df, c) else x


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mode_values(df: DataFrame, exprs: dict[str, Column]) -> dict[str, object]:
    """Most frequent non-missing value per expression; ties -> smallest value.

    Two-stage and fully distributed: count per (expression, value) with
    map-side combine, then min(struct(-count, value)) per expression - no
    buffer ever holds all distinct values of a column.  Expressions of the
    same type share one pass."""
    if not exprs:
        return {}
    names = list(exprs)
    typed = df.select(*[e.alias(f"_e{i}") for i, e in enumerate(exprs.values())])
    by_type: dict[str, list[int]] = {}
    for i, f in enumerate(typed.schema.fields):
        by_type.setdefault(f.dataType.simpleString(), []).append(i)
    out = {}
    for idx in by_type.values():
        long = typed.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_e{i}").alias("v"))
                                               for i in idx]))).where(F.col("v").isNotNull())
        counts = long.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("v").alias("v"))).alias("b"))
        got = {r.i: r.b.v for r in best.collect()}  # one row per column
        out.update({names[i]: got.get(i) for i in idx})
    return out


def impute_values(df: DataFrame, cols: Sequence[str], strategy: str,
                  fill: object = None) -> dict[str, object]:
    """Fitted fill value per column for mean / median / most_frequent / constant."""
    if not cols:
        return {}
    if strategy == "constant":
        return {c: fill for c in cols}
    if strategy == "most_frequent":
        return mode_values(df, {c: _cat(df, c) for c in cols})
    if strategy == "median":
        from tessera.operators.quantiles import quantile_arrays
        row = quantile_arrays(df.select(*[_num(df, c).alias(c) for c in cols]), cols, [0.5]).first()
        return {c: (row[f"_q{i}"][0] if row[f"_q{i}"] else None) for i, c in enumerate(cols)}
    row = df.agg(*[F.avg(_num(df, c)).alias(f"_v{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"_v{i}"] for i, c in enumerate(cols)}


def impute(df: DataFrame, fills: dict[str, object], keep: Sequence[str] = ()) -> DataFrame:
    """Projection replacing missing values by the fitted fills (NULL stays NULL
    for a column whose fill is NULL, i.e. an all-missing column)."""
    return df.select(*keep, *[F.coalesce(_cat(df, c), F.lit(v)).alias(c) if v is not None else _cat(df, c).alias(c)
                              for c, v in fills.items()])


def scaler_stats(df: DataFrame, cols: Sequence[str], kind: str) -> dict[str, tuple[float, float]]:
    """(center, scale) per column; a zero / undefined scale becomes 1."""
    if not cols or kind == "none":
        return {c: (0.0, 1.0) for c in cols}
    if kind == "standard":
        aggs = [F.struct(F.avg(_num(df, c)), F.stddev_pop(_num(df, c))).alias(f"_s{i}") for i, c in enumerate(cols)]
        row = df.agg(*aggs).first()
    elif kind == "robust":
        from tessera.operators.quantiles import quantile_arrays
        q = quantile_arrays(df.select(*[_num(df, c).alias(c) for c in cols]), cols, [0.25, 0.5, 0.75]).first()
        row = {f"_s{i}": q[f"_q{i}"] for i in range(len(cols))}
    else:
        raise ValueError(f"unknown scaler {kind!r}")
    out = {}
    for i, c in enumerate(cols):
        v = row[f"_s{i}"]
        if kind == "standard":
            center, scale = (v[0] or 0.0), v[1]
        else:
            center, scale = (v[1] if v else 0.0), ((v[2] - v[0]) if v else None)
        out[c] = (center, scale if scale not in (None, 0.0) and scale == scale else 1.0)
    return out


def _indicators(x: Column, values: list) -> Column:
    """Array with 1.0 at the place of the value that ``x`` has, else 0.0."""
    return F.transform(F.array(*[F.lit(v) for v in values]), lambda v: F.coalesce((x == v).cast("double"), F.lit(0.0)))


def _sorted_categories(values: list) -> list:
    return sorted(values)


@dataclass
class FittedPrep:
    numeric: list[str]
    categorical: list[str]
    config: PrepConfig
    numeric_fill: dict[str, object] = field(default_factory=dict)
    categorical_fill: dict[str, object] = field(default_factory=dict)
    clip: dict[str, tuple[float, float]] = field(default_factory=dict)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    categories: dict[str, list] = field(default_factory=dict)
    knn: object = None

    @property
    def feature_names(self) -> list[str]:
        return list(self.numeric) + [f"{c}_{v}" for c in self.categorical for v in self.categories[c]]

    def numeric_exprs(self, df: DataFrame) -> list[Column]:
        out = []
        for c in self.numeric:
            x = _num(df, c)
            fill = self.numeric_fill.get(c)
            if fill is not None:
                x = F.coalesce(x, F.lit(float(fill)))
            if c in self.clip:
                lo, hi = self.clip[c]
                x = F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
            center, scale = self.scale[c]
            out.append(((x - F.lit(center)) / F.lit(scale)).alias(c))
        return out

    def category(self, df: DataFrame, c: str) -> Column:
        """The column's categories; as text if a text constant fills its gaps."""
        x = _cat(df, c)
        constant = self.config.categorical_imputer == "constant" and isinstance(self.config.categorical_fill, str)
        return x.cast("string") if constant else x

    def onehot_blocks(self, df: DataFrame) -> list[Column]:
        """One array of 0.0 / 1.0 per categorical column, one expression however many categories."""
        out = []
        for c in self.categorical:
            x, fill = self.category(df, c), self.categorical_fill.get(c)
            x = F.coalesce(x, F.lit(fill)) if fill is not None else x
            if self.categories[c]:
                out.append(_indicators(x, self.categories[c]))
        return out

    def onehot_exprs(self, df: DataFrame) -> list[Column]:
        out = []
        for c in self.categorical:
            x = self.category(df, c)
            fill = self.categorical_fill.get(c)
            if fill is not None:
                x = F.coalesce(x, F.lit(fill))
            for v in self.categories[c]:
                out.append(F.coalesce((x == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}"))
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """keep columns + one double column per feature name (unseen category -> all zeros)."""
        if self.knn is not None:
            df = self.knn.transform(df)
        return df.select(*keep, *self.numeric_exprs(df), *self.onehot_exprs(df))

    def assemble(self, df: DataFrame, keep: Sequence[str] = (), output: str = "features") -> DataFrame:
        """keep columns + one vector column (numeric block then one-hot block)."""
        from pyspark.ml.functions import array_to_vector
        if self.knn is not None:
            df = self.knn.transform(df)
        numeric = F.array(*self.numeric_exprs(df)) if self.numeric else F.expr("cast(array() as array<double>)")
        return df.select(*keep, array_to_vector(F.concat(numeric, *self.onehot_blocks(df))).alias(output))


def _fill_agg(x: Column, strategy: str) -> Column | None:
    """Single-pass aggregate giving the fill value; None when the fill comes from
    its own distributed pass (median, most_frequent) or is a constant."""
    if strategy == "mean":
        return F.avg(x)
    if strategy in ("median", "most_frequent", "constant"):
        return None
    raise ValueError(f"unknown imputer {strategy!r}")


def fit_prep(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
             config: PrepConfig | None = None) -> FittedPrep:
    """Fit imputers, scalers and category lists in two passes over ``df``.

    Pass 1 (one aggregate): fill values.  Pass 2 (one aggregate): scaler statistics
    over the imputed (and optionally clipped) values and the category sets, which
    are the feature space and have to fit the driver like every model over it;
    ``max_categories`` turns a column with more into an error.  With
    ``handle_outliers`` one more pass finds the clip fences first.
    """
    cfg = config or PrepConfig()
    numeric, categorical = list(numeric), list(categorical)
    fp = FittedPrep(numeric, categorical, cfg)
    if numeric and cfg.numeric_imputer == "knn":
        raise ValueError("KNN imputation joins rows by key: run operators.knn.knn_impute(df, key, cols) "
                         "first (train_model does this for numeric_imputer='knn')")
    aggs = []
    for i, c in enumerate(numeric):
        a = _fill_agg(_num(df, c), cfg.numeric_imputer)
        if a is not None:
            aggs.append(a.alias(f"_nf{i}"))
    for i, c in enumerate(categorical):
        a = _fill_agg(_cat(df, c), cfg.categorical_imputer)
        if a is not None:
            aggs.append(a.alias(f"_cf{i}"))
    one = df.agg(*aggs).first() if aggs else None

    def fills(cols, strategy, constant, prefix):
        if strategy == "constant":
            return {c: constant for c in cols}
        if strategy in ("median", "most_frequent"):
            return impute_values(df, cols, strategy)
        return {c: one[f"{prefix}{i}"] for i, c in enumerate(cols)}

    fp.numeric_fill = fills(numeric, cfg.numeric_imputer, cfg.numeric_fill, "_nf")
    fp.categorical_fill = fills(categorical, cfg.categorical_imputer, cfg.categorical_fill, "_cf")

    def filled(c: str) -> Column:
        x = _num(df, c)
        fill = fp.numeric_fill.get(c)
        x = F.coalesce(x, F.lit(float(fill))) if fill is not None else x
        if c in fp.clip:
            x = F.least(F.greatest(x, F.lit(fp.clip[c][0])), F.lit(fp.clip[c][1]))
        return x

    from tessera.operators.quantiles import quantile_arrays
    if numeric and cfg.handle_outliers:
        q = quantile_arrays(df.select(*[filled(c).alias(c) for c in numeric]), numeric, [0.25, 0.75]).first()
        for i, c in enumerate(numeric):
            q1, q3 = q[f"_q{i}"] or (None, None)
            if q1 is not None:
                fp.clip[c] = (q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1))
    aggs2 = []
    if cfg.numeric_scaler == "standard":
        aggs2 += [F.struct(F.avg(filled(c)), F.stddev_pop(filled(c))).alias(f"_s{i}") for i, c in enumerate(numeric)]
    elif cfg.numeric_scaler == "robust":
        rq = quantile_arrays(df.select(*[filled(c).alias(c) for c in numeric]), numeric, [0.25, 0.5, 0.75]).first()
    elif cfg.numeric_scaler != "none":
        raise ValueError(f"unknown scaler {cfg.numeric_scaler!r}")
    for i, c in enumerate(categorical):
        fill = fp.categorical_fill.get(c)
        x = fp.category(df, c)
        x = F.coalesce(x, F.lit(fill)) if fill is not None else x
        aggs2.append(F.collect_set(x).alias(f"_cs{i}"))
    two = df.agg(*aggs2).first() if aggs2 else None
    for i, c in enumerate(numeric):
        if cfg.numeric_scaler == "none":
            fp.scale[c] = (0.0, 1.0)
            continue
        v = two[f"_s{i}"] if cfg.numeric_scaler == "standard" else rq[f"_q{i}"]
        if cfg.numeric_scaler == "standard":
            center, scale = (v[0] or 0.0), v[1]
        else:
            center, scale = (v[1] if v else 0.0), ((v[2] - v[0]) if v else None)
        fp.scale[c] = (center, scale if scale not in (None, 0.0) and scale == scale else 1.0)
    for i, c in enumerate(categorical):
        vals = list(two[f"_cs{i}"])
        if cfg.max_categories is not None and len(vals) > cfg.max_categories:
            raise ValueError(f"{c}: more than {cfg.max_categories} categories")
        fp.categories[c] = _sorted_categories(vals)
    return fp


# --------------------------------------------------------------------------- target

@dataclass
class LabelEncoding:
    """Target handling: classification targets get codes 0..k-1 in sorted
    label order (numeric labels sort numerically); regression targets pass."""
    column: str
    task: str
    classes: list = field(default_factory=list)

    def code(self, df: DataFrame, strict: bool = True) -> Column:
        if self.task != "classification":
            return F.col(self.column).cast("double")
        x = F.col(_quoted(self.column))
        place = F.array_position(F.array(*[F.lit(v) for v in self.classes]), x)  # NULL for a NULL label
        unseen = F.raise_error(F.concat(F.lit("unseen label: "), x.cast("string"))).cast("double") if strict else F.lit(None).cast("double")
        return F.when(place == 0, unseen).otherwise((place - 1).cast("double"))

    def transform(self, df: DataFrame, keep: Sequence[str] = (), output: str = "label") -> DataFrame:
        return df.select(*keep, self.code(df).alias(output))

    def decode(self, code: Column) -> Column:
        m = F.create_map(*[x for i, v in enumerate(self.classes) for x in (F.lit(float(i)), F.lit(v))])
        return m[code]


def fit_label(df: DataFrame, target: str, threshold: int = CATEGORICAL_THRESHOLD,
              max_classes: int | None = None) -> LabelEncoding:
    """Classes of ``target`` (bounded by the model that has to tell them apart; ``max_classes`` makes more an error).  A numeric
    target with ``threshold`` or more values is a regression target, and only so many values are fetched to see that."""
    numeric = isinstance(df.schema[target].dataType, NUMERIC_TYPES)
    distinct = df.select(F.col(_quoted(target))).where(F.col(_quoted(target)).isNotNull()).distinct()
    if numeric or max_classes is not None:
        distinct = distinct.limit(max(threshold, 1) if numeric else max_classes + 1)
    vals = [r[0] for r in distinct.collect()]
    if numeric and len(vals) >= threshold:
        return LabelEncoding(target, "regression")
    if max_classes is not None and len(vals) > max_classes:
        raise ValueError(f"{target}: more than {max_classes} classes")
    return LabelEncoding(target, "classification", sorted(vals))


__all__ = ["PrepConfig", "FittedPrep", "fit_prep", "impute", "impute_values", "scaler_stats",
           "LabelEncoding", "fit_label", "mode_values"]
