"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strings read as missing by the CSV source (the default
# missing-value tokens of the pandas CSV reader).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
CATEGORICAL_TYPES = (T.StringType, T.BooleanType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, CATEGORICAL_TYPES)]


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def nan_to_null(c: Column) -> Column:
    """NaN becomes NULL so that avg / corr / count_distinct skip it."""
    return F.nanvl(c, F.lit(None).cast("double"))


def clean_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column (one projection, no shuffle)."""
    return df.select(*[
        nan_to_null(F.col(f.name)).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return (c.isNull() | F.isnan(c)) if is_float(df, name) else c.isNull()


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (the zero-division rule of the metrics)."""
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0)).cast("double")


def stack_rows(df: DataFrame, rows: Sequence[dict[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Turn the columns of each input row into several output rows.

    ``rows`` lists, per output row, the output fields as expressions over
    ``df``; it is evaluated with ``inline(array(struct(...)))`` - a generator
    inside the same stage, no shuffle.
    """
    structs = [F.struct(*[e.alias(k) for k, e in r.items()]) for r in rows]
    return df.select(*keep, F.inline(F.array(*structs)))
