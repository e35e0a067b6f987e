"""CSV source and prediction sink.

The reader takes every field as text, turns the missing-value tokens into
NULL, then decides each column's type in one aggregate: bigint when every
present value parses as an integer, boolean for True/False text, double when
every value parses as a number, text otherwise (an all-missing column is
double, like an all-NaN column).  An explicit schema skips the inference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import NA_TOKENS, clean_missing

# Boolean spellings read as booleans.
TRUE_TOKENS = ("True", "true", "TRUE")
FALSE_TOKENS = ("False", "false", "FALSE")
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?)\s*$"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _strict(v: Column, kind: T.DataType) -> Column:
    """The number a field spells out in full; NULL for 12d, 7f and other spellings that only a cast takes."""
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.when(v.rlike(NUMBER), v.try_cast(kind))
    if isinstance(kind, T.IntegralType):
        return F.when(v.rlike(INTEGER), v.try_cast(kind))
    return v.try_cast(kind)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Quotes are doubled inside quoted fields; ``multi_line`` allows line feeds there (such a file is then one task).
    With ``schema`` the same tokens are missing and a field that doesn't parse as its type is NULL."""
    raw = (spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
           .option("multiLine", multi_line).csv(path))
    cols = raw.columns
    if schema is not None:
        by_name = {f.name: f.dataType for f in schema.fields}
        missing = [n for n in by_name if n not in cols]
        if missing:
            raise ValueError(f"the file has no column {missing[0]!r}")
        text = {c: F.when(F.col(_q(c)).isin(list(NA_TOKENS)), F.lit(None)).otherwise(F.col(_q(c))) for c in by_name}
        return clean_missing(raw.select(*[
            (text[c] if isinstance(t, T.StringType) else
             F.when(text[c].isin(*TRUE_TOKENS), True).when(text[c].isin(*FALSE_TOKENS), False) if isinstance(t, T.BooleanType) else
             _strict(text[c], t)).alias(c) for c, t in by_name.items()]))
    nulled = raw.select(*[F.when(F.col(_q(c)).isin(list(NA_TOKENS)), F.lit(None)).otherwise(F.col(_q(c))).alias(c)
                          for c in cols])
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(_q(c))
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count_if(v.isNotNull() & _strict(v, T.LongType()).isNull()).alias(f"l{i}"),
                 F.count_if(v.isNotNull() & _strict(v, T.DoubleType()).isNull()).alias(f"d{i}"),
                 F.count_if(v.isNotNull() & ~v.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"b{i}")]
    st = nulled.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        v = F.col(_q(c))
        if st[f"n{i}"] == 0:
            out.append(v.cast("double").alias(c))
        elif st[f"l{i}"] == 0:
            out.append(v.try_cast("bigint").alias(c))
        elif st[f"b{i}"] == 0:
            out.append(v.isin(*TRUE_TOKENS).alias(c))
        elif st[f"d{i}"] == 0:
            out.append(F.nanvl(_strict(v, T.DoubleType()), F.lit(None).cast("double")).alias(c))
        else:
            out.append(v.alias(c))
    return nulled.select(*out)


def write_predictions_csv(df: DataFrame, path: str, actual: str = "label", predicted: str = "prediction") -> None:
    """Actual,Predicted for every row, with a header and no index."""
    (df.select(F.col(actual).alias("Actual"), F.col(predicted).alias("Predicted"))
     .write.mode("overwrite").option("header", True).csv(path))
