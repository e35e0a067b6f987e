"""Named / path table scan (a dataset chosen by name), NaN made NULL at the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.columns import clean_missing


def load_table(spark: SparkSession, name: str, fmt: str | None = None) -> DataFrame:
    """Catalog table by name, or a parquet / orc / json / csv path by suffix."""
    if "/" not in name and fmt is None:
        df = spark.table(name)
    else:
        fmt = fmt or name.rstrip("/").rsplit(".", 1)[-1]
        if fmt == "csv":
            from tessera.sources.csv import read_csv
            df = read_csv(spark, name)
        elif fmt in ("json", "orc", "parquet"):
            df = spark.read.format(fmt).load(name)
        else:
            df = spark.read.parquet(name)
    return clean_missing(df)
