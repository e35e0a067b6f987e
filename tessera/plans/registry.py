"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c: str | Column, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + 0.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (both engines round the same way); ``+ 0.0``
    turns a negative zero into zero."""
    return df.select(*[(F.round(F.col(f.name), digits) + 0.0).alias(f.name)
                       if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                       for f in df.schema.fields])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


# lineitem with NULLs placed by a rule both engines evaluate identically
def lineitem_gaps(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    ln = F.col("l_linenumber")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(ln != 3, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice",
        F.when(ln != 5, F.col("l_discount")).alias("l_discount"), "l_tax",
        F.when(ln != 6, F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus", "l_shipdate")


LINEITEM_GAPS_SQL = """
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice,
         CASE WHEN l_linenumber = 5 THEN NULL ELSE l_discount END AS l_discount, l_tax,
         CASE WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus, l_shipdate
  FROM lineitem"""


def positive_zero_rounds(sql: str) -> str:
    """Append ``+ 0.0`` to every ``round(...)`` call of an oracle query so that
    a value rounding to zero from below is 0.0, not -0.0, as on the Spark side."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "(" + sql[j:j + 6] + positive_zero_rounds(sql[j + 6:k]) + ") + 0.0)")
        i = k + 1
