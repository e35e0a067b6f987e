"""Line deduplication over windows of three lines, in SQL functions only.

A window is three consecutive lines with at least one word.  Windows that occur again anywhere in the
corpus keep their first occurrence, in the order of (doc_id, line); the lines of later occurrences are removed,
overlapping windows merged into one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import WORD_CHAR, col, join_groups, scratch, table, whole_row

SPAN = 3
_PLACE = "decimal(38,0)"


def line_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, pos, h, place): one row per window; ``h`` is its 128-bit hash, ``place`` orders (doc_id, pos)."""
    lines = docs.select(col(id_col).cast("long").alias("doc_id"), F.split(F.coalesce(col(text_col), F.lit("")), "\n").alias("lines"))
    spans = F.filter(
        F.transform(F.sequence(F.lit(1), F.size("lines") - (SPAN - 1)),
                    lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("lines", i, SPAN), "\n").alias("t"))),
        lambda s: s["t"].rlike(WORD_CHAR))
    spans = F.transform(spans, lambda s: F.struct(s["pos"].alias("pos"), F.unhex(F.md5(s["t"].cast("binary"))).alias("h")))
    df = lines.where(F.col("doc_id").isNotNull() & (F.size("lines") >= SPAN)).select("doc_id", F.explode(spans).alias("w"))
    place = F.col("doc_id").cast(_PLACE) * F.lit(1 << 31).cast("decimal(12,0)") + F.col("w.pos")
    return df.select("doc_id", F.col("w.pos").alias("pos"), F.col("w.h").alias("h"), place.cast(_PLACE).alias("place"))


def removed_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs array<struct<first, last>>): 1-based runs of lines to remove, in order, for documents that have any."""
    windows = line_windows(docs, id_col, text_col)
    groups = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place")).where("n > 1")
    groups = scratch(groups, "line-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = join_groups(windows, groups, ["h"], "n", total).where("place > first_place").select("doc_id", "pos").distinct()
    w = W.partitionBy("doc_id").orderBy("pos")
    starts = (F.col("pos") > F.coalesce(F.lag("pos").over(w), F.lit(-SPAN)) + SPAN).cast("int")
    runs = later.withColumn("new", starts).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("doc_id", "run").agg(F.min("pos").alias("first"), (F.max("pos") + SPAN - 1).alias("last"))
    return runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text rid of repeated windows, and n_lines, n_removed_lines, n_runs (long).

    Texts without a repeated window are unchanged.  A null text has one empty line and stays null; a text of fewer
    than three lines has no window.  Lines are equal byte for byte.  A row repeated with its id is the same
    occurrence, so it takes nothing away from itself; rows with a null id are left alone.  The order
    of equal windows is that of (doc_id, line).  Other columns, whatever their names, are kept as they are, but for the three that it adds.
    """
    runs = removed_runs(docs, id_col, text_col).withColumnRenamed("doc_id", "run_doc")
    df = docs.select(whole_row(docs).alias("row"), col(id_col).cast("long").alias("id"), col(text_col).alias("text"),
                     F.split(F.coalesce(col(text_col), F.lit("")), "\n").alias("lines"))
    df = df.join(runs, F.col("id") == F.col("run_doc"), "left")
    end = F.struct((F.size("lines") + 1).alias("first"), F.lit(0).alias("last"))
    from_ = lambda k: F.when(k == 0, 1).otherwise(F.get("runs", F.greatest(k - 1, F.lit(0)))["last"] + 1)
    kept = F.flatten(F.transform(F.concat("runs", F.array(end)), lambda r, k: F.slice("lines", from_(k), r["first"] - from_(k))))
    gone = F.aggregate("runs", F.lit(0), lambda s, r: s + r["last"] - r["first"] + 1)
    told = {"n_lines": F.size("lines"), "n_removed_lines": F.coalesce(gone, F.lit(0)), "n_runs": F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs"))}
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return df.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c not in told],
                     *[v.cast("long").alias(c) for c, v in told.items()])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed_lines", "n_runs",
                                   F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, len(ls) AS n_lines, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
w AS (SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS t, n_lines
      FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS k FROM w
      WHERE pos + 2 <= n_lines AND regexp_matches(t, '[^\\x20\\x09-\\x0D]')),
g AS (SELECT DISTINCT doc_id, pos + i AS pos FROM r, (SELECT unnest([0, 1, 2]) AS i) WHERE k > 1),
f AS (SELECT e.*, g.pos IS NOT NULL AS gone FROM e LEFT JOIN g USING (doc_id, pos)),
b AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM f)
SELECT doc_id, max(n_lines)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_removed_lines, sum(starts::INT)::BIGINT AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM b GROUP BY doc_id
"""
