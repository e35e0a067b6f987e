"""Exact deduplication: one 128-bit content hash per text, byte comparison inside the hash groups.

Built from SQL functions only.  A group of copies, however large, is pre-aggregated on the map side
before its hash is shuffled; a document finds its group again through ``join_groups``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, ascii_lower, col, join_groups, keep_ids, scratch, table


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are the same after lower-casing A-Z; a null text counts as empty.
    Of equal texts the row with the largest (``keep="min"``: smallest) id stays.  Rows are grouped by the
    MD5 of the normalised text and, inside a group, by the text itself, so two texts that
    collide in the hash stay apart.  A row that is repeated with its id counts each time and its
    repetitions share the verdict; a null id never wins over another id.  An empty table gives no rows.
    Other columns are not read.
    """
    norm = docs.select(col(id_col).alias("doc_id"), ascii_lower(F.coalesce(col(text_col), F.lit(""))).alias("norm"))
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    classes = (
        norm.groupBy(F.unhex(F.md5(F.col("norm").cast("binary"))).alias("h"), "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("keep_id"))
        .select("h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "group_size", "keep_id")
    )
    classes = scratch(classes, "exact-classes")
    total = classes.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    rows = norm.select("doc_id", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("h"),
                       F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"))
    rows = scratch(rows, "exact-rows")
    # Two texts of one MD5 that were told apart by their bytes are told apart by SHA-256 here.
    out = join_groups(rows, classes, ["h", "sha"], "group_size", total)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return keep_ids(docs, id_col, exact_groups(docs, id_col, text_col, keep).where("kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
