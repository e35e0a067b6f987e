"""Helpers shared by the corpus operators: word rules, scratch tables, skew-safe joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import read_table, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word separators: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CHAR = r"[^\x20\x09-\x0D]"

#: A key that holds at least 1/HEAVY of all rows is heavy, so there are at most HEAVY such keys.
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def col_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(col_name(name))


def whole_row(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns of ``df`` except ``but`` as one struct, so that no other name can clash with theirs."""
    return F.struct(*[col(c) for c in df.columns if c not in but])


def keep_ids(docs: DataFrame, id_col: str, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``kept`` (doc_id); a null id equals a null id."""
    ids = kept.select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(ids, docs[col_name(id_col)].eqNullSafe(ids["__keep"]), "left_semi")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    """Words of a text: maximal runs of characters other than SPACES; [] for a null or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def remainder_of_id(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, no lineage,
    readable after the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-llm/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``scratch`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tessera-llm/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join every row with the one row of its group, whatever share of the rows a key holds.

    ``groups`` has one row per key and the number of rows of that key in column ``size``; ``total`` is the
    number of rows.  Keys with at least total/HEAVY rows number HEAVY at most, so they are broadcast
    and their rows never move; all other rows are shuffled, and no key among them has more than a
    1/HEAVY share.  ``how`` is inner or left_semi."""
    heavy = groups.where((F.col(size) * HEAVY >= F.lit(total)) & (F.col(size) > HEAVY))
    light = groups.where(~((F.col(size) * HEAVY >= F.lit(total)) & (F.col(size) > HEAVY)))
    hot = rows.join(F.broadcast(heavy), keys, how)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return hot.unionByName(rest)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with Arrow batches of at most ``rows`` rows from here on in its session: rows are whole texts here, and a batch
    is held by the JVM and the Python worker at once.  A smaller setting stays."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def release(spark: SparkSession) -> None:
    """Let the driver drop frames it no longer uses, so that their shuffle files go from the executors' disks."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.System.gc()
