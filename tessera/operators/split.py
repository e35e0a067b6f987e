"""Deterministic train/test split and k-fold assignment by key hash.

The hash of (key, seed) decides the side / fold, so the assignment is the
same on every run, under any partitioning, and after recomputation of a lost
partition (unlike ``randomSplit``).  The same expression is plain SQL in other
engines: ``('0x' || substr(md5(concat_ws('|', key, seed)), 1, 8))::BIGINT``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranking import prefix_sums

# Reference defaults for the split and cross-validation.
DEFAULT_TEST_SIZE = 0.2
DEFAULT_SEED = 42
DEFAULT_FOLDS = 5
HASH_SPACE = 2 ** 32


def key_hash(keys: Sequence[str], seed: int = DEFAULT_SEED) -> Column:
    """Unsigned 32-bit hash of the key columns and the seed."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def test_threshold(test_size: float) -> int:
    return int(test_size * HASH_SPACE)


def with_split(df: DataFrame, keys: Sequence[str], test_size: float = DEFAULT_TEST_SIZE,
               seed: int = DEFAULT_SEED, output: str = "is_test") -> DataFrame:
    return df.withColumn(output, key_hash(keys, seed) < F.lit(test_threshold(test_size)))


def train_test_split(df: DataFrame, keys: Sequence[str], test_size: float = DEFAULT_TEST_SIZE,
                     seed: int = DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    h = key_hash(keys, seed) < F.lit(test_threshold(test_size))
    return df.where(~h), df.where(h)


def with_folds(df: DataFrame, keys: Sequence[str], k: int = DEFAULT_FOLDS, seed: int = DEFAULT_SEED,
               output: str = "fold") -> DataFrame:
    """Plain k-fold: fold = hash mod k (a projection, no shuffle)."""
    return df.withColumn(output, F.pmod(key_hash(keys, seed), F.lit(k)).cast("int"))


def with_stratified_folds(df: DataFrame, keys: Sequence[str], label: str, k: int = DEFAULT_FOLDS,
                          seed: int = DEFAULT_SEED, output: str = "fold") -> DataFrame:
    """Stratified k-fold: rows of each label ranked by (hash, key), fold = (rank - 1) mod k.

    The rank is a bucketed prefix count, so a label holding most of the rows
    is still spread over many tasks.
    """
    d = df.withColumn("_h", key_hash(keys, seed)).withColumn("_one", F.lit(1))
    ranked = prefix_sums(d, "_h", ["_one"], groups=[label], tiebreak=list(keys))
    return ranked.withColumn(output, F.pmod(F.col("_one_cum") - 1, F.lit(k)).cast("int")).drop("_h", "_one", "_one_cum")
