from pyspark.sql import functions as F

from tessera.operators import split as S


def test_folds_partition_and_are_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "k").withColumn("y", (F.col("k") % 3).cast("int"))
    f1 = {r.k: r.fold for r in S.with_folds(df, ["k"], 5).collect()}
    f2 = {r.k: r.fold for r in S.with_folds(df.repartition(7), ["k"], 5).collect()}
    assert f1 == f2 and set(f1.values()) == set(range(5))
    strat = S.with_stratified_folds(df, ["k"], "y", 5)
    counts = strat.groupBy("y", "fold").count().collect()
    per = {}
    for r in counts:
        per.setdefault(r.y, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in per.values())
    assert strat.count() == 2000


def test_split_size_close_to_fraction(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    n_test = S.with_split(df, ["k"], 0.2).where("is_test").count()
    assert abs(n_test - 4000) < 300
