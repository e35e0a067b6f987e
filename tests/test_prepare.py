import numpy as np
import pytest

from tessera.operators import prepare as K


@pytest.fixture
def mixed5(spark):
    rows = [(1.0, 5.0, "A", "X", 10, "Class1"), (2.0, 4.0, "B", "Y", 20, "Class2"), (3.0, 3.0, "C", "X", 30, "Class1"),
            (4.0, 2.0, "A", "Y", 40, "Class2"), (5.0, 1.0, "B", "X", 50, "Class1")]
    return spark.createDataFrame(rows, "numeric1 double, numeric2 double, categorical1 string, categorical2 string, "
                                       "target_num bigint, target_cat string")


def test_widths_and_names(mixed5):
    fp = K.fit_prep(mixed5, ["numeric1", "numeric2"], ["categorical1", "categorical2"])
    assert fp.feature_names == ["numeric1", "numeric2", "categorical1_A", "categorical1_B", "categorical1_C",
                                "categorical2_X", "categorical2_Y"]
    out = fp.transform(mixed5).toPandas()
    assert out.shape == (5, 7)
    assert out[["numeric1", "numeric2"]].mean().abs().max() < 1e-12
    assert np.allclose(out[["numeric1", "numeric2"]].std(ddof=0), 1.0)  # population std
    onehot = out[fp.feature_names[2:5]].sum(axis=1)
    assert (onehot == 1).all()


def test_transform_reuses_fit(mixed5, spark):
    fp = K.fit_prep(mixed5, ["numeric1"], ["categorical1"])
    hold = spark.createDataFrame([(3.0, "A"), (9.0, "zz")], "numeric1 double, categorical1 string")
    rows = fp.transform(hold).collect()
    assert rows[1]["categorical1_A"] == rows[1]["categorical1_B"] == rows[1]["categorical1_C"] == 0.0
    assert rows[0]["numeric1"] == pytest.approx(0.0)


def test_label_rule_follows_code(mixed5, spark):
    enc = K.fit_label(mixed5, "target_num")  # 5 distinct < 10 -> classification
    assert enc.task == "classification" and enc.classes == [10, 20, 30, 40, 50]
    nums = spark.createDataFrame([(2,), (10,), (1,)], "y bigint")
    e2 = K.fit_label(nums, "y")
    assert [r[0] for r in e2.transform(nums).collect()] == [1.0, 2.0, 0.0]  # numeric order 1, 2, 10
    with pytest.raises(Exception):
        e2.transform(spark.createDataFrame([(7,)], "y bigint")).collect()


def test_imputers_and_constant_column(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, None, "a"), (2, None, 5.0, None, None), (3, 4.0, 5.0, None, "a"),
                                (4, 10.0, 5.0, None, "b")], "k bigint, a double, c double, d double, s string")
    assert K.impute_values(df, ["a"], "mean")["a"] == pytest.approx(5.0)
    assert K.impute_values(df, ["a"], "median")["a"] == pytest.approx(4.0)
    assert K.impute_values(df, ["s"], "most_frequent")["s"] == "a"
    assert K.impute_values(df, ["d"], "mean")["d"] is None
    st = K.scaler_stats(df, ["c"], "robust")
    assert st["c"] == (5.0, 1.0)  # zero IQR -> scale 1
    fp = K.fit_prep(df, ["a"], ["s"], K.PrepConfig(numeric_imputer="constant", numeric_fill=0.0,
                                                   categorical_imputer="constant", numeric_scaler="none"))
    assert "s_missing_value" in fp.feature_names
    assert fp.transform(df).where("k = 2").first()["a"] == 0.0
