"""CSV fields are read as they are written."""

import pytest
from pyspark.sql import types as T

from tessera.sources.csv import read_csv


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text('id,say,code,flag,x.y\n1,"say ""hi"", ok",12d,True,1.5\n2,NA,7f,False,\n3,"a,b",5,,2e3\n')
    return str(path)


def test_quotes_numbers_and_missing_tokens(spark, csv_file):
    df = read_csv(spark, csv_file)
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [(1, 'say "hi", ok', "12d", True, 1.5), (2, None, "7f", False, None), (3, "a,b", "5", None, 2000.0)]


def test_explicit_schema_uses_the_same_tokens(spark, csv_file):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("say", T.StringType()), T.StructField("code", T.DoubleType())])
    assert [tuple(r) for r in read_csv(spark, csv_file, schema).orderBy("id").collect()] == [(1, 'say "hi", ok', None), (2, None, None), (3, "a,b", 5.0)]
    with pytest.raises(ValueError, match="no column"):
        read_csv(spark, csv_file, T.StructType([T.StructField("zzz", T.LongType())]))


def test_line_feeds_inside_quotes(spark, tmp_path):
    path = tmp_path / "multi.csv"
    path.write_text('id,t\n1,"two\nlines"\n2,one\n')
    assert [r.t for r in read_csv(spark, str(path), multi_line=True).orderBy("id").collect()] == ["two\nlines", "one"]
