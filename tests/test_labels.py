from pyspark.sql import functions as F

from gaugewell.functions.copies import once
from gaugewell.functions.labels import label_set


def test_label_sets(spark):
    rows = [({"b": "1", "a": None, "c": "x;y=\\"},), ({},), (None,), ({"c": "x;y=\\", "b": "1"},)]
    got = [r[0] for r in spark.createDataFrame(rows, "l map<string,string>").select(label_set(F.col("l"))).collect()]
    assert got == [r"b=1;c=x\;y\=\\;", "", "", r"b=1;c=x\;y\=\\;"]


def test_copies_count_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, None)], "id bigint, x string")
    assert sorted(map(str, once(df, "id", "x").collect())) == sorted(map(str, df.collect()[1:]))
