from pyspark.sql import functions as F

from quarrygraph.operators import aggregates as A


def test_budget_prefix(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 9), ("d", 1)], "k string, cost int")
    got = lambda **kw: [r.k for r in A.budget_prefix(df, F.col("cost"), kw.pop("budget"), [F.col("k")], **kw).orderBy("k").collect()]
    assert got(budget=8) == got(budget=8, at_least=1) == ["a", "b"]
    assert got(budget=2) == ["a"] and got(budget=2, keep_first=False) == []
