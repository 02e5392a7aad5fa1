from gaugewell.functions.ranked import first_rows


def test_groups_are_limited_before_the_shuffle(spark):
    df = spark.range(10_000).selectExpr("id % 3 AS g", "id AS x").unionByName(spark.createDataFrame([(None, 7)], "g bigint, x bigint"))
    out = first_rows(df, ["g"], ["x"], 1500)
    assert {(r.g, r["count"]) for r in out.groupBy("g").count().collect()} == {(0, 1500), (1, 1500), (2, 1500), (None, 1)}
    assert out.agg({"x": "max"}).first()[0] == 3 * 1500 - 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit [g") < plan.index("Exchange hashpartitioning(g") < plan.rindex("WindowGroupLimit [g")
