import datetime

from gaugewell.operators.wide import BlockPivot, pivot

ATTR = "parent_id bigint, key string, bytes binary, str string, int bigint, _key int, n int, region string"
KEYS = [
    ("region", "region", "string"), ("cloud.region", "region", "string"), ("status", "http_status", "long"), ("load", "load", "double"), ("ok", "ok", "boolean"),
    ("at", "at", "timestamp"), ("blob", "blob", "binary"), ("pid", "parent_id", "long"), ("Reg", "REGION", "string"), (None, "x", "long"), ("odd", "odd", "decimal"),
]


def frames(spark, rows, entities):
    a = spark.createDataFrame([(*r, 1, 2, "zz") for r in rows], ATTR)
    k = spark.createDataFrame(KEYS, "raw_key string, attr_name string, value_type string")
    return a, k, spark.createDataFrame([(e, "m") for e in entities], "parent_id bigint, region string")


def test_wide_and_conflicts(spark):
    rows = [
        (1, "region", None, " eu ", None), (1, " CLOUD.Region\t", b"eu", None, None), (1, "status", None, "2e2", None), (1, "status", None, None, 200),
        (1, "ok", None, "YES", None), (1, "ok", None, "maybe", None), (1, "load", None, "0.50", None), (1, "load", b"5e-1", None, None),
        (1, "at", None, "2026-03-02T01:00:00+01:00", None), (1, "at", None, None, 1772409600000), (1, "blob", b"\xff\x00", "x", 3), (1, "pid", None, "7", None),
        (2, "region", None, "eu", None), (2, "region", None, "us", None), (2, "status", None, "n/a", None), (2, "ok", None, "  ", None), (2, "status", None, None, None),
        (2, "blob", b" ", None, None), (2, "blob", b"", None, None), (2, "load", b"\xff", None, None),
        (3, "region", None, "orphan", None), (None, "region", None, "x", None), (4, None, None, "x", None), (4, "undeclared", None, "x", None),
        (5, "region", None, "z" * 200_000, None), (5, "region", None, "z" * 200_000, None), (5, "odd", None, "1", None),
    ]
    a, k, e = frames(spark, rows * 2, [1, 2, 2, 4, 5, None])
    for size in (1, 3, 50):
        p = BlockPivot(a, k, block_size=size)
        assert set(map(str.lower, p.columns())) == {"region", "attr_region", "at", "blob", "http_status", "load", "ok", "attr_parent_id"}
        low = next(c for c, (a_, _) in zip(p.columns(), p.attributes) if a_ == "region")
        got = {r["parent_id"]: r for r in p.wide(e).collect()}
        assert set(got) == {1, 2, 4, 5}
        one = got[1]
        assert (one[low], one["http_status"], one["load"], one["ok"], bytes(one["blob"]), one["attr_parent_id"]) == ("eu", 200, 0.5, True, b"\xff\x00", 7)
        assert one["at"] == datetime.datetime(2026, 3, 2)
        assert (got[2][low], got[2]["http_status"], bytes(got[2]["blob"]), got[2]["load"]) == (None, None, b" ", None)
        assert len(got[5][low]) == 200_000 and got[4][low] is None
        assert sorted(map(tuple, p.conflicts(e).collect())) == [(2, "http_status"), (2, "load"), (2, "region")]


def test_no_shuffle_after_the_buckets(spark):
    a, k, e = frames(spark, [(i, "region", None, "eu", None) for i in range(50)], range(50))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = BlockPivot(a, k, block_size=2).wide(e)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1  # that of the entities


def test_no_rows(spark):
    a, k, e = frames(spark, [], [])
    assert pivot(spark, a, k, e).collect() == [] and BlockPivot(a, k).conflicts(e).collect() == []
    a, k, e = frames(spark, [(1, "region", None, "eu", None)], [1])
    p = BlockPivot(a, k.limit(0))
    assert [tuple(r) for r in p.wide(e).collect()] == [(1,)] and p.conflicts(e).collect() == []


def test_epochs_of_any_size(spark):
    rows = [
        (1, "at", None, "253402300800000", None), (1, "at", None, "00253402300800000", None), (2, "at", None, "9" * 40, None), (2, "at", None, "9" * 39 + "8", None), (3, "at", None, "9" * 40, None),
        (4, "at", None, "2026-03-02T00:00:00.1234567Z", None), (4, "at", None, "2026-03-02T00:00:00.123456Z", None), (5, "at", None, "2026-03-02 00:00:00.10-20:30", None), (5, "at", None, "2026-03-02T20:30:00.1Z", None),
        (6, "at", None, "2026-02-30T00:00:00Z", None), (7, "at", None, "0000", None), (7, "at", None, "1970-01-01T00:00:00Z", None), (8, "at", None, "2026-03-02T00:00:00+25:00", None),
        (9, "status", None, "\x01" + "5", None), (9, "status", None, "5", None), (10, "status", None, "+0012.50e1", None), (10, "status", None, None, 125),
    ]
    a, k, e = frames(spark, rows, range(1, 11))
    p = BlockPivot(a, k)
    assert sorted(map(tuple, p.conflicts(e).collect())) == [(2, "at"), (4, "at"), (6, "at"), (8, "at")]
    got = {r[0]: r[1] for r in p.wide(e).selectExpr("parent_id", "unix_micros(at)").collect()}
    assert got[1] == 253402300800000000 and got[3] is None and got[7] == 0 and got[5] == 1772483400100000


def test_scratch_is_removed(spark, tmp_path):
    from gaugewell.storage import scratch

    a, k, e = frames(spark, [(1, "region", None, "eu", None)], [1])
    before = {t.name for t in spark.catalog.listTables()}
    with scratch(spark):
        path = BlockPivot(a, k).stored.inputFiles()[0]
        assert {t.name for t in spark.catalog.listTables()} != before
    import os

    assert {t.name for t in spark.catalog.listTables()} == before and not os.path.exists(path.removeprefix("file://"))
