import datetime

import pytest
from pyspark.sql import functions as F

from gaugewell.errors import SchemaError
from gaugewell.functions.matchers import NOT_EQUAL, LabelMatcher, matches_all
from gaugewell.functions.series import attributes_key, series_attrs, series_key
from gaugewell.schemas import ENVELOPE
from gaugewell.sources import points, records

FLAT = "time_unix_nano bigint, metric string, value double, region string, k1 string, other bigint"
CARRIED = "metric string, _sk_envelope binary, _sk_sketch_type string, _sk_agg_id bigint, _sk_schema_version int, _sk_window_start_ms bigint, _sk_window_end_ms bigint, _sk_encoding string, value double"


def test_scalar_rows(spark):
    rows = [(1_000_000_000, "m", 2.5, "us", None, 9), (None, None, None, None, None, None), (-5, "m", 1.0, "", "x", 1)]
    got = points.decode(spark.createDataFrame(rows, FLAT)).collect()
    assert [(r.timestamp_ms, r.metric, r.labels, r.kind, r.float) for r in got] == [(1000, "m", {"region": "us"}, "Float", 2.5), (0, "", {}, "Float", 0.0), (0, "m", {"region": "", "k1": "x"}, "Float", 1.0)]


def test_timestamps_and_missing_columns(spark):
    df = spark.createDataFrame([(datetime.datetime(1970, 1, 1, 0, 0, 1, 999),)], "time_unix_nano timestamp")
    (r,) = points.decode(df).collect()
    assert (r.timestamp_ms, r.metric, r.float, r.labels) == (1000, "", 0.0, {})


def test_times_without_a_zone_are_utc(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 7, 1, 12),)], "time_unix_nano timestamp_ntz")
    want = points.decode(df).first().timestamp_ms
    assert want == 1_719_835_200_000
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert points.decode(df).first().timestamp_ms == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_envelope_rows(spark):
    rows = [("m", b"\x01", "DDSketch", 42, 1, 1000, 2000, "PROTO_FULL", None), ("m", None, None, None, None, None, None, None, 7.5), ("m", b"", "", None, None, None, None, None, None)]
    a, b, c = points.decode(spark.createDataFrame(rows, CARRIED)).collect()
    assert (a.kind, a.float, a.envelope.agg_id, a.envelope.sketch_type, a.envelope.window_end_ms, a.envelope["count"]) == ("Envelope", None, 42, "DDSketch", 2000, 0)
    assert (b.kind, b.float, b.envelope) == ("Float", 7.5, None)
    assert (c.envelope.sketch_type, c.envelope.encoding, c.envelope.agg_id) == ("Unspecified", "UNSPECIFIED", 0)


def test_wrong_types_and_names(spark):
    with pytest.raises(SchemaError):
        points.decode(spark.createDataFrame([(1,)], "value bigint"))
    for kind, enc in (("BogoSketch", "PROTO_FULL"), ("DDSketch", "URL_SAFE_BASE64")):
        df = spark.createDataFrame([("m", b"\x01", kind, 1, 1, 0, 1, enc, None)], CARRIED)
        with pytest.raises(Exception, match=kind if kind == "BogoSketch" else enc):
            points.decode(df).collect()
        assert points.decode(df, strict=False).first().problem in ("unknown_sketch_type", "unknown_encoding")


def test_encode_and_back(spark):
    rows = [(1, "DDSketch", 7, {}, {"b": "1", "metric": "x"}, 0, 10, "PROTO_FULL", b"\x02", "m", 3, 1, None), (1, "HLLSketch", 7, {}, {"a": "2"}, 0, 10, "UNSPECIFIED", None, "m", 3, 1, 4.5)]
    wide = points.encode(spark.createDataFrame(rows, ENVELOPE))
    assert wide.columns[10:] == ["a", "b", "label_metric"]
    back = points.decode(wide).collect()
    assert [(r.kind, r.float, r.timestamp_ms) for r in back] == [("Envelope", None, 10), ("Float", 4.5, 10)] and bytes(back[0].envelope.payload) == b"\x02"
    none = points.encode(spark.createDataFrame([], ENVELOPE))
    assert none.count() == 0 and len(none.columns) == 10


ATTRS = "parent_id bigint, key string, bytes binary, str string, int bigint, no int"


def test_flatten(spark):
    m = spark.createDataFrame([(0, 5, "m", 2.5, 9), (1, 6, "m", None, 9), (None, 7, "m", 1.0, 9)], "parent_id bigint, time_unix_nano bigint, metric string, value double, _sk_agg_id bigint")
    a = [(0, "region", None, "old", None, 1), (0, "region", None, "us", None, 2), (0, "_sk_agg_id", None, None, 42, 3), (0, "_sk_envelope", b"\x01", "x", 5, 4), (0, "size", None, None, 3, 5), (0, None, None, "x", None, 6), (3, "region", None, "eu", None, 7), (None, "region", None, "z", None, 8), (1, "region", None, None, None, 9)]
    got = records.flatten(m, spark.createDataFrame(a, ATTRS), ["region", "size"], "no").orderBy("time_unix_nano").collect()
    assert [(r.region, r.size, r._sk_agg_id, r._sk_envelope and bytes(r._sk_envelope)) for r in got] == [("us", None, 42, b"\x01"), (None, None, None, None), (None, None, None, None)]
    assert "parent_id" not in got[0].asDict()
    with pytest.raises(SchemaError):
        records.flatten(m, spark.createDataFrame(a, ATTRS), ["value"])
    with pytest.raises(SchemaError):
        records.flatten(m.drop("parent_id"), spark.createDataFrame(a, ATTRS), [])
    assert records.flatten(m, spark.createDataFrame([], ATTRS), ["region"]).count() == 3


def test_lift_is_the_inverse(spark):
    rows = [(i, f"r{i}" if i % 3 else None, i * 1.5, b"\x01" if i % 2 else None, i) for i in range(500)]
    flat = spark.createDataFrame(rows, "time_unix_nano bigint, region string, value double, _sk_envelope binary, extra int").repartition(7)
    m, a = records.lift(flat, "time_unix_nano")
    assert [r.parent_id for r in m.orderBy("time_unix_nano").collect()] == list(range(500))
    back = records.flatten(m, a, ["region"]).orderBy("time_unix_nano").collect()
    assert [(r.time_unix_nano, r.region, r.value, r._sk_envelope and bytes(r._sk_envelope), r.extra) for r in back] == rows
    m, a = records.lift(flat)
    assert m.select("parent_id").distinct().count() == 500 and a.join(m, "parent_id").count() == a.count()
    assert records.lift(flat.limit(0), "time_unix_nano")[1].count() == 0


#: Series keys as their readers expect them.
GOLDEN = [
    (42, {"host.name": "node-1", "service.name": "web"}, {"http.method": "GET", "http.status": "200"}, (), "42|host.name=node-1;service.name=web;|http.method=GET;http.status=200;"),
    (7, {"region": "us-east", "service.name": "api"}, {"http.method": "POST", "http.status": "500", "k8s.pod": "p-1"}, ("http.method", "http.status"), "7|region=us-east;service.name=api;|http.method=POST;http.status=500;"),
    (1, {"service.name": "ingest"}, {"a": "1", "c": "3"}, ("a", "b", "c"), "1|service.name=ingest;|a=1;c=3;"),
    (99, {"deployment.environment": "prod"}, {}, (), "99|deployment.environment=prod;|"),
    (3, None, {"x": "1", "y": "2", "z": None}, (), "3||x=1;y=2;"),
]


def test_series_keys(spark):
    for agg, resource, labels, by, want in GOLDEN:
        df = spark.createDataFrame([(resource, labels)], "r map<string,string>, l map<string,string>")
        assert df.select(series_key(agg, F.col("r"), F.col("l"), by)).first()[0] == want
    df = spark.createDataFrame([({"z": "1", "a": "2", "m": "3"},), (None,)], "l map<string,string>")
    assert [r[0] for r in df.select(attributes_key(F.col("l"))).collect()] == ["a=2;m=3;z=1;", ""]
    assert [r[0] for r in df.select(series_attrs(F.col("l"), ["m", "q"])).collect()] == [{"m": "3"}, {}]


def test_matchers(spark):
    df = spark.createDataFrame([(1, {"a": "x"}, "m"), (2, {"a": ""}, ""), (3, {}, None), (4, None, "m"), (5, {"a": None}, "m")], "i int, labels map<string,string>, metric string")
    ids = lambda *ms: [r.i for r in df.where(matches_all(ms)).collect()]
    assert ids() == [1, 2, 3, 4, 5]
    assert ids(LabelMatcher.equal("a", "x")) == [1] and ids(LabelMatcher.equal("a", "")) == [2]
    assert ids(LabelMatcher("a", "x", NOT_EQUAL)) == [2, 3, 4, 5] and ids(LabelMatcher("a", "", NOT_EQUAL)) == [1, 3, 4, 5]
    assert ids(LabelMatcher.equal("", "m")) == [1, 4, 5] and ids(LabelMatcher("", "m", NOT_EQUAL)) == [2, 3] and ids(LabelMatcher.equal("", "")) == []
    assert ids(LabelMatcher("a", "x", NOT_EQUAL), LabelMatcher.equal("", "m")) == [4, 5]
    with pytest.raises(ValueError):
        LabelMatcher("a", "x", "Regex")


def test_label_filter_before_folding_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "flat")
    spark.createDataFrame([(1, "m", 1.0, "us", "x", 1)], FLAT).write.parquet(path)
    plan = points.decode(spark.read.parquet(path).where("region = 'us'")).select("float")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(region), EqualTo(region,us)]" in plan and "k1" not in plan.split("ReadSchema")[1]
