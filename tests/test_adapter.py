import time

import pytest
from pyspark.sql import functions as F

from gaugewell.plans.plan import Plan
from gaugewell.sources.points import observation
from gaugewell.streaming.adapter import Adapter, Host, PassThrough
from gaugewell.streaming.runtime import Runtime

FLAT = "time_unix_nano bigint, metric string, value double, region string, _sk_envelope binary, _sk_sketch_type string"


class Keep(Adapter):
    def __init__(self):
        self.out, self.bad, self.stats = [], [], None

    def emit(self, batch):
        self.out += batch.collect()

    def quarantine(self, rows):
        self.bad += [r.problem for r in rows.collect()]

    def emit_telemetry(self, stats):
        self.stats = stats


def test_host(spark, tmp_path):
    rows = [(1_000_000 * t, "m", float(t), "us", None, None) for t in (1, 2, 12_000)] + [(0, "m", None, "us", b"\x01", "Bogus")]
    spark.createDataFrame(rows, FLAT).coalesce(1).write.parquet(f"{tmp_path}/in")
    keep = Keep()
    host = Host(Runtime(spark, Plan(1, "out", size_ms=10_000)), keep).start(spark.readStream.schema(FLAT).parquet(f"{tmp_path}/in"))
    host.query.processAllAvailable()
    host.tick(10_000)
    assert [(r.region, r._sk_window_end_ms) for r in keep.out] == [("us", 10_000)] and keep.bad == ["unknown_sketch_type"]
    host.shutdown()
    assert [r._sk_window_end_ms for r in keep.out] == [10_000, 20_000]
    assert (keep.stats.input_observations, keep.stats.emitted_envelopes) == (3, 2)


def test_ticker(spark):
    keep = Keep()
    host = Host(Runtime(spark, Plan(1, "out", size_ms=10)), keep)
    host.batch(spark.createDataFrame([(1_000_000, "m", 1.0, "us", None, None)], FLAT))
    host.ticker(200)
    until = time.time() + 60
    while not keep.out and time.time() < until:
        time.sleep(0.1)
    host.shutdown()
    assert len(keep.out) == 1


def test_pass_through_and_constructors(spark):
    seen = []
    df = spark.range(3)
    assert PassThrough(seen.append).forward(df) is df and seen == [df]
    for kind, n, v in (("Float", "float", 2.5), ("Hash", "hash", 7), ("Bytes", "bytes", b"x")):
        (r, *_) = spark.range(1).select(*observation(F.lit(5), F.lit("m"), F.lit(v), kind)).collect()
        assert (r.timestamp_ms, r.kind, r.labels) == (5, kind, {}) and r[n] == (bytearray(v) if kind == "Bytes" else v)
        assert sum(r[x] is not None for x in ("float", "hash", "bytes")) == 1
    with pytest.raises(ValueError):
        observation(F.lit(5), F.lit("m"), F.lit(1), "Other")
