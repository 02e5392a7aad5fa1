import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gaugewell.errors import ClosedError, PlanError
from gaugewell.functions.matchers import LabelMatcher
from gaugewell.operators import deltas, engine, views, windows
from gaugewell.operators.sketches import DDSketch, Frequency, HyperLogLog, Kll
from gaugewell.plans.plan import COUNT_MIN, COUNT_SKETCH, CUSTOM, DDSKETCH, HLL, KLL, Plan, PlanSet
from gaugewell.schemas import ENVELOPE, OBSERVATION
from gaugewell.sources import jsonl
from gaugewell.streaming.compat import ActiveWindow, replay
from gaugewell.streaming.control import ControlLoop, FileChannel
from gaugewell.streaming.runtime import Runtime, watermarked


def obs(spark, rows):
    """Rows (ts, labels, value) where the value is a float, ("h", hash) or (bytes, float)."""
    out = []
    for ts, labels, v in rows:
        if isinstance(v, tuple) and v[0] == "h":
            out.append((ts, "m", {"host": "n"}, labels, "Hash", None, v[1], None))
        elif isinstance(v, tuple):
            out.append((ts, "m", {"host": "n"}, labels, "Bytes", v[1], None, v[0]))
        else:
            out.append((ts, "m", {"host": "n"}, labels, "Float", v, None, None))
    return spark.createDataFrame(out, OBSERVATION)


P = Plan(1, "out", DDSKETCH, size_ms=10_000, transmit_sketch=False, quantiles=(0.5, 0.99))


def test_ddsketch_estimates(spark):
    got = engine.run(P, obs(spark, [(i, {"a": "x"}, float(i)) for i in range(1, 101)])).collect()
    assert {r.labels["quantile"]: r.value for r in got}.keys() == {"0.5", "0.99"}
    for r in got:
        q = float(r.labels["quantile"])
        assert abs(r.value - math.ceil(q * 99 + 1e-9)) <= 0.01 * 101 + 1 and (r["count"], r.window_start_ms, r.window_end_ms, r.encoding, r.payload, r.metric_name) == (100, 0, 10_000, "UNSPECIFIED", None, "out")


@pytest.mark.parametrize("seed", range(3))
def test_ddsketch_error_bound(spark, seed):
    rng, s = random.Random(seed), DDSketch(0.01)
    vs = [rng.choice([rng.gauss(0, 100), rng.lognormvariate(0, 3), -rng.lognormvariate(2, 2), 0.0]) for _ in range(800)]
    df = spark.createDataFrame([(1, v) for v in vs] + [(1, float("nan")), (1, None), (1, float("inf"))], "g int, float double")
    cells = s.cells(df, ["g"])
    assert cells.agg(F.sum("n")).first()[0] == 803
    vs.sort()
    for r in s.quantiles(cells, ["g"], [-1, 0, 0.1, 0.5, 0.9, 0.999, 1, 2]).collect():
        exact = vs[math.floor(min(max(r.q, 0), 1) * 799)]
        assert abs(r.value - exact) <= 0.0100001 * abs(exact) and r.total == 800


def test_hll_and_merge(spark):
    s = HyperLogLog(12)
    df = spark.createDataFrame([(i % 3, str(i % 2000)) for i in range(5000)], "shard int, item string")
    whole = s.cells(df, []).select("idx", "w")
    merged = s.merge(s.cells(df, ["shard"]), []).select("idx", "w")
    assert whole.exceptAll(merged).count() == 0
    assert abs(s.estimate(merged, []).first().estimate / 2000 - 1) < 0.05
    assert HyperLogLog(12).estimate(s.cells(df.limit(0), ["shard"]), ["shard"]).count() == 0


def test_frequencies(spark):
    rng = random.Random(1)
    items = [f"k{min(int(rng.paretovariate(1)), 300)}" for _ in range(3000)]
    df = spark.createDataFrame([(1, i) for i in items] + [(1, None)], "g int, item string")
    asked = spark.createDataFrame([(1, i) for i in sorted(set(items))[:40] + ["never", "", None]], "g int, item string")
    cms, cs = Frequency(8, 64), Frequency(8, 64, signed=True)
    for r in cms.point(cms.cells(df, ["g"]), asked, ["g"]).collect():
        assert r.estimate >= items.count(r.item) and (r.item or r.estimate == 0)
    heavy = {r.item: r.estimate for r in cs.point(cs.cells(df, ["g"]), asked, ["g"]).collect()}
    assert abs(heavy["k1"] / items.count("k1") - 1) < 0.2 and heavy[""] == heavy[None] == 0
    n = cms.norms(cms.cells(df, ["g"]), ["g"]).collect()
    assert len(n) == 8 and all(r.l1 == 3000 for r in n)
    assert cms.cells(df, ["g"]).agg(F.sum("n")).first()[0] == 3001


def test_items_are_all_labels_even_of_coarser_series(spark):
    rows = [(1, {"a": "x", "b": str(i % 2)}, 1.0) for i in range(10)]
    for kind in (COUNT_MIN, COUNT_SKETCH):
        plan = Plan(1, sketch_type=kind, size_ms=100, aggregate_by=("a",))
        table = engine.cells(plan, engine.admitted(plan, obs(spark, rows)))
        s = engine.sketch_of(plan)
        asked = table.select(*engine.KEYS).distinct().crossJoin(spark.createDataFrame([("a=x;b=0;",)], "item string"))
        assert [r.estimate for r in s.point(table, asked, engine.KEYS).collect()] == [5.0]
    plan = Plan(1, sketch_type=COUNT_SKETCH, size_ms=100)
    table = engine.cells(plan, engine.admitted(plan, obs(spark, [(1, {}, 1.0), (2, None, 1.0), (3, {}, (b"\xff", 2.5))])))
    asked = table.select(*engine.KEYS).distinct().crossJoin(spark.createDataFrame([("default_key",), ("ff",)], "item string"))
    assert {r.item: r.estimate for r in engine.sketch_of(plan).point(table, asked, engine.KEYS).collect()} == {"default_key": 2.0, "ff": 2.5}


def test_kll(spark):
    plan = replace(P, sketch_type=KLL, sketch_params={"k": 200}, quantiles=(0.5,))
    rows = [(i, {}, float(i)) for i in range(1, 1001)] + [(5, {}, float("nan"))]
    (r,) = engine.run(plan, obs(spark, rows)).collect()
    assert abs(r.value - 500) <= 60 and r["count"] == 1001
    s = Kll(200)
    parts = s.build(obs(spark, rows).withColumn("g", F.col("timestamp_ms") % 4), ["g"])
    assert abs(s.quantiles(s.merge(parts, []), [], [0.5]).first().value - 500) <= 60


@pytest.mark.parametrize("kind,encoding", [(k, e) for k in (DDSKETCH, HLL, COUNT_MIN, COUNT_SKETCH, KLL) for e in ("PROTO_FULL", "MSGPACK")])
def test_two_tiers_give_what_one_gives(spark, kind, encoding):
    plan = Plan(1, "out", kind, {"rows": 3, "cols": 64}, size_ms=1000, encoding=encoding, delta=True)
    rng = random.Random(3)
    rows = [(rng.randrange(3000), {"a": rng.choice("xy")}, ("h", rng.randrange(50)) if kind == HLL else rng.uniform(-3, 9)) for _ in range(300)]
    parts = [engine.run(plan, obs(spark, rows[k::3])) for k in range(3)]
    merged = engine.merge_envelopes(plan, parts[0].unionByName(parts[1]).unionByName(parts[2]))
    whole = engine.run(plan, obs(spark, rows))
    pick = lambda df: sorted((r.labels["a"], r.window_start_ms, r["count"], r.encoding, None if kind == KLL else bytes(r.payload)) for r in df.collect())
    assert pick(merged) == pick(whole) and len(pick(whole)) == 6
    first = {r.encoding for r in whole.where("window_start_ms = 0").collect()}
    assert first == {plan.full_encoding}
    later = {r.encoding for r in whole.where("window_start_ms > 0").collect()}
    assert later == {plan.full_encoding if kind == KLL else plan.delta_encoding}


def test_admission(spark):
    plan = replace(P, transmit_sketch=True)
    e = engine.run(plan, obs(spark, [(1, {}, 1.0)]))
    for change, problem in (({}, None), ({"agg_id": 9}, "other_plan"), ({"agg_id": 0}, None), ({"sketch_type": "KLLSketch"}, "other_sketch_type"), ({"sketch_type": "Unspecified"}, None), ({"schema_version": 2}, "unknown_schema_version")):
        df = e
        for c, v in change.items():
            df = df.withColumn(c, F.lit(v).cast(dict(e.dtypes)[c]))
        assert engine.admission(plan, df).first().problem == problem


def test_empty_sketches_and_inputs_emit_nothing(spark):
    plan = replace(P, transmit_sketch=True)
    assert engine.run(plan, obs(spark, [(1, {}, float("nan"))])).count() == 0
    for p in (plan, P, replace(plan, sketch_type=KLL), replace(plan, sketch_type=HLL)):
        assert engine.run(p, obs(spark, [])).count() == 0
    with pytest.raises(PlanError):
        engine.sketch_of(Plan(sketch_type="Unspecified"))


def test_window_stats_and_grouping(spark):
    rows = [(1, {"a": "x", "b": "1"}, 1.0), (2, {"a": "x", "b": "2"}, 2.0), (3, {"a": "y"}, 3.0), (29_999, {"a": "x"}, 4.0)]
    plan = replace(P, size_ms=30_000, window_stats=True, aggregate_by=("a",), quantiles=(0.5,))
    got = {r.labels["a"]: r.labels for r in engine.run(plan, obs(spark, rows)).collect()}
    assert got["x"] == {"a": "x", "quantile": "0.5", "sample_count": "3", "window_duration_seconds": "30"} and got["y"]["sample_count"] == "1"
    (r,) = engine.run(replace(plan, global_aggregation=True), obs(spark, rows)).collect()
    assert (r.resource_labels, r.labels["sample_count"]) == ({}, "4")
    assert len(engine.run(replace(plan, omit_resource=True), obs(spark, rows)).where("size(resource_labels) = 0").collect()) == 2
    (r,) = engine.run(replace(plan, matchers=(LabelMatcher.equal("a", "y"),)), obs(spark, rows)).collect()
    assert r["count"] == 1
    (r,) = engine.run(replace(plan, size_ms=0, window_stats=False, global_aggregation=True), obs(spark, rows)).collect()
    assert (r.window_start_ms, r.window_end_ms, r["count"]) == (1, 1, 4)


def test_windows(spark):
    df = spark.createDataFrame([(t,) for t in (0, 9, 10, 25, -1, None)], "timestamp_ms bigint")
    tumbling = windows.assign(df, Plan(size_ms=10))
    assert sorted((r.timestamp_ms, r.window_start_ms, r.window_end_ms) for r in tumbling.collect()) == [(-1, -10, 0), (0, 0, 10), (9, 0, 10), (10, 10, 20), (25, 20, 30)]
    sliding = windows.assign(df, Plan(size_ms=10, slide_ms=4, mode="Sliding"))
    assert sorted(r.window_start_ms for r in sliding.where("timestamp_ms = 9").collect()) == [0, 4, 8]
    gaps = windows.assign(df, Plan(size_ms=4, slide_ms=10, mode="Sliding"))
    assert sorted((r.timestamp_ms, r.window_start_ms) for r in gaps.collect()) == [(0, 0), (10, 10)]
    (a, b) = windows.sessions(df.where("timestamp_ms >= 0"), 11, [], [F.count(F.lit(1)).alias("n")]).orderBy("window_start_ms").collect()
    assert ((a.window_start_ms, a.window_end_ms, a.n), (b.window_start_ms, b.n)) == ((0, 21, 3), (25, 1))


def test_late_and_caps(spark):
    late = spark.createDataFrame([(8000,), (9000,), (10_500,), (None,)], "t bigint")
    assert [r.t for r in late.where(~windows.is_late(F.col("t"), 10_000, 1000)).collect()] == [9000, 10_500, None]
    assert late.where(windows.is_late(F.col("t"), 10_000, 0)).count() == 0
    plan = replace(P, max_series=2)
    rows = [(5, {"k": "c"}, 1.0), (1, {"k": "a"}, 1.0), (2, {"k": "b"}, 1.0), (6, {"k": "a"}, 1.0)]
    kept, dropped = windows.cap_series(engine.admitted(plan, obs(spark, rows)), plan, ["timestamp_ms"])
    assert sorted(r.timestamp_ms for r in kept.collect()) == [1, 2, 6] and [r.timestamp_ms for r in dropped.collect()] == [5]
    assert sorted(r.labels["k"] for r in engine.run(replace(plan, quantiles=(0.5,)), obs(spark, rows)).collect()) == ["a", "b"]


def test_deltas_between_windows(spark):
    rng = random.Random(2)
    cells = {}
    for w in (0, 10, 20, 40):
        for b in range(6):
            n = rng.randint(0, 3)
            if n:
                cells["s", w, 1, b] = n
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "series string, window_start_ms bigint, sign int, bucket int, w bigint")
    d = deltas.against_previous(df, ["series"], DDSketch.cell, 10)
    back = deltas.apply(d, ["series"], DDSketch.cell, 10)
    assert {(r.series, r.window_start_ms, r.sign, r.bucket): r.w for r in back.collect()} == cells


def test_frames_by_their_end_and_as_json(spark):
    plan = replace(P, transmit_sketch=True)
    e = engine.run(plan, obs(spark, [(1, {"a": "x", "b": None}, 1.0)]))
    assert [r.window_start_ms for r in engine.merged_cells(plan, e, by_end=True).collect()] == [10_000]
    assert [r.window_start_ms for r in engine.merged_cells(plan, e).collect()] == [0]
    back = jsonl.from_json(jsonl.to_json(e))
    assert back.collect() == e.collect() and back.schema.simpleString() == spark.createDataFrame([], ENVELOPE).schema.simpleString()
    (r,) = jsonl.from_json(spark.createDataFrame([("nonsense",)], "value string")).collect()
    assert r.agg_id is None
    (r,) = deltas.with_previous(e).collect()
    assert r.previous is None and r.first


def test_views(spark):
    e = engine.run(P, obs(spark, [(1, {"a": "x"}, 1.0), (10_001, {"a": "x"}, 1.0), (1, {"a": "y"}, 1.0)]))
    both = e.unionByName(engine.run(replace(P, agg_id=2, transmit_sketch=True), obs(spark, [(1, {"a": "x"}, 1.0)])))
    assert views.dictionary(both).count() == 5 and views.records(both).count() == 7
    assert views.records(both).where("(envelope is null) = (value is null)").count() == 0
    assert {r.key for r in views.labels(both).collect()} == {"a", "quantile", "resource.host"}


def test_runtime_ticks_and_drains(spark):
    plan = Plan(1, sketch_type=DDSKETCH, size_ms=10_000)
    r = Runtime(spark, plan)
    assert r.tick(99).count() == 0 and r.drain().count() == 0
    r.process(obs(spark, [(1000, {"m": "GET"}, 1.0), (2000, {"m": "GET"}, 1.0)]))
    r.process(obs(spark, [(3000, {"m": "POST"}, 1.0), (12_000, {"m": "GET"}, 1.0)]))
    assert r.tick(9999).count() == 0
    out = r.tick(10_000).collect()
    assert sorted((x.labels["m"], x["count"], x.window_start_ms, x.window_end_ms) for x in out) == [("GET", 2, 0, 10_000), ("POST", 1, 0, 10_000)]
    assert r.stats.active_series == 1
    (x,) = r.drain().collect()
    assert (x.window_start_ms, x.window_end_ms, x["count"]) == (10_000, 20_000, 1) and r.drain().count() == 0
    assert (r.stats.input_observations, r.stats.matched, r.stats.emitted_envelopes) == (4, 4, 3)


def test_runtime_late_retried_and_closed(spark, tmp_path):
    r = Runtime(spark, Plan(1, size_ms=10_000, allowed_lateness_ms=1000))
    r.process(obs(spark, [(5000, {}, 1.0), (15_000, {}, 1.0)]), batch=1)
    r.process(obs(spark, [(5000, {}, 1.0), (15_000, {}, 1.0)]), batch=1)  # the same batch again
    assert r.tick(10_000).first()["count"] == 1
    r.process(obs(spark, [(8000, {}, 1.0), (9500, {}, 1.0)]), batch=2)
    assert (r.stats.dropped_late, r.stats.input_observations) == (1, 4)
    r.save(str(tmp_path / "state.json"))
    again = Runtime.restore(spark, str(tmp_path / "state.json"))
    assert sorted(x["count"] for x in again.drain().collect()) == [1, 1]
    assert sorted(x["count"] for x in r.shutdown().collect()) == [1, 1]
    with pytest.raises(ClosedError):
        r.process(obs(spark, []))
    assert r.shutdown().count() == 0 and r.tick(10**9).count() == 0


def test_runtime_takes_sketches_too(spark):
    plan = Plan(1, sketch_type=DDSKETCH, size_ms=10_000)
    e = engine.run(plan, obs(spark, [(1, {"a": "x"}, 1.0), (2, {"a": "x"}, 2.0)]))
    rows = e.select(F.col("window_start_ms").alias("timestamp_ms"), F.lit("m").alias("metric"), "resource_labels", "labels", F.lit("Envelope").alias("kind"), F.lit(None).cast("double").alias("float"), F.lit(None).cast("bigint").alias("hash"), F.lit(None).cast("binary").alias("bytes"), F.struct("*").alias("envelope"))
    r = Runtime(spark, plan)
    r.process(rows)
    r.process(obs(spark, [(3, {"a": "x"}, 3.0)]))
    assert r.shutdown().first()["count"] == 3 and r.stats.input_envelopes == 1


def test_reconfiguration(spark, tmp_path):
    r = Runtime(spark, Plan(1, size_ms=10_000))
    r.process(obs(spark, [(1, {}, 1.0)]))
    assert r.update_config(PlanSet()).count() == 0 and r.update_config(PlanSet((replace(r.plan, metric_name="n"),), 1)).count() == 0
    channel = FileChannel(str(tmp_path / "plans.json"))
    drained = []
    loop = ControlLoop(channel, lambda s: drained.append(r.update_config(s)), 0.05)
    loop.step()
    assert drained == []
    (tmp_path / "plans.json").write_text(PlanSet((Plan(1, sketch_type=KLL, size_ms=500),), 7).to_json())
    loop.step()
    loop.step()
    assert len(drained) == 1 and drained[0].first().metric_name == "n" and r.plan.sketch_type == KLL and channel.acked == 7
    (tmp_path / "plans.json").write_text("{")
    loop.start()
    loop.stop()
    assert loop.errors and r.plan.sketch_type == KLL


def test_watermarked_stream(spark, tmp_path):
    rows = [(i * 100, {"a": "x"}, float(i)) for i in range(1, 101)] + [(60_000, {"a": "x"}, 1.0)]
    obs(spark, rows).withColumn("ts", F.timestamp_millis("timestamp_ms")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(OBSERVATION + ", ts timestamp").parquet(f"{tmp_path}/in")
    for kind in (DDSKETCH, HLL, COUNT_MIN, KLL):
        plan = Plan(1, "out", kind, size_ms=5000, allowed_lateness_ms=1000)
        q = watermarked(plan, stream).writeStream.format("memory").queryName(f"s{kind}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c{kind}").start()
        q.awaitTermination(120)
        got = engine.envelopes(plan, spark.table(f"s{kind}")).collect()
        assert sorted((r.window_start_ms, r["count"]) for r in got) == [(0, 49), (5000, 50), (10_000, 1)], kind


def test_strict_runtime(spark):
    w = ActiveWindow(10_000, 1000, 1)
    assert [w.observe(10_500, "a"), w.observe(8000, "a"), w.observe(99_000, "a"), w.observe(11_000, "b")] == ["ok", "late", "ok", "overflow"]
    assert (w.late, w.dropped, w.tick(19_999)) == (1, 1, [])
    assert w.tick(57_000) == [(10_000, 20_000, "a", 2, 99_000)] and (w.start, w.end) == (50_000, 60_000)
    assert w.drain() == [] and w.observe(1, "a") == "late"
    w = ActiveWindow(10, 0, 2, "EvictOldest")
    for ts, k in ((1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b")):
        w.observe(ts, k)
    assert w.drain() == [(0, 10, "b", 1, 5), (0, 10, "c", 1, 4)] and w.evicted == 2
    df = spark.createDataFrame([(a, k, t, n) for a in (1, 2) for n, (t, k) in enumerate([(1, "a"), (12, "b"), (3, "a"), (25, "a")])], "agg_id bigint, series string, timestamp_ms bigint, no int")
    got = sorted(map(tuple, replay(Plan(size_ms=10), df, "no").collect()))
    assert got == [(a, s, s + 10, k, 1, seen) for a in (1, 2) for s, k, seen in ((0, "a", 1), (10, "a", 3), (10, "b", 12), (20, "a", 25))]


def test_custom_sketch(spark):
    class Largest:
        cell, schema = ("one",), "one int, w double"

        def cells(self, df, keys, extra=()):
            return df.groupBy(*keys, F.lit(1).alias("one")).agg(F.max("float").alias("w"), F.count(F.lit(1)).alias("n"), *extra)

        def merge(self, cells, keys, extra=()):
            return cells.groupBy(*keys, "one").agg(F.max("w").alias("w"), F.sum("n").alias("n"), *extra)

    CUSTOM["Largest"] = lambda plan: Largest()
    try:
        plan = Plan(1, sketch_type="Largest", size_ms=10)
        parts = engine.run(plan, obs(spark, [(1, {}, 4.0)])).unionByName(engine.run(plan, obs(spark, [(2, {}, 6.0)])))
        assert [(r.w, r.n) for r in engine.merged_cells(plan, parts).collect()] == [(6.0, 2)]
    finally:
        del CUSTOM["Largest"]


def test_unreadable_payloads_are_set_aside(spark):
    for plan, bad in (
        (replace(P, transmit_sketch=True), [b"{not json", b'[{"sign":1,"bucket":2,"w":3},{"si', b'[{"sign":"x","bucket":2,"w":3}]', b'[{"a":1}]', b"[]", b"\xff\x00"]),
        (replace(P, transmit_sketch=True, encoding="MSGPACK"), [b"1:2", b"1:x:3;", b"1:2:3;1:2:3:4;", b";"]),
    ):
        e = engine.run(plan, obs(spark, [(1, {}, 1.0), (2, {}, 2.0)]))
        broken = [e.withColumn("payload", F.lit(b)).withColumn("count", F.lit(5 + k).cast("bigint")) for k, b in enumerate(bad)]
        both = e
        for b in broken:
            both = both.unionByName(b)
        both = both.unionByName(e.withColumn("payload", F.lit(None).cast("binary")))
        aside = engine.set_aside(plan, both).collect()
        assert sorted((r.problem, r["count"]) for r in aside) == [("unreadable_payload", 5 + k) for k in range(len(bad))]
        pick = lambda df: [(r["count"], bytes(r.payload)) for r in df.collect()]
        assert pick(engine.merge_envelopes(plan, both)) == pick(e)


def test_points_are_aggregated_by_hash(spark):
    rows = obs(spark, [(1, {"a": "x"}, 1.0), (2, {"a": "y"}, 2.0)])
    for kind in (DDSKETCH, HLL, COUNT_MIN, COUNT_SKETCH):
        plan = Plan(1, sketch_type=kind, size_ms=1000)
        text = engine.cells(plan, engine.admitted(plan, rows))._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in text and "HashAggregate" in text


def test_labels_with_the_same_text_stay_apart(spark):
    plan = Plan(1, sketch_type=HLL, size_ms=1000, transmit_sketch=False)
    rows = [(1, {"a": "x;b=y"}, ("h", 1)), (1, {"a": "x", "b": "y"}, ("h", 2)), (1, {"b": "y", "a": "x", "c": None}, ("h", 3)), (1, {"q": "a=1"}, ("h", 3))]
    got = {tuple(sorted(r.labels.items())): round(r.value) for r in engine.run(plan, obs(spark, rows)).collect()}
    assert got == {(("a", "x;b=y"),): 1, (("a", "x"), ("b", "y")): 2, (("q", "a=1"),): 1}


@pytest.mark.parametrize("kind,change", [(DDSKETCH, {"relative_accuracy": 0.02}), (HLL, {"precision": 10}), (COUNT_MIN, {"cols": 128}), (COUNT_SKETCH, {"rows": 5})])
@pytest.mark.parametrize("encoding", ["PROTO_FULL", "MSGPACK"])
def test_sketches_of_other_parameters_are_set_aside(spark, kind, change, encoding):
    plan = Plan(1, sketch_type=kind, size_ms=1000, encoding=encoding)
    e = engine.run(replace(plan, sketch_params=change), obs(spark, [(1, {}, 1.0)]))
    assert [r.problem for r in engine.set_aside(plan, e).collect()] == ["other_parameters"]
    assert engine.merge_envelopes(plan, e).count() == 0 and engine.merge_envelopes(replace(plan, sketch_params=change), e).count() == 1


def test_top_items(spark):
    s = Frequency(5, 256)
    df = spark.createDataFrame([(1, f"k{i % 7}") for i in range(70)] + [(1, "k1")] * 9 + [(2, "only"), (2, None), (2, "")], "g int, item string")
    got = s.top(s.cells(df, ["g"]), df.distinct(), ["g"], 2)
    assert sorted(map(tuple, got.select("g", "rank", "item", "estimate").collect())) == [(1, 1, "k1", 19.0), (1, 2, "k0", 10.0), (2, 1, "only", 1.0)]


def test_cap_of_a_runtime(spark):
    plan = Plan(1, size_ms=10_000, max_series=2)
    r = Runtime(spark, plan)
    r.process(obs(spark, [(5, {"k": "a"}, 1.0), (1, {"k": "b"}, 1.0)]), 0)
    r.process(obs(spark, [(2, {"k": "c"}, 1.0), (3, {"k": "a"}, 1.0), (10_001, {"k": "c"}, 1.0)]), 1)
    r.process(obs(spark, [(2, {"k": "c"}, 1.0), (3, {"k": "a"}, 1.0), (10_001, {"k": "c"}, 1.0)]), 1)
    got = r.tick(10_000).collect()
    assert sorted((x.labels["k"], x["count"]) for x in got) == [("a", 2), ("b", 1)] and r.stats.dropped_overflow == 1
    assert [(x.labels["k"], x["count"]) for x in r.drain().collect()] == [("c", 1)]
    r = Runtime(spark, replace(plan, overflow="EvictOldest"))
    r.process(obs(spark, [(5, {"k": "a"}, 1.0), (1, {"k": "b"}, 1.0)]), 0)
    r.process(obs(spark, [(7, {"k": "c"}, 1.0)]), 1)
    assert sorted((x.labels["k"], x["count"]) for x in r.tick(10_000).collect()) == [("a", 1), ("c", 1)] and r.stats.evicted_series == 1
    for bad in (lambda: engine.run(replace(plan, overflow="EvictOldest"), obs(spark, [])), lambda: watermarked(plan, obs(spark, []))):
        with pytest.raises(PlanError):
            bad()


def test_a_batch_tried_again_after_a_tick_counts_once(spark, tmp_path):
    r = Runtime(spark, Plan(1, size_ms=10_000))
    batch = obs(spark, [(5000, {}, 1.0), (15_000, {}, 1.0)])
    r.process(batch, 0)
    assert r.tick(10_000).first()["count"] == 1 and r.stats.last_emitted_envelopes == 1
    r.process(batch, 0)
    r.save(str(tmp_path / "s.json"))
    again = Runtime.restore(spark, str(tmp_path / "s.json"))
    again.process(batch, 0)
    assert [x["count"] for x in again.drain().collect()] == [1] and again.stats.input_observations == 2
