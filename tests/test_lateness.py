import random
from collections import defaultdict

import pytest

from gaugewell.operators.lateness import LambdaViews, window_plans

PLANS = "agg_id bigint, metric string, size_ms bigint, slide_ms bigint, allowed_lateness_ms bigint, value int"
OBS = "obs_id bigint, timestamp_ms bigint, received_ms bigint, metric string, kind string, float double, value string"
PLAN_ROWS = [(1, "a", 100, 0, 50, 0), (2, "a", 100, 30, 500, 0), (3, "b", 40, 0, 0, 0), (4, "b", 10, 25, 5, 0), (5, None, 10, 0, 5, 0), (6, "a", None, 0, 5, 0), (1, "a", 100, 0, 50, 1)]


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ts = rng.choice([None, 0, -20, rng.randint(1, 3000), rng.randint(1, 3000), 1500, 1500])
        at = None if rng.random() < 0.02 else (ts or 0) + int(rng.expovariate(1 / 60)) - rng.choice([0, 0, 40])
        kind, value = rng.choice([("Float", rng.uniform(-5, 5)), ("Float", None), ("Float", float("nan")), ("Float", float("inf")), ("Bytes", 9e9)])
        row = (None if rng.random() < 0.03 else i, ts, at, rng.choice(["a", "a", "b", "c", None]), kind, value, "extra")
        out.append(row)
        if row[0] is not None:
            out += [(*row[:2], None if at is None else at + rng.randint(0, 700), *row[3:]) for _ in range(rng.choice([0, 0, 0, 1, 3]))]
    rng.shuffle(out)
    return out


def brute(data, plans, now=None):
    first, alone = {}, []
    for r in data:
        at = r[2] if r[2] is not None else r[1]
        if not r[1]:
            continue
        if r[0] is None:
            alone.append((r, at))
        elif r[0] not in first or at < first[r[0]][1]:
            first[r[0]] = (r, at)
    late, view = set(), defaultdict(list)
    for r, at in [*first.values(), *alone]:
        for agg, metric, size, slide, late_ms, _ in plans:
            if metric is None or metric != r[3] or not size:
                continue
            step = slide or size
            s = r[1] // step * step
            while s + size > r[1]:
                if s <= r[1]:
                    if late_ms and at > s + size + late_ms:
                        if now is None or at <= now:
                            late.add((agg, s, r[0]))
                    elif now is None or at <= now:
                        view[agg, s].append(r[5] if r[4] == "Float" and r[5] is not None and r[5] == r[5] else None)
                s -= step
    def one(vs):
        have = [v for v in vs if v is not None]
        return len(vs), len(have), min(have, default=None), max(have, default=None)
    return late, {k: one(v) for k, v in view.items()}


def view_of(df):
    out = {(r.agg_id, r.window_start_ms): (r.n_obs, r.n_values, r.min_value, r.max_value) for r in df.collect()}
    return out


@pytest.mark.parametrize("interval", [700, 100_000])
def test_replay_against_brute_force(spark, interval):
    data = rows(400, 4)
    plans = window_plans(spark.createDataFrame(PLAN_ROWS, PLANS))
    assert len(plans) == 4
    views = LambdaViews(spark, plans, interval)
    views.ingest(spark.createDataFrame(data, OBS))
    late, view = brute(data, PLAN_ROWS[:6])
    views.replay()
    assert {tuple(r) for r in views.late().collect()} == late and late
    assert view_of(views.serve()) == view


def test_view_between_runs_has_the_fast_increments(spark):
    data = rows(300, 7)
    views = LambdaViews(spark, window_plans(spark.createDataFrame(PLAN_ROWS, PLANS)), 700)
    views.ingest(spark.createDataFrame(data, OBS))
    for r in range(-1, 3):
        views.run(r)
    for now in (1400, 1750):
        assert view_of(views.serve(now)) == brute(data, PLAN_ROWS[:6], now)[1]
    with pytest.raises(ValueError):
        views.run(2)


def test_no_rows_and_no_plans(spark):
    plans = window_plans(spark.createDataFrame(PLAN_ROWS, PLANS))
    for p, d in ((plans, []), ([], rows(20, 1))):
        views = LambdaViews(spark, p, 700)
        views.ingest(spark.createDataFrame(d, OBS))
        views.replay()
        assert views.late().collect() == [] and views.serve().collect() == []


def test_stream(spark, tmp_path):
    data = [(1, 10, 12, "b", "Float", 1.0, ""), (2, 50, 55, "b", "Float", 3.0, ""), (3, 11, 60, "b", "Float", 5.0, "")]
    spark.createDataFrame(data, OBS).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame([data[2], (4, 12, 90, "b", "Bytes", None, "")], OBS).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    views = LambdaViews(spark, window_plans(spark.createDataFrame(PLAN_ROWS[2:3], PLANS)), 700, str(tmp_path / "views"))
    source = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = views.fast_stream(source).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = LambdaViews.merge(spark.read.parquet(f"{views.folder}/fast/batch=*"))
    assert view_of(got) == {(3, 0): (3, 2, 1.0, 5.0), (3, 40): (1, 1, 3.0, 3.0)}


def test_stream_then_runs_and_views(spark, tmp_path):
    data = rows(300, 11)
    assert any(r[0] is None for r in data)
    for k in range(4):
        spark.createDataFrame(data[k::4], OBS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    views = LambdaViews(spark, window_plans(spark.createDataFrame(PLAN_ROWS, PLANS)), 700, str(tmp_path / "views"))
    source = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    views.fast_stream(source).trigger(availableNow=True).start().awaitTermination(240)
    assert view_of(views.serve(1400)) == brute(data, PLAN_ROWS[:6], 1400)[1]
    for r in range(-1, 3):
        views.run(r)
    assert view_of(views.serve(1750)) == brute(data, PLAN_ROWS[:6], 1750)[1]
    views.replay()
    late, view = brute(data, PLAN_ROWS[:6])
    assert {tuple(r) for r in views.late().collect()} == late and late
    assert view_of(views.serve()) == view


def test_what_is_ingested_after_its_run(spark):
    data = rows(300, 5)
    views = LambdaViews(spark, window_plans(spark.createDataFrame(PLAN_ROWS, PLANS)), 700)
    views.ingest(spark.createDataFrame(data[::3], OBS))
    for r in range(-1, 4):
        views.run(r)
    frozen = {(a, s) for a, _, size, _, late, _ in PLAN_ROWS[:4] for s in range(-600, 3000) if late and s + size + late <= 3 * 700}
    views.ingest(spark.createDataFrame(data[1::3], OBS))
    views.ingest(spark.createDataFrame(data[2::3], OBS))
    assert view_of(views.serve(2400)) == brute(data, PLAN_ROWS[:6], 2400)[1]
    views.run(4)
    amended = views.amended().collect()
    assert amended and {(r.agg_id, r.window_start_ms) for r in amended} <= frozen
    before, after = (sum(v[0] for k, v in brute(d, PLAN_ROWS[:6])[1].items() if k in frozen) for d in (data[::3], data))
    assert len(amended) == after - before
    views.replay()
    late, view = brute(data, PLAN_ROWS[:6])
    assert {tuple(r) for r in views.late().collect()} == late and late
    assert view_of(views.serve()) == view
    views.ingest(spark.createDataFrame([(9999, 1500, 1510, "b", "Float", 9.0, "")], OBS))
    assert view_of(views.replay().serve()) == brute([*data, (9999, 1500, 1510, "b", "Float", 9.0, "")], PLAN_ROWS[:6])[1]
    with pytest.raises(ValueError):
        LambdaViews(spark, [], 700, views.folder, done=[1])


def test_runs_are_only_those_with_arrivals_and_times_at_the_ends(spark):
    top = (1 << 63) - 1
    data = [
        (1, 1_500, None, "a", "Float", 1.0, ""), (2, 1_772_500_000_000, 1_772_500_000_500, "a", "Float", 2.0, ""),
        (3, top, 1_772_500_000_500, "b", "Float", 3.0, ""), (4, -top - 1, 1_772_500_000_500, "b", "Float", 4.0, ""), (5, top - 5, top, "a", "Float", 5.0, ""),
    ]
    views = LambdaViews(spark, window_plans(spark.createDataFrame(PLAN_ROWS, PLANS)), 86_400_000)
    views.ingest(spark.createDataFrame(data, OBS))
    views.replay()
    assert len(views.done) == 3
    late, view = brute(data, PLAN_ROWS[:6])
    fits = lambda s: -top - 1 <= s <= top
    assert {tuple(r) for r in views.late().collect()} == {x for x in late if fits(x[1])}
    assert view_of(views.serve()) == {k: v for k, v in view.items() if fits(k[1])}
