import math
import random
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hash60
from gaugewell.llm.distinct import KSmallest
from gaugewell.llm.frequent import FrequentItems
from gaugewell.llm.percentiles import Bisection, ordered, value_of

VALUES = [0.0, -0.0, 1.0, -1.0, 1.5, 2.0, math.nextafter(2, 0), math.nextafter(2, 3), 1e308, 1.7976931348623157e308, 2.2250738585072014e-308, 5e-324, 1e-310, 0.1, 1 / 3, 1e15, 2.0**52, float("inf"), float("-inf"), -5e-324, 8.0, math.nextafter(8, 0)]


def test_ordered_integers_are_the_bits(spark):
    rng = random.Random(2)
    vs = VALUES + [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    vs = [v for v in vs if v == v]
    df = spark.createDataFrame([(v,) for v in [*vs, float("nan"), None]], "v double")
    for r in df.select("v", ordered(F.col("v")).alias("k"), value_of(ordered(F.col("v"))).alias("w")).collect():
        if r.v is None or r.v != r.v:
            assert r.k is None
        else:
            bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
            assert r.k == (-bits if r.v < 0 else bits), r.v
            assert r.w == r.v


ROWS = "obs_id bigint, metric string, labels string, x double, _part string, n int, q int, total int"


def samples(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = rng.choice([None, float("nan"), rng.choice(VALUES), rng.gauss(0, 5), rng.gauss(0, 5), 3.25, float(rng.randint(0, 9))])
        g = rng.choice(["a", "a", "a", "b", None])
        row = (i if rng.random() < 0.9 else None, g, rng.choice(["", "x", None]), x, rng.choice(["d1", "d2", None]), 1, 2, 3)
        out += [row] * (rng.choice([1, 1, 1, 3]) if row[0] is not None else 1)
    return out


def brute(rows, permille):
    seen, groups = set(), defaultdict(list)
    for r in rows:
        if r[3] is None or r[3] != r[3] or (r[0] is not None and r[0] in seen):
            continue
        seen.add(r[0])
        groups[r[1], r[2]].append(r[3] + 0.0)
    return {(*g, len(v), q): sorted(v)[max(-(-q * len(v) // 1000), 1) - 1] for g, v in groups.items() for q in permille}


@pytest.mark.parametrize("first,bits", [(20, 16), (7, 20)])
def test_percentiles(spark, first, bits):
    rows, permille = samples(1500, 6), [0, 1, 250, 500, 999, 1000]
    df = spark.createDataFrame(rows, ROWS)
    b = Bisection(df, ["metric", "labels"], "x", permille, "obs_id", "_part", first, bits)
    want = brute(rows, permille)
    assert {(r.metric, r.labels, r.n, r.q): r.value for r in b.exact().collect()} == want
    # Partial counts of two halves of the days add up to the same, and bound the exact value.
    p = b.partials()
    assert b.merge(p.where("_part = 'd1'").unionByName(p.where("_part <> 'd1' or _part is null"))).exceptAll(b.merge(p)).count() == 0
    got = {(r.metric, r.labels, r.n, r.q): (r.low, r.high) for r in b.bounds(b.merge(p)).collect()}
    assert got.keys() == want.keys()
    for k, (low, high) in got.items():
        assert low <= want[k] <= high
        if first == 20 and 1e-300 < abs(want[k]) < float("inf"):
            assert high - low <= abs(want[k]) * 2**-8 * 1.01


def test_a_halving_a_pass(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (9.5,)], "x double")
    (r,) = Bisection(df, [], "x", [500], first_bits=1, bits=9).exact().collect()
    assert (r.n, r.value) == (4, 2.0)


def test_no_values(spark):
    df = spark.createDataFrame([(1, "a", "", None, "d", 1, 1, 1)], ROWS)
    b = Bisection(df, ["metric"], "x", [500], "obs_id")
    assert b.exact().collect() == [] and b.bounds(b.merge(b.partials())).collect() == []


def test_distinct_counts(spark):
    ks, rng = KSmallest(k=256), random.Random(1)
    sizes = {"a": 20_000, "b": 255, "c": 256, None: 3000}
    rows = [(g, rng.choice(["d1", "d2"]), i, 5) for g, n in sizes.items() for i in range(n) for _ in range(rng.choice([1, 1, 2]))] + [("z", "d1", None, 5)]
    df = spark.createDataFrame(rows, "g string, day string, id bigint, h int")
    whole = {r.g: r for r in ks.estimate(ks.sketch(df, ["g"], "id"), ["g"]).collect()}
    assert set(whole) == set(sizes)
    assert (whole["b"].estimate, whole["b"].low, whole["b"].high) == (255, 255, 255)
    for g in ("a", "c", None):
        assert abs(whole[g].estimate / sizes[g] - 1) < 4 / math.sqrt(254) and whole[g].low < whole[g].estimate < whole[g].high
    merged = ks.merge(ks.sketch(df, ["g", "day"], "id"), ["g"])
    assert {r.g: r.estimate for r in ks.estimate(merged, ["g"]).collect()} == {g: r.estimate for g, r in whole.items()}
    assert ks.estimate(ks.sketch(df.limit(0), ["g"], "id"), ["g"]).collect() == []


def test_set_operations(spark):
    ks = KSmallest(k=1024)
    make = lambda lo, hi, g: [(g, i) for i in range(lo, hi)]
    left = spark.createDataFrame(make(0, 30_000, "x") + make(0, 50, "y") + make(0, 9, "only"), "g string, id bigint")
    right = spark.createDataFrame(make(10_000, 50_000, "x") + make(40, 80, "y"), "g string, id bigint")
    got = {(r.g, r.op): r for r in ks.compare(ks.sketch(left, ["g"], "id"), ks.sketch(right, ["g"], "id"), ["g"]).collect()}
    for op, n in (("union", 50_000), ("intersection", 20_000), ("left_only", 10_000), ("right_only", 20_000)):
        r = got["x", op]
        assert r.low <= r.estimate <= r.high and r.estimate - 2.2 * (r.high - r.estimate) <= n <= r.estimate + 2.2 * (r.high - r.estimate)
    assert [(got["y", op].estimate, got["y", op].low, got["y", op].high) for op in ("union", "intersection", "left_only", "right_only")] == [(80,) * 3, (10,) * 3, (40,) * 3, (30,) * 3]
    assert got["only", "left_only"].estimate == 9 and got["only", "intersection"].high == 0


def test_an_item_at_the_very_threshold(spark):
    df = spark.createDataFrame([(i, "a", b"hot" if i < 7 else f"u{i}".encode()) for i in range(100)], "obs_id bigint, g string, b binary")
    assert 100 * 0.07 > 7 and [r["count"] for r in FrequentItems(df, "g", "b").find(0.07).collect()] == [7]


def test_frequent_items(spark):
    rng = random.Random(4)
    rows = []
    for i in range(20_000):
        g = rng.choice(["a", "a", "b", None])
        item = rng.choice([b"hot", f"w{int(rng.paretovariate(0.8))}".encode(), f"u{i}".encode(), f"u{i}".encode()])
        row = (i if rng.random() < 0.98 else None, g, rng.choice([item] * 30 + [None, b"", b"\xff\x00"]), 1, 2)
        rows += [row] * (rng.choice([1, 1, 4]) if row[0] is not None else 1)
    df = spark.createDataFrame(rows, "obs_id bigint, g string, b binary, count int, total int")
    for share, ids in ((0.02, "obs_id"), (0.005, "obs_id"), (0.01, None)):
        seen, counts = set(), defaultdict(Counter)
        for i, g, b, _, _ in rows:
            if b and not (ids and i is not None and i in seen):
                counts[g][b] += 1
            seen.add(i)
        want = {(g, b, n, sum(c.values())) for g, c in counts.items() for b, n in c.items() if n >= share * sum(c.values())}
        f = FrequentItems(df, "g", "b", ids)
        assert {(r.g, bytes(r.b), r["count"], r.total) for r in f.find(share).collect()} == want and want
    # Sketches of halves merge to that of the whole.
    half = [FrequentItems(df.where(f"obs_id % 2 = {k}"), "g", "b", "obs_id") for k in (0, 1)]
    whole = FrequentItems(df.where("obs_id is not null"), "g", "b", "obs_id")
    merged = FrequentItems.merge(*[h.sketch() for h in half])
    assert merged.exceptAll(whole.sketch()).count() == 0
    assert FrequentItems(df.limit(0), "g", "b", "obs_id").find(0.02).collect() == []


def test_day_to_day_has_the_combinations(spark, tmp_path):
    from gaugewell.llm.queries import p3_day_to_day

    rows = [("m", d * 86_400_000 + 5, "Hash", {"a": x, "b": y}, i) for d, x, y, i in [(1, "1", "1", 7), (1, "1", "1", 8), (2, "1", "1", 8), (2, "1", "2", 9), (3, "1", "1", 8)]]
    spark.createDataFrame(rows, "metric string, timestamp_ms bigint, kind string, labels map<string,string>, hash bigint").write.parquet(f"{tmp_path}/observations.parquet")
    spark.createDataFrame([(4, "m", "HLLSketch")], "agg_id bigint, metric string, sketch_type string").write.parquet(f"{tmp_path}/plan_configs.parquet")
    got = p3_day_to_day(spark, str(tmp_path)).where("agg_id = 4 and level = 'combination' and op in ('union', 'intersection')").collect()
    one, two = "a=1;b=1;", "a=1;b=2;"
    want = {(0, one): (2, 0), (1, one): (2, 1), (2, one): (1, 1), (3, one): (1, 0), (1, two): (1, 0), (2, two): (1, 0)}
    assert {(r.day, r.labels, r.op): r.estimate for r in got} == {(*k, op): v[n] for k, v in want.items() for n, op in enumerate(("union", "intersection"))}


def test_percentiles_of_a_hot_value_and_of_many_groups(spark):
    rng = random.Random(8)
    data = [(f"g{i % 50}" if i % 3 else None, 0.0 if i % 2 else rng.choice([rng.gauss(0, 1), 1 + rng.random() / 1000, float("inf")])) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v double")
    for first, bits in ((20, 16), (4, 20), (24, 20)):
        got = {(r.g, r.q): (r.n, r.v) for r in Bisection(df, ["g"], "v", [1, 500, 999, 1000], first_bits=first, bits=bits).exact().withColumnRenamed("value", "v").collect()}
        for g in {g for g, _ in data}:
            vs = sorted(v for h, v in data if h == g)
            for q in (1, 500, 999, 1000):
                assert got[g, q] == (len(vs), vs[max(-(-q * len(vs) // 1000), 1) - 1])


def test_large_groups_are_trimmed_exactly(spark, monkeypatch):
    from gaugewell.llm import distinct

    data = [(f"g{i % 3}" if i % 5 else None, i % 4000) for i in range(12000)]
    df = spark.createDataFrame(data, "g string, v bigint")
    ks = KSmallest(64)
    plain = {tuple(r) for r in ks.merge(df.select("g", hash60(F.col("v")).alias("h")), ["g"]).collect()}
    for left in (2, 0.5):  # with 0.5 every group comes out short and is done again
        monkeypatch.setattr(distinct, "LEFT", left)
        assert {tuple(r) for r in ks.sketch(df, ["g"], "v").collect()} == plain


def test_frequent_items_at_small_shares_and_in_several_scans(spark, monkeypatch):
    from gaugewell.llm import frequent

    rng = random.Random(9)
    data = [("m", f"hot{i}".encode()) for i in range(40) for _ in range(20)] + [("m", str(rng.random()).encode()) for _ in range(19200)]
    df = spark.createDataFrame(data, "g string, item binary")
    monkeypatch.setattr(frequent, "MOST_AT_ONCE", 7)
    got = FrequentItems(df, "g", "item", least_share=0.001).find(0.001).collect()
    assert {bytes(r["item"]) for r in got} == {f"hot{i}".encode() for i in range(40)} and {r["count"] for r in got} == {20}
    with pytest.raises(ValueError):
        FrequentItems(df, "g", "item").find(0.001)
