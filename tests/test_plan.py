import pytest

from gaugewell.errors import PlanError
from gaugewell.functions.matchers import LabelMatcher
from gaugewell.operators.engine import quantile_text
from gaugewell.plans import registry
from gaugewell.plans.plan import COUNT_MIN, DDSKETCH, HLL, KLL, Plan, PlanSet, clamp_shape, duration_ms, from_table, load, resolve


def test_defaults():
    p = Plan()
    assert p.transmit_sketch and (p.size_ms, p.max_series, p.allowed_lateness_ms) == (0, 0, 0)
    assert (p.alpha, p.k, p.precision, p.shape) == (0.01, 200, 12, (4, 2048))


@pytest.mark.parametrize("name", ["ddsketch", "DDSKETCH", "KllSketch", "hllsketch", "CountSketch", "countminsketch"])
def test_sketch_names_in_any_case(name):
    assert resolve({"sketch": name}).sketch_type.lower() == name.lower()


def test_resolve():
    p = resolve({"sketch": "KLLSketch", "window": "1m 30s", "sketch_params": {"k": 400, "note": "x"}, "allowed_lateness": "5s"})
    assert (p.size_ms, p.k, dict(p.sketch_params), p.allowed_lateness_ms, p.temporality) == (90_000, 400, {"k": 400.0}, 5000, 1)
    assert resolve({}).size_ms == 10_000
    for bad in ({"sketch": "Bogus"}, {"window": "0s"}, {"windw": "1s"}, {"window": "ten"}):
        with pytest.raises(PlanError):
            resolve(bad)
    with pytest.raises(PlanError, match="DDSketch"):
        resolve({"sketch": "Bogus"})


def test_parameters_that_make_no_sense_are_replaced():
    make = lambda kind, **p: Plan(sketch_type=kind, sketch_params=p)
    assert make(DDSKETCH, alpha=1.5).alpha == 0.01 and make(DDSKETCH, alpha=0.02).alpha == 0.02
    assert make(KLL, k=float("nan")).k == 200 and make(KLL, k=0.5).k == 200
    assert make(HLL, precision=30).precision == 18
    assert make(COUNT_MIN, rows=9, cols=1000).shape == (6, 1024)
    assert clamp_shape(99, 2048) == (5, 2048) and clamp_shape(0, 1) == (1, 1)


def test_estimates_that_would_be_empty_are_refused():
    for bad in (Plan(sketch_type=HLL, transmit_sketch=False),):
        assert bad.sketch_type == HLL
    for kw in ({"sketch_type": COUNT_MIN}, {"sketch_type": DDSKETCH}):
        with pytest.raises(PlanError):
            Plan(transmit_sketch=False, **kw)


def test_json_and_files(tmp_path):
    p = Plan(5, "m", size_ms=10, matchers=(LabelMatcher("a", "b", "NotEqual"),), aggregate_by=("x",), quantiles=(0.5,))
    assert Plan.from_json(p.to_json()) == p
    s = PlanSet((p, Plan(6)), 3)
    assert PlanSet.from_json(s.to_json()) == s
    with pytest.raises(PlanError):
        Plan.from_json('{"agg": 1}')
    (tmp_path / "a.toml").write_text('sketch = "HLLSketch"\nwindow = "10s"\n[sketch_params]\nprecision = 14\n')
    assert load(str(tmp_path / "a.toml")).precision == 14
    assert duration_ms("2h") == 7_200_000


def test_plan_sets():
    a, b = Plan(1), Plan(2)
    assert PlanSet((a, b)).update_for(b) == b and PlanSet((a,)).update_for(b) == a and PlanSet().update_for(b) == b
    assert PlanSet((a, b)).find(3) is None


def test_registry(spark):
    assert registry.validate(registry.SKETCHES_URN, {"sketch": "KLLSketch"}).sketch_type == KLL
    assert registry.create(spark, registry.SKETCHES_URN, {}).plan.size_ms == 10_000
    with pytest.raises(PlanError):
        registry.validate("urn:none", {})


def test_plans_of_a_table(spark):
    rows = [(1, "m", KLL, {"k": 100.0}, 10, 5, 3, ["a"], 7)] * 2 + [(2, None, None, None, None, None, None, None, None)]
    s = from_table(spark.createDataFrame(rows, "agg_id bigint, metric string, sketch_type string, sketch_params map<string,double>, size_ms bigint, slide_ms bigint, allowed_lateness_ms bigint, aggregate_by array<string>, max_series bigint"))
    assert [p.agg_id for p in s.plans] == [1, 2] and s.find(1).k == 100 and s.find(1).mode == "Sliding"


def test_quantile_texts():
    assert [quantile_text(q) for q in (0.5, 0.99, 1.0, 0.0, 1e-7)] == ["0.5", "0.99", "1", "0", "0.0000001"]
