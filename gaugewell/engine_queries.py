"""Queries of carriers, frames between tiers, configuration and the runtime, and the same in SQL."""

from __future__ import annotations

import json
import os
import tempfile
import time
from dataclasses import asdict, replace

from pyspark.sql import functions as F

from gaugewell.errors import ClosedError, GaugewellError
from gaugewell.functions.series import attributes_key
from gaugewell.operators import engine, windows
from gaugewell.operators.sketches import Frequency
from gaugewell.plans import plan as plans_
from gaugewell.plans import registry
from gaugewell.plans.plan import COUNT_MIN, COUNT_SKETCH, CUSTOM, HLL, KLL, Plan, PlanSet, from_table
from gaugewell.sketch_queries import _ASKED, _COUNT, _DD, _DD_PLAN, _EV, _HLL, _HLL_PLAN, _PATHS, DAY, _asked, _frequency_cells, _frequency_sql, _hll_sql, events, flat, visitors
from gaugewell.sketch_queries import SQL as _OTHERS
from gaugewell.sources import points, records
from gaugewell.storage import local_table, table, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return note


# Carriers: sketches inside flat batches and sibling tables

def carried(spark, sf_dir):
    """The sketch envelopes as a flat batch, some with names that nobody knows."""
    e = table(spark, sf_dir, "sketch_envelopes")
    odd = F.when(F.col("agg_id") == 103, "Bogus").when(F.col("agg_id") != 104, F.col("sketch_type"))
    return e.select(
        (F.col("window_end_ms") * 1_000_000).alias("time_unix_nano"), F.col("metric_name").alias("metric"), "value", F.col("payload").alias("_sk_envelope"), odd.alias("_sk_sketch_type"),
        F.col("agg_id").alias("_sk_agg_id"), F.col("schema_version").alias("_sk_schema_version"), F.col("window_start_ms").alias("_sk_window_start_ms"), F.col("window_end_ms").alias("_sk_window_end_ms"),
        F.when(F.col("agg_id") == 105, "GZIP").otherwise(F.col("encoding")).alias("_sk_encoding"), F.col("labels")["quantile"].alias("quantile"), F.col("count").alias("count"),
    )


@query("""SELECT CASE WHEN payload IS NULL THEN 'Float' ELSE 'Envelope' END AS kind, CASE WHEN payload IS NULL THEN coalesce(value, 0.0) END AS float, payload, CASE WHEN payload IS NOT NULL THEN window_start_ms END AS start_ms,
CASE WHEN payload IS NULL THEN NULL WHEN agg_id = 103 THEN NULL WHEN agg_id = 104 THEN 'Unspecified' ELSE sketch_type END AS sketch_type,
CASE WHEN payload IS NOT NULL AND agg_id <> 105 THEN encoding END AS encoding,
CASE WHEN payload IS NULL THEN NULL WHEN agg_id = 103 THEN 'unknown_sketch_type' WHEN agg_id = 105 THEN 'unknown_encoding' END AS problem FROM sketch_envelopes""")
def decode_carriers(spark, sf_dir):
    """Carried sketches and scalars of one batch; unknown names are set aside with a reason, missing ones are open."""
    d = points.decode(carried(spark, sf_dir), strict=False)
    return d.select("kind", "float", F.col("envelope.payload").alias("payload"), F.col("envelope.window_start_ms").alias("start_ms"), F.col("envelope.sketch_type").alias("sketch_type"), F.col("envelope.encoding").alias("encoding"), "problem")


@query("SELECT unnest(['event_type', 'tier', 'unit']) AS label")
def reserved_columns(spark, sf_dir):
    """The columns of a batch that are labels: text, and not one of the reserved names."""
    batch = flat(spark, sf_dir).select("*", F.lit("x").alias("_sk_encoding"), F.lit("x").alias("_sk_sketch_type"), F.lit("ms").alias("unit"), F.lit(1.5).alias("number"))
    return local_table(spark, [(n,) for n in points.label_columns(batch)], "label string")


@query(_EV + """SELECT event_id, 'Float' AS kind, value AS float, NULL::BIGINT AS hash, NULL::BLOB AS bytes FROM e UNION ALL SELECT event_id, 'Hash', NULL, user_id, NULL FROM e
UNION ALL SELECT event_id, 'Bytes', NULL, NULL, event_type::BLOB FROM e""")
def observation_kinds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = None
    for kind, value in (("Float", F.col("value")), ("Hash", F.col("user_id")), ("Bytes", F.col("event_type"))):
        made = e.select("event_id", *points.observation(F.lit(1), F.lit("events"), value, kind))
        out = made if out is None else out.unionByName(made)
    return out.select("event_id", "kind", "float", "hash", "bytes")


_WIDE = """SELECT window_end_ms * 1000000 AS time_unix_nano, metric_name AS metric, value, payload AS _sk_envelope, sketch_type AS _sk_sketch_type, agg_id AS _sk_agg_id, schema_version AS _sk_schema_version,
window_start_ms AS _sk_window_start_ms, window_end_ms AS _sk_window_end_ms, encoding AS _sk_encoding, labels['quantile'] AS quantile, labels['sample_count'] AS sample_count FROM sketch_envelopes"""


@query(_WIDE)
def encode_union(spark, sf_dir):
    """Envelopes as a flat batch whose label columns are those that the envelopes have."""
    return points.encode(table(spark, sf_dir, "sketch_envelopes"))


@query(_WIDE.replace(", labels['quantile'] AS quantile, labels['sample_count'] AS sample_count", "") + " WHERE false")
def encode_nothing(spark, sf_dir):
    return points.encode(table(spark, sf_dir, "sketch_envelopes").where("agg_id < 0"))


@query("SELECT metric_name AS metric, value, window_end_ms * 1000000 AS time_unix_nano, count, payload AS _sk_envelope, agg_id AS _sk_agg_id, window_start_ms AS _sk_window_start_ms, encoding AS _sk_encoding, labels['quantile'] AS quantile FROM sketch_envelopes WHERE agg_id NOT IN (105)")
def carriers_roundtrip(spark, sf_dir):
    """Carriers and labels taken apart into attribute rows (by type: bytes, text, numbers) and put back together."""
    batch = carried(spark, sf_dir).where("_sk_agg_id <> 105")
    metrics, attributes = records.lift(batch)
    # text of metrics stays text; the metric's own columns stay with the metrics
    out = records.flatten(metrics, attributes)
    return out.select("metric", "value", "time_unix_nano", "count", "_sk_envelope", "_sk_agg_id", "_sk_window_start_ms", "_sk_encoding", "quantile")


@query(_EV + "SELECT event_id, 'events' AS metric, value, user_id, event_type, tier FROM e")
def flatten_all(spark, sf_dir):
    """All text attributes as columns, the last row of a repeated key holding, found by an order column."""
    metrics, attributes = records.lift(flat(spark, sf_dir), "event_id")
    new = attributes.withColumn("at", F.lit(2))
    old = attributes.select("parent_id", "key", "bytes", F.concat(F.lit("zz-"), "str").alias("str"), "int").withColumn("at", F.lit(1))
    return records.flatten(metrics, new.unionByName(old), None, "at").select("event_id", "metric", "value", "user_id", "event_type", "tier")


@query(_EV + "SELECT row_number() OVER (ORDER BY event_id) - 1 AS parent_id, event_id, 'events' AS metric, value, user_id FROM e")
def lift_metrics(spark, sf_dir):
    return records.lift(flat(spark, sf_dir), "event_id")[0].select("parent_id", "event_id", "metric", "value", "user_id")


# Frames between tiers

@query(_EV + "SELECT event_type, day AS window_start_ms, count(*) AS count FROM e WHERE event_type NOT IN ('click') GROUP BY ALL")
def empty_sketches(spark, sf_dir):
    """A series whose points are all NaN has an empty sketch, which isn't sent."""
    rows = events(spark, sf_dir).withColumn("float", F.when(F.col("labels")["event_type"] == "click", F.lit(float("nan"))).otherwise(F.col("float")))
    return engine.run(replace(_DD_PLAN, transmit_sketch=True), rows).select(F.col("labels")["event_type"].alias("event_type"), "window_start_ms", "count")


_EDGE = replace(_DD_PLAN, omit_resource=False, transmit_sketch=True, quantiles=())


@query(_DD + "SELECT '7||event_type=' || event_type || ';' AS series, day + 86400000 AS window_start_ms, sign, bucket, w FROM c")
def merge_by_end(spark, sf_dir):
    """Sketches of each host in the window that holds their own window's end."""
    return engine.merged_cells(_DD_PLAN, engine.run(_EDGE, events(spark, sf_dir)), by_end=True).select("series", "window_start_ms", "sign", "bucket", "w")


@query(_OTHERS["dd_quantiles"])
def delta_merge(spark, sf_dir):
    """Full and delta frames of each host, in the compact form, merged centrally to the estimates of one pass."""
    out = engine.merge_envelopes(_DD_PLAN, engine.run(replace(_EDGE, delta=True, encoding="MSGPACK"), events(spark, sf_dir)))
    return out.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["quantile"].alias("quantile"), "window_start_ms", "window_end_ms", F.round("value", 6).alias("value"), "count")


@query(_HLL + _hll_sql("event_type, day") + f"SELECT event_type, day AS window_start_ms, round({_COUNT}, 4) AS value FROM s")
def hll_merge_two_tier(spark, sf_dir):
    edge = replace(_HLL_PLAN, omit_resource=False, transmit_sketch=True, delta=True)
    out = engine.merge_envelopes(_HLL_PLAN, engine.run(edge, visitors(spark, sf_dir)))
    return out.select(F.col("labels")["event_type"].alias("event_type"), "window_start_ms", F.round("value", 4).alias("value"))


def _items_sql(rows: int, cols: int, signed: bool) -> str:
    sign = "((h >> 20) & 1) * 2 - 1" if signed else "1"
    return _EV + f""", i AS (SELECT event_type, day, labels AS item, count(*)::DOUBLE AS n FROM e GROUP BY ALL),
h AS (SELECT *, ('0x' || substr(md5(r || '|' || item), 1, 15))::BIGINT AS h FROM i, (SELECT unnest(range({rows})) AS r))
SELECT '7||event_type=' || event_type || ';' AS series, day AS window_start_ms, r::INT AS row, (h & {cols - 1})::INT AS col, sum(n * ({sign}))::DOUBLE AS w FROM h GROUP BY ALL HAVING sum(n * ({sign})) <> 0"""


def _merged_frequencies(spark, sf_dir, kind, encoding, **params):
    plan = Plan(7, "events", kind, params, size_ms=DAY, omit_resource=True, aggregate_by=("event_type",))
    edge = replace(plan, omit_resource=False, delta=True, encoding=encoding)
    return engine.merged_cells(plan, engine.run(edge, events(spark, sf_dir))).where("w <> 0").select("series", "window_start_ms", "row", "col", "w")


@query(_items_sql(4, 2048, False))
def cms_merge_two_tier(spark, sf_dir):
    """Count-Min sketches of each host as payloads, merged centrally."""
    return _merged_frequencies(spark, sf_dir, COUNT_MIN, "PROTO_FULL", rows=4, cols=2048)


@query(_items_sql(4, 2048, True))
def cs_merge_two_tier(spark, sf_dir):
    return _merged_frequencies(spark, sf_dir, COUNT_SKETCH, "MSGPACK", rows=4, cols=2048)


@query(_items_sql(6, 1024, False))
def frequency_clamped(spark, sf_dir):
    """9 rows of 1000 columns become 6 of 1024: a power of two, and rows within the bits of one hash."""
    return _merged_frequencies(spark, sf_dir, COUNT_MIN, "PROTO_FULL", rows=9, cols=1000)


@query(_frequency_sql(True) + "SELECT day AS window_start_ms, row, sum(w) AS l1, sum(w * w) AS l2 FROM c GROUP BY ALL")
def cs_norms(spark, sf_dir):
    return Frequency(signed=True).norms(_frequency_cells(spark, sf_dir, COUNT_SKETCH), ["window_start_ms"])


@query(_frequency_sql(False) + _ASKED + """, t AS (SELECT day AS window_start_ms, item, min(w) AS estimate FROM x GROUP BY ALL HAVING min(w) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY window_start_ms ORDER BY estimate DESC, item)::INT AS rank FROM t) SELECT * FROM r WHERE rank <= 10""")
def cms_top(spark, sf_dir):
    """The ten candidates of each day with the greatest estimates."""
    return Frequency().top(_frequency_cells(spark, sf_dir, COUNT_MIN), _asked(spark, sf_dir), ["window_start_ms"], 10)


@query(_DD.split(", c AS")[0] + "SELECT event_type, day AS window_start_ms, 'PROTO_FULL' AS encoding, count(*) AS count FROM e GROUP BY ALL")
def kll_frames(spark, sf_dir):
    """KLL frames are full ones even where deltas are asked for."""
    plan = replace(_DD_PLAN, sketch_type=KLL, transmit_sketch=True, quantiles=(), delta=True)
    return engine.run(plan, events(spark, sf_dir)).select(F.col("labels")["event_type"].alias("event_type"), "window_start_ms", "encoding", "count")


_RANKS = _EV + "SELECT event_type, q AS quantile, {} true AS within FROM (SELECT DISTINCT event_type {} FROM e), (SELECT unnest(['0.5', '0.9', '0.99']) AS q)"


def _within(spark, sf_dir, est, keys):
    """Whether the estimates' ranks are within 2.65 percent (k = 200, 99 percent confidence) of those asked for."""
    e = events(spark, sf_dir).select(F.col("labels")["event_type"].alias("event_type"), (F.floor(F.col("timestamp_ms") / DAY) * DAY).cast("bigint").alias("window_start_ms"), F.col("float").alias("v"))
    got = e.join(est, keys).groupBy(*keys, "quantile", "value").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("v") < F.col("value")).cast("int")).alias("below"), F.sum((F.col("v") <= F.col("value")).cast("int")).alias("upto"))
    q, slack = F.col("quantile").cast("double"), 0.0265 * F.col("n") + 1
    return got.select(*keys, "quantile", ((F.col("below") <= q * F.col("n") + slack) & (F.col("upto") >= q * F.col("n") - slack)).alias("within"))


@query(_RANKS.format("day AS window_start_ms,", ", day"))
def kll_quantiles_bounded(spark, sf_dir):
    """Daily KLL quantiles of every event type: each within the stated rank error."""
    plan = replace(_DD_PLAN, sketch_type=KLL, sketch_params={"k": 200}, quantiles=(0.5, 0.9, 0.99))
    est = engine.run(plan, events(spark, sf_dir)).select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["quantile"].alias("quantile"), "window_start_ms", "value")
    return _within(spark, sf_dir, est, ["event_type", "window_start_ms"])


@query(_RANKS.format("day AS window_start_ms,", ", day"))
def kll_merge_bounded(spark, sf_dir):
    """KLL payloads of each host, merged centrally: still within the rank error."""
    plan = replace(_DD_PLAN, sketch_type=KLL, sketch_params={"k": 200}, quantiles=(0.5, 0.9, 0.99))
    sent = engine.run(replace(plan, omit_resource=False, transmit_sketch=True), events(spark, sf_dir))
    est = engine.merge_envelopes(plan, sent).select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["quantile"].alias("quantile"), "window_start_ms", "value")
    return _within(spark, sf_dir, est, ["event_type", "window_start_ms"])


@query(_DD.split(", c AS")[0] + """SELECT p AS problem, count(*) AS n FROM (SELECT DISTINCT event_type, day FROM e), (SELECT unnest(['other_parameters', NULL, 'unreadable_payload']) AS p) GROUP BY ALL""")
def merge_mismatch(spark, sf_dir):
    """Sketches of another accuracy and broken payloads are set aside, those that fit are taken."""
    fine = engine.run(replace(_DD_PLAN, transmit_sketch=True), events(spark, sf_dir))
    other = engine.run(replace(_DD_PLAN, transmit_sketch=True, sketch_params={"relative_accuracy": 0.02}), events(spark, sf_dir))
    broken = fine.withColumn("payload", F.substring("payload", 1, 20))
    return engine.admission(_DD_PLAN, fine.unionByName(other).unionByName(broken), payloads=True).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# Configuration

_JUNK = {"note": "x", "on": True}


@query("""SELECT agg_id, sketch_type, size_ms, coalesce(sketch_params['relative_accuracy'], 0.01) AS alpha, coalesce(sketch_params['k'], 200)::BIGINT AS k, coalesce(sketch_params['precision'], 12)::BIGINT AS precision,
coalesce(sketch_params['rows'], 4)::BIGINT AS rows, coalesce(sketch_params['cols'], 2048)::BIGINT AS cols, 1::BIGINT AS temporality FROM plan_configs""")
def plans_resolved(spark, sf_dir):
    """The plans as users write them (names in any case, durations as text, parameters that are none), by the processor's
    URN and through TOML."""
    out = []
    for p in from_table(table(spark, sf_dir, "plan_configs")).plans:
        params = "\n".join(f"{k} = {json.dumps(v)}" for k, v in {**p.sketch_params, **_JUNK}.items())
        text = f'agg_id = {p.agg_id}\nsketch = "{p.sketch_type.lower()}"\nwindow = "{p.size_ms // 1000}s"\nallowed_lateness = "{p.allowed_lateness_ms}ms"\n[sketch_params]\n{params}\n'
        with tempfile.NamedTemporaryFile("w", suffix=".toml", delete=False) as f:
            f.write(text)
        got = plans_.load(f.name)
        os.unlink(f.name)
        assert got == registry.validate(registry.SKETCHES_URN, {"agg_id": p.agg_id, "sketch": p.sketch_type.upper(), "window": f"{p.size_ms}ms", "allowed_lateness": p.allowed_lateness_ms, "sketch_params": {**p.sketch_params, **_JUNK}})
        out.append((got.agg_id, got.sketch_type, got.size_ms, got.alpha, got.k, got.precision, *got.shape, got.temporality))
    return local_table(spark, out, "agg_id bigint, sketch_type string, size_ms bigint, alpha double, k bigint, precision bigint, rows bigint, cols bigint, temporality bigint")


@query("SELECT agg_id, metric, sketch_type, size_ms, slide_ms, allowed_lateness_ms, aggregate_by, max_series FROM plan_configs")
def plans_as_json(spark, sf_dir):
    back = PlanSet.from_json(PlanSet(from_table(table(spark, sf_dir, "plan_configs")).plans, 3).to_json())
    rows = [(p.agg_id, p.matchers[0].value, p.sketch_type, p.size_ms, p.slide_ms, p.allowed_lateness_ms, list(p.aggregate_by), p.max_series) for p in back.plans]
    return local_table(spark, rows, "agg_id bigint, metric string, sketch_type string, size_ms bigint, slide_ms bigint, allowed_lateness_ms bigint, aggregate_by array<string>, max_series bigint")


@query("""SELECT agg_id, CASE sketch_type WHEN 'DDSketch' THEN 'DDSketch' WHEN 'KLLSketch' THEN 'Kll' WHEN 'HLLSketch' THEN 'HyperLogLog' ELSE 'Frequency' END AS operator, sketch_type = 'CountSketch' AS signed FROM plan_configs""")
def plan_dispatch(spark, sf_dir):
    rows = [(p.agg_id, type(s).__name__, bool(getattr(s, "signed", False))) for p in from_table(table(spark, sf_dir, "plan_configs")).plans for s in [engine.sketch_of(p)]]
    return local_table(spark, rows, "agg_id bigint, operator string, signed boolean")


_FAULTS = {
    "unknown sketch": ("PlanError", lambda: plans_.resolve({"sketch": "Bloom"})), "unknown setting": ("PlanError", lambda: plans_.resolve({"sketch": "ddsketch", "colour": 1})),
    "no window": ("PlanError", lambda: plans_.resolve({"sketch": "ddsketch", "window": "0s"})), "no duration": ("PlanError", lambda: plans_.duration_ms("soon")),
    "unknown processor": ("PlanError", lambda: registry.validate("urn:other", {})), "nothing to emit": ("PlanError", lambda: Plan(sketch_type=COUNT_MIN, transmit_sketch=False)),
    "no quantiles": ("PlanError", lambda: Plan(transmit_sketch=False)), "unknown sketch to run": ("PlanError", lambda: engine.sketch_of(Plan(sketch_type="Unspecified"))),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v[0]}')" for k, v in _FAULTS.items()) + ", ('points after the end', 'ClosedError'), ('wrong column type', 'SchemaError')) t(fault, error)")
def faults(spark, sf_dir):
    """Which error each fault gives."""
    from gaugewell.streaming.runtime import Runtime

    def closed():
        r = Runtime(spark, _EDGE)
        r.shutdown()
        r.process(events(spark, sf_dir))

    out = []
    for name, f in {**{k: v[1] for k, v in _FAULTS.items()}, "points after the end": closed, "wrong column type": lambda: points.decode(table(spark, sf_dir, "events").withColumn("metric", F.lit(1)))}.items():
        try:
            f()
            out.append((name, "none"))
        except GaugewellError as e:
            out.append((name, type(e).__name__))
    return local_table(spark, out, "fault string, error string")


class _Extremes:
    """A sketch of the user's: the least and the greatest value."""

    cell, schema = ("what",), "what string, w double"

    def cells(self, rows, keys, extra=()):
        both = rows.select("*", F.inline(F.array(*[F.struct(F.lit(n).alias("what"), (F.col("float") * s).alias("_v"), F.lit(k).alias("_k")) for n, s, k in (("greatest", 1, 1), ("least", -1, 0))])))
        return both.groupBy(*keys, "what").agg(F.max("_v").alias("w"), F.sum("_k").alias("n"), *extra)

    def merge(self, cells, keys, extra=()):
        return cells.groupBy(*keys, "what").agg(F.max("w").alias("w"), F.sum("n").alias("n"), *extra)


@query(_EV + """SELECT event_type, day AS window_start_ms, 'greatest' AS what, max(value) AS w, count(*) AS count FROM e GROUP BY event_type, day
UNION ALL SELECT event_type, day, 'least', -min(value), count(*) FROM e GROUP BY event_type, day""")
def user_sketch(spark, sf_dir):
    """A sketch type of the user's, through payloads of each host and the central merge."""
    CUSTOM.setdefault("Extremes", lambda plan: _Extremes())
    edge = replace(_EDGE, sketch_type="Extremes")
    plan = replace(edge, omit_resource=True)
    out = engine.unpack(plan, engine.merge_envelopes(plan, engine.run(edge, events(spark, sf_dir))))
    return out.select(F.col("labels")["event_type"].alias("event_type"), "window_start_ms", "what", "w", "count")


# The runtime

def _runtime(spark, plan):
    from gaugewell.streaming.runtime import Runtime

    return Runtime(spark, plan)


def _counts(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy(attributes_key(F.col("labels")).alias("labels"), "window_start_ms").agg(F.sum("count").alias("n"))


@query(_EV + """, f AS (SELECT day, labels, min(ts) AS first FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY first, '7||' || labels) AS no FROM f)
SELECT labels, day AS window_start_ms, count(*) AS n FROM e JOIN r USING (day, labels) WHERE no <= 10 GROUP BY ALL""")
def stream_series_cap(spark, sf_dir):
    """A runtime with at most ten series a window: the first ones stay."""
    r = _runtime(spark, Plan(7, "events", size_ms=DAY, omit_resource=True, max_series=10))
    r.process(events(spark, sf_dir), 0)
    return _counts([r.shutdown()])


_HALF = 1_705_276_800_000  # the middle of the events' month


@query(_EV + f"""SELECT 'event_type=' || event_type || ';' AS labels, day AS window_start_ms, count(*) AS n FROM e WHERE ts < {_HALF} GROUP BY ALL
UNION ALL SELECT coalesce('tier=' || tier || ';', ''), day, count(*) FROM e WHERE ts >= {_HALF} GROUP BY ALL""")
def runtime_reconfigured(spark, sf_dir):
    """Plans from a polled channel: what was open under the old plan is drained, later points go by the new one."""
    from gaugewell.streaming.control import ControlLoop, FileChannel

    e = events(spark, sf_dir)
    old, new = replace(_DD_PLAN, transmit_sketch=True, quantiles=()), replace(_DD_PLAN, transmit_sketch=True, quantiles=(), aggregate_by=("tier",))
    r, drained = _runtime(spark, old), []
    with tempfile.TemporaryDirectory() as folder:  # a channel is the driver's own file
        path = os.path.join(folder, "plans.json")
        channel = FileChannel(path)
        loop = ControlLoop(channel, lambda plans: drained.append(r.update_config(plans)))
        loop.step()
        r.process(e.where(F.col("timestamp_ms") < _HALF), 0)
        with open(path, "w") as f:
            f.write(PlanSet((new,), 2).to_json())
        loop.step()
        loop.step()
        assert channel.acked == 2 and len(drained) == 1 and not loop.errors
    r.process(e.where(F.col("timestamp_ms") >= _HALF), 1)
    return _counts([*drained, r.shutdown()])


@query(_EV + f"""SELECT 'input_observations' AS counter, count(*) AS value FROM e UNION ALL SELECT 'matched', count(*) FROM e WHERE event_type <> 'error' AND NOT (ts >= {_HALF} AND ts % 7 = 0)
UNION ALL SELECT 'dropped_late', count(*) FROM e WHERE event_type <> 'error' AND ts >= {_HALF} AND ts % 7 = 0 UNION ALL SELECT 'ticks', 1 UNION ALL SELECT 'last_tick_ms', {_HALF}
UNION ALL SELECT 'last_emitted_envelopes', count(DISTINCT (event_type, day)) FROM e WHERE event_type <> 'error' AND ts < {_HALF}""")
def runtime_counters(spark, sf_dir):
    """The counters after a tick in the middle, a batch tried again, and points that come a month late."""
    from gaugewell.functions.matchers import NOT_EQUAL, LabelMatcher

    e = events(spark, sf_dir)
    r = _runtime(spark, replace(_EDGE, omit_resource=True, allowed_lateness_ms=1000, matchers=(LabelMatcher("event_type", "error", NOT_EQUAL),)))
    first = e.where(F.col("timestamp_ms") < _HALF)
    r.process(first, 0)
    r.tick(_HALF)
    r.process(first, 0)
    late = F.when(F.col("timestamp_ms") % 7 == 0, F.col("timestamp_ms") - 31 * DAY).otherwise(F.col("timestamp_ms"))
    r.process(e.where(F.col("timestamp_ms") >= _HALF).withColumn("timestamp_ms", late), 1)
    names = ("input_observations", "matched", "dropped_late", "ticks", "last_tick_ms", "last_emitted_envelopes")
    return local_table(spark, [(n, asdict(r.stats)[n]) for n in names], "counter string, value bigint")


def _host(spark, sf_dir, tick):
    """Batches with carried sketches of unknown types through a host: what it emits, what it sets aside, its telemetry."""
    from gaugewell.streaming.adapter import Adapter, Host

    class Ours(Adapter):
        def __init__(self):
            self.out, self.bad, self.seen = [], [], []

        def emit(self, batch):
            self.out.append(batch)

        def quarantine(self, rows):
            self.bad.append(rows)

        def emit_telemetry(self, stats):
            self.seen.append(stats.input_observations)

    ours = Ours()
    host = Host(_runtime(spark, replace(_EDGE, omit_resource=True)), ours)
    odd = flat(spark, sf_dir).withColumn("_sk_envelope", F.when(F.col("event_type") == "error", F.lit("x").cast("binary"))).withColumn("_sk_sketch_type", F.lit("Bogus"))
    host.batch(odd, 0)
    if tick:
        host.ticker(200)
        until = time.time() + 300
        while not ours.out and time.time() < until:
            time.sleep(0.1)
    host.shutdown()
    assert ours.seen
    return ours


@query(_EV + "SELECT event_type, day + 86400000 AS end_ms, count(*) AS n FROM e WHERE event_type <> 'error' GROUP BY ALL")
def host_ticker(spark, sf_dir):
    """Windows ended by the wall clock's ticks."""
    out = _host(spark, sf_dir, True).out
    df = out[0]
    for more in out[1:]:
        df = df.unionByName(more)
    e = F.from_json(F.col("_sk_envelope").cast("string"), "struct<cells:array<struct<w:bigint>>>")
    n = F.aggregate(e["cells"], F.lit(0).cast("bigint"), lambda a, c: a + c["w"])
    return df.select("event_type", F.expr("time_unix_nano div 1000000").alias("end_ms"), n.alias("n"))


@query(_EV + "SELECT 'unknown_sketch_type' AS problem, count(*) AS n FROM e WHERE event_type = 'error'")
def host_quarantine(spark, sf_dir):
    """Rows of a batch that can't be read are set aside; the others go on."""
    return _host(spark, sf_dir, False).bad[0].groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(_EV + "SELECT event_id, value, event_type, tier FROM e")
def pass_through(spark, sf_dir):
    from gaugewell.streaming.adapter import PassThrough

    return PassThrough(lambda batch: None).forward(flat(spark, sf_dir)).select("event_id", "value", "event_type", "tier")


@query(_EV + f"SELECT '7|' || resource || '|' || labels AS series, day AS window_start_ms, day + 86400000 AS window_end_ms, count(*) AS n FROM e WHERE (day // 86400000) % 5 = 0 GROUP BY ALL")
def strict_idle_days(spark, sf_dir):
    """The strict runtime over events of every fifth day: its one window jumps over the idle days and none comes empty."""
    from gaugewell.streaming.compat import replay

    plan = Plan(7, size_ms=DAY)
    rows = engine.series_columns(events(spark, sf_dir), plan).where(F.floor(F.col("timestamp_ms") / DAY) % 5 == 0)
    return replay(plan, rows, "event_id").select("series", "window_start_ms", "window_end_ms", "n")


@query("""SELECT metric, (timestamp_ms // 86400000) * 86400000 AS window_start_ms, CASE WHEN isfinite("float") THEN sign("float")::INT END AS sign,
CASE WHEN NOT isfinite("float") THEN NULL WHEN "float" = 0 THEN 0 ELSE ceil(ln(abs("float")) / 0.020000666706669435)::INT END AS bucket, count(*) AS w
FROM observations WHERE kind = 'Float' AND timestamp_ms IS NOT NULL AND metric = 'queue_wait_ms' GROUP BY ALL""")
def dd_cells_dirty(spark, sf_dir):
    """DDSketch cells of one plan's dirty observations: null, NaN, infinite, negative and extreme values."""
    from gaugewell.functions.matchers import LabelMatcher

    plan = Plan(103, "queue_wait_ms", size_ms=DAY, global_aggregation=True, matchers=(LabelMatcher.equal("", "queue_wait_ms"),))
    out = engine.cells(plan, engine.admitted(plan, table(spark, sf_dir, "observations")))
    return out.select(F.lit("queue_wait_ms").alias("metric"), "window_start_ms", "sign", "bucket", "w")
