"""Queries of the sketch engine over the event stream and the domain tables, and the same in SQL."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from gaugewell.functions.labels import label_set
from gaugewell.functions.matchers import NOT_EQUAL, LabelMatcher, matches_all
from gaugewell.functions.series import attributes_key, series_key
from gaugewell.operators import deltas, engine, multi, views, windows
from gaugewell.operators.sketches import DDSketch, Frequency, HyperLogLog, Kll
from gaugewell.plans.plan import COUNT_MIN, COUNT_SKETCH, DDSKETCH, HLL, KLL, Plan, from_table
from gaugewell.sources import jsonl, points, records
from gaugewell.storage import table

HOUR, DAY = 3_600_000, 86_400_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return note


def flat(spark, sf_dir):
    """The events as a flat batch: scalar columns and text labels; ``tier`` is missing on some."""
    k = F.get_json_object("props", "$.k").cast("int")
    tier = F.when(k % 7 != 0, F.concat(F.lit("t"), (k % 3).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("time_unix_nano"), F.lit("events").alias("metric"), "value", "event_type", tier.alias("tier"), "user_id")


def events(spark, sf_dir):
    """The events as observations, with their id, user and a host as the resource."""
    f = flat(spark, sf_dir)
    return f.select(
        "event_id", points.timestamp_ms(f).alias("timestamp_ms"), "metric", F.create_map(F.lit("host"), F.concat(F.lit("node-"), (F.col("user_id") % 4).cast("string"))).alias("resource_labels"),
        points.fold_labels(["event_type", "tier"]).alias("labels"), F.lit("Float").alias("kind"), F.col("value").alias("float"), F.col("user_id").alias("hash"), F.lit(None).cast("binary").alias("bytes"),
    )


def visitors(spark, sf_dir):
    return events(spark, sf_dir).withColumn("kind", F.lit("Hash"))


_EV = """
WITH ev AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts, 'node-' || (user_id % 4) AS host, event_type, CASE WHEN k % 7 <> 0 THEN 't' || (k % 3) END AS tier, value, user_id
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)),
e AS (SELECT *, 'event_type=' || event_type || ';' || coalesce('tier=' || tier || ';', '') AS labels, 'host=' || host || ';' AS resource, (ts // 86400000) * 86400000 AS day FROM ev)
"""


# Sources, matchers, keys

@query(_EV + "SELECT ts AS timestamp_ms, 'events' AS metric, labels, value AS float, 'Float' AS kind FROM e")
def decode_scalar(spark, sf_dir):
    return points.decode(flat(spark, sf_dir)).select("timestamp_ms", "metric", attributes_key(F.col("labels")).alias("labels"), "float", "kind")


@query("SELECT coalesce(greatest(time_unix_nano // 1000000, 0), 0)::BIGINT AS timestamp_ms, coalesce(metric, '') AS metric, coalesce(value, 0.0) AS float FROM otap_metrics")
def decode_null_defaults(spark, sf_dir):
    return points.decode(table(spark, sf_dir, "otap_metrics")).select("timestamp_ms", "metric", "float")


@query(_EV + "SELECT event_id FROM e WHERE event_type = 'click'")
def label_match_eq(spark, sf_dir):
    return events(spark, sf_dir).where(matches_all([LabelMatcher.equal("", "events"), LabelMatcher.equal("event_type", "click")])).select("event_id")


@query(_EV + "SELECT event_id FROM e WHERE tier IS DISTINCT FROM 't0'")
def label_match_ne_missing(spark, sf_dir):
    return events(spark, sf_dir).where(matches_all([LabelMatcher("tier", "t0", NOT_EQUAL)])).select("event_id")


@query(_EV + "SELECT event_id, '7|' || resource || '|' || labels AS series FROM e")
def series_key_all(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", series_key(7, F.col("resource_labels"), F.col("labels")).alias("series"))


@query(_EV + "SELECT event_id, '7|' || resource || '|' || coalesce('tier=' || tier || ';', '') || 'event_type=' || event_type || ';' AS series FROM e")
def series_key_subset(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", series_key(7, F.col("resource_labels"), F.col("labels"), ["tier", "none", "event_type"]).alias("series"))


def _counts(rows, *more):
    return rows.groupBy("series", "window_start_ms", "window_end_ms").agg(F.count(F.lit(1)).alias("n"), *more)


@query(_EV + "SELECT '7||' AS series, day AS window_start_ms, day + 86400000 AS window_end_ms, count(*) AS n FROM e GROUP BY day")
def global_series(spark, sf_dir):
    return _counts(engine.admitted(Plan(7, size_ms=DAY, global_aggregation=True), events(spark, sf_dir)))


@query(_EV + "SELECT '7||' || labels AS series, day AS window_start_ms, day + 86400000 AS window_end_ms, count(*) AS n FROM e GROUP BY labels, day")
def omit_resource(spark, sf_dir):
    return _counts(engine.admitted(Plan(7, size_ms=DAY, omit_resource=True), events(spark, sf_dir)))


# Windows

@query(_EV + "SELECT '7|' || resource || '|' || labels AS series, (ts // 3600000) * 3600000 AS window_start_ms, (ts // 3600000) * 3600000 + 3600000 AS window_end_ms, count(*) AS n FROM e GROUP BY ALL")
def tumbling_count(spark, sf_dir):
    return _counts(engine.admitted(Plan(7, size_ms=HOUR), events(spark, sf_dir)))


@query(_EV + "SELECT '7|' || resource || '|' || labels AS series, (SELECT min(ts) FROM e) AS window_start_ms, (SELECT min(ts) FROM e) AS window_end_ms, count(*) AS n FROM e GROUP BY ALL")
def batch_count(spark, sf_dir):
    return _counts(engine.admitted(Plan(7), events(spark, sf_dir)))


@query(_EV + """, w AS (SELECT *, unnest(range((ts // 1800000) * 1800000 - 1800000, ts + 1, 1800000)) AS s FROM e)
SELECT '7|' || resource || '|' || labels AS series, s AS window_start_ms, s + 3600000 AS window_end_ms, count(*) AS n FROM w WHERE s + 3600000 > ts GROUP BY ALL""")
def sliding_count(spark, sf_dir):
    return _counts(engine.admitted(Plan(7, size_ms=HOUR, slide_ms=HOUR // 2, mode="Sliding"), events(spark, sf_dir)))


@query(_EV + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < 3600000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS window_start_ms, max(ts) + 3600000 AS window_end_ms, count(*) AS n FROM s GROUP BY user_id, no""")
def session_count(spark, sf_dir):
    return windows.sessions(events(spark, sf_dir).withColumnRenamed("hash", "user_id"), HOUR, ["user_id"], [F.count(F.lit(1)).alias("n")])


@query(_EV + "SELECT labels, day AS window_start_ms, count(*)::VARCHAR AS sample_count, '86400' AS window_duration_seconds FROM e GROUP BY labels, day")
def window_stats(spark, sf_dir):
    out = engine.run(Plan(7, sketch_type=HLL, size_ms=DAY, omit_resource=True, transmit_sketch=False, window_stats=True), visitors(spark, sf_dir))
    own = F.map_filter("labels", lambda k, v: ~k.isin("sample_count", "window_duration_seconds"))
    return out.select(attributes_key(own).alias("labels"), "window_start_ms", F.col("labels")["sample_count"].alias("sample_count"), F.col("labels")["window_duration_seconds"].alias("window_duration_seconds"))


_LATE = """SELECT (timestamp_ms // 86400000) * 86400000 AS window_start_ms, count(*) AS n FROM observations
WHERE metric = 'active_visitors' AND kind <> 'Envelope' AND received_ms <= (timestamp_ms // 86400000 + 1) * 86400000 + 21600000 GROUP BY ALL"""


@query(_LATE)
def late_drop(spark, sf_dir):
    plan = replace(from_table(table(spark, sf_dir, "plan_configs")).find(201), max_series=0)
    return engine.admitted(plan, table(spark, sf_dir, "observations")).groupBy("window_start_ms").agg(F.count(F.lit(1)).alias("n"))


@query(_EV + """, f AS (SELECT day, resource, labels, min(event_id) AS first FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY first) AS no FROM f)
SELECT '7|' || resource || '|' || labels AS series, day AS window_start_ms, day + 86400000 AS window_end_ms, count(*) AS n FROM e JOIN r USING (day, resource, labels) WHERE no <= 10 GROUP BY ALL""")
def series_cap_drop(spark, sf_dir):
    plan = Plan(7, size_ms=DAY, max_series=10)
    return _counts(windows.cap_series(engine.admitted(plan, events(spark, sf_dir)), plan, ["event_id"])[0])


@query()
def evict_oldest(spark, sf_dir):
    """The strict runtime with one active window and the least recently seen series evicted at the cap."""
    from gaugewell.streaming.compat import replay

    plan = Plan(7, size_ms=DAY, max_series=10, overflow="EvictOldest")
    return replay(plan, engine.series_columns(events(spark, sf_dir), plan), "event_id")


# Records, plans, envelopes

_STRINGS = ("region", "host.name", "service.name", "http.route")
_PIVOT = ", ".join(f"max(CASE WHEN key = '{k}' AND bytes IS NULL THEN str END) AS \"{k}\"" for k in _STRINGS)


@query(f"""WITH w AS (SELECT parent_id, {_PIVOT} FROM otap_attributes WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT m.time_unix_nano, m.metric, m.value, {", ".join(f'"{k}" AS {k.replace(".", "_")}' for k in _STRINGS)} FROM otap_metrics m LEFT JOIN w USING (parent_id)""")
def flatten_left_pivot(spark, sf_dir):
    out = records.flatten(table(spark, sf_dir, "otap_metrics"), table(spark, sf_dir, "otap_attributes"), _STRINGS)
    return out.select("time_unix_nano", "metric", "value", *[F.col(f"`{k}`").alias(k.replace(".", "_")) for k in _STRINGS])


@query(_EV + """, n AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS parent_id, event_type, tier FROM e)
SELECT parent_id, 'event_type' AS key, event_type AS str FROM n UNION ALL SELECT parent_id, 'tier', tier FROM n WHERE tier IS NOT NULL""")
def lift_unpivot(spark, sf_dir):
    return records.lift(flat(spark, sf_dir), "event_id")[1].select("parent_id", "key", "str")


@query("""SELECT agg_id, e.sketch_type, p.sketch_type AS planned, size_ms, count(*) AS n FROM sketch_envelopes e JOIN plan_configs p USING (agg_id) GROUP BY ALL""")
def plan_lookup_join(spark, sf_dir):
    plans = table(spark, sf_dir, "plan_configs").select("agg_id", F.col("sketch_type").alias("planned"), "size_ms")
    return table(spark, sf_dir, "sketch_envelopes").join(plans, "agg_id").groupBy("agg_id", "sketch_type", "planned", "size_ms").agg(F.count(F.lit(1)).alias("n"))


_ALL = "coalesce(array_to_string(list_transform(list_sort(list_filter(map_entries({0}), lambda e: e.value IS NOT NULL)), lambda e: e.key || '=' || e.value || ';'), ''), '')"


@query(f"""
WITH p AS (SELECT *, CASE WHEN slide_ms = 0 THEN size_ms ELSE slide_ms END AS step FROM plan_configs),
o AS (SELECT o.*, agg_id, size_ms, allowed_lateness_ms AS late, aggregate_by AS listed, unnest(range((timestamp_ms // step) * step - ((size_ms - 1) // step) * step, timestamp_ms + 1, step)) AS s
      FROM observations o JOIN p USING (metric) WHERE kind <> 'Envelope')
SELECT agg_id, agg_id || '|' || {_ALL.format('resource_labels')} || '|' ||
       CASE WHEN len(listed) > 0 THEN coalesce(array_to_string(list_transform(list_filter(listed, lambda k: labels[k] IS NOT NULL), lambda k: k || '=' || labels[k] || ';'), ''), '')
            ELSE {_ALL.format('labels')} END AS series, s AS window_start_ms, count(*) AS n
FROM o WHERE s + size_ms > timestamp_ms AND (late = 0 OR received_ms <= s + size_ms + late) GROUP BY ALL""")
def multi_plan(spark, sf_dir):
    rows = multi.assigned(table(spark, sf_dir, "observations"), from_table(table(spark, sf_dir, "plan_configs")))
    return rows.groupBy("agg_id", "series", "window_start_ms").agg(F.count(F.lit(1)).alias("n"))


@query(_EV + "SELECT resource, event_type, day AS window_start_ms, count(*) AS n FROM (SELECT *, 1 FROM e) GROUP BY GROUPING SETS ((resource, day), (event_type, day), (day))")
def grouping_sets(spark, sf_dir):
    rows = windows.assign(events(spark, sf_dir), Plan(size_ms=DAY)).select(attributes_key(F.col("resource_labels")).alias("resource"), F.col("labels")["event_type"].alias("event_type"), "window_start_ms")
    return rows.groupingSets([["resource", "window_start_ms"], ["event_type", "window_start_ms"], ["window_start_ms"]], "resource", "event_type", "window_start_ms").agg(F.count(F.lit(1)).alias("n")).select("resource", "event_type", "window_start_ms", "n")


@query("""SELECT agg_id, CASE WHEN agg_id <> 0 AND agg_id <> 101 THEN 'other_plan' WHEN sketch_type <> 'Unspecified' AND sketch_type <> 'DDSketch' THEN 'other_sketch_type'
WHEN schema_version > 1 THEN 'unknown_schema_version' END AS problem, count(*) AS n FROM sketch_envelopes GROUP BY ALL""")
def envelope_admission(spark, sf_dir):
    plan = from_table(table(spark, sf_dir, "plan_configs")).find(101)
    return engine.admission(plan, table(spark, sf_dir, "sketch_envelopes")).groupBy("agg_id", "problem").agg(F.count(F.lit(1)).alias("n"))


_ESC = r"""coalesce(array_to_string(list_transform(list_sort(list_filter(map_entries({0}), lambda e: e.value IS NOT NULL)),
  lambda e: regexp_replace(e.key, '([\;=])', '\\\1', 'g') || '=' || regexp_replace(e.value, '([\;=])', '\\\1', 'g') || ';'), ''), '')"""
_ID = f"('0x' || substr(md5(coalesce(agg_id::VARCHAR, '') || '|' || coalesce(metric_name, '') || '|' || {_ESC.format('resource_labels')} || '|' || {_ESC.format('labels')}), 1, 15))::BIGINT"


@query(f"SELECT DISTINCT {_ID} AS series_id, agg_id, metric_name AS metric FROM sketch_envelopes")
def dictionary_view(spark, sf_dir):
    return views.dictionary(table(spark, sf_dir, "sketch_envelopes"))


@query(f"""WITH s AS (SELECT {_ID} AS series_id, unnest(map_entries(labels)) AS e, '' AS p FROM sketch_envelopes UNION ALL SELECT {_ID}, unnest(map_entries(resource_labels)), 'resource.' FROM sketch_envelopes)
SELECT DISTINCT series_id, p || e.key AS key, e.value AS value FROM s""")
def labels_view(spark, sf_dir):
    return views.labels(table(spark, sf_dir, "sketch_envelopes"))


@query(f"""SELECT {_ID} AS series_id, window_start_ms, window_end_ms, CASE WHEN octet_length(payload) > 0 THEN payload END AS envelope,
CASE WHEN payload IS NULL OR octet_length(payload) = 0 THEN value END AS value FROM sketch_envelopes""")
def record_view(spark, sf_dir):
    return views.records(table(spark, sf_dir, "sketch_envelopes"))


@query("SELECT DISTINCT agg_id, sketch_type, coalesce(sketch_params['k'], sketch_params['precision'], sketch_params['relative_accuracy'], sketch_params['rows'] * sketch_params['cols']) AS sketch_size FROM plan_configs")
def schema_view(spark, sf_dir):
    return views.schemas(table(spark, sf_dir, "plan_configs"))


@query(f"""WITH s AS (SELECT DISTINCT * EXCLUDE (resource_labels, labels), {_ESC.format('resource_labels')} AS resource, {_ESC.format('labels')} AS labels FROM sketch_envelopes)
SELECT agg_id, resource, labels, window_start_ms, coalesce(sum(count), 0)::BIGINT AS n FROM s GROUP BY ALL""")
def envelope_counts(spark, sf_dir):
    """Counts carried over when frames of one series and window meet; repeated frames count once."""
    e = table(spark, sf_dir, "sketch_envelopes").withColumns({"resource": label_set(F.col("resource_labels")), "labels": label_set(F.col("labels"))}).drop("resource_labels").distinct()
    return e.groupBy("agg_id", "resource", "labels", "window_start_ms").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))


@query(f"""SELECT agg_id, {_ESC.format('resource_labels')} AS resource, {_ESC.format('labels')} AS labels, window_start_ms, sketch_type, encoding, payload, count, value FROM sketch_envelopes""")
def envelope_json(spark, sf_dir):
    """Envelopes written as JSON and read back."""
    back = jsonl.from_json(jsonl.to_json(table(spark, sf_dir, "sketch_envelopes")))
    return back.select("agg_id", label_set(F.col("resource_labels")).alias("resource"), label_set(F.col("labels")).alias("labels"), "window_start_ms", "sketch_type", "encoding", "payload", "count", "value")


# DDSketch

_LNG = math.log(DDSketch().gamma)
_G = repr(DDSketch().gamma)
_DD = _EV + f""", c AS (SELECT event_type, day, sign(value)::INT AS sign, CASE WHEN value = 0 THEN 0 ELSE ceil(ln(abs(value)) / {_LNG!r}) END::INT AS bucket, count(*) AS w
FROM e WHERE value IS NOT NULL AND isfinite(value) GROUP BY ALL)"""
_DD_PLAN = Plan(7, "events", DDSKETCH, size_ms=DAY, omit_resource=True, aggregate_by=("event_type",), transmit_sketch=False, quantiles=(0.5, 0.9, 0.99, 1.0))


def _dd_table(spark, sf_dir, plan=_DD_PLAN):
    return engine.cells(plan, engine.admitted(plan, events(spark, sf_dir)))


@query(_DD + "SELECT '7||event_type=' || event_type || ';' AS series, day AS window_start_ms, sign, bucket, w FROM c")
def dd_cells(spark, sf_dir):
    return _dd_table(spark, sf_dir).select("series", "window_start_ms", "sign", "bucket", "w")


def _dd_sql(groups: str) -> str:
    return f""", u AS (SELECT *, sum(w) OVER (PARTITION BY {groups} ORDER BY sign, sign * bucket) AS upto, sum(w) OVER (PARTITION BY {groups}) AS n FROM c),
q AS (SELECT *, unnest([0.5, 0.9, 0.99, 1.0]::DOUBLE[]) AS q FROM u)"""


_PICK = f"round(sign * 2 * pow({_G}, bucket) / ({_G} + 1), 6) AS value"


@query(_DD + _dd_sql("event_type, day") + f"""SELECT event_type, CASE WHEN q = 1 THEN '1' ELSE q::VARCHAR END AS quantile, day AS window_start_ms, day + 86400000 AS window_end_ms, {_PICK}, n::BIGINT AS count
FROM q WHERE upto - w <= q * (n - 1) AND q * (n - 1) < upto""")
def dd_quantiles(spark, sf_dir):
    """The flagship: daily quantiles of every event type, from points to estimate rows."""
    out = engine.run(_DD_PLAN, events(spark, sf_dir))
    return out.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["quantile"].alias("quantile"), "window_start_ms", "window_end_ms", F.round("value", 6).alias("value"), "count")


@query(SQL["dd_quantiles"])
def dd_merge_two_tier(spark, sf_dir):
    """Sketches of each host, sent as envelopes, merged centrally: the same estimates as in one pass."""
    edge = replace(_DD_PLAN, omit_resource=False, transmit_sketch=True, quantiles=())
    out = engine.merge_envelopes(_DD_PLAN, engine.run(edge, events(spark, sf_dir)))
    return out.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["quantile"].alias("quantile"), "window_start_ms", "window_end_ms", F.round("value", 6).alias("value"), "count")


@query(SQL["dd_cells"])
def envelope_roundtrip(spark, sf_dir):
    """Cells packed into payloads and read back, in the compact form."""
    plan = replace(_DD_PLAN, transmit_sketch=True, encoding="MSGPACK")
    back = engine.unpack(plan, engine.run(plan, events(spark, sf_dir)))
    return back.select(F.concat(F.lit("7||"), attributes_key(F.col("labels"))).alias("series"), "window_start_ms", "sign", "bucket", "w")


@query(_DD + """, n AS (SELECT event_type, day, count(*) AS n_cells, sum(w)::BIGINT AS count FROM c GROUP BY ALL)
SELECT event_type, day AS window_start_ms, CASE WHEN day = min(day) OVER (PARTITION BY event_type) THEN 'PROTO_FULL' ELSE 'PROTO_DELTA' END AS encoding, n_cells, count FROM n""")
def delta_against_empty(spark, sf_dir):
    plan = replace(_DD_PLAN, transmit_sketch=True, delta=True)
    out = engine.run(plan, events(spark, sf_dir)).withColumn("event_type", F.col("labels")["event_type"])
    return engine.unpack(plan, out).groupBy("event_type", "window_start_ms", "encoding", "count").agg(F.count(F.lit(1)).alias("n_cells"))


@query(_DD + """, n AS (SELECT event_type, day, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS b FROM n)
SELECT event_type, day AS window_start_ms, b IS NULL AS first, n AS cells, coalesce(b, -1) AS cells_before FROM p""")
def snapshot_lookup(spark, sf_dir):
    """Every frame beside the one before it of its series."""
    plan = replace(_DD_PLAN, transmit_sketch=True)
    out = deltas.with_previous(engine.run(plan, events(spark, sf_dir)))
    n = lambda c: F.json_array_length(F.get_json_object(F.col(c).cast("string"), "$.cells")).cast("bigint")
    return out.select(F.col("labels")["event_type"].alias("event_type"), "window_start_ms", "first", n("payload").alias("cells"), F.coalesce(n("previous"), F.lit(-1)).alias("cells_before"))


@query(_DD + """, d AS (SELECT event_type, day, sign, bucket, w FROM c UNION ALL SELECT event_type, day + 86400000, sign, bucket, -w FROM c)
SELECT '7||event_type=' || event_type || ';' AS series, day AS window_start_ms, sign, bucket, sum(w)::BIGINT AS delta FROM d GROUP BY ALL HAVING sum(w) <> 0""")
def delta_against_prev(spark, sf_dir):
    return deltas.against_previous(_dd_table(spark, sf_dir), ["series"], DDSketch.cell, DAY)


@query(SQL["dd_cells"])
def delta_apply(spark, sf_dir):
    """Deltas against the window before, put back together."""
    d = deltas.against_previous(_dd_table(spark, sf_dir), ["series"], DDSketch.cell, DAY)
    return deltas.apply(d, ["series"], DDSketch.cell, DAY).select("series", "window_start_ms", "sign", "bucket", "w")


@query(SQL["dd_quantiles"].replace("day AS window_start_ms, day + 86400000 AS window_end_ms", "(day + 86400000) * 1000000 AS time_unix_nano, 'events' AS metric").replace(", n::BIGINT AS count", ""))
def encode_wide(spark, sf_dir):
    out = points.encode(engine.run(_DD_PLAN, events(spark, sf_dir)), ["event_type", "quantile"])
    return out.select("event_type", "quantile", "time_unix_nano", "metric", F.round("value", 6).alias("value"))


# Distinct counts

_HLL = _EV + """, h AS (SELECT *, ('0x' || substr(md5(user_id::VARCHAR), 1, 15))::BIGINT AS h FROM e),
g AS (SELECT *, (h & 4095)::INT AS idx, CASE WHEN h >> 12 = 0 THEN 49 ELSE 49 - length(bin(h >> 12)) END AS rho FROM h)"""
_HLL_PLAN = Plan(7, "events", HLL, {"precision": 12}, size_ms=DAY, omit_resource=True, aggregate_by=("event_type",), transmit_sketch=False)
_COUNT = "CASE WHEN raw <= 10240 AND used < 4096 THEN 4096 * ln(4096 / (4096 - used)::DOUBLE) ELSE raw END"


def _hll_sql(groups: str) -> str:
    return f""", r AS (SELECT {groups}, idx, max(rho) AS w FROM g GROUP BY ALL),
s AS (SELECT {groups}, count(*) AS used, {0.7213 / (1 + 1.079 / 4096) * 4096 * 4096!r} / (sum(pow(2.0, -w)) + 4096 - count(*)) AS raw FROM r GROUP BY ALL)"""


@query(_HLL + "SELECT '7||event_type=' || event_type || ';' AS series, day AS window_start_ms, idx, max(rho)::BIGINT AS w FROM g GROUP BY ALL")
def hll_registers(spark, sf_dir):
    return engine.cells(_HLL_PLAN, engine.admitted(_HLL_PLAN, visitors(spark, sf_dir))).select("series", "window_start_ms", "idx", "w")


@query(_HLL + _hll_sql("event_type, day") + f"SELECT event_type, day AS window_start_ms, round({_COUNT}, 4) AS value FROM s")
def hll_estimate(spark, sf_dir):
    out = engine.run(_HLL_PLAN, visitors(spark, sf_dir))
    return out.select(F.col("labels")["event_type"].alias("event_type"), "window_start_ms", F.round("value", 4).alias("value"))


@query(_HLL + _hll_sql("event_type") + f"SELECT '7||event_type=' || event_type || ';' AS series, round({_COUNT}, 4) AS estimate FROM s")
def hll_union(spark, sf_dir):
    """The registers of all days merged."""
    s = HyperLogLog(12)
    daily = engine.cells(_HLL_PLAN, engine.admitted(_HLL_PLAN, visitors(spark, sf_dir)))
    return s.estimate(s.merge(daily, ["series"]), ["series"]).select("series", F.round("estimate", 4).alias("estimate"))


@query()
def hll_native(spark, sf_dir):
    """Spark's own sketch of the same groups: daily sketches, then their union."""
    rows = engine.admitted(_HLL_PLAN, visitors(spark, sf_dir))
    daily = rows.groupBy("series", "window_start_ms").agg(F.hll_sketch_agg("hash", 12).alias("sketch"))
    return daily.groupBy("series").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


@query()
def kll_quantiles(spark, sf_dir):
    plan = replace(_DD_PLAN, sketch_type=KLL, sketch_params={"k": 200})
    out = engine.run(plan, events(spark, sf_dir))
    return out.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["quantile"].alias("quantile"), "window_start_ms", "value", "count")


@query()
def kll_merge(spark, sf_dir):
    """KLL sketches of each host and day merged to one per event type."""
    plan = replace(_DD_PLAN, sketch_type=KLL, omit_resource=False, transmit_sketch=True)
    s = Kll(200)
    built = engine.cells(plan, engine.admitted(plan, events(spark, sf_dir))).withColumn("event_type", F.col("attrs")["event_type"])
    return s.quantiles(s.merge(built, ["event_type"]), ["event_type"], [0.5, 0.9, 0.99])


# Frequencies

_PATHS = "requested_paths"


def _paths(spark, sf_dir):
    """The requested paths as one series per day, whatever their labels."""
    return table(spark, sf_dir, "observations").where((F.col("metric") == _PATHS) & (F.col("kind") == "Bytes"))


def _frequency_plan(kind):
    return Plan(301, _PATHS, kind, {"rows": 4, "cols": 2048}, size_ms=DAY, global_aggregation=True)


def _frequency_sql(signed: bool) -> str:
    sign = "((h >> 20) & 1) * 2 - 1" if signed else "1"
    weight = "CASE WHEN octet_length(bytes) > 0 THEN coalesce(\"float\", 1.0) ELSE 1.0 END" if signed else "1.0"
    item = f"CASE WHEN octet_length(bytes) > 0 THEN lower(hex(bytes)) ELSE {_ALL.format('labels')} END"
    if signed:
        item = f"coalesce(nullif({item}, ''), 'default_key')"
    return f"""
WITH o AS (SELECT (timestamp_ms // 86400000) * 86400000 AS day, {item} AS item, {weight} AS weight FROM observations WHERE metric = '{_PATHS}' AND kind = 'Bytes' AND timestamp_ms IS NOT NULL),
i AS (SELECT day, item, sum(weight)::DOUBLE AS weight FROM o GROUP BY ALL),
h AS (SELECT *, ('0x' || substr(md5(r || '|' || item), 1, 15))::BIGINT AS h FROM i, (SELECT unnest(range(4)) AS r)),
c AS (SELECT day, r::INT AS row, (h & 2047)::INT AS col, sum(weight * ({sign}))::DOUBLE AS w FROM h GROUP BY ALL)
"""


def _frequency_cells(spark, sf_dir, kind):
    plan = _frequency_plan(kind)
    return engine.cells(plan, engine.admitted(plan, _paths(spark, sf_dir)))


@query(_frequency_sql(False) + "SELECT day AS window_start_ms, row, col, w FROM c")
def cms_cells(spark, sf_dir):
    return _frequency_cells(spark, sf_dir, COUNT_MIN).select("window_start_ms", "row", "col", "w")


@query(_frequency_sql(True) + "SELECT day AS window_start_ms, row, col, w FROM c")
def cs_cells(spark, sf_dir):
    return _frequency_cells(spark, sf_dir, COUNT_SKETCH).select("window_start_ms", "row", "col", "w")


@query(_frequency_sql(False) + "SELECT day AS window_start_ms, row, sum(w) AS l1, sum(w * w) AS l2 FROM c GROUP BY ALL")
def cms_l1_l2(spark, sf_dir):
    return Frequency().norms(_frequency_cells(spark, sf_dir, COUNT_MIN), ["window_start_ms"])


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "frequency_entries").where("agg_id = 301 and octet_length(key) > 0").select((F.floor(F.col("window_start_ms") / DAY) * DAY).cast("bigint").alias("window_start_ms"), F.lower(F.hex("key")).alias("item")).distinct()


_ASKED = """, a AS (SELECT DISTINCT (window_start_ms // 86400000) * 86400000 AS day, lower(hex(key)) AS item FROM frequency_entries WHERE agg_id = 301 AND octet_length(key) > 0),
p AS (SELECT *, ('0x' || substr(md5(r || '|' || item), 1, 15))::BIGINT AS h FROM a, (SELECT unnest(range(4)) AS r)),
x AS (SELECT p.day, p.item, coalesce(c.w, 0) AS w, ((h >> 20) & 1) * 2 - 1 AS sign FROM p LEFT JOIN c ON c.day = p.day AND c.row = p.r AND c.col = (h & 2047))"""


@query(_frequency_sql(False) + _ASKED + "SELECT day AS window_start_ms, item, min(w) AS estimate FROM x GROUP BY ALL")
def cms_point(spark, sf_dir):
    return Frequency().point(_frequency_cells(spark, sf_dir, COUNT_MIN), _asked(spark, sf_dir), ["window_start_ms"])


@query(_frequency_sql(True) + _ASKED + "SELECT day AS window_start_ms, item, (median(w * sign) + 0.0)::DOUBLE AS estimate FROM x GROUP BY ALL")
def cs_point_median(spark, sf_dir):
    return Frequency(signed=True).point(_frequency_cells(spark, sf_dir, COUNT_SKETCH), _asked(spark, sf_dir), ["window_start_ms"])


@query()
def topk_native(spark, sf_dir):
    """Spark's own frequent-items sketch: the ten most requested paths of each day."""
    rows = engine.admitted(_frequency_plan(COUNT_MIN), _paths(spark, sf_dir)).withColumn("item", F.lower(F.hex("bytes")))
    top = rows.groupBy("window_start_ms").agg(F.expr("approx_top_k(item, 10, 10000)").alias("t"))
    return top.select("window_start_ms", F.inline("t"))


# Streams

@query(_EV + "SELECT '7||event_type=' || event_type || ';' AS series, day AS window_start_ms, count(*) AS n FROM e GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    """The events as a stream through the runtime: ticks while it runs, a drain at the end."""
    from gaugewell.storage import written
    from gaugewell.streaming.runtime import Runtime

    runtime = Runtime(spark, replace(_DD_PLAN, transmit_sketch=True))
    emitted = []
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("int")
    tier = F.when(k % 7 != 0, F.concat(F.lit("t"), (k % 3).cast("string")))
    obs = stream.select(
        F.unix_millis(points.instant(F.col("ts"), dict(stream.dtypes)["ts"], spark)).alias("timestamp_ms"), F.lit("events").alias("metric"), F.create_map().cast("map<string,string>").alias("resource_labels"),
        F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("tier"), tier).alias("labels"), F.lit("Float").alias("kind"), F.col("value").alias("float"), F.col("user_id").alias("hash"), F.lit(None).cast("binary").alias("bytes"),
    )
    runtime.attach(obs, lambda df, _: emitted.append(df)).trigger(availableNow=True).start().awaitTermination()
    out = runtime.shutdown()
    for df in emitted:
        out = out.unionByName(df)
    return written(out.groupBy(F.concat(F.lit("7||"), attributes_key(F.col("labels"))).alias("series"), "window_start_ms").agg(F.sum("count").alias("n")), "stream")
