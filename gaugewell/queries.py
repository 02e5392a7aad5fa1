"""The core's queries on late events and wide tables, and those of the sketch engine, with their SQL."""

from __future__ import annotations

from gaugewell import engine_queries, sketch_queries
from gaugewell.operators.lateness import LambdaViews, window_plans
from gaugewell.operators.wide import BlockPivot
from gaugewell.storage import table


#: Half a day after a daily run, in the week of the data.
NOW_MS = 1_772_712_000_000


def _views(spark, sf_dir, until_ms=None):
    views = LambdaViews(spark, window_plans(table(spark, sf_dir, "plan_configs")))
    views.ingest(table(spark, sf_dir, "observations"))
    return views.replay(until_ms)


def p2_found(spark, sf_dir):
    """(agg_id, window_start_ms, obs_id) of the observations that came too late for a window."""
    return _views(spark, sf_dir).late()


def p2_windows(spark, sf_dir):
    """The aggregates of every plan and window, corrected until the cut-off."""
    return _views(spark, sf_dir).serve()


def p2_served(spark, sf_dir):
    """The same aggregates as they were known between two runs: frozen and open periods with the fast increments since."""
    return _views(spark, sf_dir, NOW_MS).serve(NOW_MS)


def _pivot(spark, sf_dir):
    return BlockPivot(table(spark, sf_dir, "otap_attributes"), table(spark, sf_dir, "attribute_keys"))


def p4_found(spark, sf_dir):
    """(parent_id, attr_name) of the attributes that are unreadable or contradictory."""
    return _pivot(spark, sf_dir).conflicts(table(spark, sf_dir, "otap_metrics"))


def p4_wide(spark, sf_dir):
    """One row per parent with one typed column per declared attribute."""
    return _pivot(spark, sf_dir).wide(table(spark, sf_dir, "otap_metrics"))


QUERIES = {f.__name__: f for f in (p2_found, p2_windows, p2_served, p4_found, p4_wide)}

_FIRST = """
WITH o AS (
  SELECT obs_id, metric, timestamp_ms AS ts, min(received_ms) AS arrival,
         max(CASE WHEN kind = 'Float' THEN "float" END) AS value
  FROM observations WHERE timestamp_ms <> 0 GROUP BY obs_id, metric, timestamp_ms),
w AS (
  SELECT agg_id, obs_id, arrival, value, size_ms, allowed_lateness_ms AS late,
         unnest(range((ts // step) * step - ((size_ms - 1) // step) * step, ts + 1, step)) AS s, ts
  FROM o JOIN (SELECT *, CASE WHEN slide_ms = 0 THEN size_ms ELSE slide_ms END AS step FROM plan_configs) p USING (metric))
"""
SQL = {
    "p2_found": _FIRST + "SELECT DISTINCT agg_id, s AS window_start_ms, obs_id FROM w WHERE s + size_ms > ts AND late > 0 AND arrival > s + size_ms + late",
    "p2_windows": _FIRST + """
SELECT agg_id, s AS window_start_ms, count(*) AS n_obs, count(value) FILTER (NOT isnan(value)) AS n_values,
       min(value) FILTER (NOT isnan(value)) AS min_value, max(value) FILTER (NOT isnan(value)) AS max_value
FROM w WHERE s + size_ms > ts AND (late = 0 OR arrival <= s + size_ms + late) GROUP BY ALL""",
}

SQL["p2_served"] = SQL["p2_windows"].replace("GROUP BY ALL", f"AND arrival <= {NOW_MS} GROUP BY ALL")

_VALUES = r"""
WITH r AS (
  SELECT parent_id, attr_name, value_type AS t,
         unnest(CASE WHEN value_type = 'binary' THEN [hex(bytes)]
                ELSE [trim(CASE WHEN value_type <> 'binary' THEN decode(bytes) END, E' \t\n\r'), trim(str, E' \t\n\r'), int::VARCHAR] END) AS v
  FROM otap_attributes a JOIN attribute_keys k ON lower(trim(a.key, E' \t\n\r')) = k.raw_key WHERE parent_id IS NOT NULL),
c AS (
  SELECT parent_id, attr_name, t, v,
         CASE WHEN t IN ('string', 'binary') THEN v
              WHEN t = 'boolean' THEN CASE WHEN lower(v) IN ('true', 't', 'yes', '1') THEN 'true' WHEN lower(v) IN ('false', 'f', 'no', '0') THEN 'false' END
              WHEN t = 'timestamp' THEN CASE
                WHEN regexp_full_match(v, '[0-9]+') THEN ((v::HUGEINT) * 1000)::VARCHAR
                WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})') THEN epoch_us(TRY_CAST(v AS TIMESTAMPTZ))::VARCHAR END
              WHEN NOT regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN NULL
              WHEN t = 'double' THEN (v::DOUBLE + 0.0)::VARCHAR
              WHEN TRY_CAST(v AS DECIMAL(38, 9)) = floor(TRY_CAST(v AS DECIMAL(38, 9))) THEN TRY_CAST(TRY_CAST(v AS DECIMAL(38, 9)) AS BIGINT)::VARCHAR END AS x
  FROM r WHERE v <> ''),
g AS (SELECT parent_id, attr_name, any_value(t) AS t, count(DISTINCT x) AS n, min(x) AS x FROM c GROUP BY ALL)
"""
#: The declared attributes and their types.
_ATTRIBUTES = {
    "build_id": "string", "bytes_sent": "long", "cache_hit": "boolean", "cpu_load": "double", "deployed_at": "timestamp",
    "host_name": "string", "http_method": "string", "http_route": "string", "http_status": "long", "is_error": "boolean",
    "queue_depth": "double", "region": "string", "retry_count": "long", "server_port": "long", "service_name": "string",
    "sketch_agg_id": "long", "sketch_encoding": "string", "sketch_envelope": "binary",
}
_CASTS = {"string": "{}", "long": "({})::BIGINT", "double": "({})::DOUBLE", "boolean": "({})::BOOLEAN", "timestamp": "make_timestamp(({})::BIGINT)", "binary": "unhex({})"}
SQL["p4_found"] = _VALUES + "SELECT parent_id, attr_name FROM g WHERE n <> 1 AND parent_id IN (SELECT parent_id FROM otap_metrics)"
SQL["p4_wide"] = _VALUES + "SELECT m.parent_id, " + ", ".join(
    _CASTS[t].format(f"max(CASE WHEN attr_name = '{a}' AND n = 1 THEN x END)") + f" AS {a}" for a, t in _ATTRIBUTES.items()
) + " FROM (SELECT DISTINCT parent_id FROM otap_metrics WHERE parent_id IS NOT NULL) m LEFT JOIN g ON g.parent_id = m.parent_id GROUP BY m.parent_id"
QUERIES = {**sketch_queries.QUERIES, **engine_queries.QUERIES, **QUERIES}
SQL = {**sketch_queries.SQL, **engine_queries.SQL, **SQL}
