"""Many plans over one scan: every row is joined with the plans of its metric, which is GROUPING SETS over plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.labels import entries
from gaugewell.functions.series import attributes_key
from gaugewell.operators.lateness import window_starts
from gaugewell.plans.plan import PlanSet
from gaugewell.storage import local_table


def _key_by(labels: Column, names: Column) -> Column:
    listed = F.concat_ws("", F.transform(names, lambda n: F.concat(n, F.lit("="), F.try_element_at(labels, n), F.lit(";"))))
    all_ = F.concat_ws("", F.transform(entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))))
    return F.when(F.size(names) > 0, listed).otherwise(all_)


def assigned(observations: DataFrame, plans: PlanSet) -> DataFrame:
    """The rows of every plan with ``agg_id``, ``series`` and window, without those that came too late for it."""
    metric = lambda p: next((m.value for m in p.matchers if m.name == ""), None)
    rows = [(metric(p), p.agg_id, p.size_ms, p.step_ms, p.allowed_lateness_ms, list(p.aggregate_by)) for p in plans.plans if p.size_ms > 0]
    table = local_table(observations.sparkSession, rows, "metric string, agg_id bigint, _size bigint, _step bigint, _late bigint, _by array<string>")
    joined = observations.where("coalesce(kind, '') <> 'Envelope'").join(F.broadcast(table), "metric")  # the plans that the driver holds
    out = joined.withColumn("window_start_ms", F.explode(window_starts(F.col("timestamp_ms"), F.col("_size"), F.col("_step"))))
    out = out.withColumn("window_end_ms", F.col("window_start_ms") + F.col("_size"))
    if "received_ms" in observations.columns:
        out = out.where((F.col("_late") == 0) | F.coalesce(F.col("received_ms") <= F.col("window_end_ms") + F.col("_late"), F.lit(True)))
    series = F.concat(F.col("agg_id").cast("string"), F.lit("|"), attributes_key(F.col("resource_labels")), F.lit("|"), _key_by(F.col("labels"), F.col("_by")))
    return out.withColumn("series", series).drop("_size", "_step", "_late", "_by")
