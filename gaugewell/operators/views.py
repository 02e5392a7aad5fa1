"""The normalised tables that envelopes amount to: schemas, series dictionary, labels and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hash60
from gaugewell.functions.labels import label_set


def _series(envs: DataFrame) -> DataFrame:
    """A series id needs no order or count of all series: it is the hash of plan, metric and labels."""
    text = F.concat_ws("|", F.coalesce(F.col("agg_id").cast("string"), F.lit("")), F.coalesce("metric_name", F.lit("")), label_set(F.col("resource_labels")), label_set(F.col("labels")))
    return envs.withColumn("series_id", hash60(text))


def dictionary(envs: DataFrame) -> DataFrame:
    """(series_id, agg_id, metric): one row per series; the same labels under two plans are two series."""
    return _series(envs).select("series_id", "agg_id", F.col("metric_name").alias("metric")).distinct()


def labels(envs: DataFrame) -> DataFrame:
    """(series_id, key, value): every label of every series; resource labels carry the prefix ``resource.``."""
    rows = _series(envs).select("series_id", "resource_labels", "labels")
    own = rows.select("series_id", F.explode("labels").alias("key", "value"))
    resource = rows.select("series_id", F.explode("resource_labels").alias("key", "value")).withColumn("key", F.concat(F.lit("resource."), "key"))
    return own.unionByName(resource).distinct()


def records(envs: DataFrame) -> DataFrame:
    """(series_id, window_start_ms, window_end_ms, envelope, value): a record has a sketch or a value, never both."""
    has = F.col("payload").isNotNull() & (F.octet_length("payload") > 0)
    return _series(envs).select("series_id", "window_start_ms", "window_end_ms", F.when(has, F.col("payload")).alias("envelope"), F.when(~has | F.col("payload").isNull(), F.col("value")).alias("value"))


def schemas(plans: DataFrame) -> DataFrame:
    """(agg_id, sketch_type, sketch_size): one row per plan."""
    p = F.col("sketch_params")
    size = F.coalesce(*[F.try_element_at(p, F.lit(n)) for n in ("k", "precision", "relative_accuracy")], F.try_element_at(p, F.lit("rows")) * F.try_element_at(p, F.lit("cols")))
    return plans.select("agg_id", "sketch_type", size.alias("sketch_size")).distinct()
