"""Flat batches of points and sketches: reading them as observations and writing envelopes as them.

Filters on plain columns of the batch reach the file scan only before the labels are folded into a map, so push them onto
the frame that is given to ``decode``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell import schemas
from gaugewell.errors import UNKNOWN_ENCODING, UNKNOWN_SKETCH
from gaugewell.plans.plan import ENCODINGS, SKETCH_TYPES


def observation(timestamp_ms: Column, metric: Column, value: Column, kind: str = "Float", resource_labels: Column | None = None, labels: Column | None = None) -> list[Column]:
    """The columns of observations whose ``value`` is of one kind: Float, Hash, Bytes or Envelope."""
    empty = F.create_map().cast("map<string,string>")
    kinds = {"Float": ("float", "double"), "Hash": ("hash", "bigint"), "Bytes": ("bytes", "binary")}
    if kind not in (*kinds, "Envelope"):
        raise ValueError(f"unknown kind {kind!r}")
    values = [(value if k == kind else F.lit(None)).cast(t).alias(n) for k, (n, t) in kinds.items()]
    carried = [value.alias("envelope")] if kind == "Envelope" else []
    return [
        timestamp_ms.cast("bigint").alias("timestamp_ms"), metric.alias("metric"), (empty if resource_labels is None else resource_labels).alias("resource_labels"),
        (empty if labels is None else labels).alias("labels"), F.lit(kind).alias("kind"), *values, *carried,
    ]


def instant(c: Column, kind: str, spark: SparkSession) -> Column:
    """A timestamp; one without a time zone is taken as UTC, whatever the session's zone."""
    if kind == "timestamp_ntz" and spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z"):
        c = F.convert_timezone(F.lit("UTC"), F.current_timezone(), c)
    return c.cast("timestamp")


def timestamp_ms(df: DataFrame, name: str = "time_unix_nano") -> Column:
    """Milliseconds of a nanosecond count or a timestamp; null and what isn't after 1970 give 0."""
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(0).cast("bigint")
    ms = F.expr(f"`{name}` div 1000000") if kind == "bigint" else F.unix_millis(instant(F.col(name), kind, df.sparkSession))
    return F.coalesce(F.greatest(ms, F.lit(0)), F.lit(0)).cast("bigint")


def label_columns(df: DataFrame) -> list[str]:
    """The text columns that aren't reserved: every one is a label.  Columns of other types are passed over."""
    return [n for n, t in df.dtypes if t == "string" and not schemas.is_reserved(n)]


def fold_labels(names: Sequence[str]) -> Column:
    """A map of the columns that aren't null."""
    if not names:
        return F.create_map().cast("map<string,string>")
    pairs = [x for n in names for x in (F.lit(n), F.col(f"`{n}`"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def one_of(c: Column, names: Sequence[str], reason: str, strict: bool) -> Column:
    """The name as it is; empty and null give the first; an unknown one raises, or gives null if not strict."""
    known = F.when(c.isNull() | (c == ""), F.lit(names[0])).when(c.isin(*names), c)
    return F.coalesce(known, F.raise_error(F.concat(F.lit(reason + ": "), c)).cast("string")) if strict else known


def decode(df: DataFrame, strict: bool = True) -> DataFrame:
    """Observations of a flat batch, one a row.

    A row with ``_sk_envelope`` is of kind Envelope, its ``envelope`` holding the carried sketch (count and temporality
    0); others are of kind Float, a null or missing value being 0.0.  Every known column may be missing, but none may have
    another type.  Without ``strict`` rows of unknown sketch types or encodings get a ``problem`` instead of an error.
    """
    have = schemas.check(df, schemas.SCALARS | schemas.CARRIERS)
    col = lambda n, t, d=None: F.coalesce(F.col(n).cast(t), F.lit(d)) if n in have and d is not None else F.col(n).cast(t) if n in have else F.lit(d).cast(t)
    carried = F.col("_sk_envelope").isNotNull() if "_sk_envelope" in have else F.lit(False)
    labels = fold_labels(label_columns(df))
    sketch = one_of(col("_sk_sketch_type", "string"), SKETCH_TYPES, UNKNOWN_SKETCH, strict)
    encoding = one_of(col("_sk_encoding", "string"), ENCODINGS, UNKNOWN_ENCODING, strict)
    envelope = F.struct(
        col("_sk_schema_version", "int", 0).alias("schema_version"), sketch.alias("sketch_type"), col("_sk_agg_id", "bigint", 0).alias("agg_id"),
        F.create_map().cast("map<string,string>").alias("resource_labels"), labels.alias("labels"),
        col("_sk_window_start_ms", "bigint", 0).alias("window_start_ms"), col("_sk_window_end_ms", "bigint", 0).alias("window_end_ms"), encoding.alias("encoding"),
        col("_sk_envelope", "binary").alias("payload"), col("metric", "string").alias("metric_name"), F.lit(0).cast("bigint").alias("count"),
        F.lit(0).alias("aggregation_temporality"), F.lit(None).cast("double").alias("value"),
    )
    out = df.select(
        timestamp_ms(df).alias("timestamp_ms"), col("metric", "string", "").alias("metric"), F.create_map().cast("map<string,string>").alias("resource_labels"), labels.alias("labels"),
        F.when(carried, "Envelope").otherwise("Float").alias("kind"), F.when(~carried, col("value", "double", 0.0)).alias("float"),
        F.lit(None).cast("bigint").alias("hash"), F.lit(None).cast("binary").alias("bytes"), F.when(carried, envelope).alias("envelope"),
    )
    if strict:
        return out
    held = F.col("kind") == "Envelope"
    bad = F.when(held & F.col("envelope.sketch_type").isNull(), UNKNOWN_SKETCH).when(held & F.col("envelope.encoding").isNull(), UNKNOWN_ENCODING)
    return out.withColumn("problem", bad)


def label_keys(df: DataFrame, most: int = 10_000) -> list[str]:
    """The sorted union of the label keys, which become columns; declare them instead where they are known."""
    keys = [r[0] for r in df.select(F.explode(F.map_keys("labels")).alias("k")).distinct().limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"more than {most} label keys")
    return sorted(keys)


def encode(envelopes: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Envelopes as a flat batch: ten fixed columns, then one text column per label key, sorted.

    The time is the window's end.  A label that has a fixed column's name is prefixed with ``label_``.  No rows give a
    frame of the same columns.  Estimates carry a null payload, so that reading them gives points.
    """
    keys = label_keys(envelopes) if keys is None else sorted(keys)
    end = F.least(F.col("window_end_ms"), F.lit((1 << 63) // 1_000_000 - 1)) * 1_000_000
    fixed = [
        end.alias("time_unix_nano"), F.col("metric_name").alias("metric"), F.col("value"), F.col("payload").alias("_sk_envelope"), F.col("sketch_type").alias("_sk_sketch_type"),
        F.col("agg_id").alias("_sk_agg_id"), F.col("schema_version").alias("_sk_schema_version"), F.col("window_start_ms").alias("_sk_window_start_ms"),
        F.col("window_end_ms").alias("_sk_window_end_ms"), F.col("encoding").alias("_sk_encoding"),
    ]
    labels = [F.try_element_at("labels", F.lit(k)).alias(k if k not in schemas.RESERVED else "label_" + k) for k in keys]
    return envelopes.select(*fixed, *labels)
