"""The shapes of the tables that the engine takes and gives."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gaugewell.errors import SchemaError

ENVELOPE = (
    "schema_version int, sketch_type string, agg_id bigint, resource_labels map<string,string>, labels map<string,string>, window_start_ms bigint, window_end_ms bigint, "
    "encoding string, payload binary, metric_name string, count bigint, aggregation_temporality int, value double"
)
OBSERVATION = (
    "timestamp_ms bigint, metric string, resource_labels map<string,string>, labels map<string,string>, kind string, `float` double, hash bigint, bytes binary"
)
#: Columns of a flat batch: the points' own, and those that carry a sketch.
SCALARS = {"time_unix_nano": ("bigint", "timestamp", "timestamp_ntz"), "metric": ("string",), "value": ("double",)}
CARRIERS = {
    "_sk_envelope": ("binary",), "_sk_sketch_type": ("string",), "_sk_agg_id": ("bigint", "int"), "_sk_schema_version": ("int", "bigint"),
    "_sk_window_start_ms": ("bigint",), "_sk_window_end_ms": ("bigint",), "_sk_encoding": ("string",),
}
RESERVED = frozenset(SCALARS) | frozenset(CARRIERS)


def is_reserved(name: str) -> bool:
    return name in RESERVED


def check(df: DataFrame, known: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> dict[str, str]:
    """The known columns that a frame has, with their types; an error where one has another type or is missing."""
    have = dict(df.dtypes)
    for name in required:
        if name not in have:
            raise SchemaError(f"column {name} is missing")
    for name, kinds in known.items():
        if name in have and have[name] not in kinds:
            raise SchemaError(f"column {name} is {have[name]}; it must be {' or '.join(kinds)}")
    return {n: have[n] for n in known if n in have}
