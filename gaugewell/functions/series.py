"""Series keys: which rows belong to one series.

The texts are unescaped (``k=v;``), as their readers expect; labels whose values hold ``;`` or ``=`` can thus share a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugewell.functions.labels import entries


def series_attrs(labels: Column, aggregate_by: Sequence[str] = ()) -> Column:
    """The labels of the series: those listed that a row has, or all if none are listed."""
    if not aggregate_by:
        return F.coalesce(F.map_filter(labels, lambda k, v: v.isNotNull()), F.create_map().cast("map<string,string>"))
    names = F.array(*[F.lit(n) for n in dict.fromkeys(aggregate_by)])
    return F.coalesce(F.map_filter(labels, lambda k, v: v.isNotNull() & F.array_contains(names, k)), F.create_map().cast("map<string,string>"))


def attributes_key(labels: Column, aggregate_by: Sequence[str] = ()) -> Column:
    """``k=v;`` of all labels by rising key, or of the listed ones in their order; missing ones are passed over."""
    if aggregate_by:
        parts = [F.coalesce(F.concat(F.lit(n + "="), F.try_element_at(labels, F.lit(n)), F.lit(";")), F.lit("")) for n in aggregate_by]
        return F.concat(*parts)
    return F.concat_ws("", F.transform(entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))))


def series_key(agg_id: Column | int, resource: Column, labels: Column, aggregate_by: Sequence[str] = ()) -> Column:
    """``agg_id|resource|labels``."""
    agg = F.lit(agg_id) if isinstance(agg_id, int) else agg_id
    return F.concat(agg.cast("string"), F.lit("|"), attributes_key(resource), F.lit("|"), attributes_key(labels, aggregate_by))
