"""Label maps as text: canonical label sets and series keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entries(labels: Column) -> Column:
    """The labels that have a value, by rising key; an absent map has none."""
    present = F.map_filter(labels, lambda k, v: v.isNotNull())
    return F.coalesce(F.array_sort(F.map_entries(present)), F.array().cast("array<struct<key:string,value:string>>"))


def escaped(c: Column) -> Column:
    for sign in ("\\", ";", "="):
        c = F.replace(c, F.lit(sign), F.lit("\\" + sign))
    return c


def label_set(labels: Column) -> Column:
    """``k=v;`` of every label, escaped, so that different sets have different texts; empty for null and empty maps."""
    return F.concat_ws("", F.transform(entries(labels), lambda e: F.concat(escaped(e["key"]), F.lit("="), escaped(e["value"]), F.lit(";"))))
