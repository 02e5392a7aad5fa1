"""Hashes that other engines can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash60(c: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a bigint that isn't negative; null for null."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
