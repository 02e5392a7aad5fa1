"""Envelopes as JSON lines and back: binaries as base64, maps as objects, missing values left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.schemas import ENVELOPE


def to_json(envelopes: DataFrame) -> DataFrame:
    """One text ``value`` per row; labels without a value stay, as null."""
    return envelopes.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def from_json(lines: DataFrame, text: str = "value") -> DataFrame:
    """The envelopes of texts; a text that isn't an envelope gives a row of nulls."""
    return lines.select(F.from_json(F.col(text), ENVELOPE, {"mode": "PERMISSIVE"}).alias("_e")).select("_e.*")
