"""Rows that name the same thing more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """The id and the columns, one row per id whose copies agree on the columns; rows without an id are each their own."""
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    return df.select(id_col, alone.alias("_alone"), *columns).distinct().drop("_alone")
