"""The first rows of each group, without any task holding a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_THRESHOLD = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows of each group in the order given.

    Spark limits the groups in every task before the shuffle (WindowGroupLimit), so at most n rows per task and group
    meet, but only up to a threshold of the session; that is raised to n where it is lower.
    """
    spark = df.sparkSession
    if int(spark.conf.get(_THRESHOLD)) < n:
        spark.conf.set(_THRESHOLD, str(n))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
