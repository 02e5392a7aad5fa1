"""Full and delta frames.

A series' first frame is full; later ones are deltas against an empty sketch, that is their own window's cells, so that
every frame stands for its window alone.  KLL frames are always full.  ``against_previous`` gives the changes between the
sketches of consecutive windows, and ``apply`` puts them back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.functions.series import attributes_key
from gaugewell.plans.plan import KLL, Plan


def frames(plan: Plan, envs: DataFrame) -> DataFrame:
    """The envelopes with their encoding set: full for the first window of a series, delta after it."""
    if plan.sketch_type == KLL:
        return envs.withColumn("encoding", F.lit(plan.full_encoding))
    first = Window.partitionBy("agg_id", attributes_key(F.col("resource_labels")), attributes_key(F.col("labels"))).orderBy("window_start_ms")
    return envs.withColumn("encoding", F.when(F.row_number().over(first) == 1, plan.full_encoding).otherwise(plan.delta_encoding))


def with_previous(envs: DataFrame) -> DataFrame:
    """The envelopes with ``previous``, the payload of the same series' frame before, and ``first`` where there is none."""
    w = Window.partitionBy("agg_id", attributes_key(F.col("resource_labels")), attributes_key(F.col("labels"))).orderBy("window_start_ms")
    return envs.withColumn("previous", F.lag("payload").over(w)).withColumn("first", F.row_number().over(w) == 1)


def against_previous(cells: DataFrame, series: Sequence[str], cell: Sequence[str], size_ms: int) -> DataFrame:
    """(series..., window_start_ms, cell..., delta): per cell, this window's weight less that of the window before.

    Cells that didn't change have no row.  A window after one without points has the window before it taken as empty.
    The windows that follow the last one of a cell give its negative, so that applying all deltas ends at nothing.
    """
    keys = [*series, "window_start_ms", *cell]
    now = cells.select(*keys, F.col("w").alias("delta"))
    before = cells.select(*series, (F.col("window_start_ms") + size_ms).alias("window_start_ms"), *cell, (-F.col("w")).alias("delta"))
    return now.unionByName(before).groupBy(*keys).agg(F.sum("delta").alias("delta")).where("delta <> 0")


def apply(deltas: DataFrame, series: Sequence[str], cell: Sequence[str], size_ms: int) -> DataFrame:
    """The cells that deltas add up to: the running sum of each cell, kept for every window until its next change."""
    w = Window.partitionBy(*series, *cell).orderBy("window_start_ms")
    runs = deltas.withColumn("w", F.sum("delta").over(w)).withColumn("_next", F.lead("window_start_ms").over(w)).where("w <> 0")
    last = F.greatest(F.coalesce(F.col("_next") - size_ms, F.col("window_start_ms")), F.col("window_start_ms"))
    starts = F.explode(F.sequence("window_start_ms", last, F.lit(size_ms).cast("bigint")))
    return runs.select(*series, starts.alias("window_start_ms"), *cell, "w")
