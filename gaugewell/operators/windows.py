"""Windows, late points and caps on the number of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.ranked import first_rows
from gaugewell.operators.lateness import window_starts
from gaugewell.plans.plan import Plan


def assign(df: DataFrame, plan: Plan, ts: str = "timestamp_ms") -> DataFrame:
    """``window_start_ms`` and ``window_end_ms`` of every row; with a slide one row per window that holds the point.

    Windows start at the multiples of the step.  Size 0 is one window of no length at the first point's time.  Windows
    without points don't exist.  A point without a time is in no window.
    """
    if plan.mode == "Session":
        raise ValueError("session windows depend on the group; see sessions()")
    if plan.size_ms == 0:
        first = df.agg(F.min(ts)).first()[0] or 0
        return df.withColumn("window_start_ms", F.lit(first).cast("bigint")).withColumn("window_end_ms", F.col("window_start_ms"))
    size, t = F.lit(plan.size_ms).cast("bigint"), F.col(ts)
    if plan.step_ms == plan.size_ms:
        out = df.where(t.isNotNull()).withColumn("window_start_ms", t - F.pmod(t, size))
    else:
        out = df.withColumn("window_start_ms", F.explode(window_starts(t, size, F.lit(plan.step_ms).cast("bigint"))))
    return out.withColumn("window_end_ms", F.col("window_start_ms") + size)


def sessions(df: DataFrame, gap_ms: int, keys: list[str], aggs: list[Column], ts: str = "timestamp_ms") -> DataFrame:
    """Aggregates per key and session: points less than the gap apart are one session, which ends a gap after its last."""
    df.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")  # before the shuffle too
    w = F.session_window(F.timestamp_millis(F.col(ts)), F.lit(f"{gap_ms} milliseconds"))
    out = df.where(F.col(ts).isNotNull()).groupBy(*keys, w.alias("_w")).agg(*aggs)
    return out.select(*keys, F.unix_millis("_w.start").alias("window_start_ms"), F.unix_millis("_w.end").alias("window_end_ms"), *[c for c in out.columns if c not in (*keys, "_w")])


def is_late(ts: Column, active_start_ms: Column | int, lateness_ms: int) -> Column:
    """Whether a point is too late for the active window; with lateness 0 none is."""
    active = F.lit(active_start_ms) if isinstance(active_start_ms, int) else active_start_ms
    return F.coalesce(ts + lateness_ms < active, F.lit(False)) if lateness_ms > 0 else F.lit(False)


def drop_late(df: DataFrame, plan: Plan, arrival: str = "received_ms") -> DataFrame:
    """Without the points that arrived later than the allowed lateness after the end of their window."""
    if plan.allowed_lateness_ms <= 0 or arrival not in df.columns:
        return df
    return df.where(F.coalesce(F.col(arrival) <= F.col("window_end_ms") + plan.allowed_lateness_ms, F.lit(True)))


def cap_series(df: DataFrame, plan: Plan, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of the first ``max_series`` series of each window, by first arrival, and those of the others.

    Only one row per series and window is ranked, and each task passes on no more than the cap.
    """
    if plan.max_series <= 0:
        return df, df.limit(0)
    by = ["agg_id", "window_start_ms"]
    first = df.groupBy(*by, "series").agg(F.min(F.struct(*order)).alias("_first"))
    kept = first_rows(first, by, ["_first", "series"], plan.max_series).select(*by, "series")
    on = [*by, "series"]
    return df.join(kept, on, "left_semi"), df.join(kept, on, "left_anti")
