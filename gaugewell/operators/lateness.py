"""Per-period aggregates by event time that late records correct until a cut-off: lambda views.

Three layers over one master log of first arrivals:

*   The fast layer adds new arrivals to provisional periods as increments (``fast``; ``fast_stream`` for a live source).
*   The scheduled batch (``run``) recomputes every open period from the log, replaces it, freezes the periods whose
    cut-off (end + allowed lateness) has passed, and writes out the records that came after it.  What is new to a run goes
    by the batches of the log that earlier runs had, not by arrival: a record that arrived in time but was ingested after
    its period froze is added to the frozen period by the next run, and ``amended`` names it.
*   ``serve`` merges the frozen periods, the open ones of the last batch, and the fast increments since then.

Times are those of arrival; run r takes what arrived up to ``r * interval_ms``.  The log holds one folder per batch (a call
of ``ingest`` or a micro-batch of the stream), partitioned by run and by ``lag``, the intervals between event and run, so a
run reads the folders of its new records and those that can hold events of open periods, and no others.  A batch leaves
out the copies of observations that the log has at the same or an earlier arrival; one that arrived earlier than the log
knew is added and counts instead of the other.

What becomes of a record in a window is one decision (``_FATE``), by the state in which the last run left the window:
counted in an open one that is recomputed, added to one that never freezes, amended into a frozen one it had arrived in
time for, or late.  The views and the late records of a run both come from it.

A plan with no cut-off (allowed lateness 0) has no period that ever freezes.  Its aggregates (counts, extremes) only ever
grow, so a run adds the new arrivals' part to them instead of computing all of history again.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.storage import local_table, mark, names, new_path

_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)
#: A set of plans is configuration and read by the driver; more than this is taken for a mistake.
MOST_PLANS = 100_000
#: Runs of a replay that are at work at the same time.
AT_ONCE = 4
#: ``known_ms``: the arrival of the copy that the log had before, null if it had none.
LOG = "obs_id bigint, metric string, event_ms bigint, arrival_ms bigint, value double, known_ms bigint, batch string, run bigint, lag int"
#: Lags beyond these are in the folder of the nearest one.
LAGS = (-2, 6)
VIEW = "agg_id bigint, window_start_ms bigint, n_obs bigint, n_values bigint, min_value double, max_value double"
LATE = "agg_id bigint, window_start_ms bigint, obs_id bigint"
#: What makes an observation one, with its copies.
_SAME = ["obs_id", "metric", "event_ms"]
_IN_TIME = "(cutoff is null or arrival_ms <= cutoff)"
#: In time, and not counted in this window at the arrival that was known before.
_MORE = f"{_IN_TIME} and (known_ms is null or known_ms > cutoff)"
#: By ``_was``, the state of the window after the run before (null: it never freezes), and whether the record is new.
_FATE = f"""case when _new and known_ms is null and not {_IN_TIME} then 'late'
when _was = 'open' and {_IN_TIME} then 'counted'
when _was is null and _new and known_ms is null then 'grown'
when _was = 'frozen' and _new and {_MORE} then 'amended' end"""


@dataclass(frozen=True)
class WindowPlan:
    agg_id: int
    metric: str | None
    size_ms: int
    step_ms: int
    lateness_ms: int  # 0: no cut-off


def window_plans(plans: DataFrame) -> list[WindowPlan]:
    """The plans with windows: a plan without a size or a metric has none.  Equal rows count once."""
    rows = plans.select("agg_id", "metric", "size_ms", "slide_ms", "allowed_lateness_ms").where("size_ms > 0 and metric is not null").distinct().limit(MOST_PLANS + 1).collect()
    if len(rows) > MOST_PLANS:
        raise ValueError(f"more than {MOST_PLANS} plans")
    return [WindowPlan(a, m, size, slide or size, late or 0) for a, m, size, slide, late in map(tuple, rows)]


def window_starts(ts: Column, size: Column, step: Column) -> Column:
    """The starts of the windows that hold a time: multiples of the step with start <= ts < start + size, none if null.

    Times at the very ends of 64 bits are in those windows whose start 64 bits can hold.
    """
    low = F.coalesce(F.try_subtract(ts, size - 1), F.lit(_LEAST))
    first, last = F.try_add(low, F.pmod(step - F.pmod(low, step), step)), F.try_subtract(ts, F.pmod(ts, step))
    return F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<bigint>"))


def _sum(*parts: Column) -> Column:
    """The sum of a time and lengths that aren't negative; what 64 bits can't hold is as late as can be."""
    out = parts[0]
    for p in parts[1:]:
        out = F.coalesce(F.try_add(out, p), F.lit(_MOST))
    return out


def _alone() -> Column:
    """Tells the rows without an id apart."""
    return F.when(F.col("obs_id").isNull(), F.monotonically_increasing_id()).alias("_alone")


@dataclass
class LambdaViews:
    """See the module.  ``folder`` holds the log, the views and the late records; a new one in the shared folder if None."""

    spark: SparkSession
    plans: list[WindowPlan]
    interval_ms: int = 86_400_000
    folder: str | None = None
    done: list[int] = field(default_factory=list)  # the runs so far, rising
    seen: list[str] = field(default_factory=list)  # the batches of the log that the last run had; goes with done

    def __post_init__(self) -> None:
        if self.done and not self.seen:
            raise ValueError("done needs seen, the batches that the last run had")
        self.folder = self.folder or new_path(self.spark, "views", keep=True)
        rows = [(p.metric, p.agg_id, p.size_ms, p.step_ms, p.lateness_ms) for p in self.plans]
        self._plans = local_table(self.spark, rows, "metric string, agg_id bigint, size bigint, step bigint, lateness bigint")

    # The log

    def first_arrivals(self, observations: DataFrame) -> DataFrame:
        """One row per observation of a planned metric, at its first arrival.

        Copies of an ``obs_id`` differ in their arrival alone and count once; rows without an id are each their own.
        A row without an arrival counts as having arrived at its event time.  ``value`` is the float of Float rows.
        Null and 0 event times lie in no window, so those rows aren't kept.
        """
        i = self.interval_ms
        return (
            observations.select(
                "obs_id", "metric", F.col("timestamp_ms").alias("event_ms"), F.coalesce("received_ms", "timestamp_ms").alias("_at"),
                F.when(F.col("kind") == "Float", F.col("float")).alias("value"), _alone(),
            )
            .where("event_ms <> 0")
            .join(F.broadcast(self._plans.select("metric").distinct()), "metric", "left_semi")  # at most MOST_PLANS rows
            .groupBy("obs_id", "_alone", "metric", "event_ms").agg(F.min("_at").alias("arrival_ms"), F.max("value").alias("value"))
            .select("obs_id", "metric", "event_ms", "arrival_ms", "value", F.expr(f"arrival_ms div {i} + if(arrival_ms % {i} > 0, 1, 0)").alias("run"))
            .withColumn("lag", F.least(F.greatest(F.col("run") - F.expr(f"event_ms div {i} - if(event_ms % {i} < 0, 1, 0)"), F.lit(LAGS[0])), F.lit(LAGS[1])).cast("int"))
        )

    def ingest(self, observations: DataFrame) -> None:
        """Add to the master log, as a batch of its own.  Copies of an observation may come in any call."""
        name = f"i{uuid.uuid4().hex}"
        self._add(observations, name)
        mark(self.spark, f"{self.folder}/batches/{name}")

    def _add(self, observations: DataFrame, name: str) -> None:
        """Write a batch of the log; it is part of the log once it is marked as whole."""
        rows = self.first_arrivals(observations)
        if self._batches():
            known = self.log().where("obs_id is not null").groupBy(*_SAME).agg(F.min("arrival_ms").alias("known_ms"))
            rows = rows.join(known, _SAME, "left").where("known_ms is null or arrival_ms < known_ms")
        else:
            rows = rows.withColumn("known_ms", F.lit(None).cast("bigint"))
        rows.write.mode("overwrite").partitionBy("run", "lag").parquet(f"{self.folder}/log/batch={name}")

    def _batches(self) -> list[str]:
        """The batches of the log that are whole."""
        return names(self.spark, f"{self.folder}/batches")

    def log(self, batches: list[str] | None = None) -> DataFrame:
        """The rows of these batches, all if None: an observation has more than one if a later batch knew an earlier arrival."""
        paths = [f"{self.folder}/log/batch={b}" for b in (self._batches() if batches is None else batches)]
        if not paths:
            return local_table(self.spark, [], LOG)
        return self.spark.read.schema(LOG).option("basePath", f"{self.folder}/log").parquet(*paths)

    def _observations(self, r: int | None, since: int | None, batches: list[str], seen: list[str], reach: int | None = None) -> DataFrame:
        """Of what arrived up to run r (None: all): one row per observation, with ``_new``, whether it is new since a run,
        which had the batches ``seen``.

        New are those that the run didn't have, and those that it had at a later arrival, ``known_ms``.  With ``reach``
        what isn't new and lies more than it before that run may be left out.
        """
        rows = self.log(batches)
        if r is not None:
            rows = rows.where(F.col("run") <= r)
        taken = F.lit(False) if since is None else (F.col("run") <= since) & F.col("batch").isin(seen)
        once = len(batches) < 2  # a batch has an observation once
        if since is not None and reach is not None:
            bound = since * self.interval_ms - reach
            if once:
                rows = rows.where(~taken | self._from(bound))
            else:  # an older observation may be that of a new row
                low = rows.where(~taken).agg(F.min("event_ms")).first()[0]
                rows = rows.where(self._from(bound if low is None else min(bound, low)))
        if once:
            return rows.withColumns({"known_ms": F.lit(None).cast("bigint"), "_new": ~taken})
        rows = rows.groupBy(*_SAME, _alone()).agg(
            F.min("arrival_ms").alias("arrival_ms"), F.max("value").alias("value"), F.min(F.when(taken, F.col("arrival_ms"))).alias("known_ms")
        )
        return rows.withColumn("_new", F.expr("known_ms is null or arrival_ms < known_ms"))

    def _from(self, bound: int) -> Column:
        """Events from a time on, by folder first: a folder's events are ``lag`` intervals before its run, or further off
        at both ends."""
        folder = (F.col("run") - F.col("lag") >= bound // self.interval_ms) | (F.col("lag") == LAGS[0])
        return folder & (F.col("event_ms") >= min(max(bound, _LEAST), _MOST))

    # Windows

    def _windows(self, log: DataFrame, since: int | None = None) -> DataFrame:
        """One row per record, plan and window: with ``cutoff`` (null if none), ``_was`` (the window's state after a run,
        null if it never freezes) and ``fate``."""
        joined = log.join(F.broadcast(self._plans), "metric")  # at most MOST_PLANS rows
        starts = window_starts(F.col("event_ms"), F.col("size"), F.col("step"))
        rows = joined.select("*", F.explode(starts).alias("window_start_ms"))
        rows = rows.withColumn("cutoff", F.when(F.col("lateness") > 0, _sum(F.col("window_start_ms"), F.col("size"), F.col("lateness"))))
        return rows.withColumn("_was", self._state(since)).withColumn("fate", F.expr(_FATE))

    def _state(self, r: int | None) -> Column:
        """The state in which run r leaves a window; before any run all are open."""
        at = _LEAST if r is None else min(max(r * self.interval_ms, _LEAST), _MOST)
        return F.when(F.col("cutoff") <= at, "frozen").when(F.col("cutoff").isNotNull(), "open")

    @staticmethod
    def _aggregate(rows: DataFrame, *more: str) -> DataFrame:
        number = F.when(~F.isnan("value"), F.col("value"))
        return rows.groupBy("agg_id", "window_start_ms", *more).agg(
            F.count(F.lit(1)).alias("n_obs"), F.count(number).alias("n_values"), F.min(number).alias("min_value"), F.max(number).alias("max_value")
        )

    @staticmethod
    def merge(views: DataFrame) -> DataFrame:
        """Partial views of the same periods as one."""
        return views.groupBy("agg_id", "window_start_ms").agg(
            F.sum("n_obs").alias("n_obs"), F.sum("n_values").alias("n_values"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value")
        )

    # The layers

    def run(self, r: int) -> None:
        """The scheduled batch at ``r * interval_ms``; runs come in rising order."""
        if self.done and r <= self.done[-1]:
            raise ValueError("runs come in rising order")
        batches = self._batches()
        self._run(r, self.done[-1] if self.done else None, batches, self.seen)
        self.done.append(r)
        self.seen = batches

    def _run(self, r: int, since: int | None, batches: list[str], seen: list[str]) -> None:
        reach = max((p.size_ms + p.lateness_ms for p in self.plans if p.lateness_ms > 0), default=0)
        log = self._observations(r, since, batches, seen, reach)
        late = self._windows(log.where("_new"), since).where("fate = 'late'")
        late.select("agg_id", "window_start_ms", "obs_id").distinct().write.mode("overwrite").parquet(f"{self.folder}/late/at={r}")

        rows = self._windows(log, since)
        if since is not None and not set(batches) <= set(seen):  # something that arrived before that run may be new
            gone = rows.where("fate = 'amended'").select("agg_id", "window_start_ms", "obs_id")
            gone.write.mode("overwrite").parquet(f"{self.folder}/amended/at={r}")
        kept = rows.where("fate <> 'late'").withColumn("state", F.coalesce(self._state(r), F.lit("grown")))
        self._aggregate(kept, "state").write.mode("overwrite").partitionBy("state").parquet(f"{self.folder}/views/at={r}")

    def replay(self, until_ms: int | None = None) -> LambdaViews:
        """The scheduled runs up to a time, or to the last arrival in the log, as they would have happened; one more run if
        what was ingested since the last one all arrived before it.

        A run at which nothing had arrived since the one before is left out: it would only freeze periods, which the
        next run does as well.  A run reads the log up to its own time and nothing that other runs wrote, so a few run
        at once.
        """
        batches = self._batches()
        runs = [x[0] for x in self.log(batches).select("run").distinct().orderBy("run").collect()]  # one per interval with arrivals
        last = self.done[-1] if self.done else None
        due = [r for r in runs if (last is None or r > last) and (until_ms is None or r * self.interval_ms <= until_ms)]
        if not due and self.done and until_ms is None and not set(batches) <= set(self.seen):
            due = [last + 1]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(self._run, due, [last, *due], repeat(batches), [self.seen, *[batches] * len(due)]))
        if due:
            self.done += due
            self.seen = batches
        return self

    def _views(self, state: str, runs: list[int]) -> DataFrame:
        empty = local_table(self.spark, [], VIEW)
        if not runs:
            return empty
        paths = [f"{self.folder}/views/at={r}" for r in runs]
        return self.spark.read.schema(VIEW + ", state string").option("basePath", f"{self.folder}/views").parquet(*paths).where(F.col("state") == state).select(empty.columns)

    def fast(self, arrivals: DataFrame, now_ms: int | None = None) -> DataFrame:
        """The increments of arrivals since the last run up to now (None: all): provisional until the next run replaces them."""
        rows = arrivals if now_ms is None else arrivals.where(F.col("arrival_ms") <= now_ms)
        return self._aggregate(self._windows(rows).where(_MORE))

    def serve(self, now_ms: int | None = None) -> DataFrame:
        """The periods as known now: frozen, open and fast ones merged."""
        out = self._views("frozen", self.done).unionByName(self._views("grown", self.done)).unionByName(self._views("open", self.done[-1:]))
        if now_ms is not None:
            log = self._observations(None, self.done[-1] if self.done else None, self._batches(), self.seen)
            out = out.unionByName(self.fast(log.where("_new"), now_ms))
        return self.merge(out)

    def late(self) -> DataFrame:
        """(agg_id, window_start_ms, obs_id) of the records that came after the cut-off, of the runs so far.

        Without those of which a copy that came in time was ingested later.
        """
        if not self.done:
            return local_table(self.spark, [], LATE)
        out = self.spark.read.schema(LATE).parquet(*[f"{self.folder}/late/at={r}" for r in self.done])
        return out.join(self.amended(), ["agg_id", "window_start_ms", "obs_id"], "left_anti") if self._amending() else out

    def _amending(self) -> list[str]:
        have = set(names(self.spark, f"{self.folder}/amended"))
        return [f"{self.folder}/amended/at={r}" for r in self.done if f"at={r}" in have]

    def amended(self) -> DataFrame:
        """(agg_id, window_start_ms, obs_id) of the records in time that were added to periods after these had frozen."""
        paths = self._amending()
        return self.spark.read.schema(LATE).parquet(*paths) if paths else local_table(self.spark, [], LATE)

    def fast_stream(self, observations: DataFrame, **options):
        """The fast layer over a live source: every micro-batch is a batch of the log, and its increments are written.

        So runs, ``serve`` and ``late`` have it as they have what is ingested.  A batch that is tried again overwrites its
        own folders, so nothing counts twice.  Copies in different batches are told apart by the log, rows without an id
        are each their own, and nothing is dropped for its arrival.  One stream writes to a folder.
        """

        def write(batch: DataFrame, number: int) -> None:
            name = f"s{number}"
            if name in self._batches():
                return
            self._add(batch, name)
            self.fast(self.log([name]).withColumn("_new", F.lit(True))).write.mode("overwrite").parquet(f"{self.folder}/fast/batch={number}")
            mark(self.spark, f"{self.folder}/batches/{name}")

        return observations.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.folder}/stream").options(**options)
