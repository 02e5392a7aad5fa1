"""A plan at work on batches that keep coming: ``process``, ``tick``, ``drain``, ``shutdown``.

Every batch is reduced to partial cells, written under its own number, so a batch that is tried again replaces itself; one
that is tried again after a tick has merged it is left out.  A tick merges the partials of the windows that have ended,
gives their envelopes, and writes what is still open as one new partial; state is therefore as large as the open windows'
sketches.  The same object serves a plain loop and, by ``attach``, a structured stream.

With ``max_series`` a window holds no more series than that.  ``Drop``: the first ones stay (by batch, within a batch by
time), and points of others count as ``dropped_overflow``.  ``EvictOldest``: after every batch those least recently seen
leave, with what they had; a series that comes again starts anew.

Windows go by event time.  A point for a window that was emitted before is late; with an allowed lateness of 0, or within
it, its window is emitted once more with the new points alone, which merges with the earlier frame.
"""

from __future__ import annotations

import json
import threading
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.errors import ClosedError, PlanError
from gaugewell.functions.ranked import first_rows
from gaugewell.functions.matchers import matches_all
from gaugewell.operators import engine
from gaugewell.operators.sketches import Kll
from gaugewell.operators.windows import is_late
from gaugewell.plans.plan import Plan, PlanSet
from gaugewell.storage import local_table, new_path


@dataclass
class Stats:
    input_observations: int = 0
    input_envelopes: int = 0
    matched: int = 0
    dropped_late: int = 0
    dropped_overflow: int = 0
    evicted_series: int = 0
    emitted_envelopes: int = 0
    ticks: int = 0
    active_series: int = 0
    last_tick_ms: int = 0
    last_emitted_envelopes: int = 0


class Runtime:
    def __init__(self, spark: SparkSession, plan: Plan, folder: str | None = None):
        self.spark, self.plan, self.folder = spark, plan, folder or new_path(spark, "runtime", keep=True)
        self.partials: dict[str, str] = {}  # by batch
        self.counted: dict[str, Stats] = {}
        self.merged: set[str] = set()  # batches that a tick has merged
        self.held: str | None = None  # the series of the open windows, where there is a cap
        self.emitted_until: int | None = None
        self.stats, self.closed, self.number = Stats(), False, 0
        self._lock = threading.RLock()

    # Input

    def process(self, observations: DataFrame, batch: int | str | None = None) -> None:
        """Take a batch of points and of sketches (rows of kind Envelope)."""
        with self._lock:
            if self.closed:
                raise ClosedError("the runtime was shut down")
            self.number += 1
            name = f"batch-{batch if batch is not None else f'own{self.number}'}"
            if name in self.merged:
                return
            plan = self.plan
            late = is_late(F.col("timestamp_ms"), self.emitted_until, plan.allowed_lateness_ms) if self.emitted_until is not None else F.lit(False)
            kind = F.coalesce(F.col("kind"), F.lit(""))
            taken = (kind != "Envelope") & matches_all(plan.matchers)
            got = observations.agg(F.count(F.lit(1)), F.count(F.when(kind == "Envelope", 1)), F.count(F.when(taken, 1)), F.count(F.when(taken & late, 1))).first()
            rows = engine.admitted(plan, observations.where(~late))
            overflow = 0
            if plan.max_series > 0:
                rows, overflow = self._capped(rows, name)
            table = engine.cells(plan, rows)
            if "envelope" in observations.columns:
                envs = observations.where(kind == "Envelope").select("envelope.*")
                table = table.unionByName(engine.merged_cells(plan, envs))
            path = f"{self.folder}/{name}"
            table.write.mode("overwrite").parquet(path)
            before, now = self.counted.get(name, Stats()), Stats(got[0], got[1], got[2] - got[3], got[3], overflow)
            for f in ("input_observations", "input_envelopes", "matched", "dropped_late", "dropped_overflow"):
                setattr(self.stats, f, getattr(self.stats, f) + getattr(now, f) - getattr(before, f))
            self.counted[name] = now
            self.partials[name] = path
            if plan.max_series > 0 and plan.overflow == "EvictOldest":
                self._evict()

    _SERIES = ["window_start_ms", "series"]

    def _capped(self, rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The rows of series that fit the cap of their window, and the number of the others.

        One row per series and window is kept: the batch that brought it, and when it was first and last seen.
        """
        own = rows.groupBy(*self._SERIES).agg(F.min("timestamp_ms").alias("first"), F.max("timestamp_ms").alias("last"), F.count(F.lit(1)).alias("n"))
        own = own.select(*self._SERIES, F.lit(name).alias("batch"), F.lit(self.number).alias("turn"), "first", "last", "n")
        still = F.lit(True) if self.emitted_until is None else F.col("window_start_ms") + self.plan.size_ms > self.emitted_until - self.plan.allowed_lateness_ms
        held = self.spark.read.parquet(self.held).where((F.col("batch") != name) & still) if self.held else own.limit(0)
        both = held.unionByName(own).groupBy(*self._SERIES).agg(
            F.min(F.struct("turn", "first", "batch")).alias("_f"), F.max("last").alias("last"), F.sum(F.when(F.col("batch") == name, F.col("n")).otherwise(0)).alias("n")
        )
        ranked = both.select(*self._SERIES, "_f.batch", "_f.turn", "_f.first", "last", "n")
        path = f"{self.folder}/held-{self.number}"
        ranked.write.mode("overwrite").parquet(path)
        known = self.spark.read.parquet(path)
        if self.plan.overflow == "EvictOldest":
            self.held = path
            return rows, 0
        kept = first_rows(known, ["window_start_ms"], ["turn", "first", "series"], self.plan.max_series)
        kept.write.mode("overwrite").parquet(path + "-kept")
        self.held = path + "-kept"
        fit = self.spark.read.parquet(self.held)
        overflow = known.join(fit, self._SERIES, "left_anti").agg(F.sum("n")).first()[0] or 0
        return rows.join(fit.select(*self._SERIES), self._SERIES, "left_semi"), overflow

    def _evict(self) -> None:
        """Take the least recently seen series above the cap out of what is open."""
        known = self.spark.read.parquet(self.held)
        path = f"{self.folder}/held-{self.number}-kept"
        first_rows(known, ["window_start_ms"], [F.col("last").desc(), "series"], self.plan.max_series).write.mode("overwrite").parquet(path)
        kept = self.spark.read.parquet(path).select(*self._SERIES)
        gone = known.count() - kept.count()
        self.held = path
        if gone:
            self.stats.evicted_series += gone
            one = f"{self.folder}/kept-{self.number}"
            engine.merge_cells(self.plan, self._open().join(kept, self._SERIES, "left_semi")).write.mode("overwrite").parquet(one)
            self.merged |= set(self.partials)
            self.partials = {f"kept-{self.number}": one}

    def attach(self, stream: DataFrame, sink=None, **options):
        """Process every micro-batch of a stream; after each, ``sink`` gets the envelopes of the windows that have ended by
        the latest event time seen.  Start the writer that is returned."""

        def each(batch: DataFrame, number: int) -> None:
            batch.persist()
            try:
                self.process(batch, number)
                latest = batch.agg(F.max("timestamp_ms")).first()[0]
            finally:
                batch.unpersist()
            if sink is not None and latest is not None:
                sink(self.tick(latest), number)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.folder}/checkpoint").options(**options)

    # Output

    def _open(self) -> DataFrame | None:
        return self.spark.read.parquet(*self.partials.values()) if self.partials else None

    def _none(self) -> DataFrame:
        from gaugewell.schemas import ENVELOPE

        return local_table(self.spark, [], ENVELOPE)

    def _emit(self, table: DataFrame, rest: DataFrame | None) -> DataFrame:
        self.number += 1
        out_path, open_path = f"{self.folder}/out-{self.number}", f"{self.folder}/open-{self.number}"
        engine.emit(self.plan, engine.merge_cells(self.plan, table)).write.mode("overwrite").parquet(out_path)
        kept = {}
        if rest is not None:
            engine.merge_cells(self.plan, rest).write.mode("overwrite").parquet(open_path)
            kept = {f"open-{self.number}": open_path}
        self.merged |= set(self.partials)
        self.partials = kept
        out = self.spark.read.parquet(out_path)
        self.stats.last_emitted_envelopes = out.count()
        self.stats.emitted_envelopes += self.stats.last_emitted_envelopes
        self.stats.active_series = self._open().select("series").distinct().count() if kept else 0
        return out

    def tick(self, now_ms: int) -> DataFrame:
        """The envelopes of the windows that have ended by now; in batch mode (size 0) of everything."""
        with self._lock:
            self.stats.ticks, self.stats.last_tick_ms = self.stats.ticks + 1, now_ms
            table = self._open()
            if table is None or (self.plan.size_ms and table.where(F.col("window_end_ms") <= now_ms).isEmpty()):
                return self._none()
            if not self.plan.size_ms:
                return self._emit(table, None)
            self.emitted_until = max(self.emitted_until or 0, now_ms - now_ms % self.plan.step_ms)
            return self._emit(table.where(F.col("window_end_ms") <= now_ms), table.where(F.col("window_end_ms") > now_ms))

    def drain(self) -> DataFrame:
        """The envelopes of everything that is open, with the windows' natural bounds; nothing if there is nothing."""
        with self._lock:
            table = self._open()
            return self._none() if table is None else self._emit(table, None)

    def shutdown(self) -> DataFrame:
        """Take no more points and drain.  Later calls give nothing."""
        with self._lock:
            self.closed = True
            return self.drain()

    def update_config(self, plans: PlanSet) -> DataFrame:
        """Go over to the plan of the same id, else the first; an empty set changes nothing.

        What is open stays, unless its cells don't fit the new sketch or window: then it is drained, and returned.
        """
        with self._lock:
            new = plans.update_for(self.plan)
            same = (new.sketch_type, new.sketch_params, new.size_ms, new.slide_ms, new.aggregate_by) == (self.plan.sketch_type, self.plan.sketch_params, self.plan.size_ms, self.plan.slide_ms, self.plan.aggregate_by)
            out = self._none() if same else self.drain()
            self.plan = new
            return out

    # State that outlives the process

    def save(self, path: str) -> None:
        state = {"plan": json.loads(self.plan.to_json()), "partials": self.partials, "emitted_until": self.emitted_until, "number": self.number, "folder": self.folder, "stats": asdict(self.stats), "merged": sorted(self.merged), "held": self.held, "counted": {k: asdict(v) for k, v in self.counted.items()}}
        Path(path).write_text(json.dumps(state))

    @staticmethod
    def restore(spark: SparkSession, path: str) -> Runtime:
        d = json.loads(Path(path).read_text())
        r = Runtime(spark, Plan.from_json(json.dumps(d["plan"])), d["folder"])
        r.partials, r.emitted_until, r.number, r.stats = d["partials"], d["emitted_until"], d["number"], Stats(**d["stats"])
        r.merged, r.held, r.counted = set(d["merged"]), d["held"], {k: Stats(**v) for k, v in d["counted"].items()}
        return r


def watermarked(plan: Plan, stream: DataFrame, time: str = "ts") -> DataFrame:
    """A plan as one streaming aggregation in append mode: cells (KLL: sketches) of windows the watermark has passed.

    ``time`` is a timestamp column; the watermark lags by the allowed lateness.  Cells go to estimates or envelopes in the
    sink's batches, where window functions are allowed (``engine.emit`` after ``agg_id`` and bounds are there).
    """
    if plan.max_series > 0:
        raise PlanError("a cap on series needs a Runtime: a streaming aggregation can't refuse keys")
    rows = engine.series_columns(stream.where((F.coalesce(F.col("kind"), F.lit("")) != "Envelope") & matches_all(plan.matchers)), plan)
    rows = rows.withWatermark(time, f"{plan.allowed_lateness_ms} milliseconds")
    w = F.window(F.col(time), f"{plan.size_ms} milliseconds", f"{plan.step_ms} milliseconds")
    s = engine.sketch_of(plan)
    keys = ["agg_id", "series", "_w"]
    rows = rows.withColumn("_w", w)
    if not isinstance(s, Kll) and hasattr(s, "rows"):  # one aggregation only: items are spread first
        item, weight = engine.item_of(plan)
        spread = rows.select("agg_id", "series", "_w", "resource", "attrs", weight.alias("_weight"), s._places(item))
        table = spread.groupBy(*keys, *s.cell).agg(F.sum(F.col("_weight") * F.col("sign")).alias("w"), F.sum(F.when(F.col("row") == 0, 1).otherwise(0)).alias("n"), *[F.any_value(c).alias(c) for c in ("resource", "attrs")])
    else:
        table = engine.cells(plan, rows, keys, streaming=True)
    return table.withColumns({"window_start_ms": F.unix_millis("_w.start"), "window_end_ms": F.unix_millis("_w.end")}).drop("_w")
