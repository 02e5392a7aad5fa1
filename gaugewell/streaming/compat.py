"""The strict runtime: one active window at a time, in order of arrival.

Points never choose their own window: what isn't too late goes to the active one, whatever its time.  It is inherently one
sequence per plan, so it runs as one sorted stream per plan, with memory for the series of one window; use the event-time
engine unless these very rules are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from gaugewell.plans.plan import Plan


@dataclass
class ActiveWindow:
    """Counts per series of the active window.  ``observe`` says what became of a point, ``tick`` gives an ended window."""

    size_ms: int
    lateness_ms: int = 0
    max_series: int = 0
    overflow: str = "Drop"
    start: int | None = None
    end: int = 0
    series: dict[str, list[int]] = field(default_factory=dict)  # [count, last seen]
    late: int = 0
    dropped: int = 0
    evicted: int = 0

    def observe(self, ts: int, key: str) -> str:
        if self.start is None:
            self.start = ts // self.size_ms * self.size_ms if self.size_ms else ts
            self.end = self.start + self.size_ms
        if self.lateness_ms > 0 and ts + self.lateness_ms < self.start:
            self.late += 1
            return "late"
        entry = self.series.get(key)
        if entry is None:
            if 0 < self.max_series <= len(self.series):
                if self.overflow != "EvictOldest":
                    self.dropped += 1
                    return "overflow"
                self.series.pop(min(self.series, key=lambda k: self.series[k][1]))
                self.evicted += 1
            entry = self.series[key] = [0, ts]
        entry[0] += 1
        entry[1] = max(entry[1], ts)
        return "ok"

    def tick(self, now: int) -> list[tuple[int, int, str, int, int]]:
        """(start, end, series, count, last seen) of the window if it has ended by now; the next holds now."""
        if self.start is None or (self.size_ms and now < self.end):
            return []
        out = [(self.start, self.end, k, n, seen) for k, (n, seen) in sorted(self.series.items())]
        self.series = {}
        bucket = now // self.size_ms * self.size_ms if self.size_ms else now
        self.start = bucket if bucket > self.start else self.end
        self.end = self.start + self.size_ms
        return out

    def drain(self) -> list[tuple[int, int, str, int, int]]:
        return self.tick(self.end) if self.series else []


RESULT = "agg_id bigint, window_start_ms bigint, window_end_ms bigint, series string, n bigint, last_seen_ms bigint"


def replay(plan: Plan, rows: DataFrame, order: str) -> DataFrame:
    """The windows that the strict runtime emits for rows (``agg_id``, ``series``, ``timestamp_ms``) in their order.

    The clock is the points' own: a point at or after the active window's end ticks first.  One task reads one plan's rows
    sorted, in batches, and holds the series of one window.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[int, ActiveWindow] = {}
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            out = []
            for agg, key, ts in zip(batch["agg_id"], batch["series"], batch["timestamp_ms"]):
                s = states.setdefault(agg, ActiveWindow(plan.size_ms, plan.allowed_lateness_ms, plan.max_series, plan.overflow))
                out += [(agg, *x) for x in s.tick(int(ts))] if plan.size_ms else []
                s.observe(int(ts), key)
            if out:
                yield pd.DataFrame(out, columns=names)
        rest = [(agg, *x) for agg, s in states.items() for x in s.drain()]
        if rest:
            yield pd.DataFrame(rest, columns=names)

    ready = rows.where("timestamp_ms is not null").select("agg_id", "series", "timestamp_ms", order)
    return ready.repartition("agg_id").sortWithinPartitions("agg_id", order).mapInPandas(run, RESULT)
