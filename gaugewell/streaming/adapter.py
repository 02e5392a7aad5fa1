"""Between a host and a runtime: what a host's batches are, where results go, and when to tick."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from gaugewell.sources import points
from gaugewell.streaming.runtime import Runtime, Stats


class Adapter:
    """The contract of a host; the defaults read and write flat batches.  Override what differs."""

    def decode(self, batch: DataFrame) -> DataFrame:
        """Observations of one batch.  Rows that can't be read are set aside, not lost: see ``quarantine``."""
        rows = points.decode(batch, strict=False)
        self.quarantine(rows.where("problem is not null"))
        return rows.where("problem is null").drop("problem")

    def quarantine(self, rows: DataFrame) -> None:
        """Rows with their ``problem``; nothing is done with them here."""

    def encode(self, envelopes: DataFrame) -> DataFrame:
        return points.encode(envelopes)

    def emit(self, batch: DataFrame) -> None:
        raise NotImplementedError

    def emit_telemetry(self, stats: Stats) -> None:
        """The counters after every batch and tick."""


class PassThrough(Adapter):
    """A host that forwards every batch as it is."""

    def __init__(self, sink: Callable[[DataFrame], object]):
        self.sink = sink

    def emit(self, batch: DataFrame) -> None:
        self.sink(batch)

    def forward(self, batch: DataFrame) -> DataFrame:
        self.sink(batch)
        return batch


class Host:
    """An adapter and a runtime at work together.

    ``start`` runs the stream of flat batches; ``ticker`` ends windows by the wall clock, one window's length apart, the
    first tick being skipped.  ``shutdown`` waits for what was read, stops both, drains and emits the rest.
    """

    def __init__(self, runtime: Runtime, adapter: Adapter):
        self.runtime, self.adapter, self.query = runtime, adapter, None
        self._stop, self._ticker = threading.Event(), None

    def batch(self, flat: DataFrame, number: int | None = None) -> None:
        self.runtime.process(self.adapter.decode(flat), number)
        self.adapter.emit_telemetry(self.runtime.stats)

    def _give(self, out: DataFrame) -> None:
        if not out.isEmpty():
            self.adapter.emit(self.adapter.encode(out))
        self.adapter.emit_telemetry(self.runtime.stats)

    def tick(self, now_ms: int | None = None) -> None:
        self._give(self.runtime.tick(int(time.time() * 1000) if now_ms is None else now_ms))

    def ticker(self, period_ms: int | None = None) -> Host:
        seconds = (period_ms or self.runtime.plan.size_ms or 1000) / 1000

        def run() -> None:
            while not self._stop.wait(seconds):
                self.tick()

        self._ticker = threading.Thread(target=run, daemon=True)
        self._ticker.start()
        return self

    def start(self, stream: DataFrame, **trigger) -> Host:
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.runtime.folder}/host")
        self.query = (writer.trigger(**trigger) if trigger else writer).start()
        return self

    def shutdown(self) -> None:
        if self.query is not None:
            self.query.processAllAvailable()
            self.query.stop()
        self._stop.set()
        if self._ticker is not None:
            self._ticker.join()
        self._give(self.runtime.shutdown())
