"""Changing plans while running: a channel that is polled, and the loop that hands new plans to a runtime."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from pathlib import Path

from pyspark.sql.streaming import StreamingQueryListener

from gaugewell.plans.plan import PlanSet


class FileChannel:
    """Plans in a JSON file: ``poll`` gives a set whose version hasn't been taken, ``ack`` notes that it has."""

    def __init__(self, path: str):
        self.path, self.acked = Path(path), None

    def poll(self) -> PlanSet | None:
        if not self.path.exists():
            return None
        plans = PlanSet.from_json(self.path.read_text())
        return plans if plans.version != self.acked else None

    def ack(self, version: int) -> None:
        self.acked = version
        self.path.with_suffix(".ack").write_text(json.dumps({"version": version}))


class ControlLoop:
    """Polls at once and then every ``seconds``; ``apply`` gets each new set, and it is acknowledged after that.

    A poll or plan that fails leaves the plans in force and is kept in ``errors``.
    """

    def __init__(self, channel, apply: Callable[[PlanSet], object], seconds: float = 5.0):
        self.channel, self.apply, self.seconds, self.errors = channel, apply, seconds, []
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> ControlLoop:
        self._thread.start()
        return self

    def step(self) -> None:
        try:
            plans = self.channel.poll()
            if plans is not None:
                self.apply(plans)
                self.channel.ack(plans.version)
        except Exception as e:  # the loop must outlive a bad file
            self.errors.append(e)

    def _run(self) -> None:
        self.step()
        while not self._stop.wait(self.seconds):
            self.step()

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()


class Progress(StreamingQueryListener):
    """What streams have read and dropped as late, by query id."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: dict[str, int] = {}
        self.late: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
        self.late[str(p.id)] = self.late.get(str(p.id), 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
