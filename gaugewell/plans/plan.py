"""What one aggregation does: the plan, its defaults and checks, and reading it from JSON, TOML or a table."""

from __future__ import annotations

import json
import math
import re
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame

from gaugewell.errors import PlanError
from gaugewell.functions.matchers import LabelMatcher

#: The sketch types and encodings by name.
DDSKETCH, KLL, HLL, COUNT_SKETCH, COUNT_MIN = "DDSketch", "KLLSketch", "HLLSketch", "CountSketch", "CountMinSketch"
SKETCH_TYPES = ("Unspecified", DDSKETCH, KLL, HLL, COUNT_SKETCH, COUNT_MIN)
ENCODINGS = ("UNSPECIFIED", "PROTO_FULL", "PROTO_DELTA", "MSGPACK", "MSGPACK_DELTA")
MODES = ("Tumbling", "Batch", "Sliding", "Session")
OVERFLOW = ("Drop", "Block", "EvictOldest")  # Block can't wait in a batch and drops
SCHEMA_VERSION = 1
#: Sketches of the user by type name: a function of the plan that gives an object with ``cell``, ``schema``,
#: ``cells(rows, keys, extra=...)`` and ``merge(cells, keys, extra)``, like those of ``operators.sketches``.
CUSTOM: dict = {}


@dataclass(frozen=True)
class Plan:
    """One aggregation.  Sizes are in milliseconds; ``size_ms`` 0 is one window over all of the input (batch mode)."""

    agg_id: int = 0
    metric_name: str = ""
    sketch_type: str = DDSKETCH
    sketch_params: Mapping[str, float] = field(default_factory=dict)
    size_ms: int = 0
    slide_ms: int = 0
    mode: str = "Tumbling"
    allowed_lateness_ms: int = 0  # 0: nothing is too late
    matchers: tuple[LabelMatcher, ...] = ()
    aggregate_by: tuple[str, ...] = ()  # empty: all labels
    omit_resource: bool = False
    global_aggregation: bool = False
    max_series: int = 0  # 0: no cap
    overflow: str = "Drop"
    transmit_sketch: bool = True
    quantiles: tuple[float, ...] = ()
    encoding: str = "PROTO_FULL"
    delta: bool = False
    window_stats: bool = False
    temporality: int = 0

    def __post_init__(self) -> None:
        def need(ok: bool, why: str) -> None:
            if not ok:
                raise PlanError(f"plan {self.agg_id}: {why}")

        need(self.sketch_type in SKETCH_TYPES or self.sketch_type in CUSTOM, f"unknown sketch type {self.sketch_type!r}; one of {', '.join(SKETCH_TYPES)}")
        need(self.encoding in ENCODINGS, f"unknown encoding {self.encoding!r}")
        need(self.mode in MODES and self.overflow in OVERFLOW, "unknown mode or overflow policy")
        need(min(self.size_ms, self.slide_ms, self.allowed_lateness_ms, self.max_series) >= 0, "negative size, slide, lateness or cap")
        need(self.mode not in ("Sliding", "Session") or self.size_ms > 0, f"{self.mode} needs a size")
        if not self.transmit_sketch:  # otherwise nothing would ever be emitted
            need(self.sketch_type in (DDSKETCH, KLL, HLL), f"{self.sketch_type} has no scalar estimate to emit")
            need(self.sketch_type == HLL or bool(self.quantiles), "estimates of a quantile sketch need quantiles")

    @property
    def step_ms(self) -> int:
        return self.slide_ms or self.size_ms

    def param(self, name: str, default: float) -> float:
        return float(self.sketch_params.get(name, default))

    # The sketch's own sizes, with values that make no sense replaced by the defaults.

    @property
    def alpha(self) -> float:
        a = self.param("relative_accuracy", self.param("alpha", 0.01))
        return a if 0 < a < 1 else 0.01

    @property
    def k(self) -> int:
        return positive_int(self.param("k", 200), 200)

    @property
    def precision(self) -> int:
        return min(max(positive_int(self.param("precision", 12), 12), 4), 18)

    @property
    def shape(self) -> tuple[int, int]:
        """Rows and columns of a frequency sketch: columns a power of two, rows within the bits of one 64-bit hash."""
        rows = positive_int(self.param("rows", self.param("depth", 4)), 4)
        cols = positive_int(self.param("cols", self.param("width", 2048)), 2048)
        return clamp_shape(rows, cols)

    @property
    def full_encoding(self) -> str:
        return "MSGPACK" if self.encoding.startswith("MSGPACK") else "PROTO_FULL"

    @property
    def delta_encoding(self) -> str:
        return "MSGPACK_DELTA" if self.encoding.startswith("MSGPACK") else "PROTO_DELTA"

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"sketch_params": dict(self.sketch_params)}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Plan:
        return plan_of(json.loads(text))


@dataclass(frozen=True)
class PlanSet:
    """The plans in force and their version."""

    plans: tuple[Plan, ...] = ()
    version: int = 0

    def find(self, agg_id: int) -> Plan | None:
        return next((p for p in self.plans if p.agg_id == agg_id), None)

    def update_for(self, current: Plan) -> Plan:
        """The plan that takes over from the current one: that of the same id, else the first; an empty set changes nothing."""
        return (self.find(current.agg_id) or self.plans[0]) if self.plans else current

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "plans": [json.loads(p.to_json()) for p in self.plans]})

    @staticmethod
    def from_json(text: str) -> PlanSet:
        d = json.loads(text)
        return PlanSet(tuple(map(plan_of, d.get("plans", []))), int(d.get("version", 0)))


def positive_int(x: float, default: int) -> int:
    """The whole part of a number of at least 1, else the default."""
    return int(x) if math.isfinite(x) and x >= 1 else default


def clamp_shape(rows: int, cols: int) -> tuple[int, int]:
    bits = max(math.ceil(math.log2(max(cols, 1))), 0)
    return max(1, min(rows, 64 // bits if bits else rows)), 1 << bits


def plan_of(d: Mapping) -> Plan:
    """A plan from parsed JSON; unknown fields are errors."""
    known = {f.name for f in fields(Plan)}
    if odd := set(d) - known:
        raise PlanError(f"unknown fields: {', '.join(sorted(odd))}")
    d = dict(d)
    d["matchers"] = tuple(m if isinstance(m, LabelMatcher) else LabelMatcher(**m) for m in d.get("matchers", ()))
    for name in ("aggregate_by", "quantiles"):
        d[name] = tuple(d.get(name) or ())
    return Plan(**d)


_UNITS = {"ms": 1, "s": 1000, "sec": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000}


def duration_ms(text: str | int) -> int:
    """Milliseconds of a duration as people write it: ``10s``, ``1m 30s``, ``500ms``; a bare number is milliseconds."""
    if isinstance(text, int):
        return text
    parts = re.findall(r"(\d+)\s*([a-z]+)", text)
    if not parts or re.sub(r"\d+\s*[a-z]+|\s", "", text) or any(u not in _UNITS for _, u in parts):
        raise PlanError(f"not a duration: {text!r}")
    return sum(int(n) * _UNITS[u] for n, u in parts)


#: User-level settings beside those of a plan: sketch by any case, a window as people write it.
_USER = {"sketch", "window", "slide", "allowed_lateness", "controller_url", "agent_id"}


def resolve(config: Mapping) -> Plan:
    """The plan of a user's configuration.

    ``sketch`` is matched without regard to case; ``window`` must be more than 0 and is 10 s if left out; sketch
    parameters that aren't numbers are passed over; unknown settings are errors.  Emitted values are deltas
    (temporality 1) if nothing else is said.
    """
    own = {f.name for f in fields(Plan)}
    if odd := set(config) - own - _USER:
        raise PlanError(f"unknown settings: {', '.join(sorted(odd))}")
    d = {k: v for k, v in config.items() if k in own}
    name = str(config.get("sketch", d.get("sketch_type", DDSKETCH)))
    match = {t.lower(): t for t in (*SKETCH_TYPES[1:], *CUSTOM)}
    if name.lower() not in match:
        raise PlanError(f"unknown sketch {name!r}; one of {', '.join(match.values())}")
    size = duration_ms(config["window"]) if "window" in config else d.get("size_ms", 10_000)
    if size <= 0:
        raise PlanError("the window must be more than 0")
    d |= {"sketch_type": match[name.lower()], "size_ms": size}
    for key, to in (("slide", "slide_ms"), ("allowed_lateness", "allowed_lateness_ms")):
        if key in config:
            d[to] = duration_ms(config[key])
    d["sketch_params"] = {k: float(v) for k, v in dict(d.get("sketch_params", {})).items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    d.setdefault("temporality", 1)
    return plan_of(d)


def load(path: str) -> Plan:
    """The plan of a TOML or JSON configuration file."""
    text = Path(path).read_text()
    return resolve(tomllib.loads(text) if path.endswith(".toml") else json.loads(text))


def from_table(df: DataFrame, most: int = 100_000) -> PlanSet:
    """The plans of a table of configurations, which is read by the driver; rows that repeat count once."""
    names = ("agg_id", "metric", "sketch_type", "sketch_params", "size_ms", "slide_ms", "allowed_lateness_ms", "aggregate_by", "max_series")
    rows = df.select(*names).limit(most + 1).collect()
    if len(rows) > most:
        raise PlanError(f"more than {most} plans")
    plans = {}
    for a, metric, kind, params, size, slide, late, by, cap in map(tuple, rows):
        p = Plan(a or 0, metric or "", kind or "Unspecified", {k: v for k, v in (params or {}).items() if v is not None}, size or 0, slide or 0, "Sliding" if slide else "Tumbling", late or 0, (LabelMatcher.equal("", metric or ""),), tuple(by or ()), max_series=cap or 0)
        plans.setdefault(p.agg_id, p)
    return PlanSet(tuple(plans[a] for a in sorted(plans)))


def with_sketch(plan: Plan, sketch_type: str, **params: float) -> Plan:
    return replace(plan, sketch_type=sketch_type, sketch_params=params)
