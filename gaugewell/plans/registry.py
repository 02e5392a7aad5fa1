"""Processors by name: a configuration is checked and turned into a running engine by the factory of its URN."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from gaugewell.errors import PlanError
from gaugewell.plans.plan import Plan, resolve

SKETCHES_URN = "urn:gaugewell:processor:sketches"
_FACTORIES: dict[str, tuple[Callable[[Mapping], Plan], Callable]] = {}


def register(urn: str, check: Callable[[Mapping], Plan], create: Callable) -> None:
    """``check`` gives the plan of a configuration or raises; ``create`` takes a session and the plan."""
    _FACTORIES[urn] = (check, create)


def validate(urn: str, config: Mapping) -> Plan:
    if urn not in _FACTORIES:
        raise PlanError(f"no processor {urn!r}; one of {', '.join(sorted(_FACTORIES))}")
    return _FACTORIES[urn][0](config)


def create(spark, urn: str, config: Mapping):
    return _FACTORIES[urn][1](spark, plan) if (plan := validate(urn, config)) else None


def _runtime(spark, plan: Plan):
    from gaugewell.streaming.runtime import Runtime

    return Runtime(spark, plan)


register(SKETCHES_URN, resolve, _runtime)
