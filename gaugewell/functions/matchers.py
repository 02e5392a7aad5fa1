"""Label predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

EQUAL, NOT_EQUAL = "Equal", "NotEqual"


@dataclass(frozen=True)
class LabelMatcher:
    """``name`` "" is the metric's name, of which an empty one counts as missing.

    Equal: a missing label fails, even against the empty value.  NotEqual: a missing label passes.
    """

    name: str
    value: str
    op: str = EQUAL

    def __post_init__(self) -> None:
        if self.op not in (EQUAL, NOT_EQUAL):
            raise ValueError(f"unknown operation {self.op!r}")

    @staticmethod
    def equal(name: str, value: str) -> LabelMatcher:
        return LabelMatcher(name, value)

    def predicate(self, labels: Column, metric: Column) -> Column:
        have = F.nullif(metric, F.lit("")) if self.name == "" else F.try_element_at(labels, F.lit(self.name))
        return have == self.value if self.op == EQUAL else ~have.eqNullSafe(self.value)


def matches_all(matchers, labels: Column | None = None, metric: Column | None = None) -> Column:
    """Whether a row matches every matcher; no matchers admit all.  Resource labels aren't looked at."""
    labels = F.col("labels") if labels is None else labels
    metric = F.col("metric") if metric is None else metric
    return reduce(and_, [m.predicate(labels, metric) for m in matchers], F.lit(True))
