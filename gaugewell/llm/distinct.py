"""Distinct counts over huge identifier sets: the k smallest hash values of each group.

A sketch is a set of rows (group..., h): the k smallest distinct 60-bit hashes of the group's identifiers.  Sketches merge
by keeping the k smallest of the union, so days, files and finer groups combine into coarser ones.  A group with fewer
than k hashes is known exactly; otherwise its size is (k - 1) / U for the largest kept hash U as a share of all hashes,
with a relative standard error of 1 / sqrt(k - 2).

Groups of very many identifiers are trimmed before their first shuffle: a first pass counts them roughly, by a sketch of
fixed size, and hashes that are certainly or almost certainly not among the k smallest of their group are left out where
they are read.  A group that comes out with fewer than k for that reason is done again without it, so sketches are exact.

Unions, intersections and differences of two groups count the kept hashes under the lesser of both groups' thresholds and
divide by it; their confidence bounds are those of a binomial share.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hash60
from gaugewell.functions.ranked import first_rows
from gaugewell.storage import written

SPACE = float(1 << 60)
#: Groups that are trimmed, those with the most identifiers; the bound of what is broadcast.
MOST_TRIMMED = 10_000
#: Hashes left per trimmed group, in multiples of k, by the rough count.
LEFT = 2


class KSmallest:
    """``k``: hashes kept per group; ``z``: standard deviations of the confidence bounds.

    Null identifiers are none.  Equal identifiers count once however often they come, so copies of rows need no care.
    Identifiers are hashed here, whether or not they look hashed.  A null in a group column is a group of its own.
    """

    def __init__(self, k: int = 1024, z: float = 1.96):
        if k < 3:
            raise ValueError("k must be at least 3")
        self.k, self.z = k, z

    def sketch(self, df: DataFrame, groups: Sequence[str], identifier: str) -> DataFrame:
        """The sketch of every group."""
        names = [f"_g{k}" for k in range(len(groups))]
        rows = df.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], hash60(F.col(identifier)).alias("h")).where("h is not null")
        rough = rows.groupBy(*names).agg(F.approx_count_distinct("h", 0.05).alias("_d"))
        large = written(rough.where(F.col("_d") > LEFT * self.k).orderBy(F.col("_d").desc()).limit(MOST_TRIMMED), "large")
        # The hashes of a group are spread evenly: of d, LEFT * k are expected below this one, of which k are enough.
        large = large.select(*[F.col(n).alias("_t" + n) for n in names], (F.lit(LEFT * self.k * SPACE) / F.col("_d")).cast("bigint").alias("_below"))
        if large.isEmpty():
            return self.merge(rows, names).select(*self._out(groups, names), "h")
        same = reduce(and_, [F.col(n).eqNullSafe(F.col("_t" + n)) for n in names], F.lit(True))
        trimmed = rows.join(F.broadcast(large), same, "left").where("_below is null or h < _below").select(*names, "h")  # at most MOST_TRIMMED rows
        out = written(self.merge(trimmed, names), "trimmed")
        kept = out.groupBy(*names).agg(F.count(F.lit(1)).alias("_kept")).where(F.col("_kept") >= self.k).select(*[F.col(n).alias("_k" + n) for n in names])
        full = reduce(and_, [F.col("_t" + n).eqNullSafe(F.col("_k" + n)) for n in names], F.lit(True))
        short = written(large.join(kept, full, "left_anti").drop("_below"), "short")
        if not short.isEmpty():
            again = self.merge(rows.join(F.broadcast(short), same, "left_semi"), names)  # some of the groups of large
            out = out.join(F.broadcast(short), same, "left_anti").unionByName(again)
        return out.select(*self._out(groups, names), "h")

    @staticmethod
    def _out(groups: Sequence[str], names: Sequence[str]) -> list[Column]:
        return [F.col(n).alias(g) for g, n in zip(groups, names)]

    def merge(self, sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
        """The sketches as those of the (coarser) groups.

        Equal hashes are dropped by a shuffle on group and hash, so a hot group is spread; then every task keeps the k
        smallest of its rows before they meet, so at most k rows per task and group do.
        """
        rows = sketches.select(*groups, "h").distinct()
        return first_rows(rows, groups, ["h"], self.k)

    def estimate(self, sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
        """(group..., kept, estimate, low, high)."""
        kept = sketches.groupBy(*groups).agg(F.count(F.lit(1)).alias("kept"), F.max("h").alias("_u"))
        full, share = F.col("kept") >= self.k, (F.col("_u") + F.lit(1)).cast("double") / SPACE
        guess, error = F.lit(float(self.k - 1)) / share, self.z / math.sqrt(self.k - 2)
        pick = lambda c: F.when(full, F.round(c, 6)).otherwise(F.col("kept").cast("double"))
        return kept.select(*groups, "kept", pick(guess).alias("estimate"), pick(guess / (1 + error)).alias("low"), pick(guess / (1 - error) if error < 1 else F.lit(float("inf"))).alias("high"))

    def compare(self, left: DataFrame, right: DataFrame, pair: Sequence[str]) -> DataFrame:
        """(pair..., op, estimate, low, high) for op union, intersection, left_only and right_only.

        ``left`` and ``right`` are sketches whose group columns are ``pair``; a pair with one side only is compared with
        the empty set.
        """
        both = left.select(*pair, "h", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*pair, "h", F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        w = Window.partitionBy(*pair)  # at most 2 k rows
        top = lambda side: F.when(F.sum(side).over(w) >= self.k, F.max(F.when(F.col(side) == 1, F.col("h"))).over(w)).otherwise(F.lit(1 << 60))
        marked = both.withColumn("_theta", F.least(top("_l"), top("_r")))
        hashes = marked.groupBy(*pair, "_theta", "h").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
        under = F.col("h") < F.col("_theta")
        n = lambda c: F.count(F.when(under & c, 1))
        l, r = F.col("_l") == 1, F.col("_r") == 1
        counted = hashes.groupBy(*pair, "_theta").agg(n(F.lit(True)).alias("union"), n(l & r).alias("intersection"), n(l & ~r).alias("left_only"), n(r & ~l).alias("right_only"))
        ops = F.inline(F.array(*[F.struct(F.lit(o).alias("op"), F.col(o).alias("_n")) for o in ("union", "intersection", "left_only", "right_only")]))
        share = F.col("_theta").cast("double") / SPACE
        spread = self._spread(share)
        return counted.select(*pair, "_theta", ops).select(
            *pair, "op", F.round(F.col("_n") / share, 6).alias("estimate"),
            F.round(F.greatest((F.col("_n") - spread) / share, F.col("_n").cast("double")), 6).alias("low"), F.round((F.col("_n") + spread) / share, 6).alias("high"),
        )

    def _spread(self, share: Column) -> Column:
        """Bound of the count's own error; of a count of 0 the rule of three."""
        return F.when(share >= 1, F.lit(0.0)).when(F.col("_n") == 0, F.lit(3.0)).otherwise(self.z * F.sqrt(F.col("_n") * (1 - share)))
