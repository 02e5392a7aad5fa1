"""Most frequent items among billions, in bounded memory: count-sketches over prefixes of the items' hashes.

One pass fills, for every group and every prefix length (8, 16, 24, 32 bits of a 64-bit hash), a count-sketch: ``depth``
rows of ``width`` cells, to which each item adds +1 or -1 by a signed hash of its prefix.  The cells of a group are bounded
by levels x depth x width, whatever the number of distinct items, and add up across tasks, files and days.

Then heavy prefixes are descended: the estimate of a prefix is the median over the rows of its signed cells; prefixes of
at least half the threshold are kept and their 256 continuations estimated on the next level.  A second scan counts
exactly the items under the heavy 32-bit prefixes, and those that reach the threshold are returned with true counts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.copies import once
from gaugewell.storage import written

LEVELS = (8, 16, 24, 32)
#: Heavy prefixes that one scan looks for, all broadcast; more take more scans.
MOST_AT_ONCE = 200_000


class FrequentItems:
    """Items (``item``, binary or text) per ``group``; ``id_col``: rows of the same id are copies and count once.

    Null and empty items are none.  A null group is a group of its own; rows without an id are each their own.

    ``least_share`` is the smallest share that will be asked for: the sketches are as wide as it takes for their noise to
    stay well below it, eight cells for each item that could have it and at least 2,048, unless ``width`` says otherwise.
    """

    def __init__(self, df: DataFrame, group: str, item: str, id_col: str | None = None, depth: int = 5, width: int | None = None, least_share: float = 0.005):
        if not 0 < least_share <= 1:
            raise ValueError("shares are above 0 and at most 1")
        width = max(2048, 1 << math.ceil(math.log2(8 / least_share))) if width is None else width
        if width & (width - 1) or depth % 2 == 0:
            raise ValueError("width must be a power of two and depth odd")
        self.least_share = least_share
        self.group, self.item, self.id_col, self.depth, self.width = group, item, id_col, depth, width
        keep = [F.col(id_col).alias("_id")] if id_col else []
        self.rows = df.select(F.col(group).alias("_g"), F.col(item).alias("_item"), *keep).where("_item is not null and octet_length(_item) > 0").withColumn("_h", F.xxhash64("_item"))

    def _cell(self, level: int, row: int, prefix: Column) -> Column:
        mixed = F.xxhash64(prefix, F.lit(level), F.lit(row))
        return mixed.bitwiseAND(self.width - 1).cast("int")

    def _sign(self, level: int, row: int, prefix: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(prefix, F.lit(level), F.lit(row)), 62).bitwiseAND(1) * 2 - 1

    def sketch(self) -> DataFrame:
        """(_g, level, row, cell, s): the signed sums; level 0 holds the number of items of the group."""
        rows = once(self.rows, "_id", "_g", "_h") if self.id_col else self.rows
        adds = [F.struct(F.lit(0).alias("level"), F.lit(0).alias("row"), F.lit(0).alias("cell"), F.lit(1).cast("bigint").alias("x"))]
        for level in LEVELS:
            prefix = F.shiftrightunsigned("_h", 64 - level)
            for row in range(self.depth):
                adds.append(F.struct(F.lit(level).alias("level"), F.lit(row).alias("row"), self._cell(level, row, prefix).alias("cell"), self._sign(level, row, prefix).cast("bigint").alias("x")))
        return rows.select("_g", F.inline(F.array(*adds))).groupBy("_g", "level", "row", "cell").agg(F.sum("x").alias("s"))

    @staticmethod
    def merge(*sketches: DataFrame) -> DataFrame:
        """The sketch of all the data of several sketches."""
        return reduce(DataFrame.unionByName, sketches).groupBy("_g", "level", "row", "cell").agg(F.sum("s").alias("s"))

    def heavy(self, sketch: DataFrame, share: float) -> DataFrame:
        """(_g, _total, _prefix): the 32-bit prefixes estimated at half the share or more."""
        totals = sketch.where("level = 0").select("_g", F.col("s").alias("_total"))
        known = totals.withColumn("_prefix", F.lit(0).cast("bigint"))
        for level in LEVELS:
            longer = F.explode(F.sequence(F.shiftleft("_prefix", 8), F.shiftleft("_prefix", 8) + 255))
            parts = known.select("_g", "_total", longer.alias("_prefix"))
            asked = F.inline(F.array(*[F.struct(F.lit(r).alias("row"), self._cell(level, r, F.col("_prefix")).alias("cell"), self._sign(level, r, F.col("_prefix")).alias("sign")) for r in range(self.depth)]))
            cells = sketch.where(F.col("level") == level).select(F.col("_g").alias("_cg"), F.col("row").alias("_row"), F.col("cell").alias("_cell"), "s")
            same = (F.col("row") == F.col("_row")) & (F.col("cell") == F.col("_cell")) & F.col("_g").eqNullSafe(F.col("_cg"))
            found = parts.select("_g", "_total", "_prefix", asked).join(cells, same, "left")
            estimate = F.sort_array(F.collect_list(F.coalesce("s", F.lit(0)) * F.col("sign")))[self.depth // 2]
            known = found.groupBy("_g", "_total", "_prefix").agg(estimate.alias("_e")).where(F.col("_e") >= F.col("_total") * (share / 2)).drop("_e")
        return known

    def find(self, share: float, sketch: DataFrame | None = None) -> DataFrame:
        """(group, item, count, total) of the items that make up at least ``share`` of their group's, counted exactly."""
        if share < self.least_share:
            raise ValueError(f"the sketches are for shares of {self.least_share} and more")
        heavy = written(self.heavy(written(self.sketch(), "cells") if sketch is None else sketch, share), "heavy")
        scans = max(1, -(-heavy.count() // MOST_AT_ONCE))
        found = None
        for k in range(scans):
            side = heavy.where(F.pmod(F.xxhash64("_g", "_prefix"), F.lit(scans)) == k).select(F.col("_g").alias("_hg"), F.col("_prefix"), "_total")
            same = (F.shiftrightunsigned("_h", 32) == F.col("_prefix")) & F.col("_g").eqNullSafe(F.col("_hg"))
            near = self.rows.join(F.broadcast(side), same).drop("_hg", "_prefix", "_h")  # about MOST_AT_ONCE rows
            counted = (once(near, "_id", "_g", "_item", "_total") if self.id_col else near).groupBy("_g", "_item", "_total").agg(F.count(F.lit(1)).alias("count"))
            found = counted if found is None else found.unionByName(counted)
        least = F.col("_total") * share * (1 - 1e-12)  # the product may be rounded up
        return found.where(F.col("count") >= least).select(F.col("_g").alias(self.group), F.col("_item").alias(self.item), "count", F.col("_total").alias("total"))
