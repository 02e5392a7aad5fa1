"""Sketches as cell tables: one row per key and non-empty cell.

Updating is a grouped aggregate, merging is the same aggregate over a union, the difference to an empty sketch is the
table itself, and estimates are aggregates or window functions over it.  Spark combines before every shuffle, and a key
never has more rows than its sketch has cells.

``keys`` are the columns that tell sketches apart (plan, series, window).  Every table also has ``n``, the exact number of
points, on some of the rows of a key so that its sum is right.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hash60
from gaugewell.functions.ranked import first_rows

Keys = Sequence[str]


@dataclass(frozen=True)
class DDSketch:
    """Quantiles with relative error ``alpha``: value v lies in bucket ceil(ln |v| / ln gamma) of its sign.

    0 has a bucket of its own.  Null, NaN and infinite values are in no bucket and only count as points (sign null).
    """

    alpha: float = 0.01
    cell = ("sign", "bucket")
    schema = "sign int, bucket int, w bigint"

    @property
    def params(self) -> str:
        return repr(self.alpha)

    @property
    def gamma(self) -> float:
        return (1 + self.alpha) / (1 - self.alpha)

    def cells(self, df: DataFrame, keys: Keys, value: str = "float", extra: Sequence[Column] = ()) -> DataFrame:
        v = F.col(value).cast("double")
        fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        sign = F.when(fine, F.signum(v)).cast("int")
        bucket = F.when(fine & (v != 0), F.ceil(F.log(F.abs(v)) / math.log(self.gamma))).when(fine, 0).cast("int")
        return df.groupBy(*keys, sign.alias("sign"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("w"), F.count(F.lit(1)).alias("n"), *extra)

    def merge(self, cells: DataFrame, keys: Keys, extra: Sequence[Column] = ()) -> DataFrame:
        return cells.groupBy(*keys, *self.cell).agg(F.sum("w").alias("w"), F.sum("n").alias("n"), *extra)

    def value(self, sign: Column, bucket: Column) -> Column:
        return sign * 2 * F.pow(F.lit(self.gamma), bucket) / (self.gamma + 1)

    def quantiles(self, cells: DataFrame, keys: Keys, qs: Sequence[float], maps: Sequence[str] = ()) -> DataFrame:
        """(keys..., q, value, total): for each q the value of the first bucket whose running count exceeds q (n - 1).

        q is clamped to [0, 1]; a key without values has no rows.  With ``maps`` also ``n``, the number of all points of
        the key, and these columns, which are the same on all its rows or any one of theirs.
        """
        w = Window.partitionBy(*keys)  # at most the buckets of one sketch
        counted = F.when(F.col("sign").isNotNull(), F.col("w")).otherwise(0)
        more = {"_n": F.sum("n").over(w)} | {f"_map_{m}": F.first(m).over(w) for m in maps} if maps else {}
        rows = cells.withColumns({"_upto": F.sum(counted).over(w.orderBy("sign", F.col("sign") * F.col("bucket"))), "total": F.sum(counted).over(w)} | more)
        asked = F.inline(F.array(*[F.struct(F.lit(float(q)).alias("q")) for q in qs]))
        at = F.least(F.greatest(F.col("q"), F.lit(0.0)), F.lit(1.0)) * (F.col("total") - 1)
        rows = rows.where("sign is not null and w > 0").select("*", asked).where((F.col("_upto") - F.col("w") <= at) & (at < F.col("_upto")))
        kept = [F.col("_n").alias("n"), *[F.col(f"_map_{m}").alias(m) for m in maps]] if maps else []
        return rows.select(*keys, "q", self.value(F.col("sign"), F.col("bucket")).alias("value"), "total", *kept)


@dataclass(frozen=True)
class HyperLogLog:
    """Distinct counts: 2 ** precision registers of the longest run of leading zeros among 60-bit hashes."""

    precision: int = 12
    cell = ("idx",)
    schema = "idx int, w bigint"

    @property
    def params(self) -> str:
        return str(self.precision)

    def register(self, item: Column) -> tuple[Column, Column]:
        h = hash60(item)
        rest = F.shiftright(h, self.precision)
        width = 60 - self.precision
        rho = F.when(rest == 0, width + 1).otherwise(width + 1 - F.length(F.bin(rest)))
        return h.bitwiseAND((1 << self.precision) - 1).cast("int"), rho.cast("bigint")

    def cells(self, df: DataFrame, keys: Keys, item: str = "item", extra: Sequence[Column] = ()) -> DataFrame:
        idx, rho = self.register(F.col(item))
        return df.groupBy(*keys, idx.alias("idx")).agg(F.max(rho).alias("w"), F.count(F.lit(1)).alias("n"), *extra)

    def merge(self, cells: DataFrame, keys: Keys, extra: Sequence[Column] = ()) -> DataFrame:
        return cells.groupBy(*keys, *self.cell).agg(F.max("w").alias("w"), F.sum("n").alias("n"), *extra)

    def estimate(self, cells: DataFrame, keys: Keys, maps: Sequence[str] = ()) -> DataFrame:
        """(keys..., estimate): harmonic mean, or linear counting while registers are empty and the count is small.

        With ``maps`` also ``n``, the number of all points of the key, and these columns, which go with the key.
        """
        m = 1 << self.precision
        bias = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
        more = [F.sum("n").alias("n")] if maps else []
        some = F.col("idx").isNotNull()
        used = cells.groupBy(*keys, *maps).agg(F.count(F.when(some, 1)).alias("_used"), F.coalesce(F.sum(F.when(some, F.pow(F.lit(2.0), -F.col("w")))), F.lit(0.0)).alias("_sum"), *more)
        raw = F.lit(bias * m * m) / (F.col("_sum") + (m - F.col("_used")))
        small = (raw <= 2.5 * m) & (F.col("_used") < m)
        linear = m * F.log(m / (m - F.col("_used")).cast("double"))
        return used.where("_used > 0").select(*keys, F.when(small, linear).otherwise(raw).alias("estimate"), *(["n", *maps] if maps else []))


@dataclass(frozen=True)
class Frequency:
    """Count-Min (``signed`` False) and CountSketch (True): ``rows`` hashes of an item to ``cols`` cells each.

    The hash of row r is that of ``r|item``; its low bits choose the cell, bit 20 the sign.
    """

    rows: int = 4
    cols: int = 2048
    signed: bool = False
    cell = ("row", "col")
    schema = "row int, col int, w double"

    @property
    def params(self) -> str:
        return f"{self.rows}x{self.cols}"

    def _places(self, item: Column) -> Column:
        hashes = [hash60(F.concat(F.lit(f"{r}|"), item)) for r in range(self.rows)]
        sign = lambda h: F.shiftright(h, 20).bitwiseAND(1) * 2 - 1 if self.signed else F.lit(1).cast("bigint")
        return F.inline(F.array(*[F.struct(F.lit(r).alias("row"), h.bitwiseAND(self.cols - 1).cast("int").alias("col"), sign(h).alias("sign")) for r, h in enumerate(hashes)]))

    def cells(self, df: DataFrame, keys: Keys, item: str = "item", weight: str | None = None, extra: Sequence[Column] = ()) -> DataFrame:
        """Equal items are added up before they are spread over the rows.  Null items only count as points (row null)."""
        w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight), F.lit(1.0))
        items = df.groupBy(*keys, item).agg(F.sum(w).alias("_w"), F.count(F.lit(1)).alias("_n"), *extra)
        kept = [n for n in items.columns if n not in (*keys, item, "_w", "_n")]  # the extra columns
        spread = items.where(F.col(item).isNotNull()).select(*keys, "_w", "_n", *kept, self._places(F.col(item)))
        lost = items.where(F.col(item).isNull()).select(*keys, "_w", "_n", *kept, F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(0).cast("bigint").alias("sign"))
        n = F.when((F.col("row") == 0) | F.col("row").isNull(), F.col("_n")).otherwise(0)
        again = [F.any_value(c).alias(c) for c in kept]
        return spread.unionByName(lost).groupBy(*keys, *self.cell).agg(F.sum(F.col("_w") * F.col("sign")).alias("w"), F.sum(n).alias("n"), *again)

    def merge(self, cells: DataFrame, keys: Keys, extra: Sequence[Column] = ()) -> DataFrame:
        return cells.groupBy(*keys, *self.cell).agg(F.sum("w").alias("w"), F.sum("n").alias("n"), *extra)

    def norms(self, cells: DataFrame, keys: Keys) -> DataFrame:
        """(keys..., row, l1, l2): per row the sum of the cells and of their squares."""
        return cells.where("row is not null").groupBy(*keys, "row").agg(F.sum("w").alias("l1"), F.sum(F.col("w") * F.col("w")).alias("l2"))

    def point(self, cells: DataFrame, items: DataFrame, keys: Keys, item: str = "item") -> DataFrame:
        """(keys..., item, estimate) of the asked items: the least of its cells, or with signs their median.

        ``items`` has the keys and the item; null and empty items are estimated at 0.
        """
        asked = items.select(*keys, item, F.when(F.length(item) > 0, F.col(item)).alias("_i")).distinct()
        places = asked.select(*keys, item, "_i", self._places(F.coalesce("_i", F.lit(""))))
        c = cells.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("row").alias("_row"), F.col("col").alias("_col"), "w")
        same = (F.col("row") == F.col("_row")) & (F.col("col") == F.col("_col"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col("_k_" + k))
        got = places.join(c, same, "left").withColumn("_e", F.coalesce("w", F.lit(0.0)) * F.col("sign") + F.lit(0.0))  # no -0.0
        pick = F.percentile("_e", 0.5) if self.signed else F.min("_e")
        return got.groupBy(*keys, item, "_i").agg(pick.alias("_p")).select(*keys, item, F.when(F.col("_i").isNotNull(), F.col("_p")).otherwise(0.0).alias("estimate"))


    def top(self, cells: DataFrame, candidates: DataFrame, keys: Keys, k: int, item: str = "item") -> DataFrame:
        """(keys..., item, estimate, rank) of the k candidates of each key with the greatest estimates, ties by item.

        A sketch holds no items, so candidates come from elsewhere: a list of frequent ones, or the items of the data.
        Null and empty candidates, and those estimated at 0 or less, aren't ranked.
        """
        asked = self.point(cells, candidates.where(F.length(item) > 0), keys, item).where("estimate > 0")
        first = first_rows(asked, keys, [F.col("estimate").desc(), F.col(item)], k)
        w = Window.partitionBy(*keys).orderBy(F.col("estimate").desc(), F.col(item))  # at most k rows
        return first.withColumn("rank", F.row_number().over(w))


@dataclass(frozen=True)
class Kll:
    """Quantiles with rank error, by Spark's own sketch: one binary per key.  Values that aren't finite only count."""

    k: int = 200

    def build(self, df: DataFrame, keys: Keys, value: str = "float", extra: Sequence[Column] = ()) -> DataFrame:
        v = F.col(value).cast("double")
        fine = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
        return df.groupBy(*keys).agg(F.kll_sketch_agg_double(fine, F.lit(max(self.k, 8))).alias("sketch"), F.count(F.lit(1)).alias("n"), *extra)

    def merge(self, sketches: DataFrame, keys: Keys, extra: Sequence[Column] = ()) -> DataFrame:
        """Weights of the items are kept, so that merged sketches are as good as one over all the data."""
        return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), *extra)

    def quantiles(self, sketches: DataFrame, keys: Keys, qs: Sequence[float], maps: Sequence[str] = ()) -> DataFrame:
        at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(float(q), 0.0), 1.0)))
        asked = F.inline(F.array(*[F.struct(F.lit(float(q)).alias("q"), at(q).alias("value")) for q in qs]))
        some = sketches.where(F.kll_sketch_get_n_double("sketch") > 0)
        return some.select(*keys, asked, F.col("n").alias("total"), *(["n", *maps] if maps else []))
