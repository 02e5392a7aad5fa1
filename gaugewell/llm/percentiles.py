"""Percentiles per group of very large numeric columns, by exact bisection.

Doubles are mapped to integers of the same order.  Every (group, percentile) has an interval of these integers that holds
its target rank.  A pass counts the rows below the midpoints and narrows every interval; as one pass over the data counts
for the midpoints of ``bits`` halvings at once (the rows in each of 2**bits parts, summed up from below), few passes
resolve all 64 bits.  Counts are combined before the shuffle, and no task ever holds more than the parts of one interval,
however many rows a group has.

The first pass takes ``first_bits`` halvings and is stored per part of the data (a day, a file) as counts of cells.  Cells
of different parts are combined by adding counts; they alone give an interval for every percentile whose ends are within
a relative ``2 ** -(first_bits - 12)`` of each other (``bounds``; 0.4 percent for 20 bits).

Exact values (``exact``) come from more passes, over what the first one has written: (group, value, count), each value of
a group once, so that a value that a third of all rows have is one row.  Groups go by two 64-bit hashes of their columns;
a dictionary of groups gives the columns back and makes sure that no two groups share both.  The second pass meets the
intervals by a shuffle on group, cell and a salt, and keeps the values inside them; the passes after it read only those.
Nothing is broadcast or brought to the driver, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.functions.copies import once
from gaugewell.storage import written

_MANTISSA = float(1 << 52)
#: Parts into which the values of one cell are spread in the second pass.
SALTS = 8


def ordered(v: Column) -> Column:
    """A bigint that orders doubles as their values do; -0.0 and 0.0 are one, null and NaN give null.

    It is the bit pattern of the absolute value, with the sign of the value, found by exact arithmetic: a power of two
    divides without rounding.
    """
    a = F.abs(v)
    guess = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023)).cast("double")
    p = F.pow(F.lit(2.0), guess)
    e = F.when(a < p, guess - 1).when(a / p >= 2, guess + 1).otherwise(guess)
    e = F.greatest(e, F.lit(-1022.0))
    m = a / F.pow(F.lit(2.0), e)
    bits = F.when(m < 1, (m * _MANTISSA).cast("bigint")).otherwise((e + 1023).cast("bigint") * (1 << 52) + ((m - 1) * _MANTISSA).cast("bigint"))
    bits = F.when(a == 0, F.lit(0)).when(a == float("inf"), F.lit(2047 << 52)).otherwise(bits)
    return F.when(v.isNull() | F.isnan(v), F.lit(None).cast("bigint")).when(v < 0, -bits).otherwise(bits)


def value_of(key: Column) -> Column:
    """The double of an ordered integer."""
    bits = F.abs(key)
    e, m = F.shiftright(bits, 52), bits.bitwiseAND((1 << 52) - 1).cast("double") / _MANTISSA
    value = F.when(e == 2047, F.lit(float("inf"))).when(e == 0, m * F.pow(F.lit(2.0), F.lit(-1022.0))).otherwise((m + 1) * F.pow(F.lit(2.0), (e - 1023).cast("double")))
    return F.when(key < 0, -value).otherwise(value)


class Bisection:
    """Percentiles of ``value`` per group of the columns ``groups``, null being a group of its own.

    ``permille``: the percentiles wanted, in thousandths; the rank of q among n values is ceil(q * n / 1000), at least 1
    (the least value that at least that share of the values doesn't exceed).  Null and NaN are no values; infinities are
    values like others.  Rows with the same ``id_col`` are copies and count once (copies agree in all but columns not
    named here); with ``id_col`` None every row counts.  Other columns aren't read.
    """

    def __init__(self, df: DataFrame, groups: Sequence[str], value: str, permille: Sequence[int], id_col: str | None = None, part: str | None = None, first_bits: int = 20, bits: int = 16):
        if not (1 <= first_bits <= 24 and 1 <= bits <= 20):
            raise ValueError("first_bits must be 1 to 24 and bits 1 to 20")
        self.groups, self.permille, self.first, self.bits = list(groups), sorted(set(permille)), first_bits, bits
        self.names = [f"_g{k}" for k in range(len(self.groups))]  # so that no name of the data can clash
        self.id_col = id_col
        cols = [F.col(g).alias(n) for g, n in zip(self.groups, self.names)]
        keep = [F.col(id_col).alias("_id")] if id_col else []
        day = F.col(part) if part else F.lit(None).cast("string")
        self.rows = df.select(*cols, *keep, day.alias("_part"), ordered(F.col(value).cast("double")).alias("_key")).where("_key is not null")

    def _once(self, rows: DataFrame, *names: str) -> DataFrame:
        return once(rows, "_id", *names, "_key") if self.id_col else rows

    def _cell(self) -> Column:
        return F.shiftright("_key", 64 - self.first)

    def partials(self) -> DataFrame:
        """(group..., _part, _cell, n): the counts of the first pass, one set per part of the data."""
        rows = self._once(self.rows, *self.names, "_part")
        return rows.groupBy(*self.names, "_part", self._cell().alias("_cell")).agg(F.count(F.lit(1)).alias("n"))

    def merge(self, partials: DataFrame) -> DataFrame:
        """The counts of all parts together; counts from elsewhere may be in the union that is given."""
        return partials.groupBy(*self.names, "_cell").agg(F.sum("n").alias("n"))

    def targets(self, merged: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """(group..., q, total, rank, below, _prefix): the cell of each target rank and the number of rows below it."""
        names = self.names if names is None else list(names)
        w = Window.partitionBy(*names)  # at most 2 ** first_bits cells
        counted = merged.withColumn("_upto", F.sum("n").over(w.orderBy("_cell"))).withColumn("total", F.sum("n").over(w))
        rank = lambda q: F.greatest(F.expr(f"(total * {int(q)} + 999) div 1000"), F.lit(1))
        wanted = F.inline(F.array(*[F.struct(F.lit(q).alias("q"), rank(q).alias("rank")) for q in self.permille]))
        below = F.col("_upto") - F.col("n")
        found = counted.select(*names, "total", "_upto", below.alias("below"), F.col("_cell").alias("_prefix"), wanted)
        return found.where("below < rank and rank <= _upto").drop("_upto")

    def bounds(self, merged: DataFrame) -> DataFrame:
        """(group..., n, q, low, high): each percentile lies in [low, high], from the combined partial counts alone."""
        t, width = self.targets(merged), 64 - self.first
        low = F.shiftleft("_prefix", width)
        high = F.when(F.col("_prefix") == (1 << (self.first - 1)) - 1, F.lit((1 << 63) - 1)).otherwise(low + F.lit((1 << width) - 1))
        cap = F.lit(2047 << 52)
        return t.select(*self._out(), F.col("total").alias("n"), "q", value_of(F.greatest(low, -cap)).alias("low"), value_of(F.least(high, cap)).alias("high"))

    def _out(self) -> list[Column]:
        return [F.col(n).alias(g) for n, g in zip(self.names, self.groups)]

    _ID = ["_a", "_b"]  # a group

    def exact(self) -> DataFrame:
        """(group..., n, q, value): the exact percentiles, q in thousandths."""
        text = F.to_json(F.struct(*self.names), {"ignoreNullFields": "false"})
        named = self.rows.withColumns({"_a": F.xxhash64(text), "_b": F.xxhash64(F.lit(1), text)})
        groups = named.select(*self._ID, *self.names).distinct()
        alone = F.count(F.lit(1)).over(Window.partitionBy(*self._ID)) == 1
        groups = groups.withColumn("_one", alone).where(F.when(F.col("_one"), True).otherwise(F.raise_error(F.lit("two groups share their hashes")).cast("boolean"))).drop("_one")

        # What copies of a row and equal values of a group come to, before anything is compared.
        values = written(self._once(named, *self._ID).groupBy(*self._ID, "_key").agg(F.count(F.lit(1)).alias("n")), "values")
        cells = values.groupBy(*self._ID, self._cell().alias("_cell")).agg(F.sum("n").alias("n"))
        targets = written(self.targets(cells, self._ID), "targets")

        salted = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("_prefix", "_cell")
        spread = values.withColumns({"_cell": self._cell(), "_salt": F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")})
        near = written(spread.join(salted, [*self._ID, "_cell", "_salt"]).select(*self._TARGET, "_key", "n"), "near")
        done = self.first
        while True:
            done = min(done + self.bits, 64)
            found = self._narrowed(near, done)
            if done == 64:
                break
            found = written(found, "narrowed")
            inside = found.withColumnRenamed("below", "_below").withColumnRenamed("_prefix", "_p").select(*self._ID, "q", "_below", "_p")
            near = near.withColumn("_p", F.shiftright("_key", 64 - done)).join(inside, [*self._ID, "q", "_p"]).drop("_p", "below").withColumnRenamed("_below", "below")
        return found.join(groups, self._ID).select(*self._out(), F.col("total").alias("n"), "q", value_of(F.col("_prefix")).alias("value"))

    _TARGET = [*_ID, "q", "total", "rank", "below"]

    def _narrowed(self, near: DataFrame, done: int) -> DataFrame:
        """One more pass: count the values of each interval by their first ``done`` bits and keep the part with the rank."""
        counted = near.groupBy(*self._TARGET, F.shiftright("_key", 64 - done).alias("_prefix")).agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*self._ID, "q").orderBy("_prefix")  # at most 2 ** bits parts
        out = counted.withColumn("_upto", F.col("below") + F.sum("n").over(w))
        return out.where("_upto - n < rank and rank <= _upto").select(*self._ID, "q", "total", "rank", (F.col("_upto") - F.col("n")).alias("below"), "_prefix")
