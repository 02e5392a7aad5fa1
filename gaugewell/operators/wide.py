"""Entity, attribute, value rows into one wide row per entity, by column-block pivoting.

1.  Every value is parsed to the canonical text of its attribute's type, and rows are reduced to one per entity and
    attribute: the least and the greatest canonical text, which are one if the values agree.  Spark combines these before
    the shuffle, and the shuffle key holds the attribute too, so an entity with a third of all rows is no hot spot.
2.  The reduced rows are written once in the shared folder, one folder per block of attributes, all blocks with the same
    bucketing by entity.
3.  Each block is pivoted from its own files, and the blocks are joined on the entity; neither needs another shuffle,
    however many thousand attributes there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.storage import local_table, new_path, scratch_table

TYPES = ("string", "long", "double", "boolean", "timestamp", "binary")
#: Declared keys are part of the result's schema; more than this is taken for a mistake.
MOST_KEYS = 100_000
#: Bytes of the attributes, as Spark estimates them, for one bucket; there are at least as many as shuffle partitions.
BUCKET_BYTES = 64 << 20
#: What a cell is, by ``state``: its readable values are one, or they differ or there are none.
ONE, WRONG = 1, 2

#: By rule, every character that is white space.
_SPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
_NUMERAL = r"(?-U)^([+-]?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?\z"
_TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]+))?(?:Z|([+-])([0-9]{2}):([0-9]{2}))\z"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(_SPACE))


def _rarely(f: Callable[[Column], Column], v: Column) -> Column:
    """f of a value, as a lambda: what few values need stays out of the generated code, which must be short to be compiled
    to machine code."""
    return F.element_at(F.transform(F.array(v), f), 1)


def whole_number(v: Column) -> Column:
    """The canonical text of a decimal numeral that is whole and fits 64 bits; else null."""
    plain = F.when(v.rlike(r"^[+-]?[0-9]{1,18}\z"), v.try_cast("bigint").cast("string"))
    return F.coalesce(plain, _rarely(_odd_number, v))


def _odd_number(v: Column) -> Column:
    part = lambda k: F.regexp_extract(v, _NUMERAL, k)
    frac, digits = part(3), F.concat(part(2), part(3))
    power = F.when(part(4) == "", F.lit(0)).otherwise(F.coalesce(part(4).try_cast("int"), F.when(part(4).startswith("-"), -(1 << 30)).otherwise(1 << 30)))
    shift = power.cast("bigint") - F.length(frac)
    plain = F.regexp_replace(digits, "^0+", "")
    up = F.when(F.length(plain) + shift <= 19, F.concat(plain, F.repeat(F.lit("0"), F.least(shift, F.lit(19)).cast("int"))))
    keep = F.length(digits) + shift
    tail = F.greatest(keep, F.lit(0)).cast("int")
    down = F.when((keep > 0) & ~digits.substr(tail + 1, F.length(digits)).rlike("[1-9]"), digits.substr(F.lit(1), tail))
    number = F.when(plain == "", F.lit("0")).when(shift >= 0, up).otherwise(down)
    return F.when(v.rlike(_NUMERAL), F.concat(part(1), number).try_cast("bigint").cast("string"))


def real_number(v: Column) -> Column:
    return F.when(v.rlike(_NUMERAL), (v.try_cast("double") + F.lit(0.0)).cast("string"))


def boolean(v: Column) -> Column:
    low = F.lower(v)
    return F.when(low.isin("true", "t", "yes", "1"), "true").when(low.isin("false", "f", "no", "0"), "false")


def instant(v: Column) -> Column:
    """Microseconds since 1970 as text, what is finer behind a point; or null.

    Times up to the microsecond and with an offset that Spark knows (up to 18 hours) are read by its own cast, once they
    are known to have the form; the others are taken apart.
    """
    usual = F.when(v.rlike(_TIME.replace("([0-9]+)", "[0-9]{1,6}", 1)), F.unix_micros(v.try_cast("timestamp")).cast("string"))
    return F.coalesce(usual, _rarely(_odd_instant, v))


def _odd_instant(v: Column) -> Column:
    part = lambda k: F.regexp_extract(v, _TIME, k)
    micros = F.rpad(F.substring(part(3), 1, 6), 6, "0")
    finer = F.regexp_replace(F.substring(part(3), 7, 1_000_000), "0+$", "")
    local = F.unix_micros(F.concat(part(1), F.lit("T"), part(2), F.lit("."), micros, F.lit("Z")).try_cast("timestamp"))
    hours, minutes = part(5).try_cast("bigint"), part(6).try_cast("bigint")
    ahead = F.when(part(4) == "", F.lit(0)).when((hours < 24) & (minutes < 60), (hours * 60 + minutes) * F.when(part(4) == "-", -60_000_000).otherwise(60_000_000))
    text = F.concat((local - ahead).cast("string"), F.when(finer == "", "").otherwise(F.concat(F.lit("."), finer)))
    epoch = F.regexp_replace(F.concat(v, F.lit("000")), "^0+(?=[0-9])", "")
    return F.when(v.rlike(r"^[0-9]+\z"), epoch).when(v.rlike(_TIME), text)


def canonical(v: Column, kind: Column) -> Column:
    """The text by which values of a type are compared; null if the value can't be read as that type."""
    return (
        F.when(kind.isin("string", "binary"), v)
        .when(kind == "long", whole_number(v))
        .when(kind == "double", real_number(v))
        .when(kind == "boolean", boolean(v))
        .when(kind == "timestamp", instant(v))
    )


def typed(text: Column, kind: str) -> Column:
    """The typed value of a canonical text."""
    if kind == "timestamp":  # null beyond what a timestamp can hold
        return F.timestamp_micros(F.substring_index(text, ".", 1).try_cast("bigint"))
    if kind == "binary":
        return F.unhex(text)
    return text.cast({"long": "bigint"}.get(kind, kind))


def declared(keys: DataFrame) -> list[tuple[str, str, str]]:
    """(raw key, attribute, type), each raw key once.

    Rows with a null or an unknown type are passed over.  Of several declarations of a raw key or several types of an
    attribute the first in order of text holds.
    """
    rows = keys.select("raw_key", "attr_name", "value_type").dropna().distinct().limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} declared keys")
    kinds: dict[str, str] = {}
    of: dict[str, str] = {}
    for raw, attr, kind in sorted(map(tuple, rows)):
        if kind in TYPES:
            kinds.setdefault(attr, kind)
            of.setdefault(raw, attr)
    return [(raw, attr, kinds[attr]) for raw, attr in of.items()]


class BlockPivot:
    """The cells of declared attributes, in blocks of ``block_size`` attributes with one row per entity that has any.

    A cell has a ``state``, and the canonical text where its readable values are one; both are null where the entity has no
    value.  Pivots of states aggregate whole numbers only and read no texts.

    Rows with a null entity or key, an undeclared key or no value are nobody's; repeated rows count once in effect.
    Columns beside the named ones aren't read, so their names can't clash.
    """

    def __init__(self, attributes: DataFrame, keys: DataFrame, entity: str = "parent_id", block_size: int = 8, buckets: int | None = None):
        self.entity, self.spark = entity, attributes.sparkSession
        self.keys = declared(keys)
        # Attributes of fixed width come first, so that their blocks are aggregated by hash.
        self.attributes = sorted({(a, t) for _, a, t in self.keys}, key=lambda x: (x[1] in ("string", "binary"), x))
        self.block_size = block_size
        reduced = self._reduce(attributes)
        self.buckets = buckets or self._buckets(attributes)
        self.stored = self._store(reduced)

    def _buckets(self, attributes: DataFrame) -> int:
        size = int(str(attributes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        known = size < 1 << 60  # Spark guesses the most there is for what isn't a file
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // BUCKET_BYTES), 100_000) if known else 1)

    def _reduce(self, df: DataFrame) -> DataFrame:
        number = {a: k for k, (a, _) in enumerate(self.attributes)}
        rows = [(raw, number[a], t) for raw, a, t in self.keys]
        keys = local_table(self.spark, rows, "_key string, _attr int, _kind string")
        values = F.when(F.col("_kind") == "binary", F.array(F.hex("bytes"))).otherwise(
            F.array(trimmed(F.make_valid_utf8(F.col("bytes").cast("string"))), trimmed(F.col("str").cast("string")), F.col("int").cast("string"))
        )
        found = (
            df.select(F.col(self.entity).alias("_entity"), F.lower(trimmed(F.col("key"))).alias("_key"), "bytes", "str", "int")
            .where("_entity is not null and _key is not null")
            .join(F.broadcast(keys), "_key")  # one row per declared key, at most MOST_KEYS
            .select("_entity", "_attr", "_kind", F.explode(values).alias("_value"))
            .where("_value <> ''")
        )
        one = F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(False))
        return (
            found.select("_entity", "_attr", canonical(F.col("_value"), F.col("_kind")).alias("_text"))
            .groupBy("_entity", "_attr")
            .agg(F.min("_text").alias("_lo"), F.max("_text").alias("_hi"))
            .select("_entity", "_attr", F.when(one, ONE).otherwise(WRONG).alias("_state"), F.when(one, F.col("_lo")).alias("_text"), (F.col("_attr") / self.block_size).cast("int").alias("_block"))
        )

    def _store(self, reduced: DataFrame) -> DataFrame:
        name = scratch_table(self.spark, "cells")
        (
            reduced.repartition(self.buckets, "_entity")
            .write.partitionBy("_block").bucketBy(self.buckets, "_entity")
            .option("path", new_path(self.spark, "cells")).saveAsTable(name)
        )
        return self.spark.table(name)

    def _pivot(self, first: int, cell: Callable[[str], Column]) -> DataFrame:
        names = self.columns()
        block = range(first, min(first + self.block_size, len(names)))
        pivoted = [F.max(F.when(F.col("_attr") == k, cell(self.attributes[k][1]))).alias(names[k]) for k in block]
        return self.stored.where(F.col("_block") == first // self.block_size).groupBy("_entity").agg(*pivoted).withColumnRenamed("_entity", self.entity)

    def cells(self, entities: DataFrame, cell: Callable[[str], Column]) -> DataFrame:
        """What ``cell`` makes of a cell of a type, for each distinct entity that isn't null: the blocks joined to the
        entities one after the other.

        Left joins keep the entities' partitioning, which is that of the blocks' buckets.
        """
        out = entities.select(self.entity).where(F.col(self.entity).isNotNull()).distinct()
        for first in range(0, len(self.attributes), self.block_size):
            out = out.join(self._pivot(first, cell), self.entity, "left")
        return out

    def columns(self) -> list[str]:
        """The column of each attribute: its name, with "attr_" before it while another column (in any case) has it."""
        taken, out = {self.entity.lower(), "_entity"}, []
        for a, _ in self.attributes:
            while a.lower() in taken:
                a = "attr_" + a
            taken.add(a.lower())
            out.append(a)
        return out

    def wide(self, entities: DataFrame) -> DataFrame:
        """One row for each distinct entity that isn't null, with one typed column per attribute.

        The value is null where an entity has none or none that can be read, or where readable ones differ.
        """
        return self.cells(entities, lambda kind: typed(F.col("_text"), kind)).select(self.entity, *[F.col(f"`{c}`") for c in self.columns()])

    def conflicts(self, entities: DataFrame) -> DataFrame:
        """(entity, attr_name) of the attributes with values whose readable ones aren't exactly one distinct value."""
        wrong = [F.when(F.col(f"`{n}`") == WRONG, F.lit(a)) for n, (a, _) in zip(self.columns(), self.attributes)]
        names = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")
        return self.cells(entities, lambda _: F.col("_state")).select(self.entity, F.explode(names).alias("attr_name"))


def pivot(spark: SparkSession, attributes: DataFrame, keys: DataFrame, entities: DataFrame, **kw) -> DataFrame:
    """The wide table of ``entities``; see ``BlockPivot``."""
    return BlockPivot(attributes, keys, **kw).wide(entities)
