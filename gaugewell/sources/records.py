"""Sibling tables: metrics and their attributes, joined and pivoted (``flatten``) or taken apart again (``lift``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewell import schemas
from gaugewell.errors import SchemaError
from gaugewell.storage import written

_ATTRIBUTES = {"parent_id": ("bigint", "int"), "key": ("string",), "bytes": ("binary",), "str": ("string",), "int": ("bigint", "int")}


def attribute_index(attributes: DataFrame, order: str | None = None) -> DataFrame:
    """(parent_id, key, b, s, i): one row per parent and key, the last in order holding.

    Rows without an id, a key or any value are nobody's.  Of several values of one row bytes come before text before
    number.  Without an order column rows have no last one, and the greatest value holds, text before bytes and number.
    """
    schemas.check(attributes, _ATTRIBUTES, ("parent_id", "key"))
    have = dict(attributes.dtypes)
    v = {n: F.col(n) if n in have else F.lit(None).cast(t) for n, t in (("bytes", "binary"), ("str", "string"), ("int", "bigint"))}
    b, s, i = v["bytes"], F.when(v["bytes"].isNull(), v["str"]), F.when(v["bytes"].isNull() & v["str"].isNull(), v["int"].cast("bigint"))
    value = F.struct(s.alias("s"), b.alias("b"), i.alias("i"))
    rows = attributes.where("parent_id is not null and key is not null").where(v["bytes"].isNotNull() | v["str"].isNotNull() | v["int"].isNotNull())
    best = F.max_by(value, F.col(order)) if order else F.max(value)
    return rows.groupBy(F.col("parent_id").cast("bigint").alias("parent_id"), "key").agg(best.alias("v")).select("parent_id", "key", "v.b", "v.s", "v.i")


def text_keys(attributes: DataFrame, most: int = 10_000) -> list[str]:
    """The keys, sorted, of attributes that are text somewhere: they become columns, so more than ``most`` are an error."""
    text = attributes.where("parent_id is not null and key is not null and str is not null" + (" and bytes is null" if "bytes" in attributes.columns else ""))
    keys = [r[0] for r in text.select("key").distinct().limit(most + 1).collect()] if "str" in attributes.columns else []
    if len(keys) > most:
        raise SchemaError(f"more than {most} text attributes")
    return sorted(k for k in keys if k not in schemas.CARRIERS)


def flatten(metrics: DataFrame, attributes: DataFrame, labels: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """Every metric row with its attributes as columns; a row without attributes gets nulls.

    ``labels``: the text attributes that become columns, all of ``text_keys`` if None.  Carrier attributes fill their columns by type and win over a
    column of the metrics; ``parent_id`` goes.  A label named like another column of the metrics is an error.
    """
    schemas.check(metrics, {"parent_id": ("bigint", "int")}, ("parent_id",))
    carriers = {"binary": "b", "string": "s", "bigint": "i", "int": "i"}
    names = [n for n in (text_keys(attributes) if labels is None else labels) if n not in schemas.CARRIERS]
    clash = set(names) & (set(metrics.columns) | schemas.RESERVED)
    if clash:
        raise SchemaError(f"labels named like columns of the metrics: {', '.join(sorted(clash))}")
    index = attribute_index(attributes, order).where(F.col("key").isin(*names, *schemas.CARRIERS))
    pivoted = [F.max(F.when(F.col("key") == n, F.col("s"))).alias(n) for n in names]
    pivoted += [F.max(F.when(F.col("key") == n, F.col(carriers[t[0]]))).alias(n) for n, t in schemas.CARRIERS.items()]
    wide = index.groupBy("parent_id").agg(*pivoted)
    kept = [c for c in metrics.columns if c not in schemas.CARRIERS]
    return metrics.select(*[F.col(f"`{c}`") for c in kept]).join(wide, "parent_id", "left").drop("parent_id")


def lift(flat: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The metrics and attributes of a flat batch: carriers and text labels that aren't null become attribute rows.

    Rows are numbered from 0 by ``order`` in one sorted pass (ids that grow without gaps); without it ids are unique but
    have gaps, and no row moves.  Other columns stay with the metrics.
    """
    have = dict(flat.dtypes)
    text = [n for n, t in have.items() if t == "string" and n not in schemas.SCALARS and n not in schemas.CARRIERS]
    carriers = [n for n in schemas.CARRIERS if n in have]
    rest = [n for n in have if n not in text and n not in carriers]
    if order:
        # The position of a row is that within its range of the order, plus the rows of the ranges before.
        rows = flat.repartitionByRange(F.col(f"`{order}`").asc()).sortWithinPartitions(f"`{order}`").withColumn("_p", F.spark_partition_id())
        rows = rows.withColumn("_r", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("bigint"), 33))
        rows = written(rows, "ranges")  # a second run of the plan may cut the ranges otherwise
        sizes = rows.groupBy("_p").count().withColumn("_before", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).select("_p", "_before")
        rows = rows.join(F.broadcast(sizes), "_p").withColumn("parent_id", F.col("_r") + F.col("_before")).drop("_p", "_r", "_before")  # a row per partition
    else:
        rows = flat.withColumn("parent_id", F.monotonically_increasing_id())
    rows = written(rows, "lifted")  # both results must see the same numbers
    null = lambda t: F.lit(None).cast(t)
    cells = []
    for n in carriers + text:
        t, c = have[n], F.col(f"`{n}`")
        cells.append(F.struct(F.lit(n).alias("key"), (c if t == "binary" else null("binary")).alias("bytes"), (c if t == "string" else null("string")).alias("str"), (c.cast("bigint") if t in ("bigint", "int") else null("bigint")).alias("int")))
    metrics = rows.select("parent_id", *[F.col(f"`{c}`") for c in rest])
    if not cells:
        return metrics, rows.select("parent_id", F.lit("").alias("key"), null("binary").alias("bytes"), null("string").alias("str"), null("bigint").alias("int")).limit(0)
    attributes = rows.select("parent_id", F.inline(F.array(*cells))).where("bytes is not null or str is not null or int is not null")
    return metrics, attributes
