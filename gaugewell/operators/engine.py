"""Running a plan: points to sketches or estimates, and sketches of many places to one.

Rows are filtered before labels are reduced to series, all aggregates combine before their shuffle, and the only lists
ever built are the cells of one sketch.  Points are grouped by their label maps, so nothing but numbers is aggregated (by
hash, without sorting points); the text of a series is made for its cells, not for its points.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.errors import OTHER_PARAMETERS, OTHER_PLAN, OTHER_SKETCH, OTHER_VERSION, UNREADABLE, PlanError
from gaugewell.functions.hashing import hash60
from gaugewell.functions.labels import entries, label_set
from gaugewell.functions.matchers import matches_all
from gaugewell.functions.series import attributes_key, series_attrs, series_key
from gaugewell.operators.sketches import DDSketch, Frequency, HyperLogLog, Kll
from gaugewell.operators.windows import assign, cap_series, drop_late
from gaugewell.plans.plan import COUNT_MIN, COUNT_SKETCH, CUSTOM, DDSKETCH, HLL, KLL, SCHEMA_VERSION, Plan

KEYS = ("agg_id", "series", "window_start_ms", "window_end_ms")
MAPS = ("resource", "attrs")
NO_LABELS = "map<string,string>"


def sketch_of(plan: Plan) -> DDSketch | HyperLogLog | Frequency | Kll:
    kinds = {
        DDSKETCH: lambda: DDSketch(plan.alpha), KLL: lambda: Kll(plan.k), HLL: lambda: HyperLogLog(plan.precision),
        COUNT_MIN: lambda: Frequency(*plan.shape), COUNT_SKETCH: lambda: Frequency(*plan.shape, signed=True),
    } | {n: lambda make=make: make(plan) for n, make in CUSTOM.items()}
    if plan.sketch_type not in kinds:
        raise PlanError(f"no sketch of type {plan.sketch_type}")
    return kinds[plan.sketch_type]()


def _empty() -> Column:
    return F.create_map().cast(NO_LABELS)


def _unclear(labels: Column) -> Column:
    """Whether the text of labels could be that of other labels too."""
    return F.exists(entries(labels), lambda e: e["key"].rlike("[;=|]") | e["value"].contains(";"))


def series_of(agg_id: Column | int, resource: Column, attrs: Column, aggregate_by: Sequence[str] = ()) -> Column:
    """The key of a series: ``series_key``, and a hash behind it where other labels have the same, so that series with
    different labels never meet."""
    key = series_key(agg_id, resource, attrs, aggregate_by)
    return F.when(_unclear(resource) | _unclear(attrs), F.concat(key, F.lit("#"), hash60(F.concat(label_set(resource), F.lit("|"), label_set(attrs))).cast("string"))).otherwise(key)


def series_columns(df: DataFrame, plan: Plan) -> DataFrame:
    """``agg_id``, ``series`` and the maps ``resource`` and ``attrs`` of the series of every row; labels without a value
    are none."""
    present = F.coalesce(F.map_filter("resource_labels", lambda k, v: v.isNotNull()), _empty())
    resource = _empty() if plan.omit_resource or plan.global_aggregation else present
    labels = _empty() if plan.global_aggregation else F.coalesce(F.col("labels"), _empty())
    out = df.withColumns({"agg_id": F.lit(plan.agg_id).cast("bigint"), "resource": resource, "attrs": series_attrs(labels, plan.aggregate_by)})
    return out.withColumn("series", series_of(plan.agg_id, F.col("resource"), F.col("attrs"), plan.aggregate_by))


def admitted(plan: Plan, observations: DataFrame) -> DataFrame:
    """The points that the plan takes, with their series and windows.  Sketch-valued rows go to ``merge_envelopes``."""
    points = observations.where((F.coalesce(F.col("kind"), F.lit("")) != "Envelope") & matches_all(plan.matchers))
    return drop_late(series_columns(assign(points, plan), plan), plan)


def item_of(plan: Plan) -> tuple[Column, Column]:
    """What a frequency or distinct sketch counts, as text, and the weight of a point.

    Distinct: the number of Hash points, the bytes (in hexadecimal) of Bytes points, the number of Float points as text.
    Frequency: the bytes if there are any, else all labels of the point, even where series have fewer; a CountSketch
    weighs points with bytes by their float and calls points without labels ``default_key``.
    """
    raw = F.when(F.octet_length("bytes") > 0, F.lower(F.hex("bytes")))
    if plan.sketch_type == HLL:
        kinds = F.when(F.col("kind") == "Hash", F.col("hash").cast("string")).when(F.col("kind") == "Bytes", F.lower(F.hex("bytes"))).otherwise(F.col("float").cast("string"))
        return kinds, F.lit(1.0)
    labels = attributes_key(F.coalesce(F.col("labels"), _empty()))
    if plan.sketch_type == COUNT_SKETCH:
        return F.coalesce(raw, F.nullif(labels, F.lit("")), F.lit("default_key")), F.when(raw.isNotNull(), F.coalesce(F.col("float"), F.lit(1.0))).otherwise(1.0)
    return F.coalesce(raw, labels), F.lit(1.0)


def _by_maps(keys: Sequence[str]) -> list[str]:
    return [k for k in keys if k != "series"] + list(MAPS)


def _named(plan: Plan, table: DataFrame) -> DataFrame:
    return table.withColumn("series", series_of(F.col("agg_id"), F.col("resource"), F.col("attrs"), plan.aggregate_by))


def cells(plan: Plan, rows: DataFrame, keys: Sequence[str] = KEYS, streaming: bool = False) -> DataFrame:
    """The sketches of admitted rows as cells (KLL: as binaries), with the maps of the series.

    Points of a kind that the sketch can't take are passed over: quantile sketches take Float points only.  With
    ``streaming`` rows are grouped by the text of the series, as states can't have maps as keys.
    """
    maps = [F.any_value(c).alias(c) for c in MAPS] if streaming else []
    by = list(keys) if streaming else _by_maps(keys)
    s = sketch_of(plan)
    if isinstance(s, DDSketch):
        table = s.cells(rows.where("kind = 'Float'"), by, "float", maps)
    elif isinstance(s, Kll):
        table = s.build(rows.where("kind = 'Float'"), by, "float", maps)
    elif plan.sketch_type in CUSTOM:
        table = s.cells(rows, by, extra=maps)
    else:
        item, weight = item_of(plan)
        rows = rows.withColumn("item", item).withColumn("_weight", weight)
        table = s.cells(rows, by, "item", maps) if isinstance(s, HyperLogLog) else s.cells(rows, by, "item", "_weight", maps)
    return table if streaming else _named(plan, table)


def merge_cells(plan: Plan, table: DataFrame) -> DataFrame:
    """Cells of the same series and windows as one."""
    return _named(plan, sketch_of(plan).merge(table, _by_maps(KEYS)))


# Payloads

def _params(plan: Plan) -> str:
    """The parameters without which cells mean nothing, as they stand in payloads."""
    return getattr(sketch_of(plan), "params", "")


def _pack(plan: Plan, cell: Sequence[str], schema: str) -> Column:
    """The parameters and the cells of one sketch in order, as JSON or, in the compact form, as ``params|a:b:w;``."""
    made = F.sort_array(F.collect_list(F.when(F.col(cell[0]).isNotNull() & (F.col("w") != 0), F.struct(*cell, "w"))))
    params = F.lit(_params(plan))
    if plan.full_encoding == "MSGPACK":
        text = F.concat(params, F.lit("|"), F.concat_ws("", F.transform(made, lambda c: F.concat_ws("", F.concat_ws(":", *[c[x].cast("string") for x in cell], c["w"].cast("string")), F.lit(";")))))
    else:
        text = F.to_json(F.struct(params.alias("params"), made.alias("cells")))
    return F.when(F.size(made) > 0, text).cast("binary")


def _parsed(plan: Plan) -> Column:
    """(params, cells) of a payload; null, or with nulls in it, where it can't be read."""
    text = F.col("payload").cast("string")
    fields = [c.split() for c in sketch_of(plan).schema.split(", ")]
    shape = f"array<struct<{', '.join(f'{n}:{t}' for n, t in fields)}>>"
    struct = lambda parts: F.when(F.size(parts) == len(fields), F.struct(*[F.get(parts, F.lit(k)).try_cast(t).alias(n) for k, (n, t) in enumerate(fields)]))
    body = F.when(F.instr(text, "|") > 0, F.substring_index(text, "|", -1))
    compact = F.struct(F.substring_index(text, "|", 1).alias("params"), F.transform(F.filter(F.split(body, ";"), lambda x: x != ""), lambda x: struct(F.split(x, ":"))).cast(shape).alias("cells"))
    return F.when(F.col("encoding").startswith("MSGPACK"), compact).otherwise(F.from_json(text, f"struct<params:string,cells:{shape}>"))


def _readable(plan: Plan) -> Column:
    """Whether a payload has cells and all of them are whole.  KLL binaries aren't looked at: a broken one is an error."""
    s = sketch_of(plan)
    if isinstance(s, Kll):
        return F.lit(True)
    needed = (s.cell[0], "w") if plan.sketch_type in CUSTOM else (*s.cell, "w")
    whole = lambda c: reduce(and_, [c[n].isNotNull() for n in needed])
    cells_ = _parsed(plan)["cells"]
    return F.coalesce((F.size(cells_) > 0) & F.forall(cells_, whole), F.lit(False))


def unpack(plan: Plan, envelopes: DataFrame) -> DataFrame:
    """The cells of envelopes, with the columns of the envelopes; ``n`` is the envelope's count, on one of its cells."""
    s = sketch_of(plan)
    if isinstance(s, Kll):
        return envelopes.withColumn("sketch", F.col("payload")).withColumn("n", F.coalesce("count", F.lit(0)))
    rows = envelopes.select("*", F.posexplode(_parsed(plan)["cells"]).alias("_at", "_c"))
    return rows.select("*", "_c.*").withColumn("n", F.when(F.col("_at") == 0, F.coalesce("count", F.lit(0))).otherwise(0)).drop("_at", "_c")


def _envelope(plan: Plan, df: DataFrame, payload: Column, encoding: Column, value: Column, labels: Column | None = None, count: Column | None = None) -> DataFrame:
    labels = F.col("attrs") if labels is None else labels
    if plan.window_stats:
        seconds = ((F.col("window_end_ms") - F.col("window_start_ms")) / 1000).cast("bigint").cast("string")
        labels = F.map_concat(labels, F.create_map(F.lit("sample_count"), F.col("n").cast("string"), F.lit("window_duration_seconds"), seconds))
    return df.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(plan.sketch_type).alias("sketch_type"), "agg_id", F.col("resource").alias("resource_labels"), labels.alias("labels"),
        "window_start_ms", "window_end_ms", encoding.alias("encoding"), payload.alias("payload"), F.lit(plan.metric_name).alias("metric_name"),
        (F.col("n") if count is None else count).alias("count"), F.lit(plan.temporality).alias("aggregation_temporality"), value.cast("double").alias("value"),
    )


def _totals(plan: Plan, table: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    return table.groupBy(*KEYS, *MAPS).agg(F.sum("n").alias("n"), *extra)


def envelopes(plan: Plan, table: DataFrame) -> DataFrame:
    """One row per series and window with its whole sketch; empty sketches have none."""
    s = sketch_of(plan)
    if isinstance(s, Kll):
        packed = table.withColumn("_payload", F.when(F.kll_sketch_get_n_double("sketch") > 0, F.col("sketch")))
    else:
        packed = _totals(plan, table, [_pack(plan, s.cell, s.schema).alias("_payload")])
    return _envelope(plan, packed.where("_payload is not null"), F.col("_payload"), F.lit(plan.full_encoding), F.lit(None))


def quantile_text(q: float) -> str:
    """The shortest decimal text of a number, without an exponent and without ``.0``."""
    return format(Decimal(repr(q)), "f").removesuffix(".0")


def estimates(plan: Plan, table: DataFrame) -> DataFrame:
    """One row per series, window and quantile (its label ``quantile``), or one with the distinct count; null payloads."""
    s = sketch_of(plan)
    maps = MAPS
    none, unspecified = F.lit(None).cast("binary"), F.lit("UNSPECIFIED")
    if isinstance(s, HyperLogLog):
        rows = s.estimate(table, KEYS, maps)
        return _envelope(plan, rows, none, unspecified, F.col("estimate"))
    if isinstance(s, Frequency):
        raise PlanError(f"{plan.sketch_type} has no scalar estimate to emit")
    rows = s.quantiles(table, KEYS, plan.quantiles, maps)
    names = F.create_map(*[x for q in plan.quantiles for x in (F.lit(float(q)), F.lit(quantile_text(float(q))))])
    return _envelope(plan, rows, none, unspecified, F.col("value"), F.map_concat("attrs", F.create_map(F.lit("quantile"), names[F.col("q")])))


def run(plan: Plan, observations: DataFrame, order: Sequence[str] = ("timestamp_ms",)) -> DataFrame:
    """The envelopes of a finite input: sketches, deltas or estimates as the plan says.

    Evicting at the cap depends on the order in which points come and needs a ``Runtime``.
    """
    if plan.max_series > 0 and plan.overflow == "EvictOldest":
        raise PlanError("EvictOldest needs a Runtime")
    rows, _ = cap_series(admitted(plan, observations), plan, list(order))
    return emit(plan, cells(plan, rows))


def emit(plan: Plan, table: DataFrame) -> DataFrame:
    if not plan.transmit_sketch:
        return estimates(plan, table)
    out = envelopes(plan, table)
    if plan.delta:
        from gaugewell.operators.deltas import frames

        return frames(plan, out)
    return out


# The central tier

def admission(plan: Plan, envs: DataFrame, payloads: bool = False) -> DataFrame:
    """Envelopes with the reason why the plan doesn't take them, null where it does.

    Plan ids and sketch types must be the same unless one side leaves them open (0, Unspecified); newer schema versions
    aren't understood.  With ``payloads`` those are read too, and one that can't be, has no cells or is of a sketch with other
    parameters (accuracy, precision, shape), is a reason; a null or empty payload (an estimate) is none.
    """
    other = (F.lit(plan.agg_id) != 0) & (F.col("agg_id") != 0) & (F.col("agg_id") != plan.agg_id)
    kind = (F.lit(plan.sketch_type) != "Unspecified") & (F.col("sketch_type") != "Unspecified") & (F.col("sketch_type") != plan.sketch_type)
    problem = F.when(other, OTHER_PLAN).when(kind, OTHER_SKETCH).when(F.col("schema_version") > SCHEMA_VERSION, OTHER_VERSION)
    if payloads:
        has, whole = F.octet_length("payload") > 0, _readable(plan)
        problem = problem.when(has & ~whole, UNREADABLE)
        if not isinstance(sketch_of(plan), Kll):
            problem = problem.when(has & ~F.coalesce(_parsed(plan)["params"], F.lit("")).eqNullSafe(_params(plan)), OTHER_PARAMETERS)
    return envs.withColumn("problem", problem)


def set_aside(plan: Plan, envs: DataFrame) -> DataFrame:
    """The envelopes that ``merge_envelopes`` leaves out, with their ``problem`` and their count."""
    return admission(plan, envs, payloads=True).where("problem is not null")


def merged_cells(plan: Plan, envs: DataFrame, by_end: bool = False) -> DataFrame:
    """The cells of admitted envelopes, merged per series and window; full and delta frames merge alike.

    Envelopes keep their window.  With ``by_end`` they go to the plan's window that holds their end (their start if that
    is 0), which for windows of the same size is the one after.
    """
    if by_end and plan.size_ms:
        at = F.when(F.col("window_end_ms") != 0, F.col("window_end_ms")).otherwise(F.col("window_start_ms"))
        envs = envs.withColumn("window_start_ms", at - F.pmod(at, F.lit(plan.size_ms).cast("bigint"))).withColumn("window_end_ms", F.col("window_start_ms") + plan.size_ms)
    taken = admission(plan, envs, payloads=True).where("problem is null and payload is not null").drop("problem")
    keyed = series_columns(taken.where(F.octet_length("payload") > 0), plan)
    s = sketch_of(plan)
    table = unpack(plan, keyed).select(*KEYS, "resource", "attrs", "n", *(("sketch",) if isinstance(s, Kll) else (*s.cell, "w")))
    return merge_cells(plan, table)


def merge_envelopes(plan: Plan, envs: DataFrame) -> DataFrame:
    """Envelopes of many places as one per series and window, emitted as the plan says."""
    return emit(plan, merged_cells(plan, envs))
