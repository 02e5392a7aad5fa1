"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from gaugewell.functions.labels import escaped, entries, label_set
from gaugewell.storage import table, written


def p6_ids(spark, sf_dir):
    """(doc_id, ids) of every document by byte_bpe_50k."""
    from gaugewell.llm.tokens import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"))


def p7_found(spark, sf_dir):
    """(doc_id, item_id): the document and the item's prompt share 12 consecutive words."""
    from gaugewell.llm.leaks import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), fields=("prompt",), offsets=False)


def p7_passages(spark, sf_dir):
    """Every shared passage of a prompt or an answer, with its place in the text as stored.

    An answer of fewer than 12 words counts as a whole, beside a passage of its own item.
    """
    from gaugewell.llm.leaks import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), whole=("answer",))


def p8_found(spark, sf_dir):
    """(doc_id) of the documents that are cut."""
    from gaugewell.llm.split import split_texts

    return split_texts(table(spark, sf_dir, "documents"), with_ids=False).where("piece_no = 0").select("doc_id").distinct()


def p8_pieces(spark, sf_dir):
    """The pieces of every document of more than 2,048 tokens."""
    from gaugewell.llm.split import split_texts

    return split_texts(table(spark, sf_dir, "documents"))


PERMILLE = (250, 500, 900, 990)


def _bisection(spark, sf_dir):
    from gaugewell.llm.percentiles import Bisection

    o = table(spark, sf_dir, "observations").where("kind = 'Float'").withColumn("labels", label_set(F.col("labels")))
    o = o.withColumn("day", (F.col("timestamp_ms") / 86_400_000).cast("bigint"))
    return Bisection(o, ["metric", "labels"], "float", PERMILLE, id_col="obs_id", part="day")


def p1_percentiles(spark, sf_dir):
    """Exact percentiles (in thousandths) of every metric and label set."""
    return _bisection(spark, sf_dir).exact()


def p1_from_daily_partials(spark, sf_dir):
    """Bounds of the same percentiles from the combined counts of the days alone."""
    b = _bisection(spark, sf_dir)
    return b.bounds(b.merge(written(b.partials(), "partials")))


def p1_bounds_hold(spark, sf_dir):
    """Whether the bounds from the days' counts hold the exact value and are within 0.4 percent of each other."""
    b = _bisection(spark, sf_dir)
    keys = ["metric", "labels", "n", "q"]
    exact = b.exact().select(*[F.col(k).alias("_" + k) for k in keys], "value")
    both = p1_from_daily_partials(spark, sf_dir).join(exact, reduce(and_, [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]))
    low, high, v = F.col("low"), F.col("high"), F.col("value")
    near = (high == low) | (F.abs(high - low) <= F.lit(2.0**-8) * F.least(F.abs(low), F.abs(high))) | (F.greatest(F.abs(low), F.abs(high)) < F.lit(1e-290)) | (F.abs(high) == float("inf")) | (F.abs(low) == float("inf"))
    return both.select(*keys, ((low <= v) & (v <= high) & near).alias("holds"))


def p8_pieces_fit(spark, sf_dir):
    """Per document that is cut, what all its pieces have in common: whole, in order, within the limit, overlapping."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("piece_no")  # the pieces of one document
    p = p8_pieces(spark, sf_dir).withColumns({"_before": F.lag("end_token", 1, 0).over(w), "_char": F.lag("end_char", 1, 0).over(w)})
    joint = (F.col("start_token") == F.col("_before")) & (F.col("start_char") == F.col("_char"))
    lap = F.when(F.col("piece_no") == 0, 0).otherwise(F.least(F.col("start_token"), F.lit(64)))
    fits = (F.col("n_tokens") <= 2048) & (F.col("n_tokens") == F.size("ids")) & (F.col("overlap") == lap)
    per = p.groupBy("doc_id").agg(F.min(joint).alias("joint"), F.min(fits).alias("fits"), F.max("end_char").cast("bigint").alias("chars"), (F.count(F.lit(1)) == F.max("n_pieces")).alias("complete"))
    return per.join(p8_found(spark, sf_dir), "doc_id").select("doc_id", "joint", "fits", "complete", "chars")


def p6_edited(spark, sf_dir):
    """(doc_id, same, n): whether a text put together by appends and edits of its prefix tables has the ids of the whole."""
    from gaugewell.llm.tokens import edited_texts

    return edited_texts(table(spark, sf_dir, "documents"))


def _visitor_sketches(spark, sf_dir, ks):
    """Sketches per metric, day and label set, and the merged ones of all rows and of each label value."""
    o = table(spark, sf_dir, "observations").where("kind = 'Hash'")
    day = F.floor(F.col("timestamp_ms") / 86_400_000).cast("bigint")
    pairs = F.transform(entries(F.col("labels")), lambda e: F.concat(escaped(e["key"]), F.lit("="), escaped(e["value"]), F.lit(";")))
    rows = o.select("metric", F.when(F.col("timestamp_ms") != 0, day).alias("day"), F.concat_ws("", pairs).alias("labels"), "hash")
    fine = written(ks.sketch(rows, ["metric", "day", "labels"], "hash"), "sketches")
    each = F.explode(F.array_distinct(F.regexp_extract_all("labels", F.lit(r"((?:[^\\;]|\\.)*;)"))))
    coarse = fine.select("metric", "day", F.lit("all").alias("level"), F.lit("").alias("labels"), "h").unionByName(
        fine.select("metric", "day", F.lit("value").alias("level"), each.alias("labels"), "h")
    )
    keys = ["metric", "day", "level", "labels"]
    return ks.merge(coarse, keys).unionByName(fine.select("metric", "day", F.lit("combination").alias("level"), "labels", "h")), keys


def _hash_plans(spark, sf_dir):
    return table(spark, sf_dir, "plan_configs").where("sketch_type = 'HLLSketch'").select("agg_id", "metric").distinct()


def p3_distinct(spark, sf_dir):
    """Distinct identifiers per plan, day, label value and combination of labels, with 95 percent bounds."""
    from gaugewell.llm.distinct import KSmallest

    ks = KSmallest()
    sketches, keys = _visitor_sketches(spark, sf_dir, ks)
    return ks.estimate(sketches, keys).join(_hash_plans(spark, sf_dir), "metric").drop("metric")


def p3_day_to_day(spark, sf_dir):
    """Union, intersection and differences of the identifiers of consecutive days, per plan, label value and combination."""
    from gaugewell.llm.distinct import KSmallest

    ks = KSmallest()
    sketches, _ = _visitor_sketches(spark, sf_dir, ks)
    sketches = written(sketches.where("day is not null"), "sketches")
    following = sketches.withColumn("day", F.col("day") - 1)
    out = ks.compare(sketches, following, ["metric", "day", "level", "labels"])
    return out.join(_hash_plans(spark, sf_dir), "metric").drop("metric")


def _keys(spark, sf_dir):
    from gaugewell.llm.frequent import FrequentItems

    o = table(spark, sf_dir, "observations").where("kind = 'Bytes' and metric is not null")
    return FrequentItems(o, "metric", "bytes", id_col="obs_id")


def p5_found(spark, sf_dir):
    """(metric, key_hex) of the keys that make up at least 2 percent of a metric's keys."""
    return _keys(spark, sf_dir).find(0.02).select("metric", F.lower(F.hex("bytes")).alias("key_hex"))


def p5_entries(spark, sf_dir):
    """The keys of at least half a percent, as frequency entries."""
    return _keys(spark, sf_dir).find(0.005).select("metric", F.col("bytes").alias("key"), F.col("count").cast("double").alias("count"))


_FUNCTIONS = (p1_percentiles, p1_from_daily_partials, p1_bounds_hold, p3_distinct, p3_day_to_day, p5_found, p5_entries, p6_ids, p6_edited, p7_found, p7_passages, p8_found, p8_pieces, p8_pieces_fit)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_ENTRIES = r"""list_transform(list_sort(list_filter(map_entries(labels), lambda e: e.value IS NOT NULL)),
  lambda e: regexp_replace(e.key, '([\;=])', '\\\1', 'g') || '=' || regexp_replace(e.value, '([\;=])', '\\\1', 'g') || ';')"""
_SET = f"coalesce(array_to_string({_ENTRIES}, ''), '')"
SQL: dict[str, str] = {
    "p1_percentiles": f"""
WITH o AS (SELECT DISTINCT obs_id, metric, {_SET} AS labels, "float" + 0.0 AS v FROM observations WHERE kind = 'Float' AND "float" IS NOT NULL AND NOT isnan("float")),
r AS (SELECT metric, labels, v, row_number() OVER (PARTITION BY metric, labels ORDER BY v) AS no, count(*) OVER (PARTITION BY metric, labels) AS n FROM o)
SELECT metric, labels, n, q, v AS value FROM r, (SELECT unnest([250, 500, 900, 990])::INT AS q) WHERE no = greatest((n * q + 999) // 1000, 1)""",
    "p3_distinct": f"""
WITH o AS (SELECT metric, CASE WHEN timestamp_ms <> 0 THEN timestamp_ms // 86400000 END AS day, coalesce({_ENTRIES}, []) AS e,
                  ('0x' || substr(md5(hash::VARCHAR), 1, 15))::BIGINT AS h FROM observations WHERE kind = 'Hash' AND hash IS NOT NULL),
g AS (SELECT DISTINCT metric, day, 'combination' AS level, array_to_string(e, '') AS labels, h FROM o
      UNION ALL SELECT DISTINCT metric, day, 'all', '', h FROM o UNION ALL SELECT DISTINCT metric, day, 'value', unnest(e), h FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY metric, day, level, labels ORDER BY h) AS no FROM g),
s AS (SELECT metric, day, level, labels, count(*) AS kept, 1023.0::DOUBLE / ((max(h) + 1)::DOUBLE / 1152921504606846976.0::DOUBLE) AS x,
             1.96::DOUBLE / sqrt(1022::DOUBLE) AS err FROM k WHERE no <= 1024 GROUP BY ALL)
SELECT agg_id, day, level, labels, kept, CASE WHEN kept >= 1024 THEN round(x, 6) ELSE kept END AS estimate,
       CASE WHEN kept >= 1024 THEN round(x / (1 + err), 6) ELSE kept END AS low, CASE WHEN kept >= 1024 THEN round(x / (1 - err), 6) ELSE kept END AS high
FROM s JOIN (SELECT DISTINCT agg_id, metric FROM plan_configs WHERE sketch_type = 'HLLSketch') p USING (metric)""",
}
_KEYS = """
WITH o AS (SELECT DISTINCT obs_id, metric, bytes FROM observations WHERE kind = 'Bytes' AND metric IS NOT NULL AND octet_length(bytes) > 0),
k AS (SELECT metric, bytes, count(*) AS n FROM o GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY metric) AS total FROM k)
"""
SQL["p5_found"] = _KEYS + "SELECT metric, lower(hex(bytes)) AS key_hex FROM c WHERE n >= total * 0.02"
SQL["p5_entries"] = _KEYS + "SELECT metric, bytes AS key, n::DOUBLE AS count FROM c WHERE n >= total * 0.005"
SQL["p1_bounds_hold"] = SQL["p1_percentiles"].replace("v AS value", "true AS holds")
_DAYS = SQL["p3_distinct"].split(",\ns AS")[0] + """,
s AS (SELECT metric, day, level, labels, h FROM k WHERE no <= 1024 AND day IS NOT NULL),
u AS (SELECT metric, day, level, labels, h, 1 AS l, 0 AS r FROM s UNION ALL SELECT metric, day - 1, level, labels, h, 0, 1 FROM s),
t AS (SELECT metric, day, level, labels, least(CASE WHEN sum(l) >= 1024 THEN max(h) FILTER (l = 1) ELSE 1152921504606846976 END,
                                               CASE WHEN sum(r) >= 1024 THEN max(h) FILTER (r = 1) ELSE 1152921504606846976 END) AS theta FROM u GROUP BY ALL),
b AS (SELECT metric, day, level, labels, h, max(l) AS l, max(r) AS r FROM u GROUP BY ALL),
c AS (SELECT metric, day, level, labels, theta, count(*) FILTER (h < theta) AS a, count(*) FILTER (h < theta AND l = 1 AND r = 1) AS i,
             count(*) FILTER (h < theta AND l = 1 AND r = 0) AS x, count(*) FILTER (h < theta AND l = 0 AND r = 1) AS y FROM b JOIN t USING (metric, day, level, labels) GROUP BY ALL),
o AS (SELECT metric, day, level, labels, theta::DOUBLE / 1152921504606846976.0::DOUBLE AS share, unnest(['union', 'intersection', 'left_only', 'right_only']) AS op, unnest([a, i, x, y]) AS n FROM c),
z AS (SELECT *, CASE WHEN share >= 1 THEN 0.0::DOUBLE WHEN n = 0 THEN 3.0::DOUBLE ELSE 1.96::DOUBLE * sqrt(n * (1 - share)) END AS spread FROM o)
SELECT agg_id, day, level, labels, op, round(n / share, 6) AS estimate, round(greatest((n - spread) / share, n::DOUBLE), 6) AS low, round((n + spread) / share, 6) AS high
FROM z JOIN (SELECT DISTINCT agg_id, metric FROM plan_configs WHERE sketch_type = 'HLLSketch') p USING (metric)"""
SQL["p3_day_to_day"] = _DAYS.replace("WITH o AS", "WITH obs AS").replace("FROM o\n", "FROM obs\n").replace("FROM o UNION", "FROM obs UNION").replace("FROM o),", "FROM obs),")
