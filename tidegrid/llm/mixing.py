"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. SQL functions only.

Targets: sources share a number of words by weight, but none may be repeated more than max_epochs times. With sources
in ascending order of cap / weight, the clamped ones are a prefix of that order, so prefix sums give the level of the
rest at once: resharing the excess round by round ends at the same level.

Repetitions: a source with target / size = w + f is taken w times whole, and documents holding the fraction f of its
words once more. These are the first ones in the order of a seeded hash. The order is cut with a histogram of 65,536
hash ranges for each source; only the documents of the one range in which the cut falls are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, text_of, written

SHIFT = 44  # of 60 hash bits


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, target) for one row a source; windows over that small table only."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total, all_weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (total * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("free", F.col("level") <= F.col("cap") / F.col("weight"))
    first_free = F.min_by("level", F.when(F.col("free"), F.col("cap") / F.col("weight"))).over(everything)
    return s.withColumn("rest", first_free).select("source", "source_size", F.when(F.col("free"), F.col("rest") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def _hash(seed: int) -> Column:
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("long")


def _size() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def _plan(rows: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """(s, source_size, target, whole, cut, edge, before) of rows (source, size, h): a row a source, written.

    All documents are taken `whole` times; those in hash ranges before `edge` once more, and of the range `edge`, before
    which `before` words lie, the first ones up to `cut`.
    """
    ranges = written(rows.groupBy("source", F.shiftright("h", SHIFT).alias("range")).agg(F.sum("size").alias("words")), "ranges")
    targets = _targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio)).withColumn("cut", (ratio - F.floor(ratio)) * F.col("source_size"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    cumulated = ranges.withColumn("upto", upto).withColumnRenamed("source", "s")
    edge = cumulated.join(targets, F.col("s").eqNullSafe(F.col("source"))).where("upto > cut").groupBy("source").agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    plan = targets.withColumnRenamed("source", "s").join(edge, F.col("s").eqNullSafe(F.col("source")), "left")
    return written(plan.select("s", "source_size", "target", "whole", "cut", F.col("edge.range").alias("edge"), F.col("edge.before").alias("before")), "mix_plan")


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, h, ...) with the plan's columns and copies. Only rows of the edge ranges are sorted."""
    own = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("range", F.shiftright("h", SHIFT))
    sure = own.where("edge is null or range <> edge").withColumn("extra", F.col("range") < F.coalesce("edge", F.lit(1 << 62)))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    close = own.where("range = edge").withColumn("extra", F.col("before") + ahead + F.col("size") / 2 <= F.col("cut"))
    return sure.unionByName(close).withColumn("copies", F.col("whole") + F.col("extra").cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies, source.

    size is the number of words of the whole text (null: 0). Sources in code point order, null last, have the weights
    in turn and share `share` times all words; none gets more than max_epochs times its own. The same seed gives the
    same mix. Rows that repeat a doc_id are rows like others, next to each other in the order. A document without
    words takes none; a source without words has target 0; empty docs give no rows; further columns are ignored.
    """
    rows = written(docs.select("doc_id", "source", _size().alias("size"), _hash(seed).alias("h")), "sizes")
    mixed = _copies(rows, _plan(rows, weights, share, max_epochs))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def repeated(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """docs as mix() takes them: each row as often as its copies say, all columns as they are.

    Copies are reckoned on the rows themselves, so rows that share a doc_id (null included) each have their own.
    Documents without words (null, empty or blank texts) go the way of their place in the order. Empty docs stay empty.
    Further columns may have any names.
    """
    (row,) = fresh(docs.select("doc_id", "source"), "row")
    sizes = docs.select("source", _size().alias("size"), _hash(seed).alias("h"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), "doc_id", "source", _size().alias("size"), _hash(seed).alias("h"))
    taken = _copies(whole, _plan(sizes, weights, share, max_epochs)).where("copies > 0")
    each = taken.select(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.select(*[F.col(row)[c].alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
    FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, level <= cap / weight AS free, arg_min(level, CASE WHEN level <= cap / weight THEN cap / weight END) OVER () AS rest FROM l),
t AS (SELECT source, source_size, CASE WHEN free THEN rest * weight ELSE cap END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t),
x AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.ratio, floor(e.ratio)::BIGINT AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, d.source
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
    ((whole + CASE WHEN ahead + size / 2 <= (ratio - whole) * source_size AND source_size > 0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM x
"""
