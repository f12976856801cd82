"""Exact quantiles of large groups: histograms of a range that is narrowed pass by pass.

Each wanted order statistic of a group has a range that holds it. A pass counts the group's values in equal bins of that
range, with the least and greatest value of each bin, by partial aggregation; the bin with the wanted rank is the next
range. Once a bin has few values, or only one, these alone are sorted. So no task holds a group, whatever its size, and
what is kept between passes is a row a group and order statistic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Bins of a range, and values of a range that are sorted at once.
BINS, FEW = 1_024, 10_000


def _ranks(df: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(_key, rank, lo, hi, n): the order statistics, from 0 on, that the probabilities lie between, and each group's ends."""
    ends = df.groupBy("_key").agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    places = [p * (F.col("n") - 1) for p in map(F.lit, map(float, probabilities))]
    every = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in places])))
    return ends.withColumn("rank", F.explode(every)).withColumn("below", F.lit(0).cast("long"))


def _bin(lo: str, hi: str, bins: int):
    """The bin of _x in [lo, hi]; halves keep the width finite."""
    width = F.col(hi) / 2 - F.col(lo) / 2
    return F.when(width > 0, F.least(F.floor((F.col("_x") / 2 - F.col(lo) / 2) / width * bins), F.lit(bins - 1))).otherwise(0)


def order_statistics(df: DataFrame, keys: Sequence[str], column: str, probabilities: Sequence[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(_key, rank, value, n) of the order statistics next to each probability."""
    rows = df.select(F.struct(*keys).alias("_key") if keys else F.struct(F.lit(1).alias("_all")).alias("_key"), F.col(column).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    todo, done = _ranks(rows, keys, probabilities), None
    schema = todo.schema
    while True:
        # A range with one value is settled; one with few is sorted; the others are narrowed.
        state = checkpointed(todo, "ranks")
        settled = state.where("lo = hi").select("_key", "rank", F.col("lo").alias("value"), "n")
        done = settled if done is None else done.unionByName(settled)
        wide = state.where("lo < hi")
        if wide.isEmpty():
            return done
        inside = rows.join(wide, "_key").where("_x between lo and hi")
        binned = inside.withColumn("bin", _bin("lo", "hi", bins))
        counts = binned.groupBy("_key", "rank", "n", "below", "bin").agg(F.count("*").alias("own"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        w = Window.partitionBy("_key", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        found = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("own").over(w), F.lit(0)))
        found = found.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("own")))
        found = checkpointed(found, "ranks")
        small = found.where((F.col("own") <= few) & (F.col("lo") < F.col("hi")))
        if not small.isEmpty():
            held = rows.join(small, "_key").where("_x between lo and hi").groupBy("_key", "rank", "n", "below").agg(F.sort_array(F.collect_list("_x")).alias("_sorted"))
            sorted_ = held.select("_key", "rank", F.get("_sorted", (F.col("rank") - F.col("below")).cast("int")).alias("value"), "n")
            done = done.unionByName(checkpointed(sorted_, "ranks"))
        todo = found.where((F.col("own") > few) | (F.col("lo") == F.col("hi"))).select(*schema.fieldNames())


def quantiles(df: DataFrame, keys: Sequence[str], column: str, probabilities: Sequence[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, q0, q1, ...): the quantiles of each group at the given probabilities, on the line between neighbours; nulls and NaNs have no part."""
    found = order_statistics(df, keys, column, probabilities, bins, few)
    by = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"), F.first("n").alias("n"))
    out = []
    for k, p in enumerate(probabilities):
        x = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.element_at("at", F.floor(x)), F.element_at("at", F.ceil(x))
        out.append((low + (high - low) * (x - F.floor(x))).alias(f"q{k}"))
    return by.select(*[F.col(f"_key.{c}").alias(c) for c in keys], *out)
