"""What goes along a series in order of time, split by ranges of time so that one series takes many tasks.

A range is known by its key and its start; rows are dealt by both. What a range needs from the ranges before (or after)
it comes from a summary with one row a range: the last sample, a fill value, a count or a sum. The summary is handed on
along each key and joined back. Ranges are as wide as the densest series allows, so that none has far more than the
wanted rows on average; a summary of a series with n rows has n / wanted rows of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import micros

#: Rows of a range on average: at least, and at most; in between four ranges for each task that can run at once.
LEAST, MOST = 1_000, 1_000_000
#: Wider than any time: 300,000 years in microseconds.
WIDEST = 1 << 63
#: The column that deals rows: a struct of the keys and the range's start, which compares null keys as equal.
PART = "_part"


def position(df: DataFrame, column: str) -> Column:
    """A column of times (as microseconds) or numbers as a number to cut ranges by."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return micros(F.col(column).cast("timestamp_ntz"))
    if kind == "date":
        return micros(F.col(column).cast("timestamp_ntz"))
    return F.floor(F.col(column)).cast("long")


def width(df: DataFrame, keys: Sequence[str], order: str = "ts", rows: int | None = None) -> int:
    """The width of ranges, in the unit of position(), by one pass over keys and order: first, last and number of each key's rows."""
    at = position(df, order)
    spans = df.where(F.col(order).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), (F.max(at) - F.min(at) + 1).alias("span"))
    dense = F.max(F.when(F.col("n") > min(rows or LEAST, LEAST), F.col("n") / F.col("span")))
    total, span, density = spans.agg(F.sum("n"), F.max("span"), dense).first()
    rows = rows or min(max((total or 0) // (4 * df.sparkSession.sparkContext.defaultParallelism), LEAST), MOST)
    return max(1, min(int(rows / density) if density else WIDEST, span or 1))


def parted(df: DataFrame, keys: Sequence[str], width: int, order: str = "ts") -> DataFrame:
    """df dealt by PART; the keys are in it."""
    at = position(df, order)
    part = F.struct(*[F.col(k) for k in keys], (at - F.pmod(at, F.lit(width))).alias("_from"))
    return df.withColumn(PART, part).drop(*keys).repartition(PART)


def keys_of(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{PART}.{k}").alias(k) for k in keys]


def along(keys: Sequence[str], back: bool = True) -> Window:
    """Over summaries: all ranges of the key before this one (or after it), nearest last."""
    start = F.col(f"{PART}._from")
    w = Window.partitionBy(*[F.col(f"{PART}.{k}") for k in keys]).orderBy(start.asc() if back else start.desc())
    return w.rowsBetween(Window.unboundedPreceding, -1)


def handed_on(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """rows with what their range gets, by PART; carried has a row for each range."""
    return rows.join(carried, PART)


def with_previous(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "before") -> DataFrame:
    """Parted rows (one at most for each key and the first of columns, which they are ordered by) with the struct of columns of the row before; null for a key's first."""
    here = F.struct(*columns)
    last = rows.groupBy(PART).agg(F.max(here).alias("_last"))
    carried = last.select(PART, F.last("_last").over(along(keys)).alias("_carried"))
    inside = F.lag(here).over(Window.partitionBy(PART).orderBy(columns[0]))
    return handed_on(rows.withColumn(name, inside), carried).withColumn(name, F.coalesce(name, "_carried")).drop("_carried")


def numbered(df: DataFrame, keys: Sequence[str], width: int, order: str = "ts", name: str = "_n") -> DataFrame:
    """df with each row's number in its key's order, from 1 on."""
    rows = parted(df, keys, width, order)
    counts = rows.groupBy(PART).agg(F.count("*").alias("_own"))
    carried = counts.select(PART, F.coalesce(F.sum("_own").over(along(keys)), F.lit(0)).alias("_earlier"))
    inside = F.row_number().over(Window.partitionBy(PART).orderBy(order))
    out = handed_on(rows.withColumn(name, inside), carried)
    rest = [c for c in df.columns if c not in keys]
    return out.select(*keys_of(keys), *rest, (F.col(name) + F.col("_earlier")).alias(name))
