"""Small scalar functions: unit conversions, coercion, rounding, subsets, series ids from names."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MOMENTS


def celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32) * 5 / 9


def millimetres(inches: Column) -> Column:
    return inches * 25.4


def kilometres(miles: Column) -> Column:
    return miles * 1.609344


def percent(ratio: Column) -> Column:
    return ratio * 100


def number(c: Column | str) -> Column:
    """A double; null for what isn't one, and for NaN."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def name_of_file() -> Column:
    """The name of a row's file without folders and extension, such as a series id."""
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Values and moments rounded, keys and times as they are."""
    return df.withColumns({c: F.round(c, digits) for c in ("value", *MOMENTS) if c in df.columns})


def clamped(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """c where it lies within, else 0."""
    return F.when(c.between(low, high), c).otherwise(F.lit(0.0))


def subsets(x) -> list[tuple]:
    """All non-empty subsets, the smaller ones first."""
    x = list(x)
    return [s for k in range(1, len(x) + 1) for s in combinations(x, k)]


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and parts only: the first 13 hex digits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
