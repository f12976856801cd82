"""Intervals, resolutions and resolution trees on the driver, and the same algebra as column expressions.

Buckets start at the Unix epoch everywhere. Arithmetic is in whole microseconds on timestamps without time zone, so no
session time zone has a part in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch."""
    return F.timestamp_diff("MICROSECOND", epoch(), F.col(ts) if isinstance(ts, str) else ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, epoch())


def seconds(start: Column | str, end: Column | str) -> Column:
    """Length in seconds as a double."""
    return (micros(end) - micros(start)) / F.lit(1e6)


def bucket(ts: Column | str, resolution_s: int) -> Column:
    """Start of the bucket that holds ts; floors before 1970 too."""
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(resolution_s * 1_000_000)))


def after(ts: Column | str, resolution_s: int) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(resolution_s * 1_000_000), F.col(ts) if isinstance(ts, str) else ts)


def steps(start: Column | str, end: Column | str, resolution_s: int) -> Column:
    """Starts of all buckets that overlap [start, end), as an array; the first may begin before start. Empty if end <= start."""
    a, b, size = micros(start), micros(end), resolution_s * 1_000_000
    first = a - F.pmod(a, F.lit(size))
    return F.when(b > a, F.transform(F.sequence(first, b - 1, F.lit(size)), from_micros)).otherwise(F.array().cast("array<timestamp_ntz>"))


def contains(start: Column | str, end: Column | str, ts: Column | str) -> Column:
    """Half-open: start <= ts < end."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (c(ts) >= c(start)) & (c(ts) < c(end))


def contains_interval(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Closed at both ends; a reversed interval counts as the other way round."""
    return (F.least(b0, b1) >= F.least(a0, a1)) & (F.greatest(b0, b1) <= F.greatest(a0, a1))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> tuple[Column, Column]:
    """(start, end) of what both share, null if they only touch or lie apart; an interval shares itself even at length 0."""
    x0, x1, y0, y1 = F.least(a0, a1), F.greatest(a0, a1), F.least(b0, b1), F.greatest(b0, b1)
    hit = ((x0 == y0) & (x1 == y1)) | ((x0 < y1) & (y0 < x1))
    return F.when(hit, F.greatest(x0, y0)), F.when(hit, F.least(x1, y1))


def span(df: DataFrame, *keys: str, ts: str = "ts") -> DataFrame:
    """First and last timestamp, for each key or over all."""
    return df.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))


@dataclass(frozen=True, order=True)
class TimeInterval:
    start: datetime
    end: datetime

    @property
    def delta(self) -> timedelta:
        return self.end - self.start

    @property
    def length(self) -> float:
        return self.delta.total_seconds()

    def overlap(self, other: TimeInterval) -> TimeInterval | None:
        (a, b), (c, d) = sorted((self.start, self.end)), sorted((other.start, other.end))
        if (a, b) == (c, d) or a < d and c < b:
            return TimeInterval(max(a, c), min(b, d))
        return None

    def contains(self, x: datetime | TimeInterval) -> bool:
        if isinstance(x, TimeInterval):
            (a, b), (c, d) = sorted((self.start, self.end)), sorted((x.start, x.end))
            return a <= c and d <= b
        return self.start <= x < self.end

    def where(self, ts: str = "ts") -> Column:
        """The filter of a series by this interval; reaches the Parquet scan."""
        return (F.col(ts) >= F.lit(self.start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(self.end).cast("timestamp_ntz"))


@dataclass(frozen=True, order=True)
class Resolution:
    delta: timedelta

    @classmethod
    def of(cls, **parts) -> Resolution:
        return cls(timedelta(**parts))

    @property
    def seconds(self) -> int:
        return round(self.delta.total_seconds())

    def step(self, t: datetime) -> TimeInterval:
        start = EPOCH + (t - EPOCH) // self.delta * self.delta
        return TimeInterval(start, start + self.delta)

    def steps(self, i: TimeInterval) -> Iterator[TimeInterval]:
        s = self.step(i.start)
        while s.start < i.end:
            yield s
            s = TimeInterval(s.end, s.end + self.delta)

    @staticmethod
    def gcd(*resolutions: Resolution) -> Resolution:
        return Resolution(timedelta(seconds=reduce(gcd, (r.seconds for r in resolutions))))


class ResolutionTree:
    """The root is the resolutions' greatest common divisor; each other one hangs under the smallest listed one, except the root, that divides it, or else the root.

    parents maps each resolution to the one it is derived from (the root to None); a root that isn't listed is synthetic.
    """

    def __init__(self, *resolutions: Resolution):
        self.listed = sorted(set(resolutions))
        self.root = Resolution.gcd(*self.listed)
        self.parents: dict[Resolution, Resolution | None] = {self.root: None}
        for r in self.listed:
            if r != self.root:
                self.parents[r] = next((p for p in self.listed if self.root < p < r and r.seconds % p.seconds == 0), self.root)

    def children(self, parent: Resolution) -> list[Resolution]:
        return [r for r, p in self.parents.items() if p == parent]

    def __iter__(self) -> Iterator[Resolution]:
        """Parents before children."""
        todo = [self.root]
        while todo:
            r = todo.pop(0)
            yield r
            todo += self.children(r)
