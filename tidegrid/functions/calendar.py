"""Calendar features as column expressions, and holiday calendars as small dimension tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name -> (index of a timestamp from 0, length of the circle).
PERIODIC: dict[str, tuple[Callable[[Column], Column], int]] = {
    "MonthOfYear": (lambda ts: F.month(ts) - 1, 12),
    "WeekOfYear": (lambda ts: F.weekofyear(ts) - 1, 52),
    "DayOfWeek": (lambda ts: F.weekday(ts), 7),
    "TimeOfDay": (lambda ts: F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("int"), 86_400),
}


@dataclass(frozen=True)
class Encoder:
    """A calendar feature: integer classes for grouping, and columns for models. Week 53 stays a class of its own."""

    name: str

    def index(self, ts: str = "ts") -> Column:
        return PERIODIC[self.name][0](F.col(ts)).cast("int") if self.name in PERIODIC else F.col(self.name).cast("int")

    def columns(self, ts: str = "ts") -> list[Column]:
        if self.name not in PERIODIC:
            return [F.col(self.name).cast("double").alias(self.name)]
        angle = self.index(ts) * (F.lit(2.0) * F.pi() / F.lit(float(PERIODIC[self.name][1])))
        return [((F.sin(angle) + 1) / 2).alias(f"{self.name}X"), ((F.cos(angle) + 1) / 2).alias(f"{self.name}Y")]


MonthOfYear, WeekOfYear, DayOfWeek, TimeOfDay = map(Encoder, PERIODIC)
#: These need with_calendar() first.
Holiday, DayType = Encoder("Holiday"), Encoder("DayType")


def encode(df: DataFrame, *encoders: Encoder, ts: str = "ts") -> DataFrame:
    return df.select("*", *[c for e in encoders for c in e.columns(ts)])


def easter(year: int, orthodox: bool = False) -> date:
    """Easter Sunday, by the Gregorian or (for orthodox) the Julian computus as a Gregorian date."""
    if orthodox:
        d = (19 * (year % 19) + 15) % 30
        e = (2 * (year % 4) + 4 * (year % 7) - d + 34) % 7
        return date(year, (d + e + 114) // 31, (d + e + 114) % 31 + 1) + timedelta(year // 100 - year // 400 - 2)
    a, (b, c) = year % 19, divmod(year, 100)
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    return date(year, (h + k - 7 * m + 114) // 31, (h + k - 7 * m + 114) % 31 + 1)


def nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th such weekday of a month (Monday 0); the last one for n = -1."""
    if n < 0:
        last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
        return last - timedelta((last.weekday() - weekday) % 7)
    first = date(year, month, 1)
    return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def moved(day: date, saturday: int = 2) -> date:
    """The day off for a fixed holiday, which is a holiday itself on a weekend too: the Monday after a Sunday; for a Saturday so many days later (or before)."""
    return day + timedelta({5: saturday, 6: 1}.get(day.weekday(), 0))


def _us(y: int) -> set[date]:
    fixed = {date(y, 1, 1), date(y, 7, 4), date(y, 11, 11), date(y, 12, 25)} | ({date(y, 6, 19)} if y >= 2021 else set())
    return fixed | {moved(d, -1) for d in fixed} | {nth(y, 1, 0, 3), nth(y, 2, 0, 3), nth(y, 5, 0, -1), nth(y, 9, 0, 1), nth(y, 10, 0, 2), nth(y, 11, 3, 4)}


def _gb(y: int) -> set[date]:
    e = easter(y)
    christmas = moved(date(y, 12, 25))
    boxing = moved(date(y, 12, 26))
    return {date(y, 1, 1), date(y, 12, 25), date(y, 12, 26), moved(date(y, 1, 1)), e - timedelta(2), e + timedelta(1), nth(y, 5, 0, 1), nth(y, 5, 0, -1), nth(y, 8, 0, -1), christmas, boxing + timedelta(boxing == christmas) * 1}


def _nsw(y: int) -> set[date]:
    e = easter(y)
    return {date(y, 1, 1), moved(date(y, 1, 1)), moved(date(y, 1, 26)), e - timedelta(2), e - timedelta(1), e, e + timedelta(1), date(y, 4, 25), nth(y, 6, 0, 2), nth(y, 10, 0, 1), date(y, 12, 25), date(y, 12, 26), moved(date(y, 12, 26))}


def _rs(y: int) -> set[date]:
    e = easter(y, orthodox=True)
    return {date(y, 1, 1), date(y, 1, 2), date(y, 1, 7), date(y, 2, 15), date(y, 2, 16), date(y, 5, 1), date(y, 5, 2), date(y, 11, 11), *(e + timedelta(d) for d in (-2, -1, 0, 1))}


#: Region code -> its holidays of a year. Add to it, or pass a table of one's own to with_calendar().
RULES: dict[str, Callable[[int], set[date]]] = {"US": _us, "US-NH": lambda y: _us(y) | {nth(y, 11, 3, 4) + timedelta(1)}, "GB": _gb, "AU-NSW": _nsw, "RS": _rs}


def calendar(spark: SparkSession, region: str, first_year: int, last_year: int) -> DataFrame:
    """(date, is_holiday, is_workday) of every day of the years: a few hundred rows a year."""
    off = set().union(*(RULES[region](y) for y in range(first_year, last_year + 1)))
    days = [date(first_year, 1, 1) + timedelta(k) for k in range((date(last_year, 12, 31) - date(first_year, 1, 1)).days + 1)]
    return spark.createDataFrame([(d, d in off, d not in off and d.weekday() < 5) for d in days], "date date, is_holiday boolean, is_workday boolean")


def with_calendar(df: DataFrame, days: DataFrame, ts: str = "ts") -> DataFrame:
    """df with Holiday (0, 1) and DayType (2 holiday, 0 working day, 1 other); days outside the calendar go by the weekday.

    The calendar has one row a day, so it is broadcast: a century is 36,525 rows.
    """
    known = F.broadcast(days.select(F.col("date").alias("_date"), "is_holiday", "is_workday"))
    joined = df.join(known, F.to_date(ts) == F.col("_date"), "left")
    holiday = F.coalesce("is_holiday", F.lit(False))
    work = F.coalesce("is_workday", F.weekday(ts) < 5)
    day_type = F.when(holiday, 2).when(work, 0).otherwise(1)
    return joined.withColumns({"Holiday": holiday.cast("int"), "DayType": day_type}).drop("_date", "is_holiday", "is_workday")
