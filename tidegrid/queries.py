"""The registered queries of the time series engine, each over a whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calendar as cal
from .functions import quantiles as qt
from .functions import timegrid as tg
from .operators import autocorrelation, clustering, gapfill, kernels, moments, neighbours, profiles, quantile_fit, regression, samples, segments
from .plans.learner import CumulantLearner
from .plans.transform import CumulantTransform, scores
from .schema import ID, MOMENTS, series

HOUR, DAY = 3_600, 86_400
P = [0.75, 0.95, 0.99]
TREE = tg.ResolutionTree(*[tg.Resolution.of(hours=h) for h in (1, 2, 6, 24)])
INTERVAL = tg.TimeInterval(datetime(2024, 1, 5), datetime(2024, 1, 20))
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_type(spark: SparkSession, sf: str) -> DataFrame:
    return series(read(spark, sf, "events"), source=F.col("event_type"), value_type="V", category="all")


def by_user_type(spark: SparkSession, sf: str) -> DataFrame:
    return series(read(spark, sf, "events"), source=F.col("user_id"), value_type=F.col("event_type"), category="all")


def by_user(spark: SparkSession, sf: str) -> DataFrame:
    return series(read(spark, sf, "events"), source=F.col("user_id"), value_type="V", category=F.col("user_id") % 3)


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded (and no negative zero), so that they compare with another engine's."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


BY_TYPE = "SELECT event_type AS source, 'V' AS value_type, 'all' AS category, ts, value FROM events"
BY_USER = "SELECT user_id::VARCHAR AS source, 'V' AS value_type, (user_id % 3)::VARCHAR AS category, ts, value FROM events"
BUCKETS = "SELECT source, value_type, category, time_bucket(INTERVAL '{r} seconds', ts, TIMESTAMP '1970-01-01') AS ts, avg(value) AS mean FROM ({v}) GROUP BY ALL"


@query(f"SELECT source, ts, round(mean, 6) AS mean FROM ({BUCKETS.format(r=HOUR, v=BY_TYPE)})")
def bucket_mean(spark, sf):
    return rounded(moments.bucket_moments(by_type(spark, sf), HOUR).select("source", "ts", "mean"))


@query(f"SELECT source, ts, round(mean, 6) AS mean FROM ({BUCKETS.format(r=7 * HOUR, v=BY_TYPE + ' WHERE value <> 0')})")
def skip_zeros(spark, sf):
    return rounded(moments.bucket_moments(by_type(spark, sf), 7 * HOUR, skip_zeros=True).select("source", "ts", "mean"))


@query("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def interval_filter(spark, sf):
    return read(spark, sf, "events").where(INTERVAL.where()).select("event_id", "ts", "value")


@query(
    """SELECT o_orderkey, greatest(o_orderdate, TIMESTAMP '1996-01-01') AS "start", least(o_orderdate + INTERVAL 90 DAY, TIMESTAMP '1996-07-01') AS "end"
    FROM orders WHERE o_orderdate < TIMESTAMP '1996-07-01' AND o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1996-01-01'"""
)
def interval_overlap(spark, sf):
    a, b = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-07-01").cast("timestamp_ntz")
    start, end = tg.overlap(F.col("o_orderdate"), tg.after("o_orderdate", 90 * DAY), a, b)
    return read(spark, sf, "orders").select("o_orderkey", start.alias("start"), end.alias("end")).where("start is not null")


@query("SELECT source, unnest(generate_series(time_bucket(INTERVAL '1 hour', min(ts), TIMESTAMP '1970-01-01'), max(ts), INTERVAL '1 hour')) AS ts FROM (" + BY_TYPE + ") GROUP BY source")
def steps_grid(spark, sf):
    return gapfill.grid(tg.span(by_type(spark, sf), "source"), HOUR)


@query("SELECT event_type, min(ts) AS \"start\", max(ts) AS \"end\", round(epoch_us(max(ts))/1e6 - epoch_us(min(ts))/1e6, 3) AS length FROM events GROUP BY event_type")
def interval_span(spark, sf):
    return tg.span(read(spark, sf, "events"), "event_type").withColumn("length", F.round(tg.seconds("start", "end"), 3))


@query("SELECT l_suppkey, l_shipdate, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY ALL")
def dedupe_mean(spark, sf):
    return rounded(gapfill.dedupe_mean(read(spark, sf, "lineitem"), ["l_suppkey", "l_shipdate"], ["l_quantity", "l_extendedprice"], 0.0))


@query(
    "SELECT user_id::VARCHAR AS source, "
    + ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in ("click", "error", "purchase", "signup", "view"))
    + " FROM events GROUP BY user_id"
)
def pivot_chain(spark, sf):
    means = by_user_type(spark, sf).groupBy("source", "value_type").agg(F.avg("value").alias("m"))
    return rounded(means.groupBy("source").pivot("value_type", ["click", "error", "purchase", "signup", "view"]).agg(F.first("m")))


@query("SELECT o_orderstatus, o_orderpriority, name, round(score, 6) AS score FROM (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS mean, max(o_totalprice) AS most FROM orders GROUP BY ALL) UNPIVOT (score FOR name IN (mean, most))")
def unpivot_scores(spark, sf):
    wide = read(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("most"))
    return rounded(wide.unpivot(["o_orderstatus", "o_orderpriority"], ["mean", "most"], "name", "score"))


def _circle(index: str, length: int, name: str) -> str:
    return f"round((sin({index} * (2.0 * pi() / {length}.0)) + 1) / 2, 6) AS {name}X, round((cos({index} * (2.0 * pi() / {length}.0)) + 1) / 2, 6) AS {name}Y"


@query(
    "SELECT event_id, "
    + ", ".join([_circle("(month(ts) - 1)", 12, "MonthOfYear"), _circle("(weekofyear(ts) - 1)", 52, "WeekOfYear"), _circle("(isodow(ts) - 1)", 7, "DayOfWeek"), _circle("(hour(ts) * 3600 + minute(ts) * 60 + second(ts))", 86400, "TimeOfDay")])
    + " FROM events"
)
def time_encode(spark, sf):
    return rounded(cal.encode(read(spark, sf, "events").select("event_id", "ts"), cal.MonthOfYear, cal.WeekOfYear, cal.DayOfWeek, cal.TimeOfDay).drop("ts"))


# The Easter Sundays of 1990 to 2010.
_EASTERS = ", ".join(f"DATE '{d}'" for d in ("1990-04-15 1991-03-31 1992-04-19 1993-04-11 1994-04-03 1995-04-16 1996-04-07 1997-03-30 1998-04-12 1999-04-04 2000-04-23 2001-04-15 2002-03-31 2003-04-20 2004-04-11 2005-03-27 2006-04-16 2007-04-08 2008-03-23 2009-04-12 2010-04-04").split())
_HOLIDAY = f"""(strftime(d, '%m-%d') IN ('01-01', '12-25', '12-26') OR strftime(d, '%m-%d') IN ('01-02', '01-03') AND isodow(d) = 1 OR strftime(d, '%m-%d') IN ('12-27', '12-28') AND isodow(d) IN (1, 2)
    OR d + 2 IN ({_EASTERS}) OR d - 1 IN ({_EASTERS}) OR isodow(d) = 1 AND (month(d) = 5 AND (day(d) <= 7 OR day(d) >= 25) OR month(d) = 8 AND day(d) >= 25))"""


@query(f"SELECT o_orderkey, ({_HOLIDAY})::INT AS holiday, CASE WHEN {_HOLIDAY} THEN 2 WHEN isodow(d) < 6 THEN 0 ELSE 1 END AS day_type FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def holiday_join(spark, sf):
    days = cal.calendar(spark, "GB", 1990, 2030)
    return cal.with_calendar(read(spark, sf, "orders"), days, "o_orderdate").select("o_orderkey", F.col("Holiday").alias("holiday"), F.col("DayType").alias("day_type"))


PAIRS = f"SELECT * FROM (SELECT source, lag(ts) OVER w AS ta, lag(value) OVER w AS va, ts AS tb, value AS vb FROM (SELECT source, ts, min(value) AS value FROM ({BY_TYPE}) GROUP BY source, ts) WINDOW w AS (PARTITION BY source ORDER BY ts)) WHERE ta IS NOT NULL"


def _integrals(spark, sf, kind: str):
    c = [F.col(x) for x in ("ta", "va", "tb", "vb")]
    value = segments.INTEGRALS[kind](*c, F.timestamp_add("SECOND", F.lit(-10), F.col("ta")), F.timestamp_add("SECOND", F.lit(10), F.col("tb")))
    return rounded(segments.pairs(by_type(spark, sf)).select("source", "tb", value.alias("integral")), 1)


@query(
    f"""SELECT source, tb, round((vb - va) / l * ((l + 10) * (l + 10) - 100) / 2 + va * (l + 20), 1) AS integral
    FROM (SELECT *, (epoch_us(tb) - epoch_us(ta)) / 1e6 AS l FROM ({PAIRS}))"""
)
def linear_integral(spark, sf):
    return _integrals(spark, sf, "linear")


@query(f"SELECT source, tb, round(va * ((epoch_us(tb) - epoch_us(ta)) / 1e6) + vb * 10.0, 1) AS integral FROM ({PAIRS})")
def step_integral(spark, sf):
    return _integrals(spark, sf, "step")


_PIECES = f"""
c AS (SELECT *, unnest(generate_series(time_bucket(INTERVAL '1 hour', ta, TIMESTAMP '1970-01-01'), tb - INTERVAL 1 MICROSECOND, INTERVAL '1 hour')) AS step FROM ({PAIRS})),
i AS (SELECT *, greatest(step, ta) AS i0, least(step + INTERVAL '1 hour', tb) AS i1 FROM c),
x AS (SELECT *, (epoch_us(i0) - epoch_us(ta)) / 1e6 AS x0, (epoch_us(i1) - epoch_us(ta)) / 1e6 AS x1, (epoch_us(tb) - epoch_us(ta)) / 1e6 AS l, (epoch_us(i1) - epoch_us(i0)) / 1e6 AS length FROM i),
m AS (SELECT *, ((vb - va) / l * (x1 * x1 - x0 * x0) / 2 + va * (x1 - x0)) / length AS mean FROM x),
p AS (SELECT source, step, i0, i1, length, (i0 = ta)::BIGINT AS count, mean,
""" + ",\n".join(f"((pow(vb - mean, {d}) - pow(va - mean, {d})) / l * (x1 * x1 - x0 * x0) / 2 + pow(va - mean, {d}) * (x1 - x0)) / length AS m{d}" for d in (2, 3, 4)) + " FROM m)"


@query(f"WITH {_PIECES} SELECT source, step, i0, i1, round(length, 6) AS length, count, round(mean, 4) AS mean, round(m2, 4) AS m2, round(m3, 2) AS m3, round(m4, 1) AS m4 FROM p")
def pair_segments(spark, sf):
    p = segments.pieces(by_type(spark, sf), HOUR)
    return p.select("source", "step", "i0", "i1", F.round("length", 6).alias("length"), "count", F.round("mean", 4).alias("mean"), F.round("m2", 4).alias("m2"), (F.round("m3", 2) + 0.0).alias("m3"), (F.round("m4", 1) + 0.0).alias("m4"))


_FOLD = """list_reduce(list({'w': length, 'n': count, 'mean': mean, 'm2': m2, 'm3': m3, 'm4': m4} ORDER BY i0), lambda a, b: {'w': a.w + b.w, 'n': a.n + b.n,
    'mean': (a.w * a.mean + b.w * b.mean) / (a.w + b.w),
""" + ",\n".join(f"'m{d}': (a.w * (a.m{d} + pow(a.mean - (a.w * a.mean + b.w * b.mean) / (a.w + b.w), {d})) + b.w * (b.m{d} + pow(b.mean - (a.w * a.mean + b.w * b.mean) / (a.w + b.w), {d}))) / (a.w + b.w)" for d in (2, 3, 4)) + "}) AS s"


def _level(name: str, parent: str, parent_s: int, r: int) -> str:
    bucket = f"time_bucket(INTERVAL '{r} seconds', step, TIMESTAMP '1970-01-01')"
    return f"""{name}p AS (SELECT source, {bucket} AS step, i0, i1, s.w AS length, s.n AS count, s.mean AS mean, s.m2 AS m2, s.m3 AS m3, s.m4 AS m4 FROM {parent} WHERE i1 = step + INTERVAL '{parent_s} seconds'),
{name} AS (SELECT source, step, min(i0) AS i0, max(i1) AS i1, {_FOLD} FROM {name}p GROUP BY source, step)"""


_STEPS = _PIECES[: _PIECES.index("m AS (")] + "p AS (SELECT source, step, i0, i1, length, (i0 = ta)::BIGINT AS count, va AS mean, 0.0::DOUBLE AS m2, 0.0::DOUBLE AS m3, 0.0::DOUBLE AS m4 FROM x)"


def _segments_sql(pieces: str, select: str) -> str:
    return f"WITH {pieces}, a AS (SELECT source, step, min(i0) AS i0, max(i1) AS i1, {_FOLD} FROM p GROUP BY source, step), {_level('b', 'a', HOUR, 2 * HOUR)}, {_level('c2', 'b', 2 * HOUR, 6 * HOUR)}, {_level('d', 'b', 2 * HOUR, DAY)} " + " UNION ALL ".join(
        f"SELECT {select.format(r=r)} FROM {t}" for t, r in (("a", HOUR), ("b", 2 * HOUR), ("c2", 6 * HOUR), ("d", DAY))
    )


_SEGMENT = "source, {r}::BIGINT AS resolution_s, i0 AS seg_start, i1 AS seg_end, round(s.w, 4) AS length, s.n::BIGINT AS count, round(s.mean, 4) AS mean, round(s.m2, 3) AS m2, round(s.m3, 2) AS m3, round(s.m4, 1) AS m4, i1 = step + INTERVAL '{r} seconds' AS complete"


def _shown(segments_: DataFrame) -> DataFrame:
    digits = {"length": 4, "mean": 4, "m2": 3, "m3": 2, "m4": 1}
    return segments_.select("source", "resolution_s", "seg_start", "seg_end", "count", "complete", *[(F.round(c, n) + 0.0).alias(c) for c, n in digits.items()])


@query(_segments_sql(_PIECES, _SEGMENT))
def segment_cascade(spark, sf):
    return _shown(segments.segments(by_type(spark, sf), TREE))


@query(_segments_sql(_STEPS, _SEGMENT))
def segments_step(spark, sf):
    return _shown(segments.segments(by_type(spark, sf), TREE, "step"))


@query(
    f"SELECT source, time_bucket(INTERVAL '1 day', seg_start, TIMESTAMP '1970-01-01') AS ts, round(length / {DAY}, 6) AS weight, round(mean, 4) AS mean, round(m2, 3) AS m2, round(m3, 2) AS m3, round(m4, 1) AS m4 FROM ("
    + _segments_sql(_PIECES, "source, i0 AS seg_start, s.w AS length, s.mean AS mean, s.m2 AS m2, s.m3 AS m3, s.m4 AS m4, {r} AS r, i1 = step + INTERVAL '{r} seconds' AS complete")
    + f") WHERE r = {DAY} AND complete"
)
def covered_moments(spark, sf):
    m = segments.covered_moments(segments.segments(by_type(spark, sf), TREE, open_too=False), DAY)
    return m.select("source", "ts", *[(F.round(c, n) + 0.0).alias(c) for c, n in {"weight": 6, "mean": 4, "m2": 3, "m3": 2, "m4": 1}.items()])


def _arriving(spark, sf, parts: int, start) -> None:
    """The events as files that arrive one after the other, by time; each time start(stream) is run on all that there is."""
    from .sources.shared import shared_folder

    rows = read(spark, sf, "events").select("ts", "event_type", "user_id", "value").where("ts is not null")
    folder = shared_folder(spark, "events")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    # A stream keeps its number of partitions for good: no more than tasks run at once, twice.
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(partitions), 2 * spark.sparkContext.defaultParallelism))
    try:
        for k in range(parts):
            low, high = (F.lit(None if first is None else first + (last - first + timedelta(microseconds=1)) * i // parts).cast("timestamp_ntz") for i in (k, k + 1))
            rows.where((F.col("ts") >= low) & (F.col("ts") < high)).write.mode("append").parquet(folder)
            start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def _live(spark, sf) -> tuple[str, str]:
    """(folder of written segments, checkpoint) of a stream over the events that is stopped half way and goes on from its checkpoint."""
    from .sources.shared import shared_folder
    from .streaming import live

    folder, checkpoint = shared_folder(spark, "segments"), shared_folder(spark, "checkpoint")

    def start(events):
        return live.written_live(live.live_segments(series(events, source=F.col("event_type"), value_type="V", category="all"), TREE), folder, checkpoint)

    _arriving(spark, sf, 2, start)
    return folder, checkpoint


@query(f"SELECT * FROM ({_segments_sql(_PIECES, _SEGMENT)}) WHERE complete")
def stream_finished(spark, sf):
    """Segments that a stream has written, each once its bucket was full."""
    from .streaming import live

    return _shown(live.written_segments(spark, _live(spark, sf)[0]))


@query(_segments_sql(_PIECES, _SEGMENT))
def stream_open_too(spark, sf):
    """Written segments and those under way in the state store together."""
    from .streaming import live

    return _shown(live.segment_table(spark, *_live(spark, sf)))


FACTORS = f"SELECT source, value_type, category, avg(mean) AS factor FROM ({BUCKETS.format(r=DAY, v=BY_USER)}) GROUP BY ALL"


@query(f"SELECT source, category, round(factor, 6) AS factor FROM ({FACTORS})")
def series_factor(spark, sf):
    return rounded(moments.factors(moments.bucket_moments(by_user(spark, sf), DAY)).select("source", "category", "factor"))


@query(
    f"""SELECT b.source, b.category, (isodow(b.ts) - 1)::INT AS day_of_week, round(avg(b.mean) / any_value(f.factor), 6) AS level
    FROM ({BUCKETS.format(r=6 * HOUR, v=BY_USER)}) b JOIN (SELECT source, avg(mean) AS factor FROM ({BUCKETS.format(r=6 * HOUR, v=BY_USER)}) GROUP BY source) f ON f.source = b.source GROUP BY b.source, b.category, isodow(b.ts)"""
)
def calendar_profile(spark, sf):
    m = moments.bucket_moments(by_user(spark, sf), 6 * HOUR)
    p = profiles.profiles(m, moments.factors(m), [cal.DayOfWeek])
    return rounded(p.select("source", "category", F.col("class_DayOfWeek").alias("day_of_week"), "level"))


SCALED = f"SELECT b.source, b.category, (b.source::INT % 5)::INT AS cluster, b.ts, b.mean / f.factor AS x FROM ({BUCKETS.format(r=DAY, v=BY_USER)}) b JOIN ({FACTORS}) f ON f.source = b.source"
CLUSTERED = f"""SELECT category, cluster, ts, count(*) AS n_members, any_value(mu) AS mean, avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4
    FROM (SELECT *, avg(x) OVER (PARTITION BY category, cluster, ts) AS mu FROM ({SCALED})) GROUP BY category, cluster, ts"""
STANDARD = f"SELECT category, cluster, ts, n_members, mean, sqrt(m2) AS stdev, CASE WHEN n_members > 1 AND m2 > 1e-20 THEN m3 / pow(m2, 1.5) ELSE 0 END AS skewness, CASE WHEN n_members > 1 AND m2 > 1e-20 THEN m4 / (m2 * m2) - 3 ELSE 0 END AS kurtosis FROM ({CLUSTERED})"


def ruled_membership(spark, sf):
    """Users go to clusters by their number, for results that do not depend on a search."""
    users = read(spark, sf, "events").select("user_id").distinct()
    return users.select((F.col("user_id") % 3).cast("string").alias("category"), F.col("user_id").cast("string").alias("source"), (F.col("user_id") % 5).cast("int").alias("cluster"))


def _scaled(spark, sf):
    m = moments.bucket_moments(by_user(spark, sf), DAY)
    return moments.scaled(m, moments.factors(m)).join(ruled_membership(spark, sf), ["category", "source"])


@query(f"SELECT category, cluster, ts, n_members, round(mean, 6) AS mean, round(m2, 6) AS m2, round(m3, 5) AS m3, round(m4, 4) AS m4 FROM ({CLUSTERED})")
def cluster_moments(spark, sf):
    c = moments.combined(_scaled(spark, sf), ["category", "cluster", "ts"])
    return c.select("category", "cluster", "ts", "n_members", F.round("mean", 6).alias("mean"), F.round("m2", 6).alias("m2"), (F.round("m3", 5) + 0.0).alias("m3"), (F.round("m4", 4) + 0.0).alias("m4"))


def ruled_cumulants(spark, sf):
    m = moments.bucket_moments(by_user(spark, sf), DAY)
    return moments.cumulants(m, moments.factors(m), ruled_membership(spark, sf))


@query(f"SELECT category, cluster, ts, n_members, round(mean, 6) AS mean, round(stdev, 6) AS stdev, CASE WHEN n_members > 1 THEN round(skewness, 4) ELSE 0 END AS skewness, CASE WHEN n_members > 1 THEN round(kurtosis, 4) ELSE 0 END AS kurtosis FROM ({STANDARD})")
def cumulants(spark, sf):
    return _shown_cumulants(ruled_cumulants(spark, sf))


def _shown_cumulants(rows: DataFrame) -> DataFrame:
    one = F.col("n_members") > 1
    shown = {c: F.when(one, F.round(c, 4) + 0.0).otherwise(F.lit(0.0)).alias(c) for c in ("skewness", "kurtosis")}
    return rows.select("category", "cluster", "ts", "n_members", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), shown["skewness"], shown["kurtosis"])


@query(ORACLE["cumulants"])
def incremental_cumulants(spark, sf):
    """The same from power sums that three micro-batches have appended."""
    from .sources.shared import shared_folder
    from .streaming.increments import PowerSums

    sums, checkpoint = PowerSums(spark, shared_folder(spark, "sums"), DAY), shared_folder(spark, "checkpoint")
    _arriving(spark, sf, 3, lambda events: sums.follow(series(events, source=F.col("user_id"), value_type="V", category=F.col("user_id") % 3), checkpoint))
    m = sums.moments()
    return _shown_cumulants(moments.cumulants(m, moments.factors(m), ruled_membership(spark, sf)))


def _qcf(q: float) -> str:
    return f"(mean + stdev * ({q!r}::DOUBLE + ({q!r}::DOUBLE * {q!r}::DOUBLE - 1) * skewness / 6 / sqrt(n_members::DOUBLE) + (({q!r}::DOUBLE * {q!r}::DOUBLE * {q!r}::DOUBLE - 3 * {q!r}::DOUBLE) * kurtosis / 24 - (2 * {q!r}::DOUBLE * {q!r}::DOUBLE * {q!r}::DOUBLE - 5 * {q!r}::DOUBLE) * skewness * skewness / 36) / n_members))"


INTERVALS = " UNION ALL ".join(f"SELECT category, cluster, ts, {p}::DOUBLE AS p, {_qcf(qt.ppf(qt.bounds(p)[0]))} AS lower, {_qcf(qt.ppf(qt.bounds(p)[1]))} AS upper FROM ({STANDARD}) WHERE n_members > 1" for p in P)


def ruled_intervals(spark, sf):
    return qt.intervals(ruled_cumulants(spark, sf).where("n_members > 1").drop("value_type"), P).drop("n_members")


@query(f"SELECT category, cluster, ts, p, round(lower, 4) AS lower, round(upper, 4) AS upper FROM ({INTERVALS})")
def prediction_intervals(spark, sf):
    return rounded(ruled_intervals(spark, sf), 4, ("p",))


@query(f"SELECT category, cluster, ts, round(mean + stdev * {qt.ppf(0.9)!r}::DOUBLE, 4) AS normal, round({_qcf(qt.ppf(0.9))}, 4) AS expanded FROM ({STANDARD}) WHERE n_members > 1")
def qcf_quantiles(spark, sf):
    c = ruled_cumulants(spark, sf).where("n_members > 1")
    m, s, k3, k4, n = (F.col(x) for x in ("mean", "stdev", "skewness", "kurtosis", "n_members"))
    z = qt.ppf(0.9)
    return rounded(c.select("category", "cluster", "ts", qt.cornish_fisher(z, n.cast("double"), m, s).alias("normal"), qt.cornish_fisher(z, n.cast("double"), m, s, k3, k4).alias("expanded")), 4)


@query(f"SELECT category, cluster, ts, " + ", ".join(f"round(any_value({b.lower()}) FILTER (p = {p}), 4) AS \"{b} {100 * p:g}% PI\"" for p in P for b in ("Lower", "Upper")) + f" FROM ({INTERVALS}) GROUP BY category, cluster, ts")
def intervals_to_frame(spark, sf):
    return rounded(qt.to_frame(ruled_intervals(spark, sf), ["category", "cluster", "ts"], P), 4)


MEMBER_ROWS = f"""SELECT s.source, s.category, i.p, i.lower * f.factor AS lower, i.upper * f.factor AS upper, s.x * f.factor AS x
    FROM ({SCALED}) s JOIN ({INTERVALS}) i ON i.category = s.category AND i.cluster = s.cluster AND i.ts = s.ts JOIN ({FACTORS}) f ON f.source = s.source"""


def _member_rows(spark, sf):
    m = moments.bucket_moments(by_user(spark, sf), DAY)
    f = moments.factors(m)
    members = m.join(f, ID).join(ruled_membership(spark, sf), ["category", "source"])
    both = members.select(*ID, "cluster", "ts", "factor", F.col("mean").alias("x")).join(ruled_intervals(spark, sf), ["category", "cluster", "ts"])
    return both.select(*ID, "ts", "p", (F.col("lower") * F.col("factor")).alias("lower"), (F.col("upper") * F.col("factor")).alias("upper"), "x")


@query(f"SELECT source, category, p, round(avg((upper - lower) + CASE WHEN x < lower THEN 2 * (lower - x) / (1 - p) ELSE 0 END + CASE WHEN x > upper THEN 2 * (x - upper) / (1 - p) ELSE 0 END), 3) AS score FROM ({MEMBER_ROWS}) GROUP BY ALL")
def winkler_scores(spark, sf):
    return rounded(scores(_member_rows(spark, sf), P)[1].drop("value_type"), 3, ("p",))


_QUANTILES = " UNION ALL ".join(f"SELECT source, category, {b!r}::DOUBLE AS p, {side} AS q, x FROM ({MEMBER_ROWS}) WHERE p = {p}" for p in P for b, side in zip(qt.bounds(p), ("lower", "upper"), strict=True))


@query(f"SELECT source, category, round(p, 6) AS p, round(avg(CASE WHEN x < q THEN (1 - p) * (q - x) ELSE p * (x - q) END), 4) AS score FROM ({_QUANTILES}) GROUP BY ALL")
def pinball_scores(spark, sf):
    return rounded(scores(_member_rows(spark, sf), P)[0].drop("value_type"), 4, ("p",))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity < 25 THEN 0.1 * (25 - l_quantity) ELSE 0.9 * (l_quantity - 25) END, 6) AS pinball, round(20 + CASE WHEN l_quantity < 15 THEN 2 * (15 - l_quantity) / (1 - 0.9::DOUBLE) ELSE 0 END + CASE WHEN l_quantity > 35 THEN 2 * (l_quantity - 35) / (1 - 0.9::DOUBLE) ELSE 0 END, 6) AS winkler FROM lineitem")
def losses(spark, sf):
    x = F.col("l_quantity")
    return rounded(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", qt.pinball(0.9, x, F.lit(25.0)).alias("pinball"), qt.winkler(0.9, x, F.lit(15.0), F.lit(35.0)).alias("winkler")))


_REGULAR = f"""g AS (SELECT source, unnest(generate_series(min(ts), max(ts), INTERVAL '10 minutes')) AS ts FROM b GROUP BY source),
r AS (SELECT g.source, g.ts, b.mean FROM g LEFT JOIN b ON b.source = g.source AND b.ts = g.ts),
s AS (SELECT *, last_value(CASE WHEN mean IS NOT NULL THEN ts END IGNORE NULLS) OVER k AS tp, last_value(mean IGNORE NULLS) OVER k AS vp,
    first_value(CASE WHEN mean IS NOT NULL THEN ts END IGNORE NULLS) OVER n AS tn, first_value(mean IGNORE NULLS) OVER n AS vn FROM r
    WINDOW k AS (PARTITION BY source ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY source ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"WITH b AS ({BUCKETS.format(r=600, v=BY_TYPE)}), {_REGULAR} SELECT source, ts, round(CASE WHEN mean IS NOT NULL THEN mean WHEN tn IS NULL THEN vp ELSE vp + (vn - vp) * (epoch_us(ts) - epoch_us(tp)) / (epoch_us(tn) - epoch_us(tp)) END, 9) AS mean FROM s")
def linear_gap_fill(spark, sf):
    b = moments.bucket_moments(by_type(spark, sf), 600).select("source", "ts", "mean")
    return rounded(gapfill.linear_fill(gapfill.regular(b, ["source"], 600), ["source"], ["mean"], 600 * 1_000_000 * 1_024), 9)


@query(
    f"""WITH b AS (SELECT 'x' AS source, l_shipdate AS ts, avg(l_quantity) AS mean FROM lineitem WHERE time_bucket(INTERVAL '2 days', l_shipdate, TIMESTAMP '1970-01-01') = l_shipdate GROUP BY l_shipdate),
    {_REGULAR.replace("10 minutes", "2 days")} SELECT ts, round(CASE WHEN mean IS NOT NULL THEN mean WHEN tn IS NULL THEN vp ELSE vp + (vn - vp) * (epoch_us(ts) - epoch_us(tp)) / (epoch_us(tn) - epoch_us(tp)) END, 6) AS l_quantity FROM s"""
)
def resample_exog(spark, sf):
    x = read(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ts"), "l_quantity")
    return rounded(gapfill.resampled(x, ["l_quantity"], 2 * DAY))


@query(
    f"""SELECT source, ts, past, future FROM (SELECT source, ts, list(m) OVER (PARTITION BY source ORDER BY ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS past,
    list(m) OVER (PARTITION BY source ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS future FROM (SELECT source, ts, round(mean, 6) AS m FROM ({BUCKETS.format(r=HOUR, v=BY_TYPE)}))) WHERE len(past) = 48 AND len(future) = 24"""
    .replace("SELECT source, ts, past, future FROM", "SELECT source, ts, round(list_sum(past), 1) AS past_sum, round(past[1], 6) AS past_first, round(list_sum(future), 1) AS future_sum, round(future[24], 6) AS future_last FROM")
)
def sliding_samples(spark, sf):
    m = moments.bucket_moments(by_type(spark, sf), HOUR).select("source", "ts", F.round("mean", 6).alias("m"))
    s = samples.sliding_samples(m, ["source"], ["m"], 48, 24)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 1)
    return s.select("source", "ts", total("m_past").alias("past_sum"), F.round(F.col("m_past")[0], 6).alias("past_first"), total("m_future").alias("future_sum"), F.round(F.col("m_future")[23], 6).alias("future_last"))


_SCALES = {"minmax": ("min(c_acctbal)", "max(c_acctbal) - min(c_acctbal)"), "absmax": ("0", "max(abs(c_acctbal))"), "mean": ("avg(c_acctbal)", "stddev_pop(c_acctbal)"), "median": ("quantile_cont(c_acctbal, 0.5)", "quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)")}


def _scale_query(method: str) -> Query:
    def run(spark, sf):
        x = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
        return rounded(samples.scale(x, samples.scaler(x, ["c_mktsegment"], "c_acctbal", method), ["c_mktsegment"], "c_acctbal"))

    return run


for _m, (_c, _s) in _SCALES.items():
    query(f"SELECT c_custkey, c_mktsegment, round((c_acctbal - center) / scale, 6) AS c_acctbal FROM customer JOIN (SELECT c_mktsegment, {_c} AS center, {_s} AS scale FROM customer GROUP BY c_mktsegment) USING (c_mktsegment)", f"scale_{_m}")(_scale_query(_m))


@query(
    """WITH s AS (SELECT n_name AS grp, p_brand AS feature, sum(l_extendedprice) AS score FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, feature) AS k, sum(score) OVER (PARTITION BY grp ORDER BY score DESC, feature ROWS UNBOUNDED PRECEDING) / sum(score) OVER (PARTITION BY grp) AS c FROM s)
    SELECT grp, feature, round(score, 2) AS score, k <= greatest(sum((c <= 0.6)::INT) OVER (PARTITION BY grp) + 1, 3) AS selected FROM r"""
)
def feature_topk(spark, sf):
    return rounded(samples.top_by_share(_brand_scores(spark, sf), ["grp"], 0.6), 2)


def _brand_scores(spark, sf) -> DataFrame:
    li, pa, su, na = (read(spark, sf, t) for t in ("lineitem", "part", "supplier", "nation"))
    s = li.join(pa, li.l_partkey == pa.p_partkey).join(su, li.l_suppkey == su.s_suppkey).join(na, na.n_nationkey == su.s_nationkey)
    return s.groupBy(F.col("n_name").alias("grp"), F.col("p_brand").alias("feature")).agg(F.sum("l_extendedprice").alias("score"))


@query(
    """WITH s AS (SELECT n_name AS grp, p_brand AS feature, sum(l_extendedprice) AS score FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
    u AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, feature) - 1 AS k, count(*) OVER (PARTITION BY grp) AS n FROM s),
    v AS (SELECT *, 1 - (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) - k / nullif(n - 1.0::DOUBLE, 0) AS h FROM u WINDOW w AS (PARTITION BY grp)),
    e AS (SELECT *, h > lag(h) OVER w AND h >= lead(h) OVER w AS peak, h < lag(h) OVER w AND h <= lead(h) OVER w AS dip FROM v WINDOW w AS (PARTITION BY grp ORDER BY k)),
    t AS (SELECT *, coalesce(min(CASE WHEN peak OR dip THEN k END) OVER (PARTITION BY grp ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS turn FROM e),
    q AS (SELECT t.grp, min(t.k) AS place FROM t JOIN t j ON j.grp = t.grp AND j.k > t.k AND j.k < t.turn AND j.h < t.h - 1.0 / (t.n - 1) WHERE t.peak GROUP BY t.grp)
    SELECT u.grp, feature, round(score, 2) AS score, k < greatest(coalesce(place, n - 1), 3) AS selected FROM u LEFT JOIN q ON q.grp = u.grp"""
)
def feature_knee(spark, sf):
    return rounded(samples.top_by_knee(_brand_scores(spark, sf), ["grp"]), 2)


_EXPLODED = "SELECT label AS cluster, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings"


@query(f"SELECT cluster, dim::INT AS dim, count(*) AS n, round(avg(x), 6) AS center FROM ({_EXPLODED}) GROUP BY ALL")
def centroids(spark, sf):
    return rounded(clustering.centroids(read(spark, sf, "embeddings"), "label", "embedding"))


@query(
    f"""WITH s AS (SELECT cluster, dim, count(*) AS n, avg(x) AS c, var_pop(x) AS v FROM ({_EXPLODED}) GROUP BY ALL), t AS (SELECT dim, sum(n * c) / sum(n) AS mean FROM s GROUP BY dim)
    SELECT round(sum(n * pow(c - mean, 2)) / sum(n * v) * (sum(n) / count(DISTINCT dim) - count(DISTINCT cluster)) / (count(DISTINCT cluster) - 1), 6) AS score FROM s JOIN t USING (dim)"""
)
def ch_score(spark, sf):
    return rounded(clustering.calinski_harabasz_frame(read(spark, sf, "embeddings"), "label", "embedding"))


@query(
    f"""WITH c AS (SELECT cluster, dim, avg(x) AS c FROM ({_EXPLODED}) WHERE cluster IS NOT NULL GROUP BY ALL), v AS (SELECT cluster, list(c ORDER BY dim) AS c FROM c GROUP BY cluster),
    s AS (SELECT label AS cluster, avg(sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], v.c), lambda z: pow(z[1] - z[2], 2))))) AS s FROM embeddings JOIN v ON v.cluster = label GROUP BY label),
    r AS (SELECT a.cluster, max((s.s + t.s) / sqrt(list_sum(list_transform(list_zip(a.c, b.c), lambda z: pow(z[1] - z[2], 2))))) AS r FROM v a JOIN v b ON a.cluster <> b.cluster JOIN s ON s.cluster = a.cluster JOIN s t ON t.cluster = b.cluster GROUP BY a.cluster)
    SELECT round(avg(r), 6) AS score FROM r"""
)
def db_score(spark, sf):
    return rounded(clustering.davies_bouldin_frame(read(spark, sf, "embeddings"), "label", "embedding"))


@query("SELECT label AS cluster, count(*) AS members FROM embeddings GROUP BY label")
def cardinality(spark, sf):
    return read(spark, sf, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("members"))


_CENTERS = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(4)]


@query(
    "SELECT vec_id, (list_position(ds, list_min(ds)) - 1)::INT AS cluster, round(sqrt(list_min(ds)), 6) AS distance FROM (SELECT vec_id, ["
    + ", ".join("list_sum([pow(z[1]::DOUBLE - z[2], 2) for z in list_zip(embedding, " + str(c) + "::DOUBLE[])])" for c in _CENTERS)
    + "] AS ds FROM embeddings)"
)
def kmeans_assign(spark, sf):
    return rounded(clustering.assigned(read(spark, sf, "embeddings"), "vec_id", "embedding", _CENTERS))


@query("SELECT source, ts, value, side FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts) AS f, row_number() OVER (PARTITION BY source ORDER BY ts DESC) AS l FROM (" + BY_TYPE + ")) , (VALUES ('first'), ('last')) s(side) WHERE (side = 'first' AND f <= 24) OR (side = 'last' AND l <= 24)")
def horizon_slices(spark, sf):
    s = by_type(spark, sf)
    first, last = (samples.first_rows(s, ["source"], 24, x).select("source", "ts", "value", F.lit("last" if x else "first").alias("side")) for x in (False, True))
    return first.unionByName(last)


@query("SELECT DISTINCT event_type AS category, (user_id % 3)::VARCHAR AS grp FROM events")
def distinct_categories(spark, sf):
    return read(spark, sf, "events").select(F.col("event_type").alias("category"), (F.col("user_id") % 3).cast("string").alias("grp")).distinct()


# What SQL can't say: searches, trained models, streams.


@query()
def pca_scores(spark, sf):
    share = kernels.scatter_shares(*_scatter(spark, sf))
    kept = kernels.selected(share, 0.9)
    return spark.createDataFrame([(i, float(s), i in kept) for i, s in enumerate(share)], "feature int, score double, selected boolean")


@query()
def tsga_embeddings(spark, sf):
    return clustering.tsga(read(spark, sf, "embeddings"), "vec_id", "embedding")


@query()
def kmeans_embeddings(spark, sf):
    return clustering.spark_kmeans(read(spark, sf, "embeddings"), "vec_id", "embedding", 10)


def fitted(spark, sf) -> tuple[CumulantTransform, DataFrame]:
    t = CumulantTransform(DAY, (cal.DayOfWeek,))
    s = by_user(spark, sf)
    return t.fit(s), s


@query()
def transform_cumulants(spark, sf):
    t, s = fitted(spark, sf)
    return t.transform(s, fill_gaps=True)


@query()
def transform_intervals(spark, sf):
    t, s = fitted(spark, sf)
    return t.inverse_transform(t.transform(s), P)


@query()
def clustering_score(spark, sf):
    return fitted(spark, sf)[0].clustering_score(spark)


def learner(spark, sf) -> CumulantLearner:
    make = lambda: regression.Forecaster(24, regression.StepModel("linear"), lags=regression.PartialLags(48))
    return CumulantLearner(by_type(spark, sf), None, HOUR, CumulantTransform(HOUR, (cal.TimeOfDay,)), make)


@query()
def predict_intervals(spark, sf):
    a = learner(spark, sf).fit(tg.TimeInterval(datetime(2024, 1, 1), datetime(2024, 1, 28)))
    return a.predict(datetime(2024, 1, 28), P)


@query()
def backtest(spark, sf):
    e = learner(spark, sf).evaluate(tg.TimeInterval(datetime(2024, 1, 1), datetime(2024, 1, 26)), tg.TimeInterval(datetime(2024, 1, 26), datetime(2024, 1, 29)), P, update=2)
    return e.tables["winkler_score"]


_LAGS, _RADIUS = 48, 2.5758293035489004  # Fixed value: the normal quantile of 0.995.
_PACF = f"""WITH RECURSIVE b AS ({BUCKETS.format(r=HOUR, v=BY_TYPE)}), {_REGULAR.replace("10 minutes", "1 hour")},
f AS (SELECT source, ts, CASE WHEN mean IS NOT NULL THEN mean WHEN tn IS NULL THEN vp ELSE vp + (vn - vp) * (epoch_us(ts) - epoch_us(tp)) / (epoch_us(tn) - epoch_us(tp)) END AS x FROM s),
d AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY ts) AS i, count(*) OVER (PARTITION BY source) AS n, x - avg(x) OVER (PARTITION BY source) AS d FROM f),
c AS (SELECT a.source, any_value(a.n) AS n, k, sum(a.d * b.d) / (any_value(a.n) - k) AS c FROM d a CROSS JOIN range({_LAGS + 1}) t(k) JOIN d b ON b.source = a.source AND b.i = a.i - k GROUP BY a.source, k),
cs AS (SELECT source, any_value(n) AS n, list(c ORDER BY k) AS c FROM c GROUP BY source),
p(source, k, phi, error, score) AS (SELECT source, 0, []::DOUBLE[], c[1], 1.0::DOUBLE FROM cs
    UNION ALL SELECT source, k + 1, list_append(list_transform(phi, lambda x, j: x - r * phi[k + 1 - j]), r), error * (1 - r * r), r
    FROM (SELECT p.source, p.k, p.phi, p.error, (cs.c[p.k + 2] - coalesce(list_sum(list_transform(p.phi, lambda x, j: x * cs.c[p.k + 2 - j])), 0)) / p.error AS r FROM p JOIN cs ON cs.source = p.source WHERE p.k < {_LAGS})),
s0 AS (SELECT p.source, k, CASE WHEN abs(score) <= 1 THEN score ELSE 0 END AS score, {_RADIUS} / sqrt(n) AS ci FROM p JOIN cs ON cs.source = p.source),
o AS (SELECT *, sum(CASE WHEN abs(score) < ci THEN 0 ELSE pow(score - ci, 2) END) OVER (PARTITION BY source ORDER BY k DESC) AS rest FROM s0),
u AS (SELECT *, 1 - sum(rest) OVER (PARTITION BY source ORDER BY k) / CASE WHEN sum(rest) OVER w > 0 THEN sum(rest) OVER w ELSE 1 END AS y FROM o WINDOW w AS (PARTITION BY source)),
v AS (SELECT *, 1 - (y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0) - k / {_LAGS}.0 AS h FROM u WINDOW w AS (PARTITION BY source)),
e AS (SELECT *, h > lag(h) OVER w AND h >= lead(h) OVER w AS peak, h < lag(h) OVER w AND h <= lead(h) OVER w AS dip FROM v WINDOW w AS (PARTITION BY source ORDER BY k)),
t AS (SELECT *, coalesce(min(CASE WHEN peak OR dip THEN k END) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), {_LAGS + 1}) AS turn FROM e),
q AS (SELECT t.source, min(t.k) AS place FROM t JOIN t j ON j.source = t.source AND j.k > t.k AND j.k < t.turn AND j.h < t.h - 1.0 / {_LAGS} WHERE t.peak GROUP BY t.source)
SELECT s0.source, k::INT AS lag, round(score, 6) AS score, k <= coalesce(place, {_LAGS}) AS selected, round(ci, 6) AS ci FROM s0 LEFT JOIN q ON q.source = s0.source"""


@query(_PACF)
def partial_autocorrelation(spark, sf):
    m = gapfill.linear_fill(gapfill.regular(moments.bucket_moments(by_type(spark, sf), HOUR).select("source", "ts", "mean"), ["source"], HOUR), ["source"], ["mean"], HOUR * 1_000_000 * 256)
    return rounded(autocorrelation.partial_autocorrelations(m, ["source"], "mean", _LAGS, width=HOUR * 1_000_000 * 256))


def _matrix(spark, sf, columns: int = 0) -> np.ndarray:
    """All rows of the embeddings (or of their first columns) as a matrix on the driver, in order of vec_id."""
    v = F.slice("embedding", 1, columns) if columns else F.col("embedding")
    return np.stack(read(spark, sf, "embeddings").orderBy("vec_id").select(v.alias("v")).toPandas().v.to_numpy()).astype(float)


def _scatter(spark, sf) -> tuple[int, np.ndarray]:
    """(rows, sums of products of deviations from the means) of the embeddings: tasks' sums about the means are added up by place in Spark."""
    v = read(spark, sf, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = v.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.count("*").alias("n")).orderBy("at").collect()
    m = np.array([r.m for r in means])

    def run(batches):
        import pandas as pd

        total = np.zeros((len(m), len(m)))
        for b in batches:
            if len(b):
                d = np.stack(b.v.to_numpy()) - m
                total += d.T @ d
        yield pd.DataFrame({"scatter": [total.ravel()]})

    parts = v.mapInPandas(run, "scatter array<double>").select(F.posexplode("scatter").alias("at", "x"))
    sums = parts.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    return means[0].n, np.reshape([r.x for r in sums], (len(m), -1))


_GAPPED = "SELECT vec_id, list_transform(embedding, lambda x, j: CASE WHEN vec_id % 7 = 0 AND j = 4 OR vec_id % 11 = 0 AND j = 6 THEN NULL ELSE x::DOUBLE END) AS v FROM embeddings"


@query(
    f"""WITH g AS ({_GAPPED}), w AS (SELECT vec_id AS q, j, v FROM g, range(1, 65) t(j) WHERE v[j] IS NULL),
    d AS (SELECT q, j, vec_id, g.v[j] AS x, row_number() OVER (PARTITION BY q, j ORDER BY list_sum(list_transform(list_zip(w.v, g.v), lambda z: pow(z[1] - z[2], 2))) / len(list_filter(list_zip(w.v, g.v), lambda z: z[1] - z[2] IS NOT NULL)), vec_id) AS k FROM w JOIN g ON g.v[j] IS NOT NULL)
    SELECT q AS id, (j - 1)::INT AS "column", round(avg(x), 9) AS value FROM d WHERE k <= 5 GROUP BY q, j"""
)
def knn_impute(spark, sf):
    """Component 3 of every 7th vector and component 5 of every 11th one count as missing."""
    gap = lambda j: ((F.col("vec_id") % 7 == 0) & (j == 3)) | ((F.col("vec_id") % 11 == 0) & (j == 5))
    x = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x, j: F.when(~gap(j), x.cast("double"))).alias("v"))
    return rounded(neighbours.imputed(x, "vec_id", "v"), 9)


def _uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '1', {', '.join(parts)})), 1, 13))::BIGINT / pow(2, 52))"


@query(
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) AS n, count(*) OVER () AS total FROM embeddings),
    s AS (SELECT i::INT AS "row", vec_id AS base, v, 1 + floor({_uniform("i", "'other'")} * 5) AS pick FROM range(100) t(i) JOIN e ON n = 1 + floor({_uniform("i", "'base'")} * total)),
    d AS (SELECT "row", base, s.v, pick, e.vec_id AS other, e.v AS w, row_number() OVER (PARTITION BY "row" ORDER BY list_sum(list_transform(list_zip(s.v, e.v), lambda z: pow(z[1] - z[2], 2))), e.vec_id) AS k FROM s JOIN e ON e.vec_id <> base)
    SELECT "row", base, other, list_transform(list_zip(v, w), lambda z, j: round(z[1] + (z[2] - z[1]) * {_uniform('"row"', "j - 1")}, 6)) AS value FROM d WHERE k = pick"""
    .replace("SELECT \"row\", base, other, list_transform(", "SELECT \"row\", base, other, round(list_sum(list_transform(").replace(", 6)) AS value FROM d WHERE", ", 6))), 4) AS value FROM d WHERE")
)
def synthetic_samples(spark, sf):
    s = neighbours.synthetic(read(spark, sf, "embeddings"), "vec_id", "embedding", 100)
    return s.select("row", "base", "other", F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + F.round(x, 6)), 4).alias("value"))


@query()
def joint_information(spark, sf):
    x = _matrix(spark, sf, 7)
    # The tasks hold shares of the rows against those near them.
    spread = lambda f, parts: spark.sparkContext.parallelize(parts, min(len(parts), 200)).map(f).collect()
    scores_ = kernels.joint_scores(x[:, :6], x[:, 6] + x[:, 0], over=spread)
    keep = kernels.selected(np.maximum(scores_, 1e-12), 0.9)
    return spark.createDataFrame([(i, float(s), i in keep) for i, s in enumerate(scores_)], "feature int, score double, selected boolean")


def _spread(spark):
    """over(f, parts, shared): f(part, *shared) of each part by tasks, a few for each that can run at once; shared goes to all of them, its first item once as long as it stays the same."""
    kept = []

    def over(f, parts, shared):
        if not parts:
            return []
        if not kept or kept[0] is not shared[0]:
            kept[:] = shared[0], spark.sparkContext.broadcast(shared[0])
        first, held = kept[1], spark.sparkContext.broadcast(shared[1:])

        def run(own):
            return [f(p, first.value, *held.value) for p in own]

        found = spark.sparkContext.parallelize(parts, min(len(parts), 4 * spark.sparkContext.defaultParallelism)).mapPartitions(run).collect()
        held.unpersist()
        return found

    return over


@query()
def hierarchical_clusters(spark, sf):
    x = _matrix(spark, sf)
    # Trees of many rows grow by rounds whose searches the tasks share; where merges can bring clusters nearer to others a task makes the tree, as of few rows.
    shared = [m for m in clustering.LINKAGES if m in clustering.IN_ROUNDS and len(x) > clustering.MATRIX_ROWS]
    alone = [m for m in clustering.LINKAGES if m not in shared]
    held, over = spark.sparkContext.broadcast(x), _spread(spark)
    first = clustering.nearest_rows(x, over) if shared else None
    near = spark.sparkContext.broadcast(clustering.nearest_of(first) if shared else None)
    trees = lambda f, names: spark.sparkContext.parallelize(names, len(names)).map(f).collect()
    # The trees grow beside each other: one's tasks run while another's pairs are merged. Ward sends centres, the others the rows.
    grow = lambda m: clustering.cut(clustering.linkage_in_rounds(x, m, _spread(spark) if m == "ward" else over, first=first), 5)
    with ThreadPoolExecutor(1 + len(shared)) as beside:
        rest = beside.submit(trees, lambda m: (m, clustering.cut(clustering.linkage(held.value, m, near=near.value), 5)), alone)
        labels = dict(zip(shared, beside.map(grow, shared), strict=True)) | dict(rest.result())
    found = spark.createDataFrame(pd.DataFrame({"row": np.arange(len(x), dtype=np.int32), **{m: labels[m].astype(np.int32) for m in clustering.LINKAGES}}), ", ".join(f"{c} int" for c in ("row", *clustering.LINKAGES)))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("cluster")) for m in clustering.LINKAGES]))
    return found.select("row", pairs.alias("p")).select("p.method", "row", "p.cluster")


@query()
def validity_scores(spark, sf):
    x = _matrix(spark, sf)
    labels = clustering.lloyd(x, 10)
    scored = {n: clustering.silhouette(x, labels, _spread(spark)) if n == "s" else f(x, labels) for n, f in clustering.SCORES.items()}
    return spark.createDataFrame([(n, float(s)) for n, s in scored.items()], "name string, score double")


@query()
def quantile_regression(spark, sf):
    """Component 0 of each vector by all others."""
    from .sources.shared import checkpointed

    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = checkpointed(read(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.get("v", F.lit(0)).alias("y"), F.slice("v", F.lit(2), F.size("v") - 1).alias("x")), "regression")
    return quantile_fit.predicted(rows, quantile_fit.fit(rows.select("x", "y"), [0.1, 0.5, 0.9]), ["q10", "q50", "q90"], ["vec_id"])


@query()
def multiple_correlation(spark, sf):
    _, s = _scatter(spark, sf)
    return spark.createDataFrame([(j, kernels.scatter_correlation(s, j)) for j in range(8)], "feature int, r double")


@query()
def knee_of_shares(spark, sf):
    share = kernels.scatter_shares(*_scatter(spark, sf))
    return spark.createDataFrame([(int(a), float(b)) for a, b in [kernels.knee(share)]], "x int, y double")


@query()
def extractor_score(spark, sf):
    return fitted(spark, sf)[0].extractor_score(spark)


@query()
def plot_frame(spark, sf):
    t, s = fitted(spark, sf)
    return t.plot_frame(t.transform(s), P)


_NORMAL = "sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v})"
_WAVE = "(1 + pow(sin(step * {n} / {m}::DOUBLE), 1) + pow(sin(step * {n} / {m}::DOUBLE), 2))"


@query(
    f"""SELECT id AS source, (id % 2)::VARCHAR AS value_type, floor(id % 4 / 2)::BIGINT::VARCHAR AS category, TIMESTAMP '2021-01-01' + INTERVAL 1 HOUR * step AS ts,
    round({_WAVE.format(n=168, m=167)} * {_NORMAL.format(u=_uniform("id", "step", "'r'").replace("'1'", "'0'"), v=_uniform("id", "step", "'a'").replace("'1'", "'0'"))}, 6) AS value
    FROM (SELECT DISTINCT user_id AS id FROM events), range(168) t(step)""".replace("SELECT id AS source", "SELECT id::VARCHAR AS source")
)
def generated_series(spark, sf):
    """A week of a generated series for each user of the events."""
    from .sources.files import generated

    users = read(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    return rounded(generated(spark, users, "2021-01-01", 168, HOUR))
