"""Work along a series split by ranges of time against the whole series in one piece, and streams with state as a table."""

import math
from dataclasses import astuple
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import timegrid as tg
from tidegrid.operators import autocorrelation, gapfill, kernels, neighbours, ranges, samples, segments
from tidegrid.operators.moments import bucket_moments
from tidegrid.schema import ID
from tidegrid.streaming import live
from tidegrid.streaming import segments as stream
from tidegrid.streaming.increments import PowerSums

SERIES = "source string, value_type string, category string, ts timestamp_ntz, value double"
TREE = tg.ResolutionTree(*[tg.Resolution.of(seconds=n) for n in (30, 60, 90, 120, 150)])
WHOLE = 10**15


def at(n: float) -> datetime:
    return datetime(1970, 1, 1) + timedelta(seconds=n)


@pytest.fixture(scope="module")
def odd(spark):
    """Two series of uneven samples with a long gap, a burst and repeated times, one of them with null ids, one sample alone."""
    rng = np.random.default_rng(7)
    rows = []
    for s in ("a", None):
        times = np.concatenate((np.cumsum(rng.integers(1, 50, 150)), 20_000 + np.cumsum(rng.random(200) / 10), 20_100 + np.cumsum(rng.integers(1, 90, 60))))
        rows += [(s, "V", None if s is None else "c", at(float(t)), float(v)) for t, v in zip(times, rng.normal(5, 3, len(times)), strict=True)]
        rows += [(s, "V", None if s is None else "c", rows[-1][3], 1.0), (s, "V", None if s is None else "c", None, 2.0), (s, "V", None if s is None else "c", at(25_000), None)]
    return spark.createDataFrame([*rows, ("alone", "V", "c", at(50), 1.0)], SERIES).repartition(4)


def sorted_rows(df, digits=6):
    return sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width", [7_000_000, 100_000_000])
def test_segments_do_not_depend_on_the_ranges(odd, width):
    """Ranges within a bucket (of a burst, too), of a few buckets, of a whole day."""
    for function in ("linear", "step"):
        want = sorted_rows(segments.segments(odd, TREE, function, width=WHOLE), 4)
        assert sorted_rows(segments.segments(odd, TREE, function, width=width), 4) == want and len(want) > 1_000
    assert sorted_rows(segments.pairs(odd, width=width)) == sorted_rows(segments.pairs(odd, width=WHOLE))


def test_merging_in_order_equals_a_fold(spark):
    """The running sums against merging part by part, at a bucket split by ranges."""
    rng = np.random.default_rng(1)
    parts, t = [], 0
    for _ in range(40):
        length = float(rng.integers(1, 9))
        parts.append((t, length, 1, *map(float, rng.normal(0, 2, 4))))
        t += int(length)
    w, mean, m = 0.0, 0.0, [0.0, 0.0, 0.0]
    for _, length, _, mu, *own in parts:
        total = w + length
        new = (w * mean + length * mu) / total
        m = [(w * (a + (mean - new) ** d) + length * (b + (mu - new) ** d)) / total for d, a, b in zip((2, 3, 4), m, own, strict=True)]
        w, mean = total, new
    frame = spark.createDataFrame([("k", at(s), *rest) for s, *rest in parts], "k string, i0 timestamp_ntz, length double, count long, mean double, m2 double, m3 double, m4 double").withColumn("i1", F.col("i0"))
    for width in (None, 5_000_000, 50_000_000):
        r = segments._merged(frame, ["k"], "i0", "i1", width).first()
        assert [r.length, r["count"], r.mean, r.m2, r.m3, r.m4] == pytest.approx([w, 40, mean, *m])


def test_arrival_order_by_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [("s", "V", "c", at(int(t)), float(k), k) for k, t in enumerate(np.arange(600) + rng.integers(-40, 40, 600))]
    frame = spark.createDataFrame(rows, SERIES + ", k int").repartition(4)
    kept, latest = [], -math.inf
    for r in rows:
        if (s := (r[3] - at(0)).total_seconds()) > latest:
            latest = s
            kept.append(r)
    got = segments.pairs(frame, arrival="k", width=9_000_000).orderBy("tb").collect()
    assert [(r.ta, r.va, r.tb, r.vb) for r in got] == [(a[3], a[4], b[3], b[4]) for a, b in zip(kept, kept[1:], strict=False)]


@pytest.mark.parametrize("width", [1, 900_000_000])
def test_fill_and_samples_do_not_depend_on_the_ranges(odd, width):
    b = bucket_moments(odd, 60).select("source", "ts", "mean", F.when(F.col("mean") > 5, F.col("mean")).alias("high"))
    full = gapfill.regular(b, ["source"], 60).where("source is not null")
    want = sorted_rows(gapfill.linear_fill(full, ["source"], ["mean", "high"], WHOLE))
    assert sorted_rows(gapfill.linear_fill(full, ["source"], ["mean", "high"], width)) == want
    assert any(r[3] is None for r in want) and len(want) > 300
    for stretch in (1, 16):
        got = sorted_rows(samples.sliding_samples(b, ["source"], ["mean"], 9, 4, width, stretch))
        rows = sorted((tuple(r) for r in b.select("source", "ts", "mean").collect()), key=lambda r: (str(r[0]), r[1]))
        expected = []
        for s in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == s]
            expected += [(s, own[i][1], [r[2] for r in own[i - 9 : i]], [r[2] for r in own[i : i + 4]]) for i in range(9, len(own) - 3)]
        assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in sorted(expected, key=repr)]
        assert all(r[2] == pytest.approx(e[2]) and r[3] == pytest.approx(e[3]) for r, e in zip(got, sorted(expected, key=repr), strict=True))


def test_a_long_grid_is_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(gapfill, "STRETCH", 7)
    spans = spark.createDataFrame([("a", at(-130), at(4_000)), ("b", at(30), at(30))], "k string, start timestamp_ntz, end timestamp_ntz")
    got = sorted((r.k, (r.ts - at(0)).total_seconds()) for r in gapfill.grid(spans, 60).collect())
    assert got == [("a", float(t)) for t in range(-180, 4_000, 60)] + [("b", 0.0)]


def test_width_follows_the_densest_series(spark):
    rows = [("a", "V", "c", at(k), 1.0) for k in range(2_000)] + [("b", "V", "c", at(k * 1_000), 1.0) for k in range(100)]
    frame = spark.createDataFrame(rows, SERIES)
    assert ranges.width(frame, ID, rows=100) == pytest.approx(100_000_000, rel=0.01)
    assert ranges.width(frame, ID, rows=5_000) == pytest.approx(5_000_000_000, rel=0.01)
    assert ranges.width(frame.where("source = 'b'"), ID) == 99_000_000_001
    assert ranges.width(frame.limit(0), ID) == 1
    parts = ranges.parted(frame, ID, 100_000_000)
    assert parts.groupBy(ranges.PART).count().agg(F.max("count")).first()[0] <= 101


def test_one_series_takes_many_tasks(spark):
    frame = spark.createDataFrame([("a", "V", "c", at(k), float(k)) for k in range(5_000)], SERIES)
    small = "spark.sql.adaptive.coalescePartitions.enabled"  # tiny partitions would be put together again
    spark.conf.set(small, "false")
    own = ranges.parted(frame, ID, 50_000_000).withColumn("_task", F.spark_partition_id())
    tasks = own.select("_task").distinct().count()
    spark.conf.unset(small)
    assert tasks == 4


@pytest.mark.parametrize("stretch", [64])
def test_partial_autocorrelations_equal_the_kernel(spark, stretch):
    rng = np.random.default_rng(3)
    long_ = np.convolve(rng.normal(size=700), [1, 0.7, 0.3])[:700] + 10
    short, flat = rng.normal(size=9), np.full(40, 2.0)
    rows = [(s, at(60 * k), float(v)) for s, x in (("long", long_), ("short", short), ("flat", flat)) for k, v in enumerate(x)]
    frame = spark.createDataFrame([*rows, ("long", at(10**6), None)], "k string, ts timestamp_ntz, x double").repartition(3)
    got = {}
    for r in autocorrelation.partial_autocorrelations(frame, ["k"], "x", 24, width=3_000_000_000, stretch=stretch).orderBy("lag").collect():
        got.setdefault(r.k, []).append(r)
    for k, x in (("long", long_), ("short", short), ("flat", flat)):
        lag, (scores,), ci = kernels.significant_lag([x], 24)
        assert [r.score for r in got[k]] == pytest.approx(scores.tolist(), abs=1e-8)
        assert [r.selected for r in got[k]] == [i <= lag for i in range(25)] and got[k][0].ci == pytest.approx(ci)


def brute_nearest(x, q, column, k):
    d = []
    for i, y in enumerate(x):
        both = ~np.isnan(x[q]) & ~np.isnan(y)
        if i != q and both.any() and (column < 0 or not np.isnan(y[column])):
            d.append((((x[q] - y)[both] ** 2).sum() * len(y) / both.sum(), i))
    return sorted(d)[:k]


@pytest.mark.parametrize("pivots", [1, 25])
def test_nearest_rows_are_exact(spark, pivots, monkeypatch):
    """Clustered rows with ties and gaps in two columns, in blocks of a few rows, against all pairs."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 6))[rng.integers(12, size=240)] * 20 + rng.integers(-2, 3, (240, 6))
    x[::9, 2], x[::14, 4], x[5] = np.nan, np.nan, x[3]
    frame = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(4)
    rows = neighbours.as_rows(frame, "id", "v")
    wanted = [(q, c) for q in range(0, 240, 7) for c in (-1, 2, 4)]
    asked = spark.createDataFrame([(q, c, [None if np.isnan(v) else float(v) for v in x[q]]) for q, c in wanted], "q long, column int, v array<double>")
    got = {}
    for r in neighbours.nearest(asked, rows, 5, pivots).orderBy("rank").collect():
        got.setdefault((r.q, r.column), []).append((r.d2, r.id))
    for q, c in wanted:
        want = brute_nearest(x, q, c, 5)
        assert [i for _, i in got[q, c]] == [i for _, i in want] and [d for d, _ in got[q, c]] == pytest.approx([d for d, _ in want])
    values = {(r.id, r.column): r.value for r in neighbours.imputed(frame, "id", "v", 5, pivots).collect()}
    assert values.keys() == {(int(i), int(j)) for i, j in np.argwhere(np.isnan(x))}
    for (i, j), v in values.items():
        assert v == pytest.approx(np.mean([x[n, j] for _, n in brute_nearest(x, i, j, 5)]))


def test_few_rows_have_few_neighbours(spark):
    frame = spark.createDataFrame([(1, [1.0, None]), (2, [None, 2.0]), (3, [5.0, None]), (None, [0.0, 0.0]), (4, None)], "id long, v array<double>")
    got = {(r.id, r.column): r.value for r in neighbours.imputed(frame, "id", "v").collect()}
    assert got == {(1, 1): 2.0, (2, 0): 3.0, (3, 1): 2.0}  # no row that has the column shares another one: the mean
    assert neighbours.imputed(frame.limit(0), "id", "v").collect() == [] and neighbours.synthetic(frame.where("id = 1"), "id", "v", 3).collect() == []


def test_synthetic_rows_lie_between_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3))
    frame = spark.createDataFrame([(i * 3, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    rows = neighbours.synthetic(frame, "id", "v", 30, k=4, seed=9).orderBy("row").collect()
    assert [r.row for r in rows] == list(range(30)) and len({r.base for r in rows}) > 15
    for r in rows:
        assert r.other // 3 in [i for _, i in brute_nearest(x, r.base // 3, -1, 4)]
        t = (np.array(r.value) - x[r.base // 3]) / (x[r.other // 3] - x[r.base // 3])
        assert ((0 <= t) & (t <= 1)).all() and t.std() > 0
    again = neighbours.synthetic(frame.repartition(1), "id", "v", 30, k=4, seed=9).orderBy("row").collect()
    assert rows == again


def arriving(spark, rows, folder):
    spark.createDataFrame(rows, SERIES).coalesce(1).write.mode("append").parquet(folder)


def test_live_segments_go_on_and_show_what_is_open(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rng = np.random.default_rng(3)
    rows = [(s, "V", "c", at(int(t)), float(rng.normal())) for s in ("a", "b") for t in np.cumsum(rng.integers(1, 40, 120))]
    seen = []
    for part in (rows[0::3], rows[1::3], rows[2::3]):  # each batch also has samples that come too late
        arriving(spark, part, source)
        stream = live.live_segments(spark.readStream.schema(SERIES).parquet(source), TREE)
        live.written_live(stream, out, check).awaitTermination(120)
        for s in ("a", "b"):
            last = max((r[3] for r in seen if r[0] == s), default=at(0))
            seen += [r for r in part if r[0] == s and r[3] > last]
        table = live.segment_table(spark, out, check)
        want = segments.segments(spark.createDataFrame(seen, SERIES), TREE)
        assert sorted_rows(table.select(want.columns), 5) == sorted_rows(want, 5)
    one = live.segment_table(spark, out, check, 60)
    assert sorted_rows(one.select(want.columns), 5) == sorted_rows(want.where("resolution_s = 60"), 5)
    assert live.series_of(live.written_segments(spark, out, 60), 60).count() == want.where("resolution_s = 60 and complete").count()


def test_idle_series_are_closed_by_a_timer(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    batches = [[("a", 10, 1.0), ("a", 40, 3.0), ("b", 5, 2.0)], [("b", 2_000, 4.0)], [("b", 2_010, 4.0), ("a", 2_011, 7.0)], [("a", 2_020, 8.0)]]
    for rows in batches:
        arriving(spark, [(s, "V", "c", at(t), v) for s, t, v in rows], source)
        stream = live.live_segments(spark.readStream.schema(SERIES).parquet(source), TREE, idle_s=100)
        live.written_live(stream, out, check).awaitTermination(120)
    got = {(r.source, r.resolution_s, (r.seg_start - at(0)).total_seconds()): ((r.seg_end - at(0)).total_seconds(), r.complete) for r in spark.read.parquet(out).collect()}
    # Series a fell silent after 40: its open half bucket came out as it was, and nothing joins 40 with 2011.
    assert got["a", 30, 10.0] == (30.0, True) and got["a", 30, 30.0] == (40.0, False) and got["a", 60, 10.0] == (30.0, False)
    assert not [k for k in got if k[0] == "a" and 40 < k[2] < 2_011]
    open_ = {(r.source, r.resolution_s): (r.seg_start, r.seg_end) for r in live.open_segments(spark, check).collect()}
    assert open_["a", 30] == (at(2_011), at(2_020))


def bare_segments(found):
    return [(r, *[c[f][i].item() for f in stream.FIELDS]) for r, c in found for i in range(len(c["end"]))]


@pytest.mark.parametrize("step", [False, True])
@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_samples_in_blocks_equal_the_pass_over_each(monkeypatch, step, block):
    """Late and repeated samples, times before 1970, a gap, a huge value, a stop at any place; pieces in blocks of any size."""
    monkeypatch.setattr(stream, "BLOCK", block)
    rng = np.random.default_rng(block)
    t = np.cumsum(rng.integers(-20, 60, 250)) * 1_000_000 + rng.integers(0, 5, 250) * 250_000 - 3_000_000_000
    t[120:] += 9_000_000_000
    v = rng.normal(5, 3, 250)
    v[40] = 1e15
    each, many = stream.SegmentState(TREE, step), stream.SegmentState(TREE, step)
    want = [(r, *astuple(x)) for a, b in zip(t.tolist(), v.tolist(), strict=True) for r, x in each.process(a, b)]
    cuts = [slice(0, 1), slice(1, 90), slice(90, 91), slice(91, 250)]
    got = [x for c in cuts for x in bare_segments(many.extend(t[c], v[c]))]
    got += [(r, *astuple(x)) for r, x in many.open.items()]
    want += [(r, *astuple(x)) for r, x in each.open.items()]
    assert len(got) == len(want) > 500 and many.last == each.last
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and a[4] == b[4]
        assert a == pytest.approx(b, rel=1e-7, abs=1e-7)


@pytest.mark.parametrize("far", [math.inf, 1e75])
def test_far_values_change_their_own_segments_only(far):
    t, v = np.arange(1, 400) * 10_000_000, np.arange(1, 400) % 7 + 1.0
    v[100] = v[150] = far
    each, many = stream.SegmentState(TREE), stream.SegmentState(TREE)
    want = sorted((r, *astuple(x)) for a, b in zip(t.tolist(), v.tolist(), strict=True) for r, x in each.process(a, b))
    got = sorted(bare_segments(many.extend(t, v)))
    assert len(got) == len(want) and sum(math.isfinite(x[5]) and x[5] < 8 for x in got) > 200
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-7, abs=1e-7, nan_ok=True)


class Held:
    """What a processor's state needs, without a stream."""

    def __init__(self):
        self.held = {}

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = lambda self, *_: Held()  # noqa: E731, N815
    exists = lambda self: "value" in self.held
    get = lambda self: self.held["value"]
    update = lambda self, value: self.held.update(value=value)
    iterator = lambda self: iter(self.held.items())
    removeKey = lambda self, k: self.held.pop(k)  # noqa: E731, N815
    updateValue = lambda self, k, v: self.held.update({k: v})  # noqa: E731, N815


@pytest.mark.parametrize("arrival", [False, True])
def test_live_segments_have_no_step_for_each_sample(monkeypatch, arrival):
    """A batch of a series, in several frames out of order, goes through whole columns; the samples are taken as one by one."""
    rng = np.random.default_rng(4)
    t, v = rng.permutation(np.arange(2_000)) * 7_000_000, rng.normal(5, 3, 2_000)
    place = t + rng.integers(-9, 9, 2_000) * 1_000_000
    state, want, cuts = stream.SegmentState(TREE), [], [slice(0, 900), slice(900, 2_000)]
    for c in cuts:
        order = np.lexsort((v[c], place[c] if arrival else t[c]))
        want += [(r, *astuple(x)) for k in order for r, x in state.process(t[c][k].item(), v[c][k].item())]

    def refuse(*_):
        raise AssertionError("a step for one sample")

    monkeypatch.setattr(stream.SegmentState, "process", refuse)
    processor, got = live.SegmentProcessor(TREE, False, None, arrival), []
    processor.init(Held())
    for c in cuts:
        rows = pd.DataFrame({"source": "a", "value_type": None, "category": "c", "us": t[c], "value": v[c], "place": place[c]})
        for out in processor.handleInputRows(("a", None, "c"), iter([rows[:300], rows[300:]]), None):
            assert out.columns.tolist() == [c.split()[0] for c in live.OUT.split(", ")] and set(out.value_type) == {None}
            got += [tuple(x) for x in out[out.columns[3:]].itertuples(index=False)]
    assert len(got) == len(want) > 400
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a == pytest.approx(b, rel=1e-7, abs=1e-7)


def test_power_sums_count_a_batch_once(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(s, "V", "c", at(int(t)), float(rng.normal(3, 2))) for s in ("a", None) for t in rng.integers(0, 500, 90)]
    sums = PowerSums(spark, str(tmp_path / "sums"), 60)
    assert sums.moments().count() == 0
    for k in range(3):
        sums.append(spark.createDataFrame(rows[k::3], SERIES), k)
        sums.append(spark.createDataFrame(rows[k::3], SERIES), k)  # an attempt that is run again
        if k == 1:
            sums.compact()
            sums.append(spark.createDataFrame(rows[0::3], SERIES), 0)  # and one from before a compaction
    want = sorted_rows(bucket_moments(spark.createDataFrame(rows, SERIES), 60))
    assert sorted_rows(sums.moments()) == want
    sums.compact()
    assert sorted_rows(sums.moments()) == want and sums._parts() == [f"{tmp_path}/sums/upto=2"]
    spread = {(r.source, r.ts): (r.m2, r.m3, r.m4) for r in sums.moments(spread=True).collect()}
    by = {}
    for s, _, _, t, v in rows:
        by.setdefault((s, t.replace(second=0)), []).append(v)
    for k, v in by.items():
        assert spread[k] == pytest.approx([np.mean((np.array(v) - np.mean(v)) ** d) for d in (2, 3, 4)], abs=1e-8)


@pytest.mark.parametrize("bins,few", [(4, 3), (1_024, 10_000)])
def test_quantiles_by_refinement_are_exact(spark, bins, few):
    """Repeated, skewed, huge and few values; nulls and NaNs; a null key; a group of one."""
    from tidegrid.operators.order_statistics import quantiles

    rng = np.random.default_rng(8)
    groups = {"even": rng.normal(size=301), None: np.exp(rng.normal(0, 9, 200)), "hot": np.array([2.5] * 150 + [7.0] * 3 + [-1.0]), "one": np.array([4.0]), "wide": np.array([-1.7e308, 0.0, 1e-300, 1.0, 1.7e308]), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("even", None), ("even", float("nan")), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, x double").repartition(3)
    p = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.k: r[1:] for r in quantiles(frame, ["k"], "x", p, bins, few).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        x = np.sort(x)
        at = [q * (len(x) - 1) for q in p]
        assert got[k] == pytest.approx([x[int(a)] + (x[math.ceil(a)] - x[int(a)]) * (a - int(a)) for a in at])
    assert quantiles(frame.limit(0), ["k"], "x", p).collect() == []


def test_quantile_regression_equals_the_local_one(spark):
    from tidegrid.operators import quantile_fit

    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.gamma(2, 1, 400)
    frame = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double").repartition(3).cache()
    p = [0.1, 0.5, 0.9]
    w = quantile_fit.fit(frame, p, steps=25)
    local = [kernels.QuantileRegression(q, 25).fit(x, y).weights for q in p]
    loss = lambda q, r: np.where(r >= 0, q * r, (q - 1) * r).sum()
    for q, own, other in zip(p, w, local, strict=True):
        a = np.column_stack((np.ones(400), x))
        assert loss(q, y - a @ own) == pytest.approx(loss(q, y - a @ other), rel=1e-6)
    shown = quantile_fit.predicted(frame, w, ["a", "b", "c"], ["y"]).toPandas().sort_values("y")
    assert shown.b.to_numpy() == pytest.approx((w[1, 0] + x @ w[1, 1:])[np.argsort(y)])


def test_scores_by_columns_equal_the_kernels(spark):
    """Davies and Bouldin's score, and the knee of scores with ties, a falling line, few and equal scores."""
    from tidegrid.operators import clustering

    rng = np.random.default_rng(12)
    labels = rng.integers(4, size=120)
    x = rng.normal(size=(120, 5)) + labels[:, None]
    frame = spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(labels, x, strict=True)] + [(None, [0.0] * 5)], "c int, v array<double>")
    assert clustering.davies_bouldin_frame(frame, "c", "v").first().score == pytest.approx(clustering.davies_bouldin(x, labels))
    curves = {"steep": np.exp(-np.arange(12) / 2), "line": np.arange(9.0), "few": np.array([2.0, 1.0]), "flat": np.ones(6), "random": rng.integers(0, 9, 40).astype(float)}
    rows = [(k, f"f{i:02d}", float(v)) for k, c in curves.items() for i, v in enumerate(c)]
    got = samples.top_by_knee(spark.createDataFrame(rows, "k string, feature string, score double"), ["k"]).where("selected").collect()
    for k, c in curves.items():
        assert {r.feature for r in got if r.k == k} == {f"f{i:02d}" for i in kernels.selected(c.tolist())}


def test_nearest_rows_are_sent_once_a_group(spark, monkeypatch):
    """The same neighbours when tasks hold few wanted rows and get a share of the others; a cell goes to a group once, however many blocks visit it."""
    from tidegrid.operators import neighbours

    x = np.random.default_rng(2).normal(size=(600, 6))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    wanted = rows.select(F.col("id").alias("q"), F.lit(-1).alias("column"), "v")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :3].tolist()
    sent = []
    real = neighbours._nearest_in

    def seen(visits, *rest):
        sent.append((visits.count(), visits.select("group", "cell").distinct().count()))
        return real(visits, *rest)

    monkeypatch.setattr(neighbours, "_nearest_in", seen)
    for held, share in ((16_384, 65_536), (100, 150)):
        monkeypatch.setattr(neighbours, "HELD", held)
        monkeypatch.setattr(neighbours, "SENT", share)
        got = {}
        for r in neighbours.nearest(wanted, rows, 3, 12).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append(r.id)
        assert [got[i] for i in range(600)] == want
    assert sent[1][1] <= 12 < sent[1][0]
