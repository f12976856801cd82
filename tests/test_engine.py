"""The time series engine against the goldens of its definition and against brute force."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import calendar as cal
from tidegrid.functions import quantiles as qt
from tidegrid.functions import timegrid as tg
from tidegrid.operators import clustering, gapfill, kernels, moments, regression, samples, segments
from tidegrid.plans.learner import CumulantLearner
from tidegrid.plans.transform import CumulantTransform
from tidegrid.schema import ID
from tidegrid.sources import files
from tidegrid.streaming.segments import SegmentState, append_segments, stream_segments

SERIES = "source string, value_type string, category string, ts timestamp_ntz, value double"


def u(n: float) -> datetime:
    return datetime(1970, 1, 1) + timedelta(seconds=n)


def seconds_of(t: datetime) -> float:
    return (t - datetime(1970, 1, 1)).total_seconds()


def as_series(spark, rows, source="s"):
    return spark.createDataFrame([(source, "V", "c", u(t), v) for t, v in rows], SERIES)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def lit(t):
    return F.lit(u(t)).cast("timestamp_ntz")


@pytest.mark.parametrize("a,b,want", [((1, 1), (1, 1), (1, 1)), ((1, 3), (2, 4), (2, 3)), ((1, 6), (2, 4), (2, 4)), ((1, 2), (2, 3), None), ((1, 2), (4, 5), None)])
def test_overlap(spark, a, b, want):
    for x in (a, a[::-1]):
        for y in (b, b[::-1]):
            i = tg.TimeInterval(*map(u, x)).overlap(tg.TimeInterval(*map(u, y)))
            assert (i and (seconds_of(i.start), seconds_of(i.end))) == want
            r = one(spark, *tg.overlap(*map(lit, (*x, *y))))
            assert (r.c0 and (seconds_of(r.c0), seconds_of(r.c1))) == want


def test_contains_and_buckets(spark):
    i = tg.TimeInterval(u(1), u(3))
    assert [i.contains(u(k)) for k in range(4)] == [False, True, True, False]
    r = tg.Resolution.of(hours=1)
    assert [seconds_of(s.start) for s in r.steps(tg.TimeInterval(u(2000), u(4000)))] == [0, 3600]
    assert one(spark, tg.bucket(lit(2000), 1800), tg.bucket(lit(4000), 3600), tg.bucket(lit(-5), 10))[:] == (u(1800), u(3600), u(-10))
    assert one(spark, tg.steps(lit(2000), lit(4000), 3600)).c0 == [u(0), u(3600)]
    assert one(spark, tg.steps(lit(5), lit(5), 10)).c0 == []


def test_resolution_tree():
    s = lambda n: tg.Resolution.of(seconds=n)
    t = tg.ResolutionTree(*map(s, (5, 10, 15, 20)))
    assert t.root == s(5) and t.children(s(5)) == [s(10), s(15)] and t.children(s(10)) == [s(20)]
    t = tg.ResolutionTree(*map(s, (10, 15, 20)))
    assert t.root == s(5) and t.children(s(5)) == [s(10), s(15)] and t.children(s(10)) == [s(20)]


@pytest.mark.parametrize("k3,values", [(5, (87.65, 98.82, 113.86)), (-5, (86.14, 101.18, 112.35))])
def test_cornish_fisher(spark, k3, values):
    got = one(spark, *[qt.cornish_fisher(qt.ppf(p), 50, F.lit(100.0), F.lit(10.0), F.lit(float(k3)), F.lit(1.0)) for p in (0.1, 0.5, 0.9)])
    assert [round(x, 2) for x in got] == list(values)


def test_losses(spark):
    x = lambda v: F.lit(float(v))
    assert [round(v, 6) for v in one(spark, *[qt.pinball(p, x(a), x(100)) for p, a in ((0.1, 95), (0.1, 105), (0.9, 95), (0.9, 105))])] == [4.5, 0.5, 0.5, 4.5]
    assert [round(v, 6) for v in one(spark, *[qt.winkler(0.95, x(a), x(lo), x(hi)) for a, lo, hi in ((95, 95, 105), (95, 100, 105), (105, 95, 100))])] == [10, 205, 205]


def test_encoders_and_calendar(spark):
    ts = [datetime(2000, 1, 1), datetime(2000, 4, 3, 6), datetime(2021, 1, 3)]
    frame = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    got = cal.encode(frame, cal.MonthOfYear, cal.DayOfWeek, cal.TimeOfDay, cal.WeekOfYear).toPandas()
    assert got.MonthOfYearX.round(9).tolist() == [0.5, 1.0, 0.5] and got.TimeOfDayX.round(9).tolist() == [0.5, 1.0, 0.5]
    assert got.DayOfWeekX[1] == pytest.approx((math.sin(0) + 1) / 2)
    days = [datetime(2000, m, d) for m, d in ((1, 1), (1, 2), (5, 1), (1, 7), (1, 8), (1, 10), (4, 30))]
    marked = cal.with_calendar(spark.createDataFrame([(t,) for t in days], "ts timestamp_ntz"), cal.calendar(spark, "RS", 2000, 2000)).orderBy("ts").collect()
    assert {(r.ts.month, r.ts.day): (r.Holiday, r.DayType) for r in marked} == {(1, 1): (1, 2), (1, 2): (1, 2), (5, 1): (1, 2), (1, 7): (1, 2), (1, 8): (0, 1), (1, 10): (0, 0), (4, 30): (1, 2)}
    assert [cal.easter(y).isoformat() for y in (2000, 2019, 2024)] == ["2000-04-23", "2019-04-21", "2024-03-31"]
    assert cal.easter(2019, True).isoformat() == "2019-04-28"


@pytest.mark.parametrize("kind", ["linear", "step"])
def test_integrals_equal_sums(spark, kind):
    for ta, va, tb, vb, i0, i1 in ((0, 1.0, 10, 5.0, 2, 7), (0, 1.0, 10, 5.0, -4, 14), (0, 2.0, 0, 2.0, 0, 5), (3, -1.0, 8, 4.0, 8, 8), (0, 1.0, 4, 3.0, 6, 9)):
        got = one(spark, segments.INTEGRALS[kind](lit(ta), F.lit(va), lit(tb), F.lit(vb), lit(i0), lit(i1))).c0
        x = np.arange(i0, i1, 1e-3) + 5e-4
        slope = (vb - va) / (tb - ta) if tb > ta else 0.0
        y = va + slope * (x - ta) if kind == "linear" else np.where(x < ta, 0, np.where(x < tb, va, vb))
        assert got == pytest.approx(y.sum() * 1e-3, abs=1e-6)


SAMPLES = [(11, 6.0), (44, 7.0), (56, 1.0), (146, 10.0), (170, 7.26)]
GOLDEN = """30 11 30 19 1 6.29 0.21 0.09 0.08 1
30 30 60 30 2 4.93 7.72 -5.13 79.36 1
30 60 90 30 0 2.9 13.49 70.15 546.75 1
30 90 120 30 0 5.9 20.09 -16.07 416.47 1
30 120 150 30 1 8.84 8.88 -55.59 442.72 1
30 150 170 20 0 8.4 1.82 0.83 3.71 0
60 11 60 49 3 5.46 5.25 -2.97 48.85 1
60 60 120 60 0 4.4 19.04 27.04 486.67 1
60 120 150 30 1 8.84 8.88 -55.59 442.72 0
90 11 90 79 3 4.48 9.92 23.85 240.87 1
90 90 150 60 1 7.37 16.65 -35.83 434.28 0
120 11 120 109 3 4.87 13.12 13.58 289.93 1
150 11 150 139 4 5.73 14.87 4.3 343.25 1"""
TREE = tg.ResolutionTree(*[tg.Resolution.of(seconds=n) for n in (30, 60, 90, 120, 150)])


def golden():
    rows = [list(map(float, line.split())) for line in GOLDEN.splitlines()]
    return {(int(r[0]), r[1]): r[2:] for r in rows}


def shown(r):
    return [seconds_of(r.seg_end), r.length, r["count"], *[round(r[m], 2) + 0.0 for m in ("mean", "m2", "m3", "m4")], float(r.complete)]


def test_segments_equal_goldens(spark):
    got = {(r.resolution_s, seconds_of(r.seg_start)): shown(r) for r in segments.segments(as_series(spark, SAMPLES), TREE).collect()}
    want = golden()
    assert {k: got[k] for k in want} == want
    assert not [k for k in got if k not in want and got[k][-1]]


def test_late_and_repeated_samples_are_dropped(spark):
    rows = [*SAMPLES[:2], SAMPLES[0], *SAMPLES[2:], (146, 99.0)]
    frame = spark.createDataFrame([("s", "V", "c", u(t), v, k) for k, (t, v) in enumerate(rows)], SERIES + ", k int")
    a = segments.segments(frame, TREE, arrival="k").collect()
    assert {(r.resolution_s, r.seg_start, r.mean) for r in a} == {(r.resolution_s, r.seg_start, r.mean) for r in segments.segments(as_series(spark, SAMPLES), TREE).collect()}


def test_stream_pass_equals_batch(spark):
    state, out = SegmentState(TREE), []
    for t, v in [*SAMPLES[:2], SAMPLES[0], *SAMPLES[2:]]:
        out += list(state.process(t * 1_000_000, v))
    want = {k: v for k, v in golden().items() if v[-1]}
    got = {(r, s.start / 1e6): [s.end / 1e6, s.length, s.count, *[round(getattr(s, m), 2) + 0.0 for m in ("mean", "m2", "m3", "m4")], 1.0] for r, s in out}
    assert got == want


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rng = np.random.default_rng(3)
    times = np.cumsum(rng.integers(1, 40, 120)).tolist()
    rows = [(t, float(rng.normal())) for t in times]
    for part in (rows[:50], rows[50:]):
        as_series(spark, part).coalesce(1).write.mode("append").parquet(source)
        append_segments(stream_segments(spark.readStream.schema(SERIES).parquet(source), TREE), out, check).awaitTermination(120)
    got = {(r.resolution_s, seconds_of(r.seg_start)): (seconds_of(r.seg_end), r["count"], r.mean, r.m4) for r in spark.read.parquet(out).collect()}
    want = {(r.resolution_s, seconds_of(r.seg_start)): (seconds_of(r.seg_end), r["count"], r.mean, r.m4) for r in segments.segments(as_series(spark, rows), TREE, open_too=False).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_combined_is_exact_in_any_grouping(spark):
    rng = np.random.default_rng(1)
    parts = [rng.gamma(2, size=n) + k for k, n in enumerate((5, 40, 3, 17))]
    rows = [(k % 2, float(len(p)), *[float(p.mean())], *[float(((p - p.mean()) ** d).mean()) for d in (2, 3, 4)]) for k, p in enumerate(parts)]
    frame = spark.createDataFrame(rows, "g int, weight double, mean double, m2 double, m3 double, m4 double")
    x = np.concatenate(parts)
    want = [x.mean(), *[((x - x.mean()) ** d).mean() for d in (2, 3, 4)]]
    whole = frame.transform(lambda f: moments.combined(f, [])).first()
    nested = moments.combined(moments.combined(frame, ["g"]), []).first()
    for r in (whole, nested):
        assert [r[m] for m in ("mean", "m2", "m3", "m4")] == pytest.approx(want)


def test_bucket_moments_oddities(spark):
    rows = [(0, 1.0), (5, 3.0), (10, None), (12, float("nan")), (20, 0.0), (21, 8.0), (50, 2.0)]
    got = {seconds_of(r.ts): r.mean for r in moments.bucket_moments(as_series(spark, rows), 10).collect()}
    assert got == {0: 2.0, 20: 4.0, 50: 2.0}
    assert {seconds_of(r.ts): r.mean for r in moments.bucket_moments(as_series(spark, rows), 10, skip_zeros=True).collect()}[20] == 8.0
    assert moments.bucket_moments(as_series(spark, rows).limit(0), 10).collect() == []


def test_linear_and_spline_fill(spark):
    frame = spark.createDataFrame([("k", u(10 * i), v) for i, v in enumerate([None, 0.0, None, None, 9.0, None])], "k string, ts timestamp_ntz, v double")
    assert [r.v for r in gapfill.linear_fill(frame, ["k"], ["v"]).orderBy("ts").collect()] == [None, 0.0, 3.0, 6.0, 9.0, 9.0]
    t = np.arange(12.0)
    keep = np.array([0, 1, 3, 4, 6, 9, 11])
    assert gapfill.quadratic_spline(t[keep], (t**2 - 3 * t)[keep], t) == pytest.approx(t**2 - 3 * t)
    filled = gapfill.spline_fill(spark.createDataFrame([("k", u(i), float(i * i) if i in keep else None) for i in range(12)], "k string, ts timestamp_ntz, v double"), ["k"], ["v"]).orderBy("ts").collect()
    assert [r.v for r in filled] == pytest.approx([i * i for i in range(12)])


def test_sliding_samples(spark):
    frame = spark.createDataFrame([("k", u(i), float(i)) for i in range(300)], "k string, ts timestamp_ntz, v double")
    got = samples.sliding_samples(frame, ["k"], ["v"], 48, 24).orderBy("ts").collect()
    assert len(got) == 300 - 48 - 24 + 1
    assert got[0].v_past == list(range(48)) and got[0].v_future == list(range(48, 72)) and got[-1].v_future[-1] == 299
    past, future = regression.windows(np.zeros((8760, 2)), 48, 24)
    assert past.shape == (8689, 48, 2) and future.shape == (8689, 24, 2)


@pytest.mark.parametrize("method", ["minmax", "absmax", "mean", "median", None])
def test_scalers_agree_and_invert(spark, method):
    x = np.array([1.0, 4.0, -2.0, 8.0, 3.0])
    frame = spark.createDataFrame([("k", float(v)) for v in x], "k string, v double")
    fitted = samples.scaler(frame, ["k"], "v", method)
    got = samples.scale(frame, fitted, ["k"], "v")
    s = regression.Scaler(method).fit(x[:, None])
    assert sorted(r.v for r in got.collect()) == pytest.approx(sorted(s.transform(x[:, None])[:, 0]))
    assert sorted(r.v for r in samples.scale(got, fitted, ["k"], "v", inverse=True).collect()) == pytest.approx(sorted(x))


@pytest.mark.parametrize("method", list(clustering.LINKAGES))
def test_trees_find_separate_groups(method):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(12, 3)) * 0.1 + c for c in (0, 5, 11)])
    labels = clustering.cut(clustering.linkage(x, method), 3)
    assert labels.tolist() == [0] * 12 + [1] * 12 + [2] * 12


@pytest.mark.parametrize("km", [None, *clustering.KMEANS])
@pytest.mark.parametrize("score", ["CH", "DB", "S"])
def test_clustering_invariants(km, score):
    x = np.random.default_rng(4).normal(size=(60, 20)).cumsum(1)
    c = clustering.Clustering(km_method=km, score=score, km_iterations=5).fit(x)
    assert 2 <= c.k <= 7 and len(c.labels) == 60
    for k, _, chosen, sizes in c.summary():
        assert sum(sizes) == 60 and chosen == (k == c.k)
    assert c.scores[c.k] == clustering.knee_score(list(c.scores.values()))
    few = clustering.Clustering().fit(x[:2])
    assert few.k == 2 and few.labels.tolist() == [0, 1]
    assert clustering.Clustering().fit(x[:3]).k == 2


def test_kernels():
    x = np.zeros(4000)
    e = np.random.default_rng(2).normal(size=4000)
    for t in range(2, 4000):
        x[t] = 0.6 * x[t - 1] - 0.3 * x[t - 2] + e[t]
    p = kernels.pacf(x, 10)
    assert p[2] == pytest.approx(-0.3, abs=0.05) and abs(p[3:]).max() < 0.06
    assert 2 <= kernels.significant_lag([x], 10)[0] <= 4
    assert kernels.knee([]) == (0, 0.0) and kernels.knee([1.0, 1.0])[0] == 1
    assert kernels.knee([10, 4, 2, 1.5, 1.2, 1.1, 1.05, 1.0])[0] in (1, 2)
    rng = np.random.default_rng(5)
    a, b, n = rng.normal(size=(3, 400))
    y = a + 0.1 * n
    scores = kernels.joint_scores(np.column_stack((a, b, n * 5)), y)
    assert scores.argmax() == 0
    assert kernels.mutual_information(a, b) == pytest.approx(0, abs=0.1)
    m = np.array([[1.0, 2.0], [1.1, np.nan], [9.0, 9.0]])
    assert kernels.impute_nearest(m, 1)[1, 1] == 2.0
    assert kernels.selected([5, 1, 1, 1, 1], 0.5) == [0, 1, 2] and len(kernels.selected([3, 2], 1.0)) == 2
    q = kernels.MultiQuantileRegression([0.1, 0.9]).fit_predict(a[:, None], y[:, None])
    assert (y < q[:, 0, 0]).mean() == pytest.approx(0.1, abs=0.03) and (y < q[:, 0, 1]).mean() == pytest.approx(0.9, abs=0.03)
    assert kernels.multiple_correlation(np.column_stack((a, b)), a + b) == pytest.approx(1)
    s = kernels.synthetic_samples(np.column_stack((a, b)), 50)
    assert s.shape == (50, 2) and s.min() >= min(a.min(), b.min())


@pytest.mark.parametrize("name", list(regression.MODELS))
def test_models_learn_a_daily_shape(name):
    t = pd.date_range("2021-01-04", periods=24 * 20, freq="h")
    y = pd.DataFrame({"a": np.sin(2 * np.pi * t.hour / 24) + 2}, index=t)
    r = regression.Forecaster(24, regression.StepModel(name), ("TimeOfDay",), lags=regression.FixedLag(3))
    x = pd.DataFrame(index=t)
    with pytest.raises(ValueError):
        r.ahead(x, y)
    r.learn(x.iloc[:-24], y.iloc[:-24])
    p = r.ahead(x.iloc[-24:], y.iloc[:-24])
    assert len(p) == 24 and np.abs(p.a - y.a.iloc[-24:]).mean() < 0.35
    assert r.ahead(x.iloc[:3], y).empty and len(r.summary()) == 1


def test_linear_steps_equal_a_closed_form():
    """Two outputs, two lags, one known feature: least squares on each output's own rows, applied step by step."""
    rng = np.random.default_rng(7)
    y, x = rng.normal(size=(60, 2)).cumsum(0), rng.normal(size=(60, 1))
    known, past, ahead = regression.windows(x, 2, 3)[1], *regression.windows(y, 2, 3)
    m = regression.StepModel(lambda: regression.Linear(0.0))
    assert list(m.learn(known, past, ahead).model) == [0, 1]
    got = m.steps(known[-1:], past[-1:])[0]
    for j in range(2):
        a = np.column_stack((np.ones(len(past)), known[:, 0], past[:, 0, j], past[:, 1, j]))
        w = np.linalg.lstsq(a, ahead[:, 0, j], rcond=None)[0]
        lags = list(past[-1, :, j])
        for t in range(3):
            lags.append(w @ [1, known[-1, t, 0], *lags[-2:]])
            assert got[t, j] == pytest.approx(lags[-1], abs=1e-6)
    kept = regression.StepModel("linear", remember=True)
    kept.learn(known[:20], past[:20], ahead[:20])
    kept.learn(known[20:], past[20:], ahead[20:])
    whole = regression.StepModel("linear")
    whole.learn(known, past, ahead)
    assert kept.steps(known[:5], past[:5]) == pytest.approx(whole.steps(known[:5], past[:5]))


def test_transform_and_learner(spark):
    s = files.generated(spark, 16, "2021-01-01", 24 * 20, 3600).withColumn("value", F.col("value") + 5 + 2 * F.sin(F.hour("ts") * (2 * np.pi / 24)))
    s = s.persist()
    make = lambda: regression.Forecaster(24, regression.StepModel("linear"), ("TimeOfDay",), lags=regression.FixedLag(4))
    learner = CumulantLearner(s, None, 3600, CumulantTransform(3600, (cal.TimeOfDay,)), make)
    e = learner.evaluate(tg.TimeInterval(datetime(2021, 1, 1), datetime(2021, 1, 17)), tg.TimeInterval(datetime(2021, 1, 17), datetime(2021, 1, 20)), [0.5, 0.95], update=2)
    t = learner.transformer
    assert t.membership.count() == 16 and t.membership.select("category").distinct().count() == 2
    rows = e.tables["winkler_score"].collect()
    assert len(rows) == 16 * 2 and {r.p for r in rows} == {0.5, 0.95}
    assert e.tables["pinball_score"].count() == 16 * 4 and e.tables["regressor_score"].count() >= 2
    assert {r.value_type for r in rows} == {"0", "1"}
    wide = learner.predict(datetime(2021, 1, 18), [0.5, 0.95]).groupBy("id", "level", "category", "cluster", "value_type", "ts").pivot("p", [0.5, 0.95]).agg(F.first("lower").alias("lo"), F.first("upper").alias("hi"))
    assert wide.where("`0.95_lo` > `0.5_lo` or `0.95_hi` < `0.5_hi`").count() == 0
    assert learner.transformer.plot_frame(learner.predict_cumulants(datetime(2021, 1, 18)), [0.5]).count() > 0
    s.unpersist()


def test_files(spark, tmp_path):
    (tmp_path / "m1.csv").write_text("time,kw\n2020-01-01 00:00:00,1.5\n2020-01-01 01:00:00,bad\n2020-01-01 00:00:00,2.5\n")
    columns = ["time", "kw"]
    got = files.csv_series(spark, str(tmp_path / "m1.csv"), str(tmp_path / "none.csv"), columns=columns, ts="time", value=1, source="m1")
    assert [(r.value, r.source) for r in got.orderBy("ts", "value").collect()] == [(1.5, "m1"), (2.5, "m1"), (None, "m1")]
    assert files.averaged(got).first().value == 2.0
    assert files.csv_series(spark, str(tmp_path / "none.csv"), columns=columns, ts=0, value=1).count() == 0
    files.split_series(files.averaged(got), str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).count() == 1
    for _ in range(2):
        files.write_csv(files.averaged(got), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    meters = files.SmartMeters(spark, str(tmp_path / "m1.csv"), columns=columns, ts=0, value=1)
    assert meters.dataset()[1].first().source == "m1"
    with pytest.raises(ValueError):
        files.in_memory(spark, pd.DataFrame({"ts": ["x"], "value": [1.0]}))


def test_profile_cells_are_bounded(spark):
    t = CumulantTransform(3600, (cal.TimeOfDay,), most_cells=1)
    with pytest.raises(ValueError):
        t.fit(files.generated(spark, 2, "2021-01-01", 48, 3600))
    assert ID == ["source", "value_type", "category"]


def test_matrix_queries_take_every_row(spark, tmp_path):
    from tidegrid.queries import QUERIES

    n = 2_100
    x = np.random.default_rng(7).normal(size=(n, 9)).astype("float32")
    x[:, 1:] += x[:, :1] * np.arange(8)
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}).to_parquet(tmp_path / "embeddings.parquet")
    x = x.astype(float)
    got = {q: QUERIES[q](spark, str(tmp_path)).collect() for q in ("knn_impute", "synthetic_samples", "joint_information", "hierarchical_clusters", "validity_scores", "quantile_regression", "multiple_correlation", "knee_of_shares")}
    assert len(got["knn_impute"]) == 300 + 191 and len(got["quantile_regression"]) == n and len(got["hierarchical_clusters"]) == n * len(clustering.LINKAGES)
    have = np.arange(n) % 7 != 0
    others = [0, 1, 2, 4, 5, 6, 7, 8]
    d = np.where(have, ((x[:, others] - x[7, others]) ** 2).sum(1) * 9 / 8, np.inf)
    both = [0, 1, 2, 4, 6, 7, 8]
    d = np.where(have & (np.arange(n) % 11 == 0), ((x[:, both] - x[7, both]) ** 2).sum(1) * 9 / 7, d)
    assert {(r.id, r.column): r.value for r in got["knn_impute"]}[7, 3] == pytest.approx(x[np.argsort(d)[:5], 3].mean())
    y, z = x[:, 6] + x[:, 0], x[:, :6]
    alone = [kernels.mutual_information(z[:, j], y) for j in range(2)]
    pair = [min(alone[j] if m == j else kernels.mutual_information(z[:, j], y) + kernels.mutual_information(z[:, m], y, z[:, j]) for j in range(6) if j != m) for m in (5,)]
    assert {r.feature: r.score for r in got["joint_information"]}[5] == pytest.approx(pair[0])
    assert [r.r for r in got["multiple_correlation"]] == pytest.approx([kernels.multiple_correlation(np.delete(x, j, 1), x[:, j]) for j in range(8)])
    at, value = kernels.knee(np.sort(kernels.principal_components(x)[1])[::-1])
    assert (got["knee_of_shares"][0].x, got["knee_of_shares"][0].y) == (at, pytest.approx(value))
    want = {s: f(x, clustering.lloyd(x, 10)) for s, f in clustering.SCORES.items()}
    assert {r.name: r.score for r in got["validity_scores"]} == pytest.approx(want)
    p = kernels.MultiQuantileRegression([0.5]).fit_predict(x[:, 1:], x[:, :1])[:, 0, 0]
    q50 = np.array([r.q50 for r in sorted(got["quantile_regression"])])
    assert np.abs(x[:, 0] - q50).sum() == pytest.approx(np.abs(x[:, 0] - p).sum(), rel=1e-6)
    assert len(got["synthetic_samples"]) == 100


@pytest.mark.parametrize("method", list(clustering.LINKAGES))
def test_tree_merges_the_nearest_first(method):
    """Against a search through all distances at each merge, with ties."""
    x = np.random.default_rng(3).integers(0, 4, size=(40, 2)).astype(float)
    n, square = len(x), method in ("centroid", "median", "ward")
    d = clustering.squared(x, x) if square else np.sqrt(clustering.squared(x, x))
    np.fill_diagonal(d, np.inf)
    ids, sizes, alive, want = list(range(n)), np.ones(n), set(range(n)), []
    for m in range(n - 1):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        h = d[i, j]
        want.append((*sorted((ids[i], ids[j])), float(np.sqrt(max(h, 0))) if square else float(h)))
        for o in alive - {i, j}:
            a, b, c, e = clustering.LINKAGES[method](sizes[i], sizes[j], sizes[o])
            d[i, o] = d[o, i] = a * d[i, o] + b * d[j, o] + c * h + e * abs(d[i, o] - d[j, o])
        alive.discard(j)
        ids[i] = n + m
        sizes[i] += sizes[j]
        d[j], d[:, j] = np.inf, np.inf
    got = clustering.linkage(x, method)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


@pytest.mark.parametrize("method", list(clustering.LINKAGES))
@pytest.mark.parametrize("kept", [0, 1 << 20])
def test_tree_without_a_matrix_is_the_same(method, kept, monkeypatch):
    monkeypatch.setattr(clustering, "KEPT_BYTES", max(kept, 1))
    monkeypatch.setattr(clustering, "AT_ONCE", 500)
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 3, 150):
        x = rng.normal(size=(n, 4)) + rng.integers(0, 3, size=(n, 1))
        got, want = clustering.linkage(x, method, 0), clustering.linkage(x, method, n)
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    x = np.repeat(np.eye(5) * 9, 30, axis=0) + np.repeat(rng.normal(size=(30, 5)), 5, axis=0)  # rows that are equal
    assert [g[2] for g in clustering.linkage(x, method, 0)] == pytest.approx([w[2] for w in clustering.linkage(x, method, 150)], abs=1e-6)


@pytest.mark.parametrize("method", ["average", "centroid"])
def test_tree_of_many_rows_holds_no_matrix(method):
    import tracemalloc

    x = np.random.default_rng(5).normal(size=(3_000, 16))
    tracemalloc.start()
    tree = clustering.linkage(x, method)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(tree) == 2_999 and most < 3_000 * 3_000 * 8


@pytest.mark.parametrize("method", clustering.IN_ROUNDS)
def test_tree_in_rounds_is_the_same(method, monkeypatch):
    """Many clusters are searched at once by several parts, and those of over PIECE rows in pieces."""
    monkeypatch.setattr(clustering, "PIECE", 3)
    monkeypatch.setattr(clustering, "ROUND_CELLS", 500)
    rng, parts = np.random.default_rng(8), []

    def over(f, own, shared):
        parts.append(len(own))
        return [f(p, *shared) for p in own]

    for n in (0, 1, 2, 3, 700):
        x = rng.normal(size=(n, 4)) + rng.integers(0, 3, size=(n, 1))
        got, want = clustering.linkage_in_rounds(x, method, over, 20), clustering.linkage(x, method, n)
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert len(parts) < 60 and max(parts) > 1
    x = np.repeat(np.eye(5) * 9, 30, axis=0) + np.repeat(rng.normal(size=(30, 5)), 5, axis=0)  # rows that are equal
    assert [g[2] for g in clustering.linkage_in_rounds(x, method, matrix_rows=9)] == pytest.approx([w[2] for w in clustering.linkage(x, method, 150)], abs=1e-6)


@pytest.mark.parametrize("method", ["complete", "average", "weighted"])
def test_tree_in_rounds_searches_few_rows(method):
    """A search lists several clusters, so that most merges need no other one."""
    x, searched = np.random.default_rng(6).normal(size=(3_000, 16)), []

    def over(f, parts, shared):
        if f.__name__ != "_pair_distances":  # of two clusters only
            searched.extend(len(p) if len(shared) < 3 else np.isin(shared[2], p).sum() for p in parts)
        return [f(p, *shared) for p in parts]

    got, want = clustering.linkage_in_rounds(x, method, over, 300), clustering.linkage(x, method, len(x))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert sum(searched) < 12 * len(x)


@pytest.mark.parametrize("method", ["centroid", "median"])
def test_cluster_that_takes_the_others_needs_no_search_each_time(method, monkeypatch):
    x, looks, row = np.random.default_rng(6).normal(size=(2_000, 32)), [], clustering._Centres.row
    x /= np.sqrt((x**2).sum(1))[:, None]
    monkeypatch.setattr(clustering._Centres, "row", lambda self, i: looks.append(i) or row(self, i))
    got, want = clustering.linkage(x, method, 0), clustering.linkage(x, method, len(x))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert len(looks) < 1.2 * len(x)


@pytest.mark.parametrize("kind", ["spread", "copies", "few values"])
def test_joint_scores_compare_few_rows(kind, monkeypatch):
    """Equal to the sums over all pairs of rows, of which most are never compared."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3_000, 4)).astype("float32").astype(float)
    x = np.repeat(x[:600], 5, axis=0) if kind == "copies" else np.round(x, 1) if kind == "few values" else x
    y = x[:, 3] + x[:, 0]
    x = x[:, :3]
    alone = [kernels.mutual_information(x[:, j], y) for j in range(3)]
    want = [min(alone[j] + kernels.mutual_information(x[:, i], y, x[:, j]) for j in range(3) if j != i) for i in range(3)]
    given = []
    monkeypatch.setattr(kernels, "LEAF", 32)
    real = np.partition
    monkeypatch.setattr(np, "partition", lambda d, *a, **k: (given.append(d.size), real(d, *a, **k))[1])
    assert kernels.joint_scores(x, y) == pytest.approx(want, abs=1e-9)
    assert kind != "spread" or sum(given) < 6 * 3_000**2 / 4


def test_silhouette_goes_in_parts():
    rng = np.random.default_rng(4)
    x, labels, parts = rng.normal(size=(1_300, 3)), rng.integers(0, 4, 1_300) * 2, []
    x[5] = x[9]
    labels[7] = 11  # alone
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    means = np.stack([d[:, labels == c].mean(1) for c in np.unique(labels)], 1)
    own = np.searchsorted(np.unique(labels), labels)
    n = np.bincount(own)[own]
    i = np.arange(len(x))
    near = means[i, own] * n / np.maximum(n - 1, 1)
    means[i, own] = np.inf
    want = np.where(n > 1, (means.min(1) - near) / np.maximum(means.min(1), near), 0).mean()
    assert clustering.silhouette(x, labels, lambda f, p, shared: [parts.append(q) or f(q, *shared) for q in p]) == pytest.approx(want)
    assert len(parts) == 3


def test_search_over_k_scores_cuts_from_sums(monkeypatch):
    rng, calls = np.random.default_rng(5), []
    x = rng.normal(size=(900, 5)) + rng.integers(0, 4, size=(900, 1)) * 3
    real = clustering.calinski_harabasz
    own = clustering.Clustering(score=lambda x, labels: calls.append(len(x)) or real(x, labels)).fit(x)
    got = clustering.Clustering().fit(x)
    assert got.scores == pytest.approx(own.scores) and len(calls) == len(own.scores)
    assert (got.k, got.labels.tolist(), got.cardinality) == (own.k, own.labels.tolist(), own.cardinality)
    monkeypatch.setitem(clustering.SCORES, "ch", real)
    monkeypatch.setattr(clustering, "squared", lambda a, b, f=clustering.squared: (calls.append(len(a) * len(b)), f(a, b))[1])
    monkeypatch.setattr(clustering, "AT_ONCE", 3_000)
    assert clustering.Clustering().fit(x).labels.tolist() == own.labels.tolist() and max(calls[len(own.scores) :]) <= 3_000
    for k, sizes in got.cardinality.items():
        assert sum(sizes) == 900 and len(sizes) <= k
