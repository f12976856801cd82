"""Learning cluster-level cumulants: fit, update, predict, and rolling-origin evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timegrid import TimeInterval
from ..operators.gapfill import resampled
from ..operators.regression import Forecaster
from .transform import CumulantTransform, scores

CUMULANTS = ["mean", "stdev", "skewness", "kurtosis"]


@dataclass
class Evaluation:
    """Score tables: of the clustering, extractor, selectors and regressors, and the losses."""

    tables: dict[str, DataFrame]

    def to_csv(self, folder: str) -> None:
        for name, df in self.tables.items():
            flat = df.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
            flat.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


@dataclass
class CumulantLearner:
    """One regressor a (category, cluster), over the cumulants of all its value types.

    Each cluster learns and forecasts in a task of its own; the driver holds the models, one a cluster. Cumulants are
    small (a row a cluster, value type and step) and stay in Spark, as the series do.
    """

    series: DataFrame
    exogenous: DataFrame | None
    resolution_s: int
    transformer: CumulantTransform
    regressor: Callable[[], Forecaster]
    models: dict[tuple[str, int], Forecaster] = field(default_factory=dict)
    cache: list[tuple[TimeInterval, DataFrame]] = field(default_factory=list)
    scored: list[DataFrame] = field(default_factory=list)

    @property
    def step(self) -> timedelta:
        return timedelta(seconds=self.resolution_s)

    def cumulants(self, interval: TimeInterval) -> DataFrame:
        """From an earlier result that contains the interval, or anew (and kept)."""
        for known, df in self.cache:
            if known.contains(interval):
                return df.where(interval.where())
        df = self.transformer.transform(self.series, interval, fill_gaps=True).persist()
        self.cache.append((interval, df))
        return df

    @staticmethod
    def _wide(rows: pd.DataFrame) -> pd.DataFrame:
        """One cluster's cumulants by time, a column for each value type and cumulant."""
        y = rows.pivot(index="ts", columns="value_type", values=CUMULANTS).sort_index().fillna(0.0)
        y.columns = [f"{v}|{c}" for c, v in y.columns]
        return y

    def _inputs(self, interval: TimeInterval, index: pd.DatetimeIndex | None = None) -> pd.DataFrame:
        if self.exogenous is None:
            steps = index if index is not None else pd.date_range(interval.start, interval.end, freq=self.step, inclusive="left")
            return pd.DataFrame(index=pd.DatetimeIndex(steps))
        columns = [c for c in self.exogenous.columns if c != "ts"]
        return resampled(self.exogenous.where(interval.where()), columns, self.resolution_s).toPandas().set_index("ts").sort_index()

    def fit(self, interval: TimeInterval) -> CumulantLearner:
        """Finds the clusters and trains anew."""
        self.transformer.fit(self.series, interval)
        self.release()
        self.models = {}
        self._train(interval)
        return self

    def release(self) -> None:
        """Lets go of the frames that are kept in memory: known cumulants, and the rows that evaluate()'s scores read."""
        for df in (*(df for _, df in self.cache), *self.scored):
            df.unpersist()
        self.cache, self.scored = [], []

    def update(self, interval: TimeInterval) -> CumulantLearner:
        """Trains the regressors on; clusters and factors stay. The lookback before the interval is included."""
        if not self.models:
            raise ValueError("fit comes before update")
        self._train(TimeInterval(interval.start - self.lookback(), interval.end))
        return self

    def _train(self, interval: TimeInterval) -> None:
        """A task for each cluster; what comes back are the models, whose number and size don't grow with the series."""
        x, wide, make = self._inputs(interval), self._wide, self.regressor
        so_far = {key: cloudpickle.dumps(m) for key, m in self.models.items()}

        def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            y = wide(rows)
            own = so_far.get((key[0], int(key[1])))
            model = cloudpickle.loads(own) if own else make()
            model.learn(x if len(x.columns) else pd.DataFrame(index=y.index), y)
            return pd.DataFrame({"category": [key[0]], "cluster": [key[1]], "model": [cloudpickle.dumps(model)]})

        rows = self.cumulants(interval).select("category", "cluster", "value_type", "ts", *CUMULANTS)
        for r in rows.groupBy("category", "cluster").applyInPandas(learn, "category string, cluster int, model binary").collect():
            self.models[r.category, int(r.cluster)] = cloudpickle.loads(bytes(r.model))

    def lookback(self) -> timedelta:
        return max(m.lookback for m in self.models.values()) * self.step

    def horizon(self) -> timedelta:
        return max(m.horizon for m in self.models.values()) * self.step

    def predict_cumulants(self, start) -> DataFrame:
        """The cumulants of each cluster over the horizon from start on."""
        if not self.models:
            raise ValueError("fit comes before predict")
        ahead = TimeInterval(start, start + self.horizon())
        x, wide = self._inputs(ahead), self._wide
        models = {key: cloudpickle.dumps(m) for key, m in self.models.items()}
        columns = ["category", "cluster", "value_type", "ts", *CUMULANTS]

        def forecast(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            own = models.get((key[0], int(key[1])))
            found = cloudpickle.loads(own).ahead(x, wide(rows)) if own else pd.DataFrame()
            if found.empty:
                return pd.DataFrame(columns=columns)
            found.columns = pd.MultiIndex.from_tuples([tuple(c.rsplit("|", 1)) for c in found.columns], names=["value_type", None])
            long = found.stack("value_type", future_stack=True).rename_axis(["ts", "value_type"]).reset_index()
            return long.assign(category=key[0], cluster=key[1], stdev=long.stdev.clip(lower=0.0))[columns]

        past = self.cumulants(TimeInterval(start - self.lookback(), start)).select(*columns)
        return past.groupBy("category", "cluster").applyInPandas(forecast, "category string, cluster int, value_type string, ts timestamp_ntz, mean double, stdev double, skewness double, kurtosis double")

    def predict(self, start, p: Sequence[float], clusters: bool = True, members: bool = True) -> DataFrame:
        return self.transformer.inverse_transform(self.predict_cumulants(start), p, clusters, members)

    def evaluate(self, fit: TimeInterval, predict: TimeInterval, p: Sequence[float], update: int | None = None) -> Evaluation:
        """Predicts horizon after horizon through an interval, trains on after every `update` of them, and scores members."""
        spark = self.series.sparkSession
        if not self.models:
            self.fit(fit)
        self.cumulants(TimeInterval(min(fit.start, predict.start), max(fit.end, predict.end)))
        start, done, out, since = predict.start, 0, None, predict.start
        while start + self.horizon() <= predict.end:
            own = self.predict_cumulants(start)
            out = own if out is None else out.unionByName(own)
            start, done = start + self.horizon(), done + 1
            if update and done % update == 0 and start + self.horizon() <= predict.end:
                self.update(TimeInterval(since, start))
                since = start
        if out is None:
            raise ValueError("the interval is shorter than the horizon")
        actual = self.transformer.moments(self.series, predict).select("source", "value_type", "category", "ts", F.col("mean").alias("x"))
        rows = self.transformer.inverse_transform(out, p, clusters=False).withColumnRenamed("id", "source").join(actual, ["source", "value_type", "category", "ts"])
        rows = rows.persist()  # a row a member, step and probability; both scores read it, release() lets it go
        self.scored.append(rows)
        pin, win = scores(rows, p)
        tables = {"clustering_score": self.transformer.clustering_score(spark), "extractor_score": self.transformer.extractor_score(spark), "regressor_score": self.regressor_score(), "pinball_score": pin, "winkler_score": win}
        return Evaluation(tables | {"x_selector_score": self.x_selector_score(), "y_selector_score": self.y_selector_score()})

    def regressor_score(self) -> DataFrame:
        rows = [(k[0], int(k[1]), int(r.fit), int(r.model), float(r.metric)) for k, m in sorted(self.models.items()) for r in m.summary().itertuples()]
        return self.series.sparkSession.createDataFrame(rows, "category string, cluster int, fit int, model int, metric double")

    def x_selector_score(self) -> DataFrame:
        rows = [(k[0], int(k[1]), i, j, float(s), j in (m.chosen or ())) for k, m in sorted(self.models.items()) for i, line in enumerate(getattr(m.exogenous, "scores", ())) for j, s in enumerate(line)]
        return self.series.sparkSession.createDataFrame(rows, "category string, cluster int, y int, x int, score double, selected boolean")

    def y_selector_score(self) -> DataFrame:
        rows = [(k[0], int(k[1]), i, lag, float(s), lag <= m.lookback, float(m.lags.radius)) for k, m in sorted(self.models.items()) for i, line in enumerate(getattr(m.lags, "scores", ())) for lag, s in enumerate(line)]
        return self.series.sparkSession.createDataFrame(rows, "category string, cluster int, feature int, lag int, score double, selected boolean, ci double")
