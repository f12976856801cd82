"""Multi-resolution segments of a stream of samples, one pass, with a state of one open segment a resolution and series."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from ..functions.timegrid import ResolutionTree, from_micros, micros
from ..schema import ID, MOMENTS


@dataclass
class Open:
    """A segment under way: times in microseconds, length in seconds."""

    start: int
    end: int
    length: float = 0.0
    count: int = 0
    mean: float = 0.0
    m2: float = 0.0
    m3: float = 0.0
    m4: float = 0.0

    def merged(self, o: Open) -> Open:
        start, end, total = min(self.start, o.start), max(self.end, o.end), self.length + o.length
        if not total:
            return Open(start, end)
        mean = (self.length * self.mean + o.length * o.mean) / total
        sides = [(x.length, x.mean - mean, x) for x in (self, o)]
        return Open(start, end, total, self.count + o.count, mean, *[sum(w * (getattr(x, f"m{d}") + e**d) for w, e, x in sides) / total for d in (2, 3, 4)])


def piece(ta: int, va: float, tb: int, vb: float, i0: int, i1: int, step: bool) -> Open:
    """The part [i0, i1] of the curve through two samples."""
    length = (i1 - i0) / 1e6

    def average(a: float, b: float) -> float:
        return a if step else a + (b - a) * ((i0 - ta) + (i1 - ta)) / (2 * (tb - ta))

    mean = average(va, vb)
    return Open(i0, i1, length, int(i0 == ta), mean, *[average((va - mean) ** d, (vb - mean) ** d) for d in (2, 3, 4)])


#: Pieces that are cut and merged at a time.
BLOCK = 200_000
FIELDS = [f.name for f in fields(Open)]
Columns = dict[str, np.ndarray]


def pieces(t: np.ndarray, v: np.ndarray, size: int, step: bool) -> Iterator[Columns]:
    """The parts of the curve through samples in order of time, cut at all multiples of size, in blocks: the fields of Open as columns."""
    first = t[:-1] // size
    ends = np.cumsum((t[1:] - 1) // size - first + 1)
    for low in range(0, int(ends[-1]), BLOCK):
        n = np.arange(low, min(low + BLOCK, int(ends[-1])))
        k = np.searchsorted(ends, n, side="right")
        ta, tb, va, vb = t[k], t[k + 1], v[k], v[k + 1]
        at = (first[k] + n - (ends[k] - ((tb - 1) // size - first[k] + 1))) * size
        i0, i1 = np.maximum(at, ta), np.minimum(at + size, tb)
        part = ((i0 - ta) + (i1 - ta)) / (2.0 * (tb - ta))
        average = lambda a, b: a if step else a + (b - a) * part  # noqa: B023, E731
        mean = average(va, vb)
        own = {"start": i0, "end": i1, "length": (i1 - i0) / 1e6, "count": (i0 == ta).astype(np.int64), "mean": mean}
        yield own | {f"m{d}": average(power(va - mean, d), power(vb - mean, d)) for d in (2, 3, 4)}


def power(x: np.ndarray, d: int) -> np.ndarray:
    return x * x if d == 2 else x * power(x, d - 1)


def merged(parts: Columns, size: int) -> Columns:
    """Parts in order of time, merged one by one as Open.merged() does, those of each stretch of size.

    Merging part k into the parts before it, of length W and mean M, moves the mean to N and adds W (M - N)^d and
    length (m_d + (mean - N)^d) to the d-th moment's sum. Means are taken about each stretch's first one, where that is finite.
    """
    stretch = parts["start"] // size
    heads = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1])))
    sizes = np.diff(np.append(heads, len(stretch)))
    w, reference = parts["length"], np.where(np.isfinite(parts["mean"][heads]), parts["mean"][heads], 0.0)
    mean = parts["mean"] - np.repeat(reference, sizes)

    several = [(h, h + n - 1) for h, n in zip(heads.tolist(), sizes.tolist(), strict=True) if n > 1]

    def before(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for h, e in several:  # sums over all stretches, less those before, would carry a huge or infinite value's error on
            np.cumsum(x[h:e], out=out[h + 1 : e + 1])
        return out

    w0, s0 = before(w), before(w * mean)
    old = np.divide(s0, w0, out=np.zeros_like(s0), where=w0 > 0)
    new = (s0 + w * mean) / (w0 + w)
    total = np.add.reduceat(w, heads)
    sums = {f"m{d}": np.add.reduceat(w0 * power(old - new, d) + w * (parts[f"m{d}"] + power(mean - new, d)), heads) / total for d in (2, 3, 4)}
    own = {"start": parts["start"][heads], "end": parts["end"][heads + sizes - 1], "length": total, "count": np.add.reduceat(parts["count"], heads)}
    return own | {"mean": reference + np.add.reduceat(w * mean, heads) / total} | sums


class SegmentState:
    """The pass over one series. process() takes a sample and gives (resolution in seconds, segment) for each that it finishes; extend() takes many."""

    def __init__(self, tree: ResolutionTree, step: bool = False):
        self.tree, self.step = tree, step
        self.last: tuple[int, float] | None = None
        self.open: dict[int, Open] = {}

    def process(self, t: int, value: float) -> Iterator[tuple[int, Open]]:
        """t in microseconds. A sample that isn't later than the last one is dropped."""
        if self.last is not None and t <= self.last[0]:
            return
        if self.last is not None:
            root = self.tree.root
            size, (ta, va) = root.seconds * 1_000_000, self.last
            at = ta
            while at < t:
                end = at - at % size + size
                own = piece(ta, va, t, value, at, min(end, t), self.step)
                held = self.open.get(root.seconds)
                self.open[root.seconds] = held.merged(own) if held else own
                if end <= t:
                    yield from self._finish(root, self.open.pop(root.seconds))
                at = min(end, t)
        self.last = (t, value)

    def extend(self, t: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, Columns]]:
        """process() for samples in the order they came: (resolution in seconds, columns of segments) that they finish."""
        least = np.iinfo(np.int64).min if self.last is None else self.last[0]
        later = t > np.maximum.accumulate(np.concatenate(([least], t)))[:-1]
        t, values = t[later], values[later]
        if not len(t):
            return
        if self.last is not None:
            t, values = np.concatenate(([self.last[0]], t)), np.concatenate(([self.last[1]], values))
        if len(t) > 1:
            for parts in pieces(t, values, self.tree.root.seconds * 1_000_000, self.step):
                yield from self._extend(self.tree.root, parts)
        self.last = (int(t[-1]), float(values[-1]))

    def _extend(self, resolution, parts: Columns) -> Iterator[tuple[int, Columns]]:
        """Parts follow one another without holes: all segments but the last are full."""
        size = resolution.seconds * 1_000_000
        held = self.open.pop(resolution.seconds, None)
        if held:
            parts = {c: np.concatenate(([getattr(held, c)], parts[c])) for c in FIELDS}
        out = merged(parts, size)
        if out["end"][-1] % size:
            self.open[resolution.seconds] = Open(*[out[c][-1].item() for c in FIELDS])
            out = {c: x[:-1] for c, x in out.items()}
        if len(out["end"]):
            yield resolution.seconds, out
            for r in self.tree.children(resolution):
                yield from self._extend(r, out)

    def _finish(self, resolution, segment: Open) -> Iterator[tuple[int, Open]]:
        yield resolution.seconds, segment
        for r in self.tree.children(resolution):
            held = self.open.get(r.seconds)
            own = held.merged(segment) if held else segment
            if segment.end % (r.seconds * 1_000_000) == 0:
                self.open.pop(r.seconds, None)
                yield from self._finish(r, own)
            else:
                self.open[r.seconds] = own


STATE = T.StructType(
    [
        T.StructField("t", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("resolutions", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("numbers", T.ArrayType(T.DoubleType())),
    ]
)
OUT = T.StructType([*[T.StructField(c, T.StringType()) for c in ID], T.StructField("resolution_s", T.LongType()), T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()), T.StructField("length", T.DoubleType()), T.StructField("count", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in MOMENTS]])


def frame(key: tuple, resolution_s: int, found: Columns) -> pd.DataFrame:
    """Segments of a series as rows of OUT."""
    n = len(found["end"])
    ids = {c: pd.Series([k] * n, dtype=object) for c, k in zip(ID, key, strict=True)}
    return pd.DataFrame(ids | {"resolution_s": resolution_s} | {f"{c}_us" if c in ("start", "end") else c: found[c] for c in FIELDS})


def stream_segments(series: DataFrame, tree: ResolutionTree, step: bool = False, arrival: str | None = None, skip_zeros: bool = False) -> DataFrame:
    """Finished segments of a streaming series table, in append mode.

    Within a micro-batch the samples of a series are taken in order of the arrival column if there is one, else of
    time; across batches a sample that isn't later than the last one is dropped. No timer closes a segment.
    """
    rows = series.where("ts is not null and value is not null and not isnan(value)")
    rows = rows.where("value <> 0") if skip_zeros else rows
    rows = rows.select(*ID, micros("ts").alias("us"), "value", (F.col(arrival) if arrival else micros("ts")).alias("_order"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = SegmentState(tree, step)
        if state.exists:
            t, value, resolutions, starts, ends, numbers = state.get
            s.last = (t, value)
            for k, r in enumerate(resolutions):
                length, count, *moments = numbers[6 * k : 6 * k + 6]
                s.open[r] = Open(starts[k], ends[k], length, int(count), *moments)
        pdf = pd.concat([b[["us", "value", "_order"]] for b in batches]).sort_values("_order", kind="stable")
        out = [frame(key, r, x) for r, x in s.extend(pdf.us.to_numpy(), pdf.value.to_numpy())]
        if s.last:
            held = [(r, astuple(x)) for r, x in s.open.items()]
            state.update((*s.last, [r for r, _ in held], [x[0] for _, x in held], [x[1] for _, x in held], [float(n) for _, x in held for n in x[2:]]))
        yield from out or [pd.DataFrame(columns=OUT.fieldNames())]

    out = rows.groupBy(*ID).applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")
    return out.select(*ID, "resolution_s", from_micros(F.col("start_us")).alias("seg_start"), from_micros(F.col("end_us")).alias("seg_end"), "length", "count", *MOMENTS)


def append_segments(segments: DataFrame, folder: str, checkpoint: str):
    """Writes a stream of finished segments to Parquet, partitioned by resolution. Returns the query (all available input)."""
    return segments.writeStream.partitionBy("resolution_s").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
