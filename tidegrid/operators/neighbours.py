"""Exact k nearest rows by distances over shared columns, imputation from them, and synthetic rows between them.

Rows are arrays whose nulls (or NaNs) are missing values. The distance of two rows is over the columns both have, scaled
up to all columns. It is never below their Euclidean distance over the columns that no row misses, which is a metric:
by it each row belongs to the nearest of some pivots, its cell, and a cell at whose border that distance is too large
holds no nearer row. A first pass compares a row with the nearest cells that have k candidates; a second one with every
other cell that the k-th distance found so far doesn't rule out. Cells are compared in blocks of rows, so a large cell
is many pairs of blocks and no cell is ever held by one task. Where distances are all alike nothing is ruled out and
work grows with the square of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from ..sources.shared import checkpointed
from . import ranges

#: Pivots at most (a block's rows for each otherwise), rows of a block on average, and rows of it that are compared at a time.
PIVOTS, BLOCK, SLICE = 4_096, 2_048, 256
#: Wanted rows that a task holds, about, and rows that it is sent for them: what is sent in all falls with the first, what a task reads with the second.
HELD, SENT = 16_384, 65_536
#: What is ruled out has to be this much farther, relatively: more than rounding can do.
SLACK = 1e-9


def _matrix(v: Iterable) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in v])


@dataclass
class Cells:
    """Pivots over the columns that no row misses, and of each cell its radius and the rows that have each column (last: all rows)."""

    complete: np.ndarray
    pivots: np.ndarray
    radius: np.ndarray
    have: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        y = x[:, self.complete]
        d = (y**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * y @ self.pivots.T
        return np.sqrt(np.maximum(d, 0))

    def least(self, x: np.ndarray) -> np.ndarray:
        """No row of a cell is nearer than this, rounding of the pivots' distances included."""
        scale = np.sqrt((x[:, self.complete] ** 2).sum(1))[:, None] + np.sqrt((self.pivots**2).sum(1)) + self.radius
        return np.maximum(self.distances(x) - self.radius - 1e-6 * scale, 0)


def by_columns(rows: DataFrame, width: int) -> np.ndarray:
    """Whether each of the columns is in all rows."""
    counts = rows.select(*[F.count(F.get("v", F.lit(j))).alias(f"c{j}") for j in range(width)], F.count("*").alias("n")) if width else None
    found = counts.first() if counts is not None else [0]
    return np.array([n == found[-1] for n in found[:-1]], bool)


def celled(rows: DataFrame, pivots: int | None = None) -> tuple[DataFrame, Cells]:
    """rows (id, v) with their cell and block, and the cells. Pivots are the rows that come first by a hash of their id."""
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    complete = np.flatnonzero(by_columns(rows, width or 0))
    most = pivots or max(1, min(PIVOTS, (n or 0) // BLOCK))
    first = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("v").collect()
    points = _matrix(r.v for r in first)[:, complete] if first else np.zeros((1, 0))
    cells = Cells(complete, points, np.zeros(len(points)), np.zeros((len(points), (width or 0) + 1), np.int64))

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = cells.distances(_matrix(b.v))
                own = d.argmin(1)
                yield pd.DataFrame({"id": b.id, "v": b.v, "cell": own, "r": d[np.arange(len(b)), own]})

    dealt = rows.mapInPandas(assign, "id long, v array<double>, cell int, r double")
    each = [F.count(F.get("v", F.lit(j))).alias(f"c{j}") for j in range(width or 0)]
    sums = dealt.groupBy("cell").agg(F.max("r").alias("r"), *each, F.count("*").alias("n")).collect()  # a row a pivot
    for s in sums:
        cells.radius[s.cell] = s.r
        cells.have[s.cell] = s[2:]
    blocks = F.element_at(F.array(*[F.lit(max(1, -(-int(h) // BLOCK))) for h in cells.have[:, -1]]), F.col("cell") + 1)
    return dealt.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).drop("r"), cells


def _packed(rows: DataFrame, key: str, *columns: str, name: str) -> DataFrame:
    """A row for each value of key and block with the list of its rows."""
    return rows.groupBy(key, "block").agg(F.collect_list(F.struct(*columns)).alias(name))


def _unpacked(column: pa.Array, i: int) -> tuple[pa.StructArray, np.ndarray]:
    """The structs of a list and their arrays v as a matrix, nulls as NaN."""
    rows = column.slice(i, 1).flatten()
    v = rows.field("v")
    return rows, v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)


FOUND = "q long, column int, id long, d2 double, value double"


def _compared(columns: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(place in x, id, d2, value) of the k nearest rows y of each row x, and of those that rounding could bring among them."""
    hx, hy = ~np.isnan(x), ~np.isnan(y)
    fx, fy = np.where(hx, x, 0.0), np.where(hy, y, 0.0)
    shared = hx.astype(float) @ hy.T.astype(float)
    near = (fx**2) @ hy.T + hx @ (fy**2).T - 2 * fx @ fy.T
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.where(shared > 0, np.maximum(near, 0) * x.shape[1] / shared, np.inf)
    usable = np.where(columns[:, None] >= 0, hy[:, np.maximum(columns, 0)].T, True) & (own[:, None] != ids)
    near = np.where(usable, near, np.inf)
    scale = 1e-9 * ((fx**2).sum(1)[:, None] + (fy**2).sum(1)) * x.shape[1]
    last = min(k, len(ids)) - 1
    limit = np.partition(near + scale, last, axis=1)[:, last]
    i, j = np.nonzero((near - scale <= limit[:, None]) & np.isfinite(near))
    both = hx[i] & hy[j]
    d2 = (np.where(both, fx[i] - fy[j], 0.0) ** 2).sum(1) * x.shape[1] / np.maximum(both.sum(1), 1)
    c = columns[i]
    return i, ids[j], d2, np.where(c >= 0, y[j, np.maximum(c, 0)], 0.0)


class _Block:
    """A block of wanted rows with the k nearest found so far."""

    def __init__(self, column: pa.Array, i: int):
        rows, self.x = _unpacked(column, i)
        self.q, self.columns = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("q", "column"))
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))

    def visit(self, column: pa.Array, i: int, k: int) -> None:
        rows, y = _unpacked(column, i)
        ids, parts = rows.field("id").to_numpy(zero_copy_only=False), [self.found]
        for s in range(0, len(self.q), SLICE):
            own = slice(s, s + SLICE)
            at, *rest = _compared(self.columns[own], self.q[own], self.x[own], ids, y, k)
            parts.append((at + s, *rest))
        at, ids, d2, value = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((ids, d2, at))
        at = at[order]
        order, at = (z[np.arange(len(at)) - np.searchsorted(at, at) < k] for z in (order, at))
        self.found = at, ids[order], d2[order], value[order]

    def rows(self) -> pa.RecordBatch:
        at, ids, d2, value = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.q[at]), pa.array(self.columns[at].astype(np.int32)), pa.array(ids), pa.array(d2), pa.array(value)], names=["q", "column", "id", "d2", "value"])


def _nearest_in(visits: DataFrame, left: DataFrame, right: DataFrame, k: int, shares: int) -> DataFrame:
    """FOUND: of each block of left the k nearest rows in the blocks of the cells it visits, one of which is held at a time.

    A task holds the blocks of a group and is sent a share of the cells' blocks that any of them visits, each once.
    """
    none = {c: F.lit(None).cast(dict((f.name, f.dataType) for f in d.schema)[c]) for c, d in (("left", left), ("right", right))}
    which = F.array(F.struct("home", "block"))
    none_of = F.lit(-1).alias("cell")
    by = visits.groupBy("group", "cell").agg(F.collect_list(F.struct("home", "block")).alias("which"))
    goes = by.join(right, "cell").select("group", "share", "cell", "which", none["left"].alias("left"), "right")
    begin = left.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"), none_of, which.alias("which"), "left", none["right"].alias("right"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for b in batches:
            keys = zip(b.column("group").to_pylist(), b.column("share").to_pylist(), strict=True)
            for n, (key, cell) in enumerate(zip(keys, b.column("cell").to_pylist(), strict=True)):
                if key != at:
                    yield from (x.rows() for x in held.values() if len(x.found[0]))
                    at, held = key, {}
                own = [(w["home"], w["block"]) for w in b.column("which").slice(n, 1).to_pylist()[0]]
                if cell < 0:
                    held[own[0]] = _Block(b.column("left"), n)
                else:
                    for o in own:
                        held[o].visit(b.column("right"), n, k)
        yield from (x.rows() for x in held.values() if len(x.found[0]))

    return begin.unionByName(goes).repartition("group", "share").sortWithinPartitions("group", "share", "cell").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q", "column").orderBy("d2", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(wanted: DataFrame, rows: DataFrame, k: int, pivots: int | None = None) -> DataFrame:
    """(q, column, id, d2, value, rank): of each row of wanted (q, column, v) the k nearest of rows (id, v), ids unique, that have the column; d2 is the squared distance.

    A column of -1 asks for any row. A row is not its own neighbour (by id). Of equal distances the smaller id comes
    first. Rows that share no column are no neighbours, so there may be fewer than k.
    """
    dealt, cells = celled(rows, pivots)
    shares = max(1, -(-int(cells.have[:, -1].sum()) // SENT))
    right = _packed(dealt, "cell", "id", "v", name="right").withColumn("share", F.pmod(F.xxhash64("cell", "block"), F.lit(shares)).cast("long")).drop("block")
    asked = checkpointed(_asked(wanted, cells), "wanted")
    left = _packed(asked, "home", "q", "column", "v", name="left").join(F.broadcast(_groups(asked, cells)), "home")

    def visits(second: bool):
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x = _matrix(b.v)
                d = cells.distances(x)
                order = d.argsort(1, kind="stable")
                have = cells.have[order, b["column"].to_numpy()[:, None]]
                # The nearest cells that hold k candidates besides the row itself.
                first = np.zeros(d.shape, bool)
                np.put_along_axis(first, order, np.cumsum(have, 1) - have < k + 1, 1)
                go = first if not second else ~first & (cells.least(x) ** 2 <= b.bound.to_numpy()[:, None] * (1 + SLACK))
                i, cell = np.nonzero(go)
                yield b.iloc[i][["home", "block"]].assign(cell=cell).drop_duplicates()

        return run

    schema = "home int, block long, cell int"
    goes = checkpointed(asked.mapInPandas(visits(False), schema).distinct(), "visits")
    grouped = lambda v: v.join(F.broadcast(_groups(asked, cells)), "home")
    one = _best(_nearest_in(grouped(goes), left, right, k, shares), k)
    if len(cells.pivots) == 1:
        return one
    one = checkpointed(one, "nearest")
    bounds = one.groupBy("q", "column").agg(F.when(F.count("*") == k, F.max("d2")).alias("bound"))
    bounded = asked.join(bounds, ["q", "column"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    more = bounded.mapInPandas(visits(True), schema).distinct().join(goes, ["home", "block", "cell"], "left_anti")
    two = _nearest_in(grouped(more), left, right, k, shares)
    return _best(one.drop("rank").unionByName(two), k)


def _groups(asked: DataFrame, cells: Cells) -> DataFrame:
    """(home, group): homes whose pivots are near each other along the line of most spread, of about HELD wanted rows together."""
    counts = {r.home: r.n for r in asked.groupBy("home").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    p = cells.pivots - cells.pivots.mean(0)
    line = p @ np.linalg.eigh(p.T @ p)[1][:, -1] if p.shape[1] else np.zeros(len(p))
    rows, group, total = [], 0, 0
    for home in np.argsort(line, kind="stable").tolist():
        n = counts.get(home, 0)
        if total and total + n > HELD:
            group, total = group + 1, 0
        total += n
        rows.append((home, group))
    return asked.sparkSession.createDataFrame(rows, "home int, group long")


def _asked(wanted: DataFrame, cells: Cells) -> DataFrame:
    """wanted with its nearest cell and a block there: rows that are near each other visit the same cells."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[["q", "column", "v"]].assign(home=cells.distances(_matrix(b.v)).argmin(1))

    at = wanted.mapInPandas(run, "q long, column int, v array<double>, home int")
    counts = at.groupBy("home").agg(F.count("*").alias("_own"))  # a row a pivot
    return at.join(F.broadcast(counts), "home").withColumn("block", F.pmod(F.xxhash64("q", "column"), F.ceil(F.col("_own") / BLOCK))).drop("_own")


def as_rows(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v) with NaNs as nulls; rows without an id or an array are left out."""
    v = F.transform(F.col(column).cast("array<double>"), lambda x: F.when(~F.isnan(x), x))
    return df.where(F.col(id_column).isNotNull() & F.col(column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.alias("v"))


def imputed(df: DataFrame, id_column: str, column: str, k: int = 5, pivots: int | None = None) -> DataFrame:
    """(id, column, value) for each missing value: the column's mean over the k nearest rows that have it, or over all rows where no row shares a column."""
    rows = as_rows(df, id_column, column)
    gaps = F.filter(F.transform("v", lambda x, j: F.when(x.isNull(), j)), lambda j: j.isNotNull())
    wanted = rows.select(F.col("id").alias("q"), F.explode(gaps).alias("column"), "v")
    near = nearest(wanted, rows, k, pivots).groupBy("q", "column").agg(F.avg("value").alias("near"))
    means = rows.select(F.posexplode("v").alias("column", "x")).groupBy("column").agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("mean"))
    out = wanted.select("q", "column").join(near, ["q", "column"], "left").join(F.broadcast(means), "column")
    return out.select(F.col("q").alias("id"), "column", F.coalesce("near", "mean").alias("value"))


def synthetic(df: DataFrame, id_column: str, column: str, n: int, k: int = 5, seed: int = 1, pivots: int | None = None) -> DataFrame:
    """(row, base, other, value): n rows, each from a random row towards one of its k nearest ones, a random part of the way in each column.

    The random numbers are uniform(seed, row, what): the same at every run. Rows must be complete.
    """
    spark = df.sparkSession
    rows = as_rows(df, id_column, column)
    total = rows.count()
    if total < 2:
        return spark.createDataFrame([], "row int, base long, other long, value array<double>")
    few = min(k, total - 1)
    picks = spark.range(n).select(F.col("id").cast("int").alias("row")).withColumn("_n", F.floor(uniform(seed, "row", F.lit("base")) * total) + 1)
    every = rows.withColumn("_all", F.lit(1))
    order = ranges.numbered(every, ["_all"], ranges.width(every, ["_all"], "id"), "id").select("id", "v", "_n")
    base = order.join(F.broadcast(picks), "_n").select("row", F.col("id").alias("base"), "v")
    wanted = base.select(F.col("base").alias("q"), F.lit(-1).alias("column"), "v").dropDuplicates(["q"])
    near = nearest(wanted, rows, few, pivots).select(F.col("q").alias("base"), F.col("id").alias("other"), "rank")
    chosen = base.withColumn("rank", F.floor(uniform(seed, "row", F.lit("other")) * few).cast("int") + 1).join(near, ["base", "rank"])
    there = rows.select(F.col("id").alias("other"), F.col("v").alias("w")).join(F.broadcast(chosen), "other")
    parts = F.transform("v", lambda x, j: x + (F.get("w", j) - x) * uniform(seed, "row", j))
    return there.select("row", "base", "other", parts.alias("value"))
