"""Embedding near-duplicates by dual traversal of cover trees: all pairs within a distance, exactly.

Vectors of length one whose cosine is at least c lie within eps = sqrt(2 - 2c) of each other. A cover tree has nested
levels with halving radii: the centres of a level are further than its radius from each other, cover all points within
it, and stay centres on finer levels, down to the points. All levels come from one farthest-first order of the points:
the centres of a level are those that were further than its radius from all before them. Each node knows the true
largest distance to what lies under it (its covering radius), so two nodes can hold a pair only if their centres are at
most eps plus both covering radii apart. Two trees are gone through together, level by level: pairs of nodes that the
bound rules out are never opened, the others give the pairs of their children, and pairs of points that are left are
compared in double precision.

The points are dealt to cells around sampled centres and cut into blocks of a fixed size, one tree each. Pairs of cells
and then pairs of blocks are pruned in Spark by the same bound. Blocks are compared in tiles: a task holds the blocks of
two groups at most. It returns the number of links of each point and one link of a point to its component's first, so
results grow with the points and not with the pairs. Equal vectors are one point with a multiplicity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, written

THRESHOLD = 0.9
BLOCK = 1_024  # points in a block, about
CELLS = 1_000  # sampled centres at most
GROUP = 8  # blocks that a tile's side holds
SLACK = 1e-6  # of distances in double precision
MARGIN = 1e-4  # of products in single precision, which only rule out
FINEST = 2.0**-12  # below this radius the next level is the points themselves


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


class CoverTree:
    """Points of length one in farthest-first order, so that each level's centres are a prefix.

    sizes: how many centres each level has, from one to all; parents: of each level's nodes the node of the level above;
    radii: of each node the largest distance to a point under it (the last level's are 0).
    """

    def __init__(self, x: np.ndarray):
        n, apart = len(x), distances(x, x)
        np.fill_diagonal(apart, 0)
        order, inserted, nearest = [0], [np.inf], apart[0].copy()
        for _ in range(n - 1):
            nearest[order[-1]] = -1
            far = int(np.argmax(nearest))
            order.append(far)
            inserted.append(float(nearest[far]))
            np.minimum(nearest, apart[far], out=nearest)
        self.order = np.array(order)
        self.points, apart, far = x[self.order], apart[np.ix_(self.order, self.order)], np.array(inserted)
        self.sizes, radius = [1], 1.0
        while self.sizes[-1] < n and radius >= FINEST:
            size = int((far > radius).sum())
            if size > self.sizes[-1]:
                self.sizes.append(size)
            radius /= 2
        if self.sizes[-1] < n:
            self.sizes.append(n)
        self.parents = [np.zeros(1, np.int64)]
        for above, size in zip(self.sizes, self.sizes[1:], strict=False):
            up = np.argmin(apart[:size, :above], axis=1)
            up[:above] = np.arange(above)
            self.parents.append(up)
        self.radii, node = [], np.arange(n)
        for k in range(len(self.sizes) - 1, -1, -1):
            if k < len(self.sizes) - 1:
                node = self.parents[k + 1][node]
            most = np.zeros(self.sizes[k])
            np.maximum.at(most, node, apart[np.arange(n), node])
            self.radii.append(most)
        self.radii.reverse()
        self.single = self.points.astype(np.float32)

    def dump(self) -> bytes:
        return pickle.dumps((self.order, self.points, self.sizes, self.parents, self.radii))

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        own = cls.__new__(cls)
        own.order, own.points, own.sizes, own.parents, own.radii = pickle.loads(data)
        own.single = own.points.astype(np.float32)
        return own


def close(a: CoverTree, b: CoverTree, eps: float, threshold: float, pruned: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), in the trees' order, of the points of a and b with cosine >= threshold. pruned gets the number of node pairs ruled out above the points."""
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(len(a.sizes), len(b.sizes))):
        sides = []
        for t, own in ((a, i), (b, j)):
            # The tree that has come to its points waits there for the other one.
            k = min(level, len(t.sizes) - 1)
            opened = 0 < level == k
            sides.append((k, t.parents[k] if opened else np.arange(t.sizes[k]), own))
        (ka, up_a, _), (kb, up_b, _) = sides
        if level:
            # Of each pair of nodes that is left, all pairs of children, as a table of the two levels' nodes.
            left = np.zeros((int(up_a.max()) + 1, int(up_b.max()) + 1), bool)
            left[i, j] = True
            rows, columns = np.flatnonzero(left.any(1)[up_a]), np.flatnonzero(left.any(0)[up_b])
            open_ = left[np.ix_(up_a[rows], up_b[columns])]
        else:
            rows, columns, open_ = np.arange(a.sizes[0]), np.arange(b.sizes[0]), np.ones((1, 1), bool)
        last = ka == len(a.sizes) - 1 and kb == len(b.sizes) - 1
        if last and len(i) * 16 < len(rows) * len(columns):  # few pairs of parents are left: only their children's products
            x, y = np.nonzero(open_)
            i, j = rows[x], columns[y]
            break
        ra, rb = a.radii[ka][rows], b.radii[kb][columns]
        if not last and eps + ra.min(initial=2) + rb.min(initial=2) >= 2:
            near = open_  # no two points are further apart
        else:
            # distance <= bound, as products: dot >= 1 - bound ** 2 / 2
            dots = a.single[rows] @ b.single[columns].T
            least = np.add.outer((ra + eps).astype(np.float32), rb.astype(np.float32))
            least *= least
            least *= np.float32(-0.5)
            least += np.float32(1 - MARGIN)
            near = dots >= least
            near &= open_
        if last:
            x, y = np.nonzero(near)
            i, j = rows[x], columns[y]
            break
        if pruned is not None:
            pruned.append(int(open_.sum() - near.sum()))
        x, y = np.nonzero(near)
        i, j = rows[x], columns[y]
        if not len(i):
            return i, j
    exact = np.concatenate([np.einsum("ij,ij->i", a.points[i[k : k + 100_000]], b.points[j[k : k + 100_000]]) >= threshold for k in range(0, len(i), 100_000)] or [np.zeros(0, bool)])
    return i[exact], j[exact]


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0..n-1 is connected with by links (a, b)."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def as_doubles() -> Column:
    return F.transform("embedding", lambda x: x.cast("double"))


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, k1, k2): v as doubles and its hash of 128 bits; both null for a vector that links with nothing."""
    usable = F.expr("embedding is not null and vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    own = vectors.select("vec_id", F.when(usable, as_doubles()).alias("v"))
    return own.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(1))), "k2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(2), "v"))})


def units(vectors: DataFrame) -> DataFrame:
    """(point, least, copies, k1, k2, dim, unit array<double>), written: each different vector once, scaled to length one; least is its smallest vec_id."""
    own = keyed(vectors).where("v is not null")
    groups = own.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    one = own.withColumnRenamed("vec_id", "least").join(groups, ["k1", "k2", "least"]).dropDuplicates(["k1", "k2"])
    # Scaled by the largest component first, so that no square overflows or vanishes.
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = one.withColumn("most", most).withColumn("s", F.transform("v", lambda x: x / F.col("most")))
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    scaled = scaled.withColumn("length", length).select(F.monotonically_increasing_id().alias("point"), "least", "copies", "k1", "k2", F.size("v").alias("dim"), F.transform("s", lambda x: x / F.col("length")).alias("unit"))
    return written(scaled, "points")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column])


def blocks(points: DataFrame, n: int, seed: int = 5) -> DataFrame:
    """(dim, cell, piece, middle, radius, ids, copies, tree), written: the points of a cell (nearest to the same sampled centre) in pieces of about BLOCK points."""
    wanted = max(1, min(-(-n // (BLOCK * GROUP)), CELLS))
    # The centres are a bounded sample; every point goes to the nearest one of its own length.
    sample = points.orderBy(F.xxhash64("point", F.lit(seed)), "point").limit(wanted).select("dim", "unit").toPandas()
    centres = {d: _matrix(g.unit) for d, g in sample.groupby("dim")}

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = np.zeros(len(b), np.int64)
            for d, at in b.groupby("dim").indices.items():
                if d in centres:
                    near[at] = np.argmax(_matrix(b.unit.iloc[at]) @ centres[d].T, axis=1)
            yield pd.DataFrame({"point": b.point, "cell": near})

    cells = points.select("point", "dim", "unit").mapInPandas(assign, "point long, cell long")
    placed = written(points.select("point", "copies", "dim", "unit").join(written(cells, "cells"), "point"), "placed")
    pieces = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("pieces"))
    cut = placed.join(pieces, ["dim", "cell"]).withColumn("piece", F.pmod(F.xxhash64("point"), F.col("pieces")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.unit)
        middle = x.mean(0)
        middle = middle / (np.linalg.norm(middle) or 1)
        radius = float(np.linalg.norm(x - middle, axis=1).max())
        return pd.DataFrame({"dim": [pdf.dim.iloc[0]], "cell": [pdf.cell.iloc[0]], "piece": [pdf.piece.iloc[0]], "middle": [middle], "radius": [radius], "ids": [pdf.point.to_numpy(np.int64).tobytes()], "copies": [pdf.copies.to_numpy(np.int64).tobytes()], "tree": [CoverTree(x).dump()]})

    packed = written(cut.groupBy("dim", "cell", "piece").applyInPandas(pack, "dim int, cell long, piece long, middle array<double>, radius double, ids binary, copies binary, tree binary"), "blocks")
    discard(placed)
    return packed


def near_balls(a: str, b: str, eps: float) -> Column:
    """Whether two balls (middle, radius) may hold a pair."""
    away = F.sqrt(F.aggregate(F.zip_with(f"{a}.middle", f"{b}.middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return away <= F.lit(eps + SLACK) + F.col(f"{a}.radius") + F.col(f"{b}.radius")


def tiles(packed: DataFrame, eps: float) -> DataFrame:
    """(tile, side, dim, cell, piece): which blocks meet in which tile, for the pairs of blocks that the bounds leave.

    Cells first (CELLS a length at most, each a ball about the middle of its first block), then the blocks of the cells that
    are left. A tile holds GROUP blocks of each of its two sides.
    """
    own = packed.select("dim", "cell", "piece", "middle", "radius")
    first = own.groupBy("dim", "cell").agg(F.min("piece").alias("piece"))
    middles = own.join(first, ["dim", "cell", "piece"]).select("dim", "cell", "middle")
    reach = F.sqrt(F.aggregate(F.zip_with("b.middle", "c.middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) + F.col("b.radius")
    balls = own.alias("b").join(middles.alias("c"), ["dim", "cell"]).groupBy("dim", "cell").agg(F.max(reach).alias("radius")).join(middles, ["dim", "cell"])
    balls = written(balls.select("dim", "cell", F.struct("middle", "radius").alias("ball")), "balls")
    x, y = (balls.select("dim", F.col("cell").alias(f"cell_{s}"), F.col("ball").alias(f"ball_{s}")) for s in "ab")
    cells = x.join(y, "dim").where((F.col("cell_a") <= F.col("cell_b")) & near_balls("ball_a", "ball_b", eps)).select("dim", "cell_a", "cell_b")
    x, y = (own.select("dim", F.col("cell").alias(f"cell_{s}"), F.col("piece").alias(f"piece_{s}"), F.struct("middle", "radius").alias(f"ball_{s}")) for s in "ab")
    pairs = cells.join(x, ["dim", "cell_a"]).join(y, ["dim", "cell_b"])
    pairs = pairs.where(((F.col("cell_a") < F.col("cell_b")) | (F.col("piece_a") <= F.col("piece_b"))) & near_balls("ball_a", "ball_b", eps))
    tile = F.concat_ws("-", "dim", "cell_a", F.floor(F.col("piece_a") / GROUP), "cell_b", F.floor(F.col("piece_b") / GROUP))
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"cell_{s}").alias("cell"), F.col(f"piece_{s}").alias("piece")) for k, s in enumerate("ab")])
    return pairs.select("dim", tile.alias("tile"), F.explode(sides).alias("own")).select("tile", "own.side", "dim", "own.cell", "own.piece").distinct()


def compared(pdf: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """A tile: (a, b, links): links of each point a (b null), and links (a, b) that connect its components."""
    eps = float(np.sqrt(2 - 2 * threshold))
    names = pdf.cell.astype(str) + "-" + pdf.piece.astype(str)
    sides = [sorted(set(names[pdf.side == s])) for s in (0, 1)]
    own = pdf.assign(name=names).drop_duplicates("name").set_index("name")
    trees = {k: CoverTree.load(u) for k, u in own.tree.items()}
    ids = {k: np.frombuffer(u, np.int64)[trees[k].order] for k, u in own.ids.items()}
    copies = {k: np.frombuffer(u, np.int64)[trees[k].order] for k, u in own.copies.items()}
    starts = dict(zip(trees, np.cumsum([0, *map(len, ids.values())])[:-1].tolist(), strict=True))
    counts = {k: np.zeros(len(u), np.int64) for k, u in ids.items()}
    links: list[tuple[np.ndarray, np.ndarray]] = []
    # Within one group, pairs are met from both sides: each is taken once.
    one_group = bool(set(sides[0]) & set(sides[1])) or sides[0] == sides[1]
    seen = set()
    for p in sides[0]:
        for q in sides[1]:
            if one_group and (q, p) in seen:
                continue
            seen.add((p, q))
            i, j = close(trees[p], trees[q], eps, threshold)
            if p == q:
                i, j = i[i < j], j[i < j]
            counts[p] += np.bincount(i, copies[q][j], len(ids[p])).astype(np.int64)
            counts[q] += np.bincount(j, copies[p][i], len(ids[q])).astype(np.int64)
            links.append((i + starts[p], j + starts[q]))
    every = np.concatenate(list(ids.values()))
    total = np.concatenate(list(counts.values()))
    label = labels(len(every), *(np.concatenate(x) for x in zip(*links, strict=True)))
    linked, joined = np.flatnonzero(total), np.flatnonzero(label != np.arange(len(every)))
    rows = pd.DataFrame({"a": every[linked], "b": pd.array([None] * len(linked), "Int64"), "links": total[linked]})
    edges = pd.DataFrame({"a": every[joined], "b": pd.array(every[label[joined]], "Int64"), "links": np.zeros(len(joined), np.int64)})
    return pd.concat([rows, edges], ignore_index=True)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other vectors with cosine >= threshold), component_id, kept.

    A vector that is null, empty, zero or holds null or non-finite components links with nothing, as do vectors of
    another length; a row without vec_id has no component. Rows that share a vec_id are compared each for itself. Equal
    vectors (by a hash of 128 bits) are linked. Empty vectors give no rows; further columns are ignored.
    """
    points = units(vectors.select("vec_id", "embedding"))
    n = points.count()
    if n:
        packed = blocks(points, n)
        plan = tiles(packed, float(np.sqrt(2 - 2 * threshold)))
        found = written(plan.join(packed.drop("middle", "radius"), ["dim", "cell", "piece"]).groupBy("tile").applyInPandas(lambda pdf: compared(pdf, threshold), "a long, b long, links long"), "near")
        discard(packed)
    else:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, links long")
    parts = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "point")
    links = found.where("b is null").groupBy(F.col("a").alias("point")).agg(F.sum("links").alias("others"))
    own = points.select("point", "least", "copies", "k1", "k2").join(links, "point", "left").join(parts, "point", "left").withColumn("part", F.coalesce("component", "point"))
    least = own.where("component is not null").groupBy("part").agg(F.min("least").alias("component_id"))
    own = own.join(least, "part", "left").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component_id", "least").alias("first"))
    out = keyed(vectors.select("vec_id", "embedding")).drop("v").join(own, ["k1", "k2"], "left")
    component = F.coalesce("first", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
