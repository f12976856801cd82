"""Clustering of profile matrices: k-means of several kinds, hierarchical trees, validity, and the search over k.

The matrix has one row a series (or object). k-means to at most sqrt(n) centres, then a tree over the centres only,
keeps distances between all rows out of it; every smaller k is a cut of the one tree. spark_kmeans() does the first
step on a DataFrame where the rows are too many for one machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from math import floor, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import blocks, knee, principal_components


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator, spread: bool) -> np.ndarray:
    if not spread:
        return x[rng.choice(len(x), k, replace=False)]
    chosen = [x[rng.integers(len(x))]]
    norms, twice = (x**2).sum(1)[:, None], 2 * x
    to = lambda row: np.maximum(norms + (row[None] ** 2).sum(1)[None] - twice @ row[None].T, 0)[:, 0]
    d = to(chosen[0])
    while len(chosen) < k:
        at = rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))
        chosen.append(x[at])
        d = np.minimum(d, to(x[at]))
    return np.array(chosen)


def lloyd(x: np.ndarray, k: int, iterations: int = 100, spread: bool = True, seed: int = 1) -> np.ndarray:
    """Labels by k-means; an empty cluster takes the row farthest from its centre."""
    centres = _seeds(x, k, np.random.default_rng(seed), spread)
    labels, step = np.full(len(x), -1), max(1, AT_ONCE // k)
    for _ in range(iterations):
        new, low = np.zeros(len(x), int), np.zeros(len(x))
        for a in range(0, len(x), step):
            d = squared(x[a : a + step], centres)
            new[a : a + step], low[a : a + step] = d.argmin(1), d.min(1)
        for c in np.setdiff1d(np.arange(k), new):
            far = low.argmax()
            new[far], low[far] = c, 0
        if (new == labels).all():
            break
        labels = new
        centres = np.stack([x[labels == c].mean(0) for c in range(k)])
    return labels


def hartigan(x: np.ndarray, k: int, iterations: int = 10, seed: int = 1) -> np.ndarray:
    """k-means by moving single rows wherever that lowers the total spread, from Lloyd's first assignment."""
    labels = lloyd(x, k, 1, True, seed)
    sizes = np.bincount(labels, minlength=k).astype(float)
    sums = np.stack([x[labels == c].sum(0) for c in range(k)])
    means = sums / sizes[:, None]
    for _ in range(iterations):
        moved = False
        for i, row in enumerate(x):
            own = labels[i]
            if sizes[own] <= 1:
                continue
            d = ((means - row) ** 2).sum(1)
            cost = d * sizes / (sizes + 1)
            cost[own] = d[own] * sizes[own] / (sizes[own] - 1)
            best = int(cost.argmin())
            if cost[best] < cost[own] - 1e-12:
                sizes[own] -= 1
                sizes[best] += 1
                sums[own] -= row
                sums[best] += row
                means[own], means[best] = sums[own] / sizes[own], sums[best] / sizes[best]
                labels[i], moved = best, True
        if not moved:
            break
    return labels


def bisecting(x: np.ndarray, k: int, iterations: int = 100, spread: bool = True, seed: int = 1) -> np.ndarray:
    """Splits the cluster with the largest spread in two until there are k."""
    labels = np.zeros(len(x), int)
    for c in range(1, k):
        spread_of = [((x[m] - x[m].mean(0)) ** 2).sum() if (m := labels == i).sum() > 1 else -1.0 for i in range(c)]
        rows = np.flatnonzero(labels == int(np.argmax(spread_of)))
        labels[rows[lloyd(x[rows], 2, iterations, spread, seed + c) == 1]] = c
    return labels


def shape_distance(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(1 - largest normalized cross-correlation with the centre, the shift that gives it) of each row."""
    n = x.shape[1]
    size = 1 << (2 * n - 1).bit_length()
    cc = np.fft.irfft(np.fft.rfft(x, size, axis=1) * np.conj(np.fft.rfft(centre, size)), size, axis=1)
    cc = np.concatenate((cc[:, -(n - 1) :], cc[:, :n]), axis=1) if n > 1 else cc[:, :1]
    norm = np.linalg.norm(x, axis=1) * np.linalg.norm(centre)
    cc = cc / np.where(norm > 0, norm, 1)[:, None]
    return 1 - cc.max(1), cc.argmax(1) - (n - 1)


def kshape(x: np.ndarray, k: int, iterations: int = 20, seed: int = 1) -> np.ndarray:
    """Clusters by shape: rows are standardized, aligned to their centre, which is the shape that correlates most."""
    z = x - x.mean(1, keepdims=True)
    z = z / np.where((s := z.std(1, keepdims=True)) > 0, s, 1)
    labels = np.random.default_rng(seed).permutation(np.arange(len(x)) % k)
    centres = np.zeros((k, x.shape[1]))
    for _ in range(iterations):
        for c in range(k):
            rows = z[labels == c]
            if len(rows):
                _, shifts = shape_distance(rows, centres[c]) if centres[c].any() else (None, np.zeros(len(rows), int))
                aligned = np.stack([np.concatenate((r[s:], np.zeros(s))) if s >= 0 else np.concatenate((np.zeros(-s), r[:s])) for r, s in zip(rows, shifts, strict=True)])
                _, _, v = np.linalg.svd(aligned - aligned.mean(1, keepdims=True), full_matrices=False)
                centres[c] = v[0] * (1 if (aligned @ v[0]).sum() >= 0 else -1)
        new = np.stack([shape_distance(z, c)[0] for c in centres], 1).argmin(1)
        if (new == labels).all():
            break
        labels = new
    return labels


KMEANS: dict[str, Callable[[np.ndarray, int, int, int], np.ndarray]] = {
    "kmeans": lambda x, k, n, seed: lloyd(x, k, n, False, seed),
    "kmeans++": lambda x, k, n, seed: lloyd(x, k, n, True, seed),
    "bisect": lambda x, k, n, seed: bisecting(x, k, n, False, seed),
    "bisect++": lambda x, k, n, seed: bisecting(x, k, n, True, seed),
    "hartigan": hartigan,
    "kshape": kshape,
}

#: Lance and Williams' coefficients: (a_i, a_j, b, c) from the sizes of i, j and the other cluster.
LINKAGES: dict[str, Callable[[float, float, float], tuple[float, float, float, float]]] = {
    "single": lambda i, j, o: (0.5, 0.5, 0.0, -0.5),
    "complete": lambda i, j, o: (0.5, 0.5, 0.0, 0.5),
    "average": lambda i, j, o: (i / (i + j), j / (i + j), 0.0, 0.0),
    "weighted": lambda i, j, o: (0.5, 0.5, 0.0, 0.0),
    "centroid": lambda i, j, o: (i / (i + j), j / (i + j), -i * j / (i + j) ** 2, 0.0),
    "median": lambda i, j, o: (0.5, 0.5, -0.25, 0.0),
    "ward": lambda i, j, o: ((i + o) / (i + j + o), (j + o) / (i + j + o), -o / (i + j + o), 0.0),
}


SQUARED = ("centroid", "median", "ward")  # whose formula is on squared distances
MATRIX_ROWS = 1_000  # whose distances are held as a matrix (8 MB)
KEPT_BYTES = 128 << 20  # of sums that are kept for large clusters of a tree without a matrix
AT_ONCE = 1 << 20  # distances that are held at a time beside them
Near = tuple[np.ndarray, np.ndarray, np.ndarray]  # of each row the nearest other one, its squared distance, and one that all others have at least


def linkage(x: np.ndarray, method: str = "ward", matrix_rows: int = MATRIX_ROWS, near: Near | None = None) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of an agglomerative tree; the m-th merge makes cluster n + m.

    Up to matrix_rows by Lance and Williams' formula on the matrix of distances. Of more rows the same tree comes from the
    rows themselves, in memory that grows with the rows and not with their square; merges of equal height may then come in
    another order, as rounding differs. near are the rows' nearest ones, where they are known.
    """
    if len(x) <= matrix_rows:
        return _linkage_of_matrix(x, method)
    return _linkage_of_centres(x, method, near) if method in ("centroid", "median") else _linkage_of_rows(x, method)


def _linkage_of_matrix(x: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    n, square = len(x), method in SQUARED
    d = np.empty((n, n))
    for a, z in blocks(n):
        d[a:z] = squared(x[a:z], x) if square else np.sqrt(squared(x[a:z], x))
    return _linkage_of_distances(d, np.ones(n), method)


def _linkage_of_distances(d: np.ndarray, sizes: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    """Of clusters of these sizes from their distances (squared ones for SQUARED), which are written over."""
    n, square = len(d), method in SQUARED
    np.fill_diagonal(d, np.inf)
    ids, sizes, alive, out = list(range(n)), sizes.copy(), np.ones(n, bool), []
    # Of each row the nearest other one (of equal ones the first) and its distance, kept up to date.
    near = d.argmin(1) if n else np.zeros(0, int)
    low = d[np.arange(n), near]
    for m in range(n - 1):
        i = int(low.argmin())
        i, j = sorted((i, int(near[i])))
        h = d[i, j]
        out.append((*sorted((ids[i], ids[j])), float(sqrt(max(h, 0))) if square else float(h)))
        alive[i] = alive[j] = False
        o = np.flatnonzero(alive)
        a, b, c, e = LINKAGES[method](sizes[i], sizes[j], sizes[o])
        new = a * d[i, o] + b * d[j, o] + c * h + e * np.abs(d[i, o] - d[j, o])
        d[i, o] = d[o, i] = new
        alive[i], ids[i] = True, n + m
        sizes[i] += sizes[j]
        d[j], d[:, j] = np.inf, np.inf
        stale = (near[o] == i) | (near[o] == j)
        closer = ~stale & ((new < low[o]) | (new == low[o]) & (i < near[o]))
        near[o[closer]], low[o[closer]], low[j] = i, new[closer], np.inf
        for r in (i, *o[stale]):
            near[r] = d[r].argmin()
            low[r] = d[r, near[r]]
    return out


class _Centres:
    """Distances (squared) of clusters that follow from their centres and sizes: centroid, median, ward."""

    def __init__(self, x: np.ndarray, method: str):
        self.method, self.x, self.sizes = method, x.copy(), np.ones(len(x))
        self.norms = (x**2).sum(1)

    def row(self, i: int) -> np.ndarray:
        d = np.maximum(self.norms + self.norms[i] - 2 * (self.x @ self.x[i]), 0)
        return d * (2 * self.sizes[i] * self.sizes / (self.sizes[i] + self.sizes)) if self.method == "ward" else d

    def merge(self, i: int, j: int) -> None:
        """j into i."""
        a, b = (0.5, 0.5) if self.method == "median" else (self.sizes[i], self.sizes[j])
        self.x[i] = (a * self.x[i] + b * self.x[j]) / (a + b)
        self.norms[i] = (self.x[i] ** 2).sum()
        self.sizes[i] += self.sizes[j]

    def compress(self, slots: np.ndarray) -> None:
        self.x, self.norms, self.sizes = self.x[slots], self.norms[slots], self.sizes[slots]


class _Members:
    """Distances of clusters that follow from those of their members: the least, the most, or a mean by weight.

    What a cluster's members have to each row in common (least, most or weighted sum) is kept for clusters of so many
    members that all of them take KEPT_BYTES at most, and made from the members of smaller ones each time.
    """

    def __init__(self, x: np.ndarray, method: str):
        n = len(x)
        self.method, self.x, self.norms = method, x, (x**2).sum(1)
        self.sizes, self.weights, self.slot = np.ones(n), np.ones(n), np.arange(n)
        self.members = [np.array([i]) for i in range(n)]
        self.kept: dict[int, np.ndarray] = {}
        self.least = max(2, -(-8 * n * n // KEPT_BYTES))

    def common(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        own, out, step = self.members[i], None, max(1, AT_ONCE // len(self.x))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            d = self.x[part] @ self.x.T
            d *= -2
            d += self.norms
            d += self.norms[part][:, None]
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            d = d.min(0) if self.method == "single" else d.max(0) if self.method == "complete" else self.weights[part] @ d
            out = d if out is None else self.both(out, d)
        return out

    def both(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a, b) if self.method == "single" else np.maximum(a, b) if self.method == "complete" else a + b

    def row(self, i: int) -> np.ndarray:
        common, k = self.common(i), len(self.sizes)
        if self.method == "average":
            return np.bincount(self.slot, common, k) / (self.sizes[i] * self.sizes)
        if self.method == "weighted":
            return np.bincount(self.slot, self.weights * common, k)
        out = np.full(k, np.inf if self.method == "single" else -np.inf)
        (np.minimum if self.method == "single" else np.maximum).at(out, self.slot, common)
        return out

    def merge(self, i: int, j: int) -> None:
        own = np.concatenate((self.members[i], self.members[j]))
        if len(own) >= self.least:
            total = self.both(self.common(i), self.common(j))
            self.kept.pop(j, None)
            self.kept[i] = total / 2 if self.method == "weighted" else total
        if self.method == "weighted":
            self.weights[own] /= 2
        self.slot[self.members[j]] = i
        self.members[i], self.members[j] = own, own[:0]
        self.sizes[i] += self.sizes[j]

    def compress(self, slots: np.ndarray) -> None:
        place = np.zeros(len(self.sizes), int)
        place[slots] = np.arange(len(slots))
        self.kept = {int(place[i]): v for i, v in self.kept.items()}
        self.members, self.sizes, self.slot = [self.members[i] for i in slots], self.sizes[slots], place[self.slot]


def _nearest_two(x: np.ndarray) -> Near:
    n = len(x)
    near, low, others = np.zeros(n, int), np.zeros(n), np.zeros(n)
    norms, step = (x**2).sum(1), max(1, AT_ONCE // max(1, n))
    for a in range(0, n, step):
        d = x[a : a + step] @ x.T
        d *= -2
        d += norms
        d += norms[a : a + step, None]
        np.maximum(d, 0, out=d)
        i = np.arange(len(d))
        d[i, a + i] = np.inf
        near[a : a + step] = at = d.argmin(1)
        low[a : a + step] = d[i, at]
        d[i, at] = np.inf
        others[a : a + step] = d.min(1)
    return near, low, others


def _linkage_of_rows(x: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    """Of each cluster the nearest other one is known, or else only a bound: none is nearer than low.

    A merge changes the distances to the new cluster alone. Clusters that lose their nearest one go on with the distance
    that all others had at least (others), and look for it anew only when no bound is lower.
    """
    n, square = len(x), method in SQUARED
    space = _Centres(x, method) if square else _Members(x, method)
    near, low, others = _nearest_two(x)
    if not square:
        low, others = np.sqrt(low), np.sqrt(others)
    ids, alive, out = np.arange(n), np.ones(n, bool), []

    def look(i: int) -> np.ndarray:
        d = space.row(i)
        d[~alive] = d[i] = np.inf
        near[i] = d.argmin()
        low[i], d[near[i]] = d[near[i]], np.inf
        others[i] = d.min()
        d[near[i]] = low[i]
        return d

    for m in range(n - 1):
        while near[r := int(low.argmin())] < 0:
            look(r)
        i, j = sorted((r, int(near[r])))
        h = low[r]
        out.append((*sorted((int(ids[i]), int(ids[j]))), float(sqrt(max(h, 0))) if square else float(h)))
        space.merge(i, j)
        alive[j], ids[i], low[j] = False, n + m, np.inf
        lost = (near == i) | (near == j)
        d = look(i)
        own = near[i], low[i], others[i]
        bound = np.where(lost, others, low)
        closer = (d < bound) | (d == bound) & (lost | (i < near))
        others = np.where(closer, bound, np.minimum(others, d))
        near = np.where(closer, i, np.where(lost, -1, near))
        low = np.where(closer, d, bound)
        near[i], low[i], others[i] = own
        low[j] = np.inf
        if 2 * (n - 1 - m) < len(alive):
            slots = np.flatnonzero(alive)
            space.compress(slots)
            place = np.full(len(alive), -1)
            place[slots] = np.arange(len(slots))
            near, low, others, ids, alive = np.where(near < 0, -1, place[near])[slots], low[slots], others[slots], ids[slots], alive[slots]
    return out


def _linkage_of_centres(x: np.ndarray, method: str, near: Near | None = None) -> list[tuple[int, int, float]]:
    """_linkage_of_rows() of centroid and median, where one cluster (hub) often takes most of the others one by one.

    The hub stands outside of what is known of the others: they keep the nearest one beside it (-1: not known) and a bound, which
    stay right when the hub takes clusters. So such a merge needs the distances from the hub only. They come from single
    precision; those within its error of the least are found again in double precision.
    """
    n, space = len(x), _Centres(x, method)
    near, low, others = (a.copy() for a in near or _nearest_two(x))
    ids, alive, out = np.arange(n), np.ones(n, bool), []
    plain, norms = x.astype(np.float32), space.norms.astype(np.float32)  # norms: infinite of clusters that are gone and of the hub
    error = 4 * (x.shape[1] + 8) * float(np.finfo(np.float32).eps) * float(space.norms.max(initial=0))  # centres are no longer than the longest row
    hub, last, best, best_d = -1, -1, -1, np.inf

    def look(i: int) -> np.ndarray:
        d = space.row(i)
        d[~alive] = d[i] = np.inf
        if hub >= 0:
            d[hub] = np.inf
        near[i] = d.argmin()
        low[i], d[near[i]] = d[near[i]], np.inf
        others[i] = d.min()
        d[near[i]] = low[i]
        return d

    def enter(i: int) -> None:
        """i is new beside the hub."""
        nonlocal near, low, others
        lost = near == i
        d = look(i)
        own = near[i], low[i], others[i]
        bound = np.where(lost, others, low)
        closer = (d < bound) | (d == bound) & (lost | (i < near))
        others = np.where(closer, bound, np.minimum(others, d))
        near = np.where(closer, i, np.where(lost, -1, near))
        low = np.where(closer, d, bound)
        near[i], low[i], others[i] = own

    def nearest_to_hub() -> tuple[int, float]:
        d = plain @ plain[hub]
        d *= -2
        d += norms
        least = d.min()
        at = np.flatnonzero(d <= least + 2 * error) if np.isfinite(least) else np.zeros(0, int)
        if not len(at):
            return -1, np.inf
        exact = np.maximum(space.norms[at] + space.norms[hub] - 2 * (space.x[at] @ space.x[hub]), 0)
        return int(at[exact.argmin()]), float(exact.min())

    for m in range(n - 1):
        while True:
            r = int(low.argmin())
            if best >= 0 and best_d <= low[r]:
                i, j, h = *sorted((hub, best)), best_d
                break
            if near[r] >= 0 and alive[near[r]]:
                i, j, h = *sorted((r, int(near[r]))), low[r]
                break
            if near[r] >= 0 and others[r] > low[r]:  # the hub took it
                near[r], low[r] = -1, others[r]
            else:
                look(r)
        out.append((*sorted((int(ids[i]), int(ids[j]))), float(sqrt(max(h, 0)))))
        grows = hub in (i, j)
        if grows:
            i, j = hub, best
        space.merge(i, j)
        alive[j], ids[i], near[j], low[j], norms[j] = False, n + m, -1, np.inf, np.inf
        plain[i] = space.x[i]
        if not grows:
            if last in (i, j):  # it grows again: the new hub
                old, hub = hub, i
                near, low = np.where(near == i, -1, near), np.where(near == i, others, low)
                near[i], low[i], norms[i] = -1, np.inf, np.inf
                if old >= 0:
                    norms[old] = space.norms[old]
                    enter(old)
            else:
                norms[i] = space.norms[i]
                near, low = np.where(near == j, -1, near), np.where(near == j, others, low)
                enter(i)
                if hub >= 0:
                    d = max(space.norms[i] + space.norms[hub] - 2 * (space.x[i] @ space.x[hub]), 0)
                    if best in (i, j):
                        best, best_d = nearest_to_hub()
                    elif d < best_d:
                        best, best_d = i, float(d)
        last = i
        if hub == i:
            best, best_d = nearest_to_hub()
        if 2 * (n - 1 - m) < len(alive):
            slots = np.flatnonzero(alive)
            space.compress(slots)
            place = np.full(len(alive) + 1, -1)
            place[slots] = np.arange(len(slots))
            near, low, others, ids, alive, plain, norms = place[near][slots], low[slots], others[slots], ids[slots], alive[slots], plain[slots], norms[slots]
            hub, last, best = (int(place[a]) for a in (hub, last, best))
    return out


#: Methods whose merges never bring clusters nearer to others: all pairs that are each other's nearest can merge at once.
IN_ROUNDS = ("single", "complete", "average", "weighted", "ward")
ROUND_CELLS, PIECE = 1 << 18, 32  # distances of a round that a task holds at a time, and rows of a cluster that are folded at once
KNOWN = 32  # nearest clusters that a search lists, about
Over = Callable[[Callable, list, tuple], Iterable]
Listed = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # pairs of rows (a, b), their distance; of each row one that all others have at least


def _in_process(f: Callable, parts: list, shared: tuple) -> Iterable:
    return (f(p, *shared) for p in parts)


def linkage_in_rounds(x: np.ndarray, method: str, over: Over = _in_process, matrix_rows: int = MATRIX_ROWS, first: Listed | None = None) -> list[tuple[int, int, float]]:
    """linkage() of a method in IN_ROUNDS by rounds of searches, which over(f, parts, shared) does as f(part, *shared) for each part.

    Clusters that are each other's nearest merge at once, which gives the same tree as one merge at a time; the last
    matrix_rows clusters go by the matrix of their distances. Single linkage joins each component with its nearest row
    outside (a shortest spanning tree). A part takes about ROUND_CELLS distances at a time, so memory grows with the rows and
    time with their square. Merges of equal height may come in another order. first is nearest_rows(), where it is known.
    """
    if len(x) < 2:
        return []
    first = first or nearest_rows(x, over)
    if method in ("single", "ward"):
        near, low, _ = nearest_of(first)
        merges = _spanning(x, over, near, np.sqrt(low)) if method == "single" else _reciprocal(x, over, matrix_rows, near, low)
    else:
        merges = _listed(x, method, over, matrix_rows, first)
    return _numbered(len(x), sorted(merges, key=lambda m: m[2]))


def _numbered(n: int, merges: Iterable[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Merges of the clusters of two rows as merges of clusters by number."""
    top, ids, out = list(range(n)), list(range(n)), []

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for m, (a, b, h) in enumerate(merges):
        a, b = root(a), root(b)
        out.append((*sorted((ids[a], ids[b])), float(h)))
        top[b], ids[a] = a, n + m
    return out


def _layers(label: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in pieces of a cluster, of PIECE rows at most, the longest first: (cluster of each piece, row j of each piece or -1, length)."""
    rows = rows[np.argsort(label[rows], kind="stable")]
    own = label[rows]
    at = np.arange(len(rows)) - np.searchsorted(own, own)
    new = at % PIECE == 0
    number = np.cumsum(new) - 1
    sizes = np.bincount(number)
    order = np.argsort(-sizes, kind="stable")
    members = np.full((len(sizes), sizes.max()), -1)
    members[number, at % PIECE] = rows
    return own[new][order], members[order], sizes[order]


def _folded(d: np.ndarray, clusters: np.ndarray, fold: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """(clusters in ascending order, rows of d folded by them)."""
    order = np.argsort(clusters, kind="stable")
    found, first = np.unique(clusters[order], return_index=True)
    return found, d[order] if len(found) == len(clusters) else fold.reduceat(d[order], first, axis=0)


def _cluster_distances(own: np.ndarray, x: np.ndarray, method: str, label: np.ndarray, share: np.ndarray, sizes: np.ndarray, pieces: tuple) -> np.ndarray:
    """Distances of clusters own (ascending) to all: x are rows with the cluster and share of each, in pieces."""
    fold = np.maximum if method == "complete" else np.add
    weights = np.ones(len(x)) if method == "complete" else share**2

    # One product gives the squared distances, times the squares of both shares.
    def left(rows):
        return np.column_stack((-2 * x[rows], (x[rows] ** 2).sum(1), np.ones(len(rows)))) * weights[rows, None]

    def right(rows):
        return np.column_stack((x[rows], np.ones(len(rows)), (x[rows] ** 2).sum(1))) * weights[rows, None]

    mine, my_rows, my_sizes = _layers(label, np.flatnonzero(np.isin(label, own)))
    counts = [int((my_sizes > j).sum()) for j in range(my_rows.shape[1])]
    y = left(np.concatenate([my_rows[:m, j] for j, m in enumerate(counts)]))
    others, rows, lengths = pieces
    out, step = np.zeros((len(sizes), len(own))), max(16, ROUND_CELLS // len(y))
    for a in range(0, len(others), step):
        part, long = rows[a : a + step], lengths[a : a + step]
        sums = None
        for j in range(int(long[0])):
            m = int((long > j).sum())
            d = right(part[:m, j]) @ y.T
            np.maximum(d, 0, out=d)
            if method != "complete":
                np.sqrt(d, out=d)
            sums = d if sums is None else sums
            if j:
                fold(sums[:m], d, out=sums[:m])
        total, at = sums[:, : counts[0]], counts[0]
        for m in counts[1:]:
            fold(total[:, :m], sums[:, at : at + m], out=total[:, :m])
            at += m
        found, total = _folded(total, others[a : a + step], fold)
        total = _folded(total.T, mine, fold)[1].T
        out[found] = fold(out[found], total)
    return np.ascontiguousarray((np.sqrt(out, out=out) if method == "complete" else out).T)


def _centre_distances(own: np.ndarray, centres: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    d = centres[own] @ centres.T
    d *= -2
    d += (centres**2).sum(1)
    d += (centres[own] ** 2).sum(1)[:, None]
    np.maximum(d, 0, out=d)
    d /= 1 / sizes + 1 / sizes[own, None]
    d *= 2
    return d


def _nearest_centres(own: np.ndarray, centres: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    near, low, step = np.empty(len(own), int), np.empty(len(own)), max(1, ROUND_CELLS // len(centres))
    for a in range(0, len(own), step):
        part = own[a : a + step]
        d = _centre_distances(part, centres, sizes)
        i = np.arange(len(part))
        d[i, part] = np.inf
        near[a : a + step] = at = d.argmin(1)
        low[a : a + step] = d[i, at]
    return own, near, low


def _whole_centres(own: np.ndarray, *shared) -> tuple[np.ndarray, np.ndarray]:
    return own, _centre_distances(own, *shared)


def _whole_rows(own: np.ndarray, *shared) -> tuple[np.ndarray, np.ndarray]:
    return own, _cluster_distances(own, *shared)


def _dealt(wanted: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
    """wanted clusters in parts of about 512 rows, 16 ROUND_CELLS results at most."""
    number = np.cumsum(sizes[wanted]) // 512
    cuts = np.flatnonzero(np.diff(number)) + 1
    most = max(1, 16 * ROUND_CELLS // k)
    return [p[a : a + most] for p in np.split(wanted, cuts) for a in range(0, len(p), most)] if len(wanted) else []


def _reciprocal(x: np.ndarray, over: Over, matrix_rows: int, near: np.ndarray, low: np.ndarray) -> list[tuple[int, int, float]]:
    """Of ward, whose distances follow from the centres."""
    rep, sizes, centres, merges = np.arange(len(x)), np.ones(len(x)), x.copy(), []
    while (k := len(rep)) > max(1, matrix_rows):
        lost = np.flatnonzero(near < 0)
        for own, at, d in over(_nearest_centres, _dealt(lost, np.ones(k), k), (centres, sizes)):
            near[own], low[own] = at, d
        i = np.arange(k)
        left = i[(near[near] == i) & (i < near)]
        if not len(left):  # rounding only
            left = np.array([low.argmin()])
        right = near[left]
        merges += zip(rep[left].tolist(), rep[right].tolist(), np.sqrt(low[left]).tolist(), strict=True)
        centres[left] = (sizes[left, None] * centres[left] + sizes[right, None] * centres[right]) / (sizes[left] + sizes[right])[:, None]
        sizes[left] += sizes[right]
        changed, stays = np.zeros(k, bool), np.ones(k, bool)
        changed[left], changed[right], stays[right] = True, True, False
        place = np.cumsum(stays) - 1
        near = np.where(changed | (near < 0) | changed[near], -1, place[near])[stays]
        low, rep, sizes, centres = low[stays], rep[stays], sizes[stays], centres[stays]
    return _last(over, _whole_centres, (centres, sizes), np.ones(len(rep)), sizes, rep, "ward", merges)


def _last(over: Over, f: Callable, shared: tuple, work: np.ndarray, sizes: np.ndarray, rep: np.ndarray, method: str, merges: list) -> list[tuple[int, int, float]]:
    """The last clusters merge by the matrix of their distances."""
    k = len(rep)
    if k > 1:
        d = np.empty((k, k))
        for own, part in over(f, _dealt(np.arange(k), work, k), shared):
            d[own] = part
        rep = rep.tolist()
        for a, b, h in _linkage_of_distances((d + d.T) / 2, sizes, method):
            merges.append((rep[a], rep[b], h))
            rep.append(rep[a])
    return merges


def _below(d: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own, and of each pair the first, the second, the distance; of each own a distance that all others have at least) from the distances of own to all."""
    k = d.shape[1]
    i = np.arange(len(own))
    d[i, own] = np.inf
    bound = np.full(len(own), np.inf)
    if k - 1 > KNOWN:
        part = d[:, :: max(1, k >> 14)]  # a part of them tells about where the bound is; any bound is right
        j = max(2, KNOWN * part.shape[1] // k)
        bound = np.partition(part, j, axis=1)[:, j]
        bound[~np.isfinite(bound)] = np.inf
    mask = d < bound[:, None]
    many = np.flatnonzero(mask.sum(1) > 4 * KNOWN)
    if len(many):
        bound[many] = np.partition(d[many], KNOWN, axis=1)[:, KNOWN]
        mask[many] = d[many] < bound[many, None]
    none = np.flatnonzero(~mask.any(1))
    mask[none, d[none].argmin(1)] = True
    a, b = np.nonzero(mask)
    return own, own[a].astype(np.int32), b.astype(np.int32), d[a, b], bound


def _nearest_rows(own: np.ndarray, x: np.ndarray) -> list:
    norms, step, out = (x**2).sum(1), max(1, 2 * AT_ONCE // len(x)), []
    for a in range(0, len(own), step):
        part = own[a : a + step]
        d = x[part] @ x.T
        d *= -2
        d += norms
        d += norms[part, None]
        np.maximum(d, 0, out=d)
        _, i, j, low, bound = _below(d, part)
        out.append((part, i, j, np.sqrt(low), np.sqrt(bound)))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def nearest_rows(x: np.ndarray, over: Over = _in_process) -> Listed:
    """About KNOWN nearest rows of each row, each pair once."""
    return _pairs(over(_nearest_rows, _dealt(np.arange(len(x)), np.ones(len(x)), 1), (x,)), len(x))


def _pairs(found: Iterable, k: int, bound: np.ndarray | None = None) -> Listed:
    bound, parts = np.full(k, np.inf) if bound is None else bound, [(np.zeros(0, np.int32),) * 2 + (np.zeros(0),)]
    for own, a, b, d, low in found:
        bound[own] = low
        parts.append((np.minimum(a, b), np.maximum(a, b), d))
    a, b, d = (np.concatenate(c) for c in zip(*parts, strict=True))
    first = np.unique(a.astype(np.int64) * k + b, return_index=True)[1]
    return a[first], b[first], d[first], bound


def nearest_of(first: Listed) -> Near:
    a, b, d, bound = first
    a, b, d = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((d, d)) ** 2
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    near, low, others = np.full(len(bound), -1), np.full(len(bound), np.inf), bound**2
    head = np.flatnonzero(np.diff(a, prepend=-1))
    near[a[head]], low[a[head]] = b[head], d[head]
    second = head[np.diff(np.append(head, len(a))) > 1] + 1
    others[a[second]] = np.minimum(others[a[second]], d[second])
    return near, low, others


def _listed_clusters(own: np.ndarray, *shared) -> tuple:
    return _below(_cluster_distances(own, *shared), own)


def _pair_distances(pairs: np.ndarray, x: np.ndarray, method: str, label: np.ndarray, share: np.ndarray, *_) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (number, first, second cluster), in order of the first."""
    rows = np.argsort(label, kind="stable")
    start = np.searchsorted(label[rows], np.arange(label.max() + 2))
    norms, out = (x**2).sum(1), np.empty(len(pairs))
    head = np.flatnonzero(np.diff(pairs[:, 1], prepend=-1))
    for s, e in zip(head.tolist(), [*head[1:].tolist(), len(pairs)], strict=True):
        own = rows[start[pairs[s, 1]] : start[pairs[s, 1] + 1]]
        sizes = start[pairs[s:e, 2] + 1] - start[pairs[s:e, 2]]
        at = np.cumsum(sizes) - sizes
        other = rows[np.repeat(start[pairs[s:e, 2]] - at, sizes) + np.arange(sizes.sum())]
        total, step = None, max(1, ROUND_CELLS // len(other))
        for a in range(0, len(own), step):
            part = own[a : a + step]
            d = x[part] @ x[other].T
            d *= -2
            d += norms[other]
            d += norms[part, None]
            np.maximum(d, 0, out=d)
            if method == "complete":
                d = d.max(0)
                total = d if total is None else np.maximum(total, d)
            else:
                d = share[part] @ np.sqrt(d, out=d)
                total = d if total is None else total + d
        out[s:e] = np.sqrt(np.maximum.reduceat(total, at)) if method == "complete" else np.add.reduceat(total * share[other], at)
    return pairs[:, 0], out


def _listed(x: np.ndarray, method: str, over: Over, matrix_rows: int, first: Listed) -> list[tuple[int, int, float]]:
    """Of complete, average and weighted, with the pairs of clusters that searches have listed.

    A pair that is not listed is no nearer than the bounds of both. When clusters merge, their pairs merge by Lance and Williams'
    formula; a bound takes the place of a distance that is not listed (known: false), which is found when it may be the nearest.
    Clusters whose bound is below their listed pairs wait, and are searched together when few others can merge.
    """
    n, fold = len(x), method == "complete"
    label, rep, sizes, share, merges = np.arange(n), np.arange(n), np.ones(n), np.ones(n), []
    u, v, d, bound = first[0], first[1], first[2], first[3].copy()
    known = np.ones(len(u), bool)

    def shared() -> tuple:
        return x, method, label, share, sizes, _layers(label, np.arange(n))

    turn = 0
    while (k := len(rep)) > max(1, matrix_rows):
        low, least = np.full(k, np.inf), np.full(k, np.inf)
        np.minimum.at(low, u, d)
        np.minimum.at(low, v, d)
        np.minimum.at(least, u[known], d[known])
        np.minimum.at(least, v[known], d[known])
        sure = low <= bound
        for_u, for_v = sure[u] & (d == low[u]), sure[v] & (d == low[v])
        # Found are the least bounds, and of clusters that have them also others that are below the least distance.
        some = np.zeros(k, bool)
        some[u[for_u & ~known]] = some[v[for_v & ~known]] = True
        most = np.where(some, np.minimum((low + np.where(np.isfinite(least), least, low)) / 2, bound), -1)
        wanted = np.flatnonzero(~known & (for_u | for_v | (d <= most[u]) | (d <= most[v])))
        if len(wanted) and (turn == 0 or turn < 4 and 50 * len(wanted) > k):
            turn += 1
            work = sizes[u[wanted]] * sizes[v[wanted]] + 2_000
            order = np.argsort(u[wanted], kind="stable")
            pairs, parts = np.column_stack((wanted, u[wanted], v[wanted]))[order], max(1, min(64, int(work.sum()) >> 21))
            cuts = np.flatnonzero(np.diff(np.cumsum(work[order]) * parts // (work.sum() + 1))) + 1
            for at, found in (over if parts > 3 else _in_process)(_pair_distances, np.split(pairs, cuts), (x, method, label, share)):
                d[at], known[at] = found, True
            continue
        turn, for_u, for_v = 0, for_u & known, for_v & known
        near = np.full(k, k)
        np.minimum.at(near, u[for_u], v[for_u])
        np.minimum.at(near, v[for_v], u[for_v])
        i = np.flatnonzero(near < k)
        left = i[(near[near[i]] == i) & (i < near[i])]
        wait = np.flatnonzero(~sure)
        if 16 * len(left) < len(wait) and not len(wanted):
            a, b, e, bound = _pairs(over(_listed_clusters, _dealt(wait, sizes, k), shared()), k, bound)
            # A distance that the search didn't list is at least its bound; the other side's bound still needs the pair.
            least = np.where(sure, 0, bound)
            d = np.where(known, d, np.maximum(d, np.maximum(least[u], least[v])))
            stays = d <= np.maximum(bound[u], bound[v])
            code = np.concatenate((a.astype(np.int64) * k + b, u[stays].astype(np.int64) * k + v[stays]))
            at = np.unique(code, return_index=True)[1]
            u, v, d, known = (np.concatenate(c)[at] for c in ((a, u[stays]), (b, v[stays]), (e, d[stays]), (np.ones(len(a), bool), known[stays])))
            continue
        if not len(left) and len(wanted):
            continue
        if not len(left):  # rounding only
            at = np.where(known, d, np.inf).argmin()
            left, near[u[at]] = np.array([u[at]]), v[at]
        right = near[left]
        merges += zip(rep[left].tolist(), rep[right].tolist(), low[left].tolist(), strict=True)
        to, other, second, part = np.arange(k), np.full(k, -1), np.zeros(k, np.int64), np.ones(k)
        to[right], other[left], other[right], second[right] = left, right, left, 1
        part[left] = part[right] = 0.5
        if method == "average":
            part[left], part[right] = sizes[left] / (sizes[left] + sizes[right]), sizes[right] / (sizes[left] + sizes[right])
        share = share * part[label]
        joined = np.maximum(bound[left], bound[right]) if fold else part[left] * bound[left] + part[right] * bound[right]
        before = bound.copy()
        bound[left] = joined
        sizes[left] += sizes[right]
        stays = np.ones(k, bool)
        stays[right] = False
        place = np.cumsum(stays) - 1
        # Pairs of which a side merges: up to four stand for one.
        apart = to[u] != to[v]
        u, v, d, known = u[apart], v[apart], d[apart], known[apart]
        moved = (other[u] >= 0) | (other[v] >= 0)
        a, b = u[moved], v[moved]
        turned = to[a] > to[b]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        code, at = np.unique(to[a].astype(np.int64) * k + to[b], return_inverse=True)
        p, q = code // k, code % k
        firsts, lasts = (p, np.where(other[p] >= 0, other[p], p)), (q, np.where(other[q] >= 0, other[q], q))
        slots, weight = np.empty((4, len(code))), np.empty((4, len(code)))
        for c in range(4):
            s, t = firsts[c >> 1], lasts[c & 1]
            gone = (other[p] < 0) & bool(c >> 1) | (other[q] < 0) & bool(c & 1)
            slots[c] = np.where(gone, 0, np.maximum(before[s], before[t]))
            weight[c] = np.where(gone, 0, part[s] * part[t])
        have = np.zeros((4, len(code)), bool)
        c = 2 * second[a] + second[b]
        slots[c, at], have[c, at] = d[moved], known[moved]
        e = slots.max(0) if fold else (slots * weight).sum(0)
        all_known = (have | (weight == 0)).all(0)
        keep = e <= np.maximum(bound[p], bound[q])
        u, v = (place[np.concatenate((w[~moved], z[keep]))].astype(np.int32) for w, z in ((u, p), (v, q)))
        d, known = np.concatenate((d[~moved], e[keep])), np.concatenate((known[~moved], all_known[keep]))
        label, bound, rep, sizes = place[to[label]], bound[stays], rep[stays], sizes[stays]
    return _last(over, _whole_rows, shared(), sizes, sizes, rep, method, merges)


def _nearest_outside(rows: np.ndarray, x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows the nearest row with another label and its distance, the first of equal ones."""
    y, step = x[rows], max(1, ROUND_CELLS // len(rows))
    norms, low, near = (y**2).sum(1)[:, None], np.full(len(rows), np.inf), np.full(len(rows), -1)
    i = np.arange(len(rows))
    for a in range(0, len(x), step):
        z = x[a : a + step]
        d = y @ z.T
        d *= -2
        d += norms
        d += (z**2).sum(1)
        np.maximum(d, 0, out=d)
        d[label[rows, None] == label[a : a + step]] = np.inf
        at = d.argmin(1)
        closer = d[i, at] < low
        low[closer], near[closer] = d[i, at][closer], a + at[closer]
    return rows, near, np.sqrt(low)


def _spanning(x: np.ndarray, over: Over, near: np.ndarray, low: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges (row, row, distance) of a shortest spanning tree: each component takes its nearest row outside."""
    n = len(x)
    label, edges = np.arange(n), []
    while len(edges) < n - 1:
        lost = (near < 0) | (label[near] == label)
        best = np.full(n, np.inf)
        np.minimum.at(best, label[~lost], low[~lost])
        wanted = np.flatnonzero(lost & (low <= best[label]))  # what a row has lost was no farther than what is left for it
        for rows, at, d in over(_nearest_outside, [wanted[a : a + 512] for a in range(0, len(wanted), 512)], (x, label)):
            near[rows], low[rows] = at, d
        known = np.flatnonzero((near >= 0) & (label[near] != label))
        first, last = np.minimum(known, near[known]), np.maximum(known, near[known])
        known = known[np.lexsort((last, first, low[known], label[known]))]
        known = known[np.unique(label[known], return_index=True)[1]]
        top = list(range(n))

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = i = top[top[i]]
            return i

        for r in known[np.argsort(low[known], kind="stable")].tolist():
            a, b = root(int(label[r])), root(int(label[near[r]]))
            if a != b:
                top[max(a, b)] = min(a, b)
                edges.append((r, int(near[r]), float(low[r])))
        label = np.array([root(i) for i in label.tolist()])
    return edges


def cut(tree: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """Labels of k clusters, numbered by first appearance."""
    n = len(tree) + 1
    top = list(range(2 * n - 1))
    for m in range(n - k - 1, -1, -1):  # from the last merge down, so that the top of a merge is known
        a, b, _ = tree[m]
        top[a] = top[b] = top[n + m]
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(top[i], len(seen)) for i in range(n)])


def calinski_harabasz(x: np.ndarray, labels: np.ndarray) -> float:
    k = np.unique(labels)
    between = sum((labels == c).sum() * ((x[labels == c].mean(0) - x.mean(0)) ** 2).sum() for c in k)
    within = sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in k)
    return float(between / within * (len(x) - len(k)) / (len(k) - 1)) if within > 0 and 1 < len(k) else 1.0


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    k = np.unique(labels)
    centres = np.stack([x[labels == c].mean(0) for c in k])
    spread = np.array([np.sqrt(((x[labels == c] - m) ** 2).sum(1)).mean() for c, m in zip(k, centres, strict=True)])
    d = np.sqrt(squared(centres, centres))
    np.fill_diagonal(d, np.inf)
    ratio = (spread[:, None] + spread) / np.where(d > 0, d, np.inf)
    return float(ratio.max(1).mean())


def _silhouette_part(rows: tuple[int, int], x: np.ndarray, start: np.ndarray) -> float:
    """Sum of the rows' widths; x is in order of clusters, which begin at start (last: the end)."""
    a, z = rows
    y = np.column_stack((-2 * x[a:z], (x[a:z] ** 2).sum(1), np.ones(z - a)))
    sums, step = np.zeros((z - a, len(start) - 1)), max(1, ROUND_CELLS // (z - a))
    for c in range(len(start) - 1):
        for b in range(start[c], start[c + 1], step):
            other = x[b : min(b + step, start[c + 1])]
            d = y @ np.column_stack((other, np.ones(len(other)), (other**2).sum(1))).T
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            own = np.arange(max(a, b), min(z, b + len(other)))
            d[own - a, own - b] = 0  # a row and itself
            sums[:, c] += d.sum(1)
    sizes, own, i = np.diff(start), np.searchsorted(start, np.arange(a, z), side="right") - 1, np.arange(z - a)
    near = sums[i, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[i, own] = np.inf
    far = means.min(1)
    return float(np.where(sizes[own] > 1, (far - near) / np.maximum(np.maximum(near, far), 1e-300), 0).sum())


def silhouette(x: np.ndarray, labels: np.ndarray, over: Over = _in_process) -> float:
    """The mean width. Every row is held against all rows, 512 rows a part: over(f, parts, shared) gives f(part, *shared) of each part."""
    order = np.argsort(labels, kind="stable")
    start = np.append(np.unique(labels[order], return_index=True)[1], len(x))
    parts = [(a, min(a + 512, len(x))) for a in range(0, len(x), 512)]
    return sum(over(_silhouette_part, parts, (x[order], start))) / len(x)


def _cut_score(cut_: np.ndarray, sizes: np.ndarray, means: np.ndarray, within: float) -> float:
    """calinski_harabasz() of clusters that are made of smaller ones, from their sizes, their means and their sum of squares within."""
    k, n = cut_.max() + 1, np.bincount(cut_, sizes)
    centres = np.stack([np.bincount(cut_, sizes * c, k) for c in means.T], 1) / n[:, None]
    between = (n * ((centres - sizes @ means / sizes.sum()) ** 2).sum(1)).sum()
    within = within + (sizes * ((means - centres[cut_]) ** 2).sum(1)).sum()
    return float(between / within * (sizes.sum() - k) / (k - 1)) if within > 0 and k > 1 else 1.0


SCORES = {"ch": calinski_harabasz, "db": davies_bouldin, "s": silhouette}


def knee_score(scores: list[float]) -> float:
    """The score at the knee of the scores from the highest on."""
    return knee(sorted(scores, reverse=True))[1]


@dataclass
class Clustering:
    """Search for the number of clusters: k_max first, then from k_min up; of equal best scores the first counts.

    km_method None builds the tree over the rows themselves. best picks one of the scores. fit() takes a matrix.
    """

    k_min: int = 2
    k_max: int | None = None
    km_method: str | None = "hartigan"
    km_iterations: int = 1
    hc_method: str = "ward"
    score: str | Callable[[np.ndarray, np.ndarray], float] = "CH"
    best: Callable[[list[float]], float] = knee_score
    ratio: float | None = None
    extract: bool = True
    seed: int = 1
    k: int = 0
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    scores: dict[int, float] = field(default_factory=dict)
    cardinality: dict[int, list[int]] = field(default_factory=dict)
    shares: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kept: list[int] = field(default_factory=list)

    def fit(self, x: np.ndarray) -> Clustering:
        n = len(x)
        if n <= self.k_min:
            self.k, self.labels = n, np.arange(n)
            self.scores, self.cardinality = {n: float("nan")}, {n: [1] * n}
            return self
        f = SCORES[self.score.lower()] if isinstance(self.score, str) else self.score
        if self.extract:
            x, self.shares, self.kept = principal_components(x, self.ratio)
        top = min(n, max(self.k_min, floor(sqrt(n)) if self.k_max is None else self.k_max))
        first = KMEANS[self.km_method](x, top, self.km_iterations, self.seed) if self.km_method else np.arange(n)
        first = np.unique(first, return_inverse=True)[1]
        means, sizes = np.stack([x[first == c].mean(0) for c in range(first.max() + 1)]), np.bincount(first).astype(float)
        tree = linkage(means, self.hc_method)
        within = sum(((x[first == c] - m) ** 2).sum() for c, m in enumerate(means)) if f is calinski_harabasz else 0.0
        begin = np.unique(first, return_index=True)[1]
        # Cuts are kept as labels of the first clusters: no work on rows for each k, but by scores that need it.
        found = {}
        for k in [top, *range(self.k_min, top)]:
            found[k] = c = np.arange(len(means)) if self.km_method and k == top else cut(tree, min(k, len(tree) + 1))
            self.scores[k] = _cut_score(c, sizes, means, within) if f is calinski_harabasz else f(x, c[first])
            earliest = np.full(c.max() + 1, n)
            np.minimum.at(earliest, c, begin)
            self.cardinality[k] = np.bincount(c, sizes)[np.argsort(earliest)].astype(int).tolist()
        best = self.best(list(self.scores.values()))
        self.k = next(k for k, s in self.scores.items() if s == best)
        self.labels = found[self.k][first]
        return self

    def fit_predict(self, x: np.ndarray) -> np.ndarray:
        return self.fit(x).labels

    def summary(self) -> list[tuple[int, float, bool, list[int]]]:
        """(k, score, selected, cardinality), by k."""
        return [(k, self.scores[k], k == self.k, self.cardinality[k]) for k in sorted(self.scores)]


def tsga(df: DataFrame, id_column: str, vector: str, clustering: Clustering | None = None) -> DataFrame:
    """(id, cluster) of objects with a vector column, whose matrix must fit the driver (rows x dimensions x 8 bytes)."""
    rows = df.select(id_column, F.col(vector).cast("array<double>").alias("v")).orderBy(id_column).toPandas()
    labels = (clustering or Clustering()).fit_predict(np.stack(rows.v.to_numpy())) if len(rows) else []
    return df.sparkSession.createDataFrame([(int(i), int(c)) for i, c in zip(rows[id_column], labels, strict=True)], f"{id_column} long, cluster int")


def spark_kmeans(df: DataFrame, id_column: str, vector: str, k: int, bisect: bool = False, iterations: int = 20, seed: int = 1) -> DataFrame:
    """(id, cluster) by the distributed k-means, for more rows than one machine holds."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(id_column, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = (BisectingKMeans if bisect else KMeans)(k=k, maxIter=iterations, seed=seed).fit(rows)
    return model.transform(rows).select(id_column, F.col("prediction").alias("cluster"))


# Validity on DataFrames of (cluster, vector): sums by cluster and dimension only, no pairs of rows.


def exploded(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    return df.select(F.col(cluster).alias("cluster"), F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, dim, n, center)."""
    return exploded(df, cluster, vector).groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("center"))


def calinski_harabasz_frame(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """One row: score, from sums of squares by cluster and dimension."""
    s = exploded(df, cluster, vector).groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("c"), F.var_pop("x").alias("v"))
    total = s.groupBy("dim").agg((F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("mean"))
    within = F.sum(F.col("n") * F.col("v"))
    between = F.sum(F.col("n") * F.pow(F.col("c") - F.col("mean"), F.lit(2.0)))
    k, rows = F.count_distinct("cluster"), F.sum("n") / F.count_distinct("dim")
    return s.join(total, "dim").agg((between / within * (rows - k) / (k - 1)).alias("score"))


def davies_bouldin_frame(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """One row: score, the mean over clusters of the worst ratio of two clusters' spreads to the distance of their centres. Rows without a cluster have no part."""
    own = centroids(df.where(F.col(cluster).isNotNull()), cluster, vector)
    arrays = own.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "center"))), lambda x: x["center"]).alias("centre"))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    rows = df.select(F.col(cluster).alias("cluster"), F.col(vector).alias("v")).join(arrays, "cluster")
    spread = rows.groupBy("cluster").agg(F.avg(F.sqrt(square(F.col("v"), F.col("centre")))).alias("spread"))
    known = own.join(spread, "cluster")
    other = known.select("dim", F.col("cluster").alias("other"), F.col("center").alias("center_o"), F.col("spread").alias("spread_o"))
    pairs = known.join(other, "dim").where("cluster <> other")  # as many as clusters squared, by dimension
    apart = F.sqrt(F.sum(F.pow(F.col("center") - F.col("center_o"), F.lit(2.0))))
    ratio = pairs.groupBy("cluster", "other").agg(((F.first("spread") + F.first("spread_o")) / F.nullif(apart, F.lit(0.0))).alias("ratio"))
    return ratio.groupBy("cluster").agg(F.max(F.coalesce("ratio", F.lit(0.0))).alias("worst")).agg(F.avg("worst").alias("score"))


def assigned(df: DataFrame, id_column: str, vector: str, centres: list[list[float]]) -> DataFrame:
    """(id, cluster, distance) to the nearest of a few fixed centres."""
    def distance(c: list[float]):
        return F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, map(float, c))), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)

    nearest = F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centres)]))
    return df.select(id_column, nearest.alias("best")).select(id_column, F.col("best.c").alias("cluster"), F.sqrt("best.d").alias("distance"))
