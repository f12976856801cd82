"""Small numerical kernels on arrays: for one series, one profile matrix or one set of exogenous columns at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import partial
from itertools import combinations
from statistics import NormalDist

import numpy as np

#: Cells of a block of rows against all rows.
CELLS = 1_000_000


def blocks(n: int) -> list[tuple[int, int]]:
    """(first, one past the last) of blocks of n rows, each of CELLS cells against all rows at most (a row at least)."""
    step = max(1, CELLS // max(1, n))
    return [(a, min(n, a + step)) for a in range(0, n, step)]


def knee(curve: Sequence[float], shape: str = "convex", direction: str = "decreasing", sensitivity: float = 1.0) -> tuple[int, float]:
    """(place, value) of the knee by Kneedle; of an empty curve (0, 0), without a knee its last point."""
    y = np.asarray(curve, float)
    n = len(y)
    if not n:
        return 0, 0.0
    low, high = y.min(), y.max()
    if n > 2 and high > low:
        x, v = np.linspace(0, 1, n), (y - low) / (high - low)
        # Turned so that the curve is concave and increasing.
        if direction == "decreasing":
            v = v[::-1] if shape == "concave" else 1 - v
        elif shape == "convex":
            v = 1 - v[::-1]
        d = v - x
        peak = [i for i in range(1, n - 1) if d[i] > d[i - 1] and d[i] >= d[i + 1]]
        dips = {i for i in range(1, n - 1) if d[i] < d[i - 1] and d[i] <= d[i + 1]}
        for i in peak:
            least = d[i] - sensitivity / (n - 1)
            for j in range(i + 1, n):
                if j in dips or j in peak:
                    break
                if d[j] < least:
                    at = n - 1 - i if (shape, direction) in (("concave", "decreasing"), ("convex", "increasing")) else i
                    return at, float(y[at])
    return n - 1, float(y[-1])


def autocovariances(x: np.ndarray, lags: int) -> np.ndarray:
    """Over n - lag pairs each, about the mean."""
    d = np.asarray(x, float) - np.mean(x)
    n = len(d)
    return np.array([d[k:] @ d[: n - k] / (n - k) for k in range(lags + 1)])


def pacf(x: Sequence[float], lags: int | None = None) -> np.ndarray:
    """Partial autocorrelations at lags 0..lags (5 % of the length by default), by Durbin and Levinson; 0 where outside [-1, 1]."""
    x = np.asarray(x, float)
    lags = int(len(x) * 0.05) if lags is None else lags
    c = autocovariances(x, min(lags, len(x) - 1)) if len(x) else np.zeros(1)
    out, phi, error = np.zeros(lags + 1), np.zeros(0), c[0]
    out[0] = 1.0
    for k in range(1, len(c)):
        if error <= 0:
            break
        r = (c[k] - phi @ c[k - 1 : 0 : -1]) / error
        phi = np.append(phi - r * phi[::-1], r)
        error *= 1 - r * r
        out[k] = r
    return np.where(np.abs(out) <= 1, out, 0.0)


def significant_lag(columns: Sequence[np.ndarray], lags: int | None = None, p: float = 0.99) -> tuple[int, list[np.ndarray], float]:
    """(lag at the knee of the mean share of what later lags explain beyond chance, scores, radius of chance)."""
    scores = [pacf(x, lags) for x in columns]
    radius = NormalDist().inv_cdf(0.5 + p / 2) / np.sqrt(len(columns[0]))
    curves = []
    for s in scores:
        over = np.where(np.abs(s) < radius, 0.0, (s - radius) ** 2)
        rest = np.cumsum(over[::-1])[::-1]
        curves.append(1 - np.cumsum(rest / (rest.sum() or 1)))
    return knee(np.mean(curves, axis=0))[0], scores, float(radius)


def selected(scores: Sequence[float], ratio: float | None = None) -> list[int]:
    """Places of the highest scores: up to the knee, or those within the cumulative share and one more; at least 3."""
    order = sorted(range(len(scores)), key=lambda i: -scores[i])
    ranked = np.array([scores[i] for i in order], float)
    n = knee(ranked)[0] if ratio is None else int((np.cumsum(ranked / ranked.sum()) <= ratio).sum()) + 1
    return order[: min(max(3, n), len(order))]


def principal_components(x: np.ndarray, ratio: float | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(scores of the kept components, explained shares of all, places of the kept ones)."""
    centred = x - x.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    share = s**2 / ((s**2).sum() or 1)
    keep = selected(share, ratio)
    return (u * s)[:, keep], share, keep


def impute_nearest(x: np.ndarray, k: int = 5) -> np.ndarray:
    """NaNs replaced by the column's mean over the k nearest rows that have it, by the distance over shared columns."""
    x = np.array(x, float)
    missing = np.isnan(x)
    if not missing.any():
        return x
    have, filled = (~missing).astype(float), np.where(missing, 0.0, x)
    out, means = x.copy(), np.where(have.sum(0) > 0, filled.sum(0) / np.maximum(have.sum(0), 1), 0.0)
    wanting = np.flatnonzero(missing.any(1))
    for a, z in blocks(len(x)):
        rows = wanting[(wanting >= a) & (wanting < z)]
        if not len(rows):
            continue
        shared = have[rows] @ have.T
        squares = (filled[rows] ** 2) @ have.T + have[rows] @ (filled**2).T - 2 * filled[rows] @ filled.T
        distance = np.sqrt(np.maximum(np.where(shared > 0, squares * x.shape[1] / np.maximum(shared, 1), np.inf), 0))
        distance[np.arange(len(rows)), rows] = np.inf
        for d, i in zip(distance, rows, strict=True):
            for j in np.flatnonzero(missing[i]):
                near = _nearest(np.where(missing[:, j], np.inf, d), k)
                out[i, j] = x[near, j].mean() if len(near) else means[j]
    return out


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest finite distances, nearest first; of equal ones the first."""
    at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if k < len(d) else np.arange(len(d))
    at = at[np.isfinite(d[at])]
    return at[np.argsort(d[at], kind="stable")[:k]]


def digamma(n: np.ndarray) -> np.ndarray:
    x = np.asarray(n, float).copy()
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def _ranked_distances(x: np.ndarray) -> np.ndarray:
    return np.abs(x[:, None] - x[None, :])


def mutual_information(x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, k: int = 3) -> float:
    """I(x; y) or I(x; y | z) of single columns by k nearest neighbours in the maximum norm."""
    n = len(x)
    parts = [_ranked_distances(np.asarray(c, float)) for c in (x, y) + (() if z is None else (z,))]
    joint = np.maximum.reduce(parts)
    np.fill_diagonal(joint, np.inf)
    radius = np.partition(joint, k - 1, axis=1)[:, k - 1 : k]

    def inside(d: np.ndarray) -> np.ndarray:
        return (d < radius).sum(1) - (radius[:, 0] > 0)

    if z is None:
        return float(digamma(np.array([k]))[0] + digamma(np.array([n]))[0] - np.mean(digamma(inside(parts[0]) + 1) + digamma(inside(parts[1]) + 1)))
    xz, yz = np.maximum(parts[0], parts[2]), np.maximum(parts[1], parts[2])
    return float(digamma(np.array([k]))[0] - np.mean(digamma(inside(xz) + 1) + digamma(inside(yz) + 1) - digamma(inside(parts[2]) + 1)))


#: Rows of a leaf, whose nearest rows are searched together, and distances that are held at a time for it.
LEAF, LEAF_CELLS = 64, 1 << 16


def _leaves(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in leaves of LEAF at most by halving the widest column: (rows in order, first of each leaf and the end, lowest and highest values of each)."""
    order, start, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        a, z = todo.pop()
        if z - a <= LEAF:
            start.append(a)
            continue
        own = points[order[a:z]]
        half = (z - a) // 2
        order[a:z] = order[a:z][np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half)]
        todo += [(a + half, z), (a, a + half)]
    at = points[order]
    return order, np.array([*start, len(points)]), np.minimum.reduceat(at, start), np.maximum.reduceat(at, start)


def _sorted_inside(values: np.ndarray, at: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many of the sorted values have |value - at| < radius, rounding as in that difference."""
    first, last = np.searchsorted(values, at - radius), np.searchsorted(values, at + radius)
    n = len(values)
    inside = lambda i: (i >= 0) & (i < n) & (np.abs(values[np.clip(i, 0, n - 1)] - at) < radius)
    while (more := inside(first - 1)).any():
        first = first - more
    while (more := (first < last) & ~inside(first)).any():
        first = first + more
    while (more := inside(last)).any():
        last = last + more
    while (more := (last > first) & ~inside(last - 1)).any():
        last = last - more
    return last - first


def _joint_sums(part: tuple[tuple[int, ...], int, int], x: np.ndarray, y: np.ndarray, k: int) -> list[float]:
    """Of a share (its number, of how many) of all rows, the sums that mutual_information() takes means of: of one column, or of each of two under the other.

    The k-th distance in a leaf bounds the one among all rows; only rows in the leaf's box, widened by it, are compared.
    """
    columns, number, shares = part
    points = np.column_stack((*(x[:, j] for j in columns), y))
    order, start, low, high = _leaves(points)
    at, n, width = points[order], len(points), points.shape[1]
    ranked = [np.sort(points[:, c]) for c in range(width)]
    sums = [0.0] * len(columns)

    def candidates(lo: np.ndarray, hi: np.ndarray, dims: list[int]) -> np.ndarray:
        hit = np.flatnonzero(np.logical_and.reduce([(low[:, c] <= hi[c]) & (high[:, c] >= lo[c]) for c in dims]))
        if not len(hit):
            return np.zeros(0, int)
        rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in hit])
        own = at[rows]
        return rows[np.logical_and.reduce([(own[:, c] <= hi[c]) & (own[:, c] >= lo[c]) for c in dims])]

    def distances(own: np.ndarray, other: np.ndarray, dims: list[int]) -> np.ndarray:
        out = None
        for c in dims:
            d = own[:, c, None] - other[None, :, c]
            np.abs(d, out=d)
            out = d if out is None else np.maximum(out, d, out=out)
        return out

    every = list(range(width))
    for leaf in range(number, len(start) - 1, shares):
        rows = np.arange(start[leaf], start[leaf + 1])
        own, m = at[rows], len(rows)

        def kth(d: np.ndarray) -> np.ndarray:
            return np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] >= k else np.column_stack((d, np.full((len(d), k - d.shape[1]), np.inf)))

        d = distances(own, own, every)
        np.fill_diagonal(d, np.inf)
        radius = kth(d)[:, k - 1].copy()
        todo = np.flatnonzero(radius > 0)

        def box(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            r = radius[which, None]
            with np.errstate(invalid="ignore"):
                lo, hi = own[which] - r, own[which] + r
            return np.nextafter(lo.min(0), -np.inf), np.nextafter(hi.max(0), np.inf)

        if len(todo):
            found, best = candidates(*box(todo), every), None
            step = max(1, LEAF_CELLS // len(todo))
            for a in range(0, len(found), step):
                others = found[a : a + step]
                d = distances(own[todo], at[others], every)
                d[rows[todo, None] == others] = np.inf
                best = kth(d if best is None else np.column_stack((best, d)))
            radius[todo] = best.max(1)

        def inside(dims: list[int]) -> np.ndarray:
            count = np.ones(m, int)  # the row itself
            which = np.flatnonzero(radius > 0)
            if len(dims) == 1:
                count[which] = _sorted_inside(ranked[dims[0]], own[which, dims[0]], radius[which])
            elif len(which):
                count[which] = 0
                found, step = candidates(*box(which), dims), max(1, LEAF_CELLS // len(which))
                for a in range(0, len(found), step):
                    count[which] += np.count_nonzero(distances(own[which], at[found[a : a + step]], dims) < radius[which, None], axis=1)
            return digamma(count)

        if width == 2:
            sums[0] += (inside([0]) + inside([1])).sum()
        else:
            near = inside([0, 1])
            for j in (0, 1):
                sums[j] += (near + inside([j, 2]) - inside([j])).sum()
    return sums


def joint_scores(x: np.ndarray, y: np.ndarray, k: int = 3, over: Callable[[Callable, list], Iterable] = map) -> np.ndarray:
    """Of each column the least information that it and one other column have on y together; a lone column's own.

    A row is held against those near it only, so work grows with the 4/3 power of the rows where they are spread out.
    over maps a function over parts (columns and a share of the rows), in this process by default.
    """
    n, m = x.shape
    shares = max(1, min(64, n // 20_000))
    parts = [(columns, a, shares) for columns in [*combinations(range(m), 2), *((j,) for j in range(m))] for a in range(shares)]
    alone, pair = np.zeros(m), np.zeros((m, m))
    for (columns, *_), sums in zip(parts, over(partial(_joint_sums, x=x, y=y, k=k), parts), strict=True):
        if len(columns) == 1:
            alone[columns[0]] += sums[0]
        else:
            i, j = columns
            pair[i, j], pair[j, i] = pair[i, j] + sums[1], pair[j, i] + sums[0]
    at_k, at_n = digamma(np.array([k, n]))
    alone = at_k + at_n - alone / n
    if m == 1:
        return alone
    given = at_k - pair / n
    return np.array([min(alone[j] + given[i, j] for j in range(m) if j != i) for i in range(m)])


def power_sums(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sums of products of deviations from the means)."""
    d = x - (mean := x.mean(0))
    return len(x), mean, d.T @ d


def merged_sums(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """power_sums() of the rows of both."""
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def scatter_shares(n: int, scatter: np.ndarray) -> np.ndarray:
    """principal_components()'s explained shares, from the highest on, of n rows with these power sums."""
    s = np.maximum(np.linalg.eigvalsh(scatter)[::-1], 0)[:n]
    return s / (s.sum() or 1)


def scatter_correlation(scatter: np.ndarray, j: int) -> float:
    """multiple_correlation() of column j with the others, from their power sums."""
    rest = np.delete(np.arange(len(scatter)), j)
    own, cross, y = scatter[np.ix_(rest, rest)], scatter[rest, j], scatter[j, j]
    w = np.linalg.lstsq(own, cross, rcond=None)[0]
    fit = w @ own @ w
    return float(w @ cross / np.sqrt(fit * y)) if fit > 0 and y > 0 else 0.0


def multiple_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Correlation of y with its least squares fit by the columns of x; 0 without spread."""
    a = np.column_stack((np.ones(len(x)), x))
    fit = a @ np.linalg.lstsq(a, y, rcond=None)[0]
    return float(np.corrcoef(fit, y)[0, 1]) if fit.std() > 0 and y.std() > 0 else 0.0


def synthetic_samples(x: np.ndarray, n: int, k: int = 5, seed: int = 1) -> np.ndarray:
    """n rows, each from a random row towards one of its k nearest ones, a random part of the way in each column."""
    rng = np.random.default_rng(seed)
    base = rng.integers(len(x), size=n)
    pick = rng.integers(min(k, len(x) - 1), size=n)
    other = np.zeros(n, int)
    for m, (i, p) in enumerate(zip(base, pick, strict=True)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        other[m] = _nearest(d, p + 1)[p]
    return x[base] + (x[other] - x[base]) * rng.random((n, x.shape[1]))


class QuantileRegression:
    """Linear quantile regression by iteratively reweighted least squares."""

    def __init__(self, p: float, steps: int = 200):
        self.p, self.steps, self.weights = p, steps, np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> QuantileRegression:
        a = np.column_stack((np.ones(len(x)), x))
        w = np.linalg.lstsq(a, y, rcond=None)[0]
        for _ in range(self.steps):
            r = y - a @ w
            v = np.where(r >= 0, self.p, 1 - self.p) / np.maximum(np.abs(r), 1e-6)
            new = np.linalg.lstsq(a * np.sqrt(v)[:, None], y * np.sqrt(v), rcond=None)[0]
            if np.abs(new - w).max() < 1e-8:
                break
            w = new
        self.weights = w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((np.ones(len(x)), x)) @ self.weights


class MultiQuantileRegression:
    """One quantile regression for each column of y and probability; predict gives (rows, columns, probabilities)."""

    def __init__(self, p: Sequence[float]):
        self.p, self.models = list(p), []

    def fit(self, x: np.ndarray, y: np.ndarray) -> MultiQuantileRegression:
        self.models = [[QuantileRegression(p).fit(x, y[:, j]) for p in self.p] for j in range(y.shape[1])]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.stack([m.predict(x) for m in models], 1) for models in self.models], 1)

    def fit_predict(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.fit(x, y).predict(x)
