"""Set distances between bags (matrices of instances) in numpy, one bag against a stack of bags.

Fixed meanings: ``maxmin`` is the directed Hausdorff distance; ``meanmin`` is directed too.  ``mahalanobis`` isn't rooted
and uses the mean of both sample covariances (0 for a bag of one), pseudo-inverted where singular.  ``earth_movers`` is
the optimal transport of equal weights.  ``cauchy_schwarz`` takes the cross kernel over all pairs and the own kernels over
each instance with itself, with one bandwidth from the pooled norms.
"""

from __future__ import annotations

import numpy as np


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None] - b[None]) ** 2).sum(2))
    return out


def _covariance(x: np.ndarray) -> np.ndarray:
    return np.cov(x, rowvar=False, ddof=1).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.zeros((x.shape[1],) * 2)


def mahalanobis(a: np.ndarray, b: np.ndarray) -> float:
    gap = a.mean(0) - b.mean(0)
    s = (_covariance(a) + _covariance(b)) / 2
    inverse = np.linalg.inv(s) if np.linalg.matrix_rank(s) == len(s) else np.linalg.pinv(s)
    return float(gap @ inverse @ gap)


def transport(cost: np.ndarray) -> float:
    """Least cost of moving equal row weights 1/n to equal column weights 1/m, by successive shortest paths.

    Weights are scaled to whole numbers: each row supplies m and each column takes n units.
    """
    n, m = cost.shape
    supply, demand = np.full(n, m), np.full(m, n)
    flow = np.zeros((n, m), int)
    u, v = np.zeros(n), np.zeros(m)  # potentials keep reduced costs nonnegative
    v[:] = cost.min(0)
    while supply.any():
        far_r, far_c = np.full(n, np.inf), np.full(m, np.inf)
        from_r, from_c = np.full(n, -1), np.full(m, -1)
        far_r[supply > 0] = 0
        done_r, done_c = np.zeros(n, bool), np.zeros(m, bool)
        while True:
            r, c = np.where(done_r, np.inf, far_r), np.where(done_c, np.inf, far_c)
            if r.min() <= c.min():
                i = int(r.argmin())
                done_r[i] = True
                d = far_r[i] + np.maximum(0, cost[i] - u[i] - v)
                better = d < far_c
                far_c[better], from_c[better] = d[better], i
            else:
                j = int(c.argmin())
                done_c[j] = True
                if demand[j] > 0:
                    break
                back = flow[:, j] > 0
                d = far_c[j] + np.maximum(0, -(cost[:, j] - u - v[j]))
                better = back & (d < far_r)
                far_r[better], from_r[better] = d[better], j
        reach = far_c[j]
        u += np.where(done_r, reach - far_r, 0)
        v -= np.where(done_c, reach - far_c, 0)
        path, col = [], j
        while True:
            row = from_c[col]
            path.append((row, col, 1))
            if from_r[row] < 0:
                break
            col = from_r[row]
            path.append((row, col, -1))
        units = min([supply[row], demand[j], *(flow[r, c] for r, c, s in path if s < 0)])
        for r, c, s in path:
            flow[r, c] += s * units
        supply[row] -= units
        demand[j] -= units
    return float((flow * cost).sum() / (n * m))


def cauchy_schwarz(a: np.ndarray, b: np.ndarray) -> float:
    norms = np.sort(np.concatenate([np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))]))
    n = len(norms)
    spread = norms[n * 3 // 4] - norms[n // 4]
    h = 0.99 * min(norms.std(ddof=1), spread / 1.34) / n**0.2
    with np.errstate(all="ignore"):
        s = 2 * (2 * h) ** 2
        scale = (np.pi * s) ** (a.shape[1] // 2)
        cross = np.exp(-(euclidean(a, b) ** 2) / s).sum() / scale
        return float(abs(np.log(cross / np.sqrt(len(a) / scale * (len(b) / scale)))))


HAUSDORFF = {"maxmin": 0, "minmin": 1, "meanmin": 2, "mean": 3}
PAIRWISE = {"mahalanobis": mahalanobis, "cauchy_schwarz": cauchy_schwarz, "earth_movers": lambda a, b: transport(euclidean(a, b))}
NAMES = (*HAUSDORFF, *PAIRWISE)


class Stack:
    """Bags that many others are measured against: instances one below the other, and what the distances need of each bag."""

    def __init__(self, mats: list[np.ndarray]) -> None:
        self.mats, self.sizes = mats, np.array([len(m) for m in mats])
        self.rows, self.starts = np.concatenate(mats), np.cumsum([0, *self.sizes[:-1]])
        self.columns, self.squares = np.ascontiguousarray(self.rows.T), (self.rows * self.rows).sum(1)
        self._moments = self._norms = None

    def gaps(self, bag: np.ndarray) -> np.ndarray:
        """Euclidean distances from each instance of a bag to all instances, by a product of matrices; those that are small
        against the norms, where it loses digits, and those that aren't finite are computed as ``euclidean`` does."""
        with np.errstate(all="ignore"):
            whole = (bag * bag).sum(1)[:, None] + self.squares
            out = whole - 2 * (bag @ self.columns)
            i, j = np.nonzero(~(out > 0.01 * whole) | ~(whole < np.inf))
            if 8 * len(i) > out.size:
                return euclidean(bag, self.rows)
            out[i, j] = ((bag[i] - self.rows[j]) ** 2).sum(1)
            return np.sqrt(out, out=out)

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        if self._moments is None:
            self._moments = np.stack([m.mean(0) for m in self.mats]), np.stack([_covariance(m) for m in self.mats])
        return self._moments

    def norms(self) -> np.ndarray:
        """The sorted norms of each bag, in rows filled up with infinity."""
        if self._norms is None:
            self._norms = np.full((len(self.mats), self.sizes.max()), np.inf)
            for k, m in enumerate(self.mats):
                self._norms[k, : len(m)] = np.sort(np.sqrt((m * m).sum(1)))
        return self._norms


def moments_of(bag: np.ndarray) -> np.ndarray:
    """The mean and the covariances of a bag, one behind the other: all that mahalanobis needs of it."""
    return np.concatenate([bag.mean(0), _covariance(bag).ravel()])


def split_moments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of rows of ``moments_of``."""
    d = int((rows.shape[1] + 0.25) ** 0.5)  # d + d * d values
    return rows[:, :d], rows[:, d:].reshape(len(rows), d, d)


def _mahalanobis_all(bag: np.ndarray, to: Stack) -> np.ndarray:
    return mahalanobis_of(bag.mean(0), _covariance(bag), *to.moments())


def mahalanobis_of(mean: np.ndarray, covariance: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    gap, s = mean - means, (covariance + covariances) / 2
    out, rest = np.empty(len(gap)), np.ones(len(gap), bool)
    if s.shape[1] == 2:  # in closed form, but for matrices that are nearly singular
        a, b, c = s[:, 0, 0], s[:, 0, 1], s[:, 1, 1]
        det, (x, y) = a * c - b * b, gap.T
        rest = ~(det > 1e-9 * (a + c) ** 2)
        out[~rest] = ((x * x * c - 2 * x * y * b + y * y * a)[~rest]) / det[~rest]
    if rest.any():
        full = rest.copy()
        full[rest] = np.linalg.matrix_rank(s[rest]) == s.shape[1]
        for rows, inverted in ((full, np.linalg.inv), (rest & ~full, np.linalg.pinv)):
            if rows.any():
                out[rows] = np.einsum("ni,nij,nj->n", gap[rows], inverted(s[rows]), gap[rows])
    return out


def _cauchy_schwarz_all(bag: np.ndarray, to: Stack) -> np.ndarray:
    own, n = np.sqrt((bag * bag).sum(1)), len(bag) + to.sizes
    norms = np.sort(np.concatenate([np.broadcast_to(own, (len(n), len(own))), to.norms()], 1), 1)
    every, there = np.arange(len(n)), np.arange(norms.shape[1]) < n[:, None]
    with np.errstate(all="ignore"):
        spread = norms[every, n * 3 // 4] - norms[every, n // 4]
        held = np.where(there, norms, 0.0)
        off = np.where(there, held - (held.sum(1) / n)[:, None], 0.0)
        h = 0.99 * np.minimum(np.sqrt((off * off).sum(1) / (n - 1)), spread / 1.34) / n**0.2
        s = 2 * (2 * h) ** 2
        scale = (np.pi * s) ** (bag.shape[1] // 2)
        near, narrow = np.zeros(len(to.rows)), -1 / np.repeat(s, to.sizes)
        for x in bag:
            gaps = np.zeros(len(to.rows))
            for v, column in zip(x, to.columns, strict=True):
                off_by = column - v
                off_by *= off_by
                gaps += off_by
            gaps *= narrow
            near += np.exp(gaps, out=gaps)
        cross = np.add.reduceat(near, to.starts) / scale
        return np.abs(np.log(cross / np.sqrt(len(bag) / scale * (to.sizes / scale))))


def _earth_movers_all(bag: np.ndarray, to: Stack) -> np.ndarray:
    """Small bags of one size (equal weights, so some assignment of rows is optimal) are solved together, by a table of the
    best cost of each set of columns; all others one by one."""
    n, cost = len(bag), euclidean(bag, to.rows)
    out, same = np.empty(len(to.mats)), to.sizes == n
    same &= n <= 6
    if same.any():
        costs = np.stack([cost[:, a : a + n] for a in to.starts[same]])
        best = {0: np.zeros(len(costs))}
        for i in range(n):
            after: dict[int, np.ndarray] = {}
            for used, value in best.items():
                for j in range(n):
                    if not used >> j & 1:
                        took = value + costs[:, i, j]
                        after[used | 1 << j] = np.minimum(after[used | 1 << j], took) if used | 1 << j in after else took
            best = after
        out[same] = best[(1 << n) - 1] / n
    for k in np.flatnonzero(~same):
        out[k] = transport(cost[:, to.starts[k] : to.starts[k] + to.sizes[k]])
    return out


ALL = {"mahalanobis": _mahalanobis_all, "cauchy_schwarz": _cauchy_schwarz_all, "earth_movers": _earth_movers_all}


def against(name: str, bag: np.ndarray, stack: np.ndarray, starts: np.ndarray, held: Stack | None = None) -> np.ndarray:
    """Distances from one bag to each bag of a stack of instances that begin at ``starts``; ``held`` is that stack, kept for
    further bags."""
    if name in PAIRWISE:
        return ALL[name](bag, held or Stack(np.split(stack, starts[1:])))
    d = euclidean(bag, stack) if held is None else held.gaps(bag)
    if name == "mean":
        sizes = np.diff(np.append(starts, len(stack)))
        return np.add.reduceat(d, starts, axis=1).sum(0) / (len(bag) * sizes)
    least = np.minimum.reduceat(d, starts, axis=1)
    return {"maxmin": least.max, "minmin": least.min, "meanmin": least.mean}[name](0)


def distance(name: str, a, b) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float(against(name, a, b, np.zeros(1, int))[0])


TILE = 362  # instances of a tile's bags, so that all gaps of two tiles stay near the processor


class Tile:
    """Bags at ``places`` of a block as sheets: sheet k holds the k-th instance of every bag, or its first if it has fewer."""

    def __init__(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> None:
        self.places, self.sizes = places, sizes[places]
        k = np.arange(self.sizes.max())[:, None]
        self.there = k < self.sizes
        self.sheets = rows[starts[places] + np.where(self.there, k, 0)]


class Sheets:
    """The bags of a block in tiles of similar sizes.  ``centre``, near all bags, keeps the products below from losing digits."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, centre: np.ndarray) -> None:
        self.n, self.d, self.sizes = len(sizes), rows.shape[1], sizes
        self.rows, self.starts = rows, np.cumsum(sizes) - sizes
        with np.errstate(all="ignore"):
            self.most = float(((rows - centre) ** 2).sum(1).max())  # not finite where any value isn't
        order, at, self.tiles = np.argsort(sizes, kind="stable"), 0, []
        while at < len(order):
            upto = at + 1
            while upto < len(order) and (upto + 1 - at) * sizes[order[upto]] <= TILE:
                upto += 1
            self.tiles.append(Tile(rows, self.starts, sizes, order[at:upto]))
            at = upto
        self.centre = centre

    def bag(self, k: int) -> np.ndarray:
        return self.rows[self.starts[k] : self.starts[k] + self.sizes[k]]


def sheets(flat, sizes, centre: np.ndarray | None = None) -> Sheets:
    """Of bags whose instances were put one behind the other."""
    sizes = np.asarray(sizes, np.int64)
    rows = np.concatenate([np.asarray(f, float) for f in flat]).reshape(int(sizes.sum()), -1)
    with np.errstate(all="ignore"):
        return Sheets(rows, sizes, rows.mean(0) if centre is None else centre)


def _left(t: Tile, centre: np.ndarray) -> np.ndarray:
    x = (t.sheets - centre).reshape(-1, len(centre))
    return np.concatenate([-2 * x, (x * x).sum(1)[:, None], np.ones((len(x), 1))], 1)


def _right(t: Tile, centre: np.ndarray) -> np.ndarray:
    y = (t.sheets - centre).reshape(-1, len(centre))
    return np.ascontiguousarray(np.concatenate([y, np.ones((len(y), 1)), (y * y).sum(1)[:, None]], 1).T)


def tiled(x: Sheets, y: Sheets):
    """(tile, tile, squared gaps): sheet and bag of the first, sheet and bag of the second; right to ``rounding(x, y)``."""
    right = [_right(t, y.centre) for t in y.tiles]
    for a in x.tiles:
        left = _left(a, y.centre)
        for b, r in zip(y.tiles, right, strict=True):
            yield a, b, (left @ r).reshape(*a.there.shape, *b.there.shape)


def rounding(x: Sheets, y: Sheets) -> float:
    """How far squared gaps of ``tiled`` may be off; not finite where the bags aren't."""
    return 16 * (x.d + 2) * np.finfo(float).eps * (x.most + y.most)


def gaps_of(a: Tile, b: Tile, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Gaps of all instances of bag i[c] and bag j[c], as ``euclidean`` computes them: sheet of a, sheet of b, c."""
    out = np.empty((len(a.sheets), len(b.sheets), len(i)))
    step = max(1, (1 << 20) // max(1, out.shape[0] * out.shape[1] * a.sheets.shape[2]))
    for c in range(0, len(i), step):
        out[..., c : c + step] = np.sqrt(((a.sheets[:, None, i[c : c + step]] - b.sheets[None, :, j[c : c + step]]) ** 2).sum(3))
    return out


def _folded(kind: str, near: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Directed distances from the gaps of each instance to its nearest one (first axis: instances)."""
    return near.max(0) if kind == "maxmin" else near.min(0) if kind == "minmin" else (near * there).sum(0) / there.sum(0)


def both_ways(kind: str, x: Sheets, y: Sheets) -> tuple[np.ndarray, np.ndarray]:
    """Of the Hausdorff family: the distances of the bags of x to those of y, and those of y to x (at the same places)."""
    to, back = np.empty((x.n, y.n)), np.empty((x.n, y.n))
    if not np.isfinite(x.most + y.most):
        for s, t, out in ((x, y, to), (y, x, back.T)):
            for k in range(s.n):
                out[k] = against(kind, s.bag(k), t.rows, t.starts)
        return to, back
    close = 1e-3 * (x.most + y.most)
    for a, b, g in tiled(x, y):
        at = np.ix_(a.places, b.places)
        near = g.min(0).transpose(1, 0, 2)
        i, j = np.nonzero(near.min(0) < close)
        exact = gaps_of(a, b, i, j) if len(i) else None  # where products lose digits
        if kind == "mean":
            both = np.einsum("snm,sn->nm", np.einsum("sntm,tm->snm", np.sqrt(np.maximum(g, 0)), b.there.astype(float)), a.there.astype(float))
            if len(i):
                both[i, j] = np.einsum("stc,sc,tc->c", exact, a.there[:, i].astype(float), b.there[:, j].astype(float))
            to[at] = back[at] = both / (a.sizes[:, None] * b.sizes)
            continue
        one = _folded(kind, np.sqrt(np.maximum(g.min(2), 0)), a.there[:, :, None])
        two = _folded(kind, np.sqrt(np.maximum(near, 0)), b.there[:, None, :])
        if len(i):
            one[i, j] = _folded(kind, exact.min(1), a.there[:, i])
            two[i, j] = _folded(kind, exact.min(0), b.there[:, j])
        to[at], back[at] = one, two
    return to, back


def nearest_pairs(x: Sheets, y: Sheets, radii: np.ndarray, most: int | None = None):
    """(i, j, d) in pieces: of ``minmin``, the pairs with d <= radii[i], or of each tile those among which are all of the ``most``
    nearest of i.  Products find the pairs and the instances that may be nearest; those are measured as ``euclidean`` does."""
    off = rounding(x, y)
    with np.errstate(over="ignore"):
        bars = (radii * (1 + 1e-12)) ** 2 + off
    for a, b, g in tiled(x, y):
        best = g.min(0).min(1)
        bar = bars[a.places]
        if most is not None and most < best.shape[1]:
            bar = np.minimum(bar, np.partition(best, most - 1, 1)[:, most - 1] + 2 * off)
        i, j = np.nonzero(best <= bar[:, None])
        if len(i):
            step = max(1, (1 << 21) // (len(g) * g.shape[2]))
            for c in range(0, len(i), step):
                p, q = i[c : c + step], j[c : c + step]
                pair, s, t = np.nonzero(g[:, p, :, q] <= (best[p, q] + 2 * off)[:, None, None])
                d = np.sqrt(((a.sheets[s, p[pair]] - b.sheets[t, q[pair]]) ** 2).sum(1))
                d = np.minimum.reduceat(d, np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]))
                mask = d <= radii[a.places[p]]
                yield a.places[p[mask]], b.places[q[mask]], d[mask]
