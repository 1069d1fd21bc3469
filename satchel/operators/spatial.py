"""Neighbours within a radius, and the nearest k, without comparing all pairs.

For the distances of BOUNDED no two bags are nearer than their bounding boxes, nor than their ranges on any axis on which
two points are never farther apart than they are: a coordinate, or the distance to a fixed point (a pivot).  The axes that
separate bags best at the given radius are cut into strips; a left bag, grown by its radius, and a right bag meet in the
cells that both cover, by an equi-join, and are reported in one of them.  Crowded cells are cut into blocks, pairs of which
are tasks of their own.  For ``minmin`` products of matrices find the pairs of a block that may be near enough; for other
distances only pairs whose boxes are near enough are measured.

For the k nearest, bags are first put in the order of their cells: the k-th distance inside a run of that order bounds the
radius of each bag, and then only cells within that radius are visited.

Other distances have no such bound; for them all pairs of blocks are compared (joins.pair_table's plan).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from . import ranks
from .lineage import saved

BOUNDED = ("maxmin", "minmin", "meanmin", "mean", "earth_movers")
BLOCK, MOST, BLOCKS = 256, 2048, 32  # bags of a block, at least and at most, and blocks of a cell before they grow
CELLS = 1 << 14  # at most, so that a row per cell is small
AXES, PIVOTS = 3, 8
RUN = 512  # bags of a run that bounds radii
SLACK = 1e-9  # of the size of coordinates, for rounding

Axis = tuple[int, float, float, int]  # number, lowest value, width and number of strips


def pivots(bags: DataFrame, n: int = PIVOTS) -> list[list[float]]:
    """The first instances of n bags in a hashed order."""
    return [list(map(float, r[0])) for r in bags.where(F.size("bag") > 0).orderBy(F.xxhash64("bag_idx"), "bag_idx").select(F.col("bag")[0]).limit(n).collect()]


def with_ranges(bags: DataFrame, points: list[list[float]]) -> DataFrame:
    """bag_idx, bag, and the ranges low and high of its instances on every coordinate, then on the distances to points."""

    def far(x: Column, p: list[float]) -> Column:
        gaps = F.zip_with(x, F.lit(p), lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v))

    rows = F.transform("bag", lambda x: F.concat(x, F.array(*(far(x, p) for p in points)).cast("array<double>")))
    wide = bags.select("bag_idx", "bag", rows.alias("rows"))

    def fold(f) -> Column:
        return F.aggregate("rows", F.get("rows", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda u, v: f(u, v)))

    return wide.select("bag_idx", "bag", fold(F.least).alias("low"), fold(F.greatest).alias("high"))


def axes(right: DataFrame, radius: float, n: int) -> list[Axis]:
    """The axes that cut the ranges of ``right`` into the most strips at this radius, and how."""
    both = F.posexplode(F.arrays_zip("low", "high")).alias("axis", "s")
    stats = right.select(both).select("axis", F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    found = stats.groupBy("axis").agg(F.min("low").alias("a"), F.max("high").alias("z"), F.avg(F.col("high") - F.col("low")).alias("e")).collect()  # a row per axis
    able = []
    for r in found:
        if all(map(math.isfinite, (r.a, r.z, r.e))) and r.z > r.a:
            strips = int(min(CELLS, (r.z - r.a) / max(2 * (radius + r.e), (r.z - r.a) / CELLS)))
            able.append((strips, r))
    able = sorted((x for x in able if x[0] > 1), key=lambda x: (-x[0], x[1].axis))[:AXES]
    left, out = max(1, min(CELLS, -(-4 * n // BLOCK))), []
    for k, (strips, r) in enumerate(able):
        take = min(strips, math.ceil(left ** (1 / (len(able) - k))))
        if take > 1:
            out.append((r.axis, r.a, (r.z - r.a) / take, take))
            left = max(1, left // take)
    return out


def _strip(value: Column, axis: Axis) -> Column:
    _, lowest, width, n = axis
    return F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (value - lowest) / width)).cast("int")


def with_cells(ranged: DataFrame, cut: list[Axis], radius: Column | None = None) -> DataFrame:
    """A row per cell that the bag covers (grown by a radius): ``cell``, and ``firsts``, its first strip on each axis."""
    grown = F.lit(0.0) if radius is None else radius
    firsts, lasts = [], []
    for axis in cut:
        low, high = F.get("low", F.lit(axis[0])), F.get("high", F.lit(axis[0]))
        by = grown + SLACK * (F.abs(low) + F.abs(high) + abs(axis[1]) + grown) if radius is not None else F.lit(0.0)
        firsts.append(_strip(low - by, axis))
        lasts.append(_strip(high + by, axis))
    out = ranged.withColumn("firsts", F.array(*firsts).cast("array<int>")).withColumn("cell", F.lit(0))
    for axis, first, last in zip(cut, firsts, lasts, strict=True):
        out = out.withColumn("strip", F.explode(F.sequence(first, last))).withColumn("cell", F.col("cell") * axis[3] + F.col("strip")).drop("strip")
    return out


def _bags(flat: pd.Series, sizes: pd.Series) -> list[np.ndarray]:
    return [np.asarray(f, float).reshape(n, -1) for f, n in zip(flat, sizes, strict=True)]


def _one_by_one(x: pd.DataFrame, y: pd.DataFrame, distance: str, strips: list[int], most: int | None):
    """(places of x, places of y, d) of the pairs within the radius that are reported in this cell, bag by bag; a bag on both
    sides is near itself.  most: at least the nearest so many others."""
    bounded, mats = distance in BOUNDED, _bags(y.y, y.m)
    low, high = np.stack([m.min(0) for m in mats]), np.stack([m.max(0) for m in mats])
    ids, firsts = y.j.to_numpy(), np.stack(y.b.to_numpy()).reshape(len(y), -1)
    for at, (i, bag, radius, first, cell) in enumerate(zip(x.i, _bags(x.x, x.n), x.radius, x.a, x.cell, strict=True)):
        mine = np.zeros(len(ids), np.int64)
        for k, n in enumerate(strips):
            mine = mine * n + np.maximum(firsts[:, k], first[k])
        able, least, top = mine == cell, bag.min(0), bag.max(0)
        own = (ids == i) & ((low == least) | (np.isnan(low) & np.isnan(least))).all(1) & ((high == top) | (np.isnan(high) & np.isnan(top))).all(1)
        if bounded:
            gap = np.sqrt((np.maximum(0, np.maximum(low - top, least - high)) ** 2).sum(1))
            able &= ~(gap * (1 - SLACK) > radius) | own
        some = np.flatnonzero(able)
        if len(some):
            near = [mats[k] for k in some]
            d = kernels.against(distance, bag, np.concatenate(near), np.cumsum([0, *(len(m) for m in near[:-1])]))
            mask = (d <= radius) | own[some] if most is None else np.ones(len(d), bool)  # the k nearest also where a distance isn't a number
            yield np.full(mask.sum(), at), some[mask], d[mask]


def _together(x: pd.DataFrame, y: pd.DataFrame, strips: list[int], most: int | None):
    """As ``_one_by_one`` for ``minmin`` and bags of finite values, with all of the block at once."""
    right = kernels.sheets(y.y, y.m)
    left = kernels.sheets(x.x, x.n, right.centre)
    radii, cell = x.radius.to_numpy(), x.cell.to_numpy()
    if not np.isfinite(kernels.rounding(left, right)) or not (radii >= 0).all():
        yield from _one_by_one(x, y, "minmin", strips, most)
        return
    one, two = (np.stack(f.to_numpy()).reshape(len(f), -1) for f in (x.a, y.b))
    for i, j, d in kernels.nearest_pairs(left, right, radii, None if most is None else most + 1):  # itself may be among them
        if strips:
            mine = np.zeros(len(i), np.int64)
            for k, n in enumerate(strips):
                mine = mine * n + np.maximum(one[i, k], two[j, k])
            mask = mine == cell[i]
            i, j, d = i[mask], j[mask], d[mask]
        yield i, j, d


def least_of(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least d of each i, ties by j."""
    order = np.lexsort((j, d, i))
    own = i[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return order[rank < k]


def as_pairs(x: pd.DataFrame, y: pd.DataFrame, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"i": x.i.to_numpy()[i], "j": y.j.to_numpy()[j], "d": d})


def as_counts(x: pd.DataFrame, y: pd.DataFrame, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    n = np.bincount(i, minlength=len(x))
    return pd.DataFrame({"i": x.i.to_numpy()[n > 0], "n": n[n > 0]})


def least_pairs(k: int):
    """The k nearest of each bag, itself among them."""
    def finish(x: pd.DataFrame, y: pd.DataFrame, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        return as_pairs(x, y, *(v[least_of(i, y.j.to_numpy()[j], d, k)] for v in (i, j, d)))

    return finish


def as_lists(x: pd.DataFrame, y: pd.DataFrame, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    """A row per marked bag with the ids and distances of its neighbours as bytes."""
    mask = x.mark.to_numpy()[i]
    i, j, d = i[mask], y.j.to_numpy()[j[mask]], d[mask]
    order = np.argsort(i, kind="stable")
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
    ends = np.r_[first[1:], len(i)] if len(i) else first
    return pd.DataFrame({"i": x.i.to_numpy()[i[first]], "js": [j[p:q].tobytes() for p, q in zip(first, ends, strict=True)], "ds": [d[p:q].tobytes() for p, q in zip(first, ends, strict=True)]})


def as_links(both: bool):
    """(a, b, border): edges that connect what the pairs of a block connect, at most one for each bag of it.  Pairs count if the
    left bag is marked and, with ``both``, the right one too; then pairs of another left bag and a marked one are border rows."""

    def finish(x: pd.DataFrame, y: pd.DataFrame, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        left, right = x.mark.to_numpy()[i], y.mark.to_numpy()[j]
        mask, ids = left & right if both else left, np.concatenate([x.i.to_numpy(), y.j.to_numpy()])
        u, v, label = i[mask], j[mask] + len(x), np.arange(len(ids))
        while len(u):
            least = np.minimum(label[u], label[v])
            moved = label.copy()
            for end in (label[u], label[v]):
                np.minimum.at(moved, end, least)
            while (moved != moved[moved]).any():
                moved = moved[moved]
            label = moved[label]
            apart = label[u] != label[v]
            u, v = u[apart], v[apart]
        tied = np.flatnonzero(label != np.arange(len(ids)))
        out = pd.DataFrame({"a": ids[label[tied]], "b": ids[tied], "border": False})
        if not both:
            return out
        edge = ~left & right
        return pd.concat([out, pd.DataFrame({"a": x.i.to_numpy()[i[edge]], "b": y.j.to_numpy()[j[edge]], "border": True})])

    return finish


def _measure(distance: str, cut: list[Axis], finish, schema: str, most: int | None):
    """What ``finish`` makes of a cell's block of left and block of right bags and their pairs that are near enough."""
    strips = [n for *_, n in cut]
    names = [part.split()[0] for part in schema.split(", ")]

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({name: [] for name in names})
        found = _together(x, y, strips, most) if distance == "minmin" else _one_by_one(x, y, distance, strips, most)
        parts = []
        for i, j, d in found:
            if most is not None:
                other = x.i.to_numpy()[i] != y.j.to_numpy()[j]
                i, j, d = i[other], j[other], d[other]
            parts.append((i, j, d))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        i, j, d = (np.concatenate(c) for c in zip(none, *parts, strict=True))
        if most is not None:
            some = least_of(i, y.j.to_numpy()[j], d, most)
            i, j, d = i[some], j[some], d[some]
        return finish(x, y, i, j, d)[names]

    return compare


def _size(n: Column) -> Column:
    """Bags of a block of a cell of n: more of them in crowded cells, as each bag is sent once for each block of the other side."""
    return F.greatest(F.lit(BLOCK), F.least(F.lit(MOST), F.ceil(n / BLOCKS)))


def _blocks(rows: DataFrame, counts: DataFrame, own: str, others: str, key: str) -> DataFrame:
    """rows with their block of the cell, and once for each block of the other side."""
    sized = counts.select("cell", F.col(own).alias("_own"), F.col(others).alias("_others"))
    n, m = (F.ceil(F.col(c) / _size(F.col(c))) for c in ("_own", "_others"))
    mine = F.pmod(F.xxhash64(key), n).cast("int")
    return rows.join(F.broadcast(sized), "cell").withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), m.cast("int") - 1)))


class Cells:
    """The cells of left bags (bag_idx, bag, radius) and right bags (bag_idx, bag), and the comparisons that they ask for."""

    def __init__(self, left: DataFrame, right: DataFrame, radius: float, distance: str) -> None:
        self.distance = distance
        points = pivots(right) if distance in BOUNDED else []
        ranged = with_ranges(right, points)
        self.total = right.count()
        self.cut = axes(ranged, radius, self.total) if distance in BOUNDED and math.isfinite(radius) else []
        mine = with_ranges(left, points).join(left.select("bag_idx", "radius"), "bag_idx") if "radius" in left.columns else with_ranges(left, points).withColumn("radius", F.lit(float(radius)))
        flat = F.flatten("bag")
        self.left = saved(with_cells(mine, self.cut, F.col("radius")).select(F.col("bag_idx").alias("i"), flat.alias("x"), F.size("bag").alias("n"), "radius", F.col("firsts").alias("a"), "cell"))
        self.right = saved(with_cells(ranged, self.cut).select(F.col("bag_idx").alias("j"), flat.alias("y"), F.size("bag").alias("m"), F.col("firsts").alias("b"), "cell"))
        # a row per cell, of which there are CELLS at most
        self.counts = saved(self.left.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(self.right.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell"))

    def pairs_of_blocks(self) -> int:
        """How many pairs of blocks are compared; all of them would be ceil(bags / BLOCK) of both sides, multiplied."""
        return self.counts.agg(F.sum(F.ceil(F.col("n") / _size(F.col("n"))) * F.ceil(F.col("m") / _size(F.col("m"))))).first()[0] or 0

    def joined(self, most: int | None = None, finish=as_pairs, schema: str = "i long, j long, d double", marked: DataFrame | None = None) -> DataFrame:
        """What finish makes of the pairs of each two blocks: those within the radius, or with ``most`` so many nearest others of
        each bag of the block.  marked (bag_idx) gives bags of both sides the mark that finish may look at."""
        left, right, marks = self.left, self.right, []
        if marked is not None:
            left, right = (t.join(marked.select(F.col("bag_idx").alias(c), F.lit(True).alias("mark")), c, "left").withColumn("mark", F.coalesce("mark", F.lit(False))) for t, c in ((left, "i"), (right, "j")))
            marks = ["mark"]
        a = _blocks(left, self.counts, "n", "m", "i").select("i", "x", "n", "radius", "a", "cell", *marks, F.col("own").alias("p"), F.col("other").alias("q"))
        b = _blocks(right, self.counts, "m", "n", "j").select("j", "y", "m", "b", *marks, F.col("cell").alias("c"), F.col("other").alias("r"), F.col("own").alias("s"))
        return a.groupBy("cell", "p", "q").cogroup(b.groupBy("c", "r", "s")).applyInPandas(_measure(self.distance, self.cut, finish, schema, most), schema)


def within(left: DataFrame, right: DataFrame, epsilon: float, distance: str = "minmin") -> DataFrame:
    """(i, j, d) with d <= epsilon; a bag that stands on both sides (the same index and box) is its own neighbour."""
    return Cells(left, right, epsilon, distance).joined()


def first_radii(left: DataFrame, right: DataFrame, k: int, distance: str) -> DataFrame:
    """left with ``radius``: the k-th distance to bags of right in a run of RUN bags that are near in the order of cells;
    infinite where the run has fewer."""
    points = pivots(right)
    ranged = with_ranges(right, points)
    cut = axes(ranged, 0.0, right.count())

    def home(rows: DataFrame, side: int) -> DataFrame:
        cell = F.lit(0)
        for axis in cut:
            cell = cell * axis[3] + _strip((F.get("low", F.lit(axis[0])) + F.get("high", F.lit(axis[0]))) / 2, axis)
        return rows.select("bag_idx", F.flatten("bag").alias("flat"), F.size("bag").alias("size"), F.lit(side).alias("side"), cell.alias("cell"))

    both = home(with_ranges(left, points), 0).unionByName(home(ranged, 1))
    runs = ranks.numbered(both, ["cell", F.xxhash64("bag_idx"), "bag_idx", "side"]).withColumn("run", F.floor(F.col("place") / RUN))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, others = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if distance == "minmin" and len(mine) and len(others):
            right = kernels.sheets(others.flat, others["size"])
            left = kernels.sheets(mine.flat, mine["size"], right.centre)
            if np.isfinite(kernels.rounding(left, right)):
                radii = np.full(len(mine), math.inf)
                i, j, d = (np.concatenate(c) for c in zip(*kernels.nearest_pairs(left, right, radii, k + 1), strict=True))
                other = mine.bag_idx.to_numpy()[i] != others.bag_idx.to_numpy()[j]
                i, j, d = i[other], j[other], d[other]
                some = least_of(i, j, d, k)
                i, d = i[some], d[some]
                last = np.flatnonzero(np.r_[i[1:] != i[:-1], True]) if len(i) else np.zeros(0, int)
                last = last[np.bincount(i, minlength=len(mine))[i[last]] == k]
                radii[i[last]] = d[last]
                return pd.DataFrame({"bag_idx": mine.bag_idx, "radius": radii})
        mats, ids = _bags(others.flat, others["size"]), others.bag_idx.to_numpy()
        stack, starts = (np.concatenate(mats), np.cumsum([0, *(len(m) for m in mats[:-1])])) if mats else (None, None)
        radii = []
        for i, bag in zip(mine.bag_idx, _bags(mine.flat, mine["size"]), strict=True):
            d = kernels.against(distance, bag, stack, starts)[ids != i] if mats else np.zeros(0)
            d = np.sort(d[~np.isnan(d)])
            radii.append(float(d[k - 1]) if len(d) >= k else math.inf)
        return pd.DataFrame({"bag_idx": mine.bag_idx, "radius": radii})

    found = runs.groupBy("run").applyInPandas(bound, "bag_idx long, radius double")
    return left.select("bag_idx", "bag").join(found, "bag_idx")


def nearest(left: DataFrame, right: DataFrame, k: int, distance: str = "minmin") -> Cells:
    """The cells within the first radii; joined(k) gives the candidates for the k nearest."""
    bounded = saved(first_radii(left, right, k, distance))
    mean = bounded.where(F.col("radius") < float("inf")).agg(F.avg("radius")).first()[0]
    return Cells(bounded, right, float("inf") if mean is None else mean, distance)
