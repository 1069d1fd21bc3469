"""Pareto fronts, crowding, SPEA2 strength and density, sharing by given distances, and comparators (niches.py has the rest).

A population is (ind_id, objectives array<double>), all objectives to be maximised unless ``signs`` has -1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins, ranks
from .lineage import saved


def signed(pop: DataFrame, signs: list[int]) -> DataFrame:
    return pop.withColumn("objectives", F.transform("objectives", lambda v, i: v * F.get(F.array(*(F.lit(s) for s in signs)), i)))


def dominates(a: Column, b: Column) -> Column:
    z = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.forall(z, lambda s: s["a"] >= s["b"]) & F.exists(z, lambda s: s["a"] > s["b"])


def lexicographic(a: Column, b: Column) -> Column:
    """Whether a comes before b: arrays compare locus by locus."""
    return a > b


def dominance(pop: DataFrame) -> DataFrame:
    """(i, j): i dominates j."""
    a, b = pop.select(F.col("ind_id").alias("i"), F.col("objectives").alias("x")), pop.select(F.col("ind_id").alias("j"), F.col("objectives").alias("y"))
    return a.join(b, dominates(F.col("x"), F.col("y"))).select("i", "j")


def _dominators(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether row x[i] dominates row y[j]."""
    out = np.zeros((len(x), len(y)), bool)
    for a in range(0, len(y), 256):
        part = y[a : a + 256]
        least, more = np.ones((len(x), len(part)), bool), np.zeros((len(x), len(part)), bool)
        for p, q in zip(x.T, part.T, strict=True):
            least &= p[:, None] >= q
            more |= p[:, None] > q
        out[:, a : a + 256] = least & more
    return out


def _local(group: pd.DataFrame) -> pd.DataFrame:
    """Fronts inside a block, none below the one that is known already."""
    group = group.sort_values("place")
    x, front = np.array(group["objectives"].tolist(), float), group["front"].to_numpy().copy()
    for k in range(1, len(x)):
        above = (x[:k] >= x[k]).all(1) & (x[:k] > x[k]).any(1)
        if above.any():
            front[k] = max(front[k], front[:k][above].max() + 1)
    return group.assign(was=group["front"], front=front)


def _raised(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """The front that each row of y has at least because of a block x before it."""
    if not len(x) or not len(y):
        return pd.DataFrame({"ind_id": [], "least": []})
    above = _dominators(np.array(x["objectives"].tolist(), float), np.array(y["objectives"].tolist(), float))
    least = np.where(above, x["front"].to_numpy()[:, None] + 1, 0).max(0)
    return pd.DataFrame({"ind_id": y["ind_id"], "least": least})[least > 0]


def fronts(pop: DataFrame, block: int = 4096) -> DataFrame:
    """ind_id and front (0 first): the longest chain of individuals that dominate each other down to this one.

    Individuals are put in descending order of their objectives, where dominators come first, and cut into blocks.  Each
    block is solved in its task; then blocks raise those behind them until nothing changes, and only blocks that have
    changed are compared again.  Every round settles one more block at least, so there are at most as many rounds as blocks,
    however many fronts there are; no table of pairs is kept.  Individuals of equal objectives share a front."""
    rows = ranks.numbered(pop.select("ind_id", "objectives"), [F.col("objectives").desc(), "ind_id"])
    rows = rows.withColumn("block", F.floor(F.col("place") / block).cast("int")).withColumn("front", F.lit(0))
    schema = "ind_id long, objectives array<double>, place long, block int, front int, was int"
    columns = ["ind_id", "objectives", "place", "block", "front"]
    solved = saved(rows.select(*columns).groupBy("block").applyInPandas(_local, schema))
    last = solved.agg(F.max("block")).first()[0]
    changed = list(range(last or 0))
    while changed:
        a = solved.where(F.col("block").isin(changed) & (F.col("block") < last)).select("objectives", "front", F.col("block").alias("p"), F.explode(F.sequence(F.col("block") + 1, F.lit(last))).alias("q"))
        before = F.filter(F.lit(changed), lambda p: p < F.col("block"))
        b = solved.select("ind_id", "objectives", F.explode(before).alias("s"), F.col("block").alias("t"))
        raised = a.groupBy("p", "q").cogroup(b.groupBy("s", "t")).applyInPandas(_raised, "ind_id long, least int").groupBy("ind_id").agg(F.max("least").alias("least"))
        more = solved.join(raised, "ind_id", "left").withColumn("front", F.greatest("front", F.coalesce("least", F.lit(0))))
        known = solved.select("ind_id", F.col("front").alias("before"))
        solved = saved(more.select(*columns).groupBy("block").applyInPandas(_local, schema).drop("was").join(known, "ind_id"))
        changed = sorted(r[0] for r in solved.where("front != before").select("block").distinct().collect())  # numbers of blocks
        solved = solved.drop("before")
    return solved.select("ind_id", "front")


def crowding(ranked: DataFrame) -> DataFrame:
    """Of (ind_id, front, objectives): the sum over objectives of the neighbours' gap by range; infinite at the ends."""
    flat = ranked.select("ind_id", "front", F.posexplode("objectives").alias("k", "v"))
    by = Window.partitionBy("front", "k")
    order = by.orderBy("v", "ind_id")
    gap = F.lead("v").over(order) - F.lag("v").over(order)
    span = F.max("v").over(by) - F.min("v").over(by)
    value = F.when(F.lag("v").over(order).isNull() | F.lead("v").over(order).isNull(), float("inf")).otherwise(F.when(span == 0, 0.0).otherwise(gap / F.when(span == 0, 1.0).otherwise(span)))
    return flat.withColumn("c", value).groupBy("ind_id", "front").agg(F.sum("c").alias("crowding"))


def _by_dominance(forms: DataFrame, weight: str, below: bool, last: int) -> DataFrame:
    """place and total: the sum of ``weight`` over the forms that a form dominates (below), or that dominate it.

    Forms (place, objectives, block, weight) are in ascending order, so a dominator's block isn't before that of what it
    dominates.  Each such pair of blocks is a task that keeps one sum a row: no table of pairs is made."""
    a = forms.select(F.col("place").alias("i"), F.col("objectives").alias("x"), F.col(weight).alias("v"), F.col("block").alias("p"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("q"))
    b = forms.select(F.col("place").alias("j"), F.col("objectives").alias("y"), F.col(weight).alias("w"), F.col("block").alias("s"), F.explode(F.sequence(F.col("block"), F.lit(last))).alias("r"))

    def summed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"place": [], "part": []})
        x, y = np.array(left["x"].tolist(), float), np.array(right["y"].tolist(), float)
        able, asked = (x >= np.fmin.reduce(y)).all(1), (y <= np.fmax.reduce(x)).all(1)
        over = _dominators(x[able], y[asked])
        if below:
            place, parts = left["i"].to_numpy()[able], [np.where(o, right["w"].to_numpy()[asked], 0).sum() for o in over]
        else:
            place, parts = right["j"].to_numpy()[asked], [np.where(o, left["v"].to_numpy()[able], 0).sum() for o in over.T]
        found = pd.DataFrame({"place": place, "part": np.array(parts, np.int64)})
        return found[found["part"] != 0]

    parts = a.groupBy("p", "q").cogroup(b.groupBy("r", "s")).applyInPandas(summed, "place long, part long")
    return parts.groupBy("place").agg(F.sum("part").alias("total"))


def spea2(pop: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """ind_id, strength, raw, density, fitness (lower is better): density from the k-th nearest other individual.

    Individuals of equal objectives are one form with a count; strengths and raw fitness are sums over pairs of blocks of
    forms, and the k-th nearest comes from the cells of spatial.nearest.  The population is kept first: sums of doubles can
    differ when they are computed again."""
    pop = saved(pop.select("ind_id", "objectives"))
    forms = ranks.numbered(pop.groupBy("objectives").agg(F.count(F.lit(1)).alias("n")), ["objectives"])
    forms = saved(forms.withColumn("block", F.floor(F.col("place") / block).cast("int")))
    last = forms.agg(F.max("block")).first()[0] or 0
    zero = F.lit(0).cast("long")
    strong = saved(forms.join(_by_dominance(forms, "n", True, last), "place", "left").withColumn("strength", F.coalesce("total", zero)).drop("total").withColumn("all", F.col("n") * F.col("strength")))
    rated = strong.join(_by_dominance(strong, "all", False, last), "place", "left").select("objectives", "strength", F.coalesce("total", zero).alias("raw"))
    bags = pop.select(F.col("ind_id").cast("long").alias("bag_idx"), F.array(F.transform("objectives", lambda v: F.coalesce(v, F.lit(float("nan"))))).alias("bag"))
    kth = joins.nearest_join(bags, bags, k).where(F.col("rank") == k).select(F.col("i").alias("ind_id"), (1 / (F.col("d") + 2)).alias("density"))
    out = pop.join(rated, "objectives").join(kth, "ind_id", "left").select("ind_id", "strength", "raw", F.coalesce("density", F.lit(0.5)).alias("density"))
    return out.withColumn("fitness", F.col("raw") + F.col("density"))


def uncrowded(x: np.ndarray, size: int, k: int, width: int = 256) -> np.ndarray:
    """The rows of x that ``truncated`` keeps.  Each row knows its nearest others (``width`` of them), which are looked for
    again once too few of them are left; so memory and each step grow with the number of rows only."""
    n, alive = len(x), np.ones(len(x), bool)
    width = max(1, min(n - 1, max(width, 4 * k)))
    near, other, far = np.full((n, width), -1), np.zeros(n, int), np.full(n, np.inf)

    def distances(i: int) -> np.ndarray:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        return np.where(np.isnan(d), np.inf, d)

    def fill(i: int) -> None:
        among = np.flatnonzero(alive)
        among = among[among != i]
        d, most = distances(i)[among], min(width, len(among))
        some = np.flatnonzero(d <= np.partition(d, most - 1)[most - 1])
        near[i] = -1
        near[i, :most] = among[some[d[some].argsort(kind="stable")][:most]]

    def settle(rows: np.ndarray, place: int) -> None:
        for a in range(0, len(rows), 4096):
            part = rows[a : a + 4096]
            left = ((near[part] >= 0) & alive[near[part]]).cumsum(1)
            short = left[:, -1] < place
            if short.any():
                for i in part[short]:
                    fill(i)
                left = ((near[part] >= 0) & alive[near[part]]).cumsum(1)
            other[part] = near[part, (left < place).sum(1)]
            gaps = np.sqrt(((x[part] - x[other[part]]) ** 2).sum(1))
            far[part] = np.where(np.isnan(gaps), np.inf, gaps)

    left, placed = n, None
    while left > max(size, 1):
        if placed != min(k, left - 1):
            placed = min(k, left - 1)
            settle(np.flatnonzero(alive), placed)
        among = np.flatnonzero(alive)
        gone = other[among[far[among].argmin()]]
        alive[gone], left = False, left - 1
        d = distances(gone)
        if left > max(size, 1):
            settle(np.flatnonzero(alive & ((d < far) | ((d == far) & (gone <= other)))), min(placed, left - 1))
    return np.flatnonzero(alive)[: max(size, 0)]


def truncated(points: DataFrame, size: int, k: int = 1) -> DataFrame:
    """The ind_id that stay of (ind_id, objectives) when crowded points leave, one at a time, until ``size`` are left: of the
    point whose k-th nearest other is closest, that other one leaves.  Ties go by ind_id; with k others or fewer left, the
    farthest counts.  Each step depends on the one before, so all points are in one task, which holds their nearest others."""

    def stay(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ind_id")
        return group.iloc[uncrowded(np.array(group["objectives"].tolist(), float), size, k)][["ind_id"]]

    return points.select("ind_id", "objectives").groupBy().applyInPandas(stay, "ind_id long")


def archive(scored: DataFrame, size: int, points: DataFrame | None = None, k: int = 1) -> DataFrame:
    """The non-dominated ones (raw 0), filled by fitness to ``size``; if they are more, cut by neighbours among ``points``
    (ind_id, objectives), or by fitness without these."""
    ahead = scored.where("raw = 0")
    if points is not None and ahead.count() > size:
        return scored.join(truncated(points.join(ahead.select("ind_id"), "ind_id"), size, k), "ind_id")
    return scored.orderBy((F.col("raw") > 0).cast("int"), "fitness", "ind_id").limit(size)


def shared_fitness(pop: DataFrame, pairs: DataFrame, radius: float, alpha: float = 1.0, compat: bool = False) -> DataFrame:
    """Of (ind_id, fitness) and distances (i, j, d) of i < j: fitness by the sum of the sharing function, itself being 1.

    The function is 1 - (d / radius)^alpha within the radius; compat: (d / radius)^alpha, itself being 0.
    """
    both = pairs.union(pairs.select("j", "i", "d"))
    part = F.pow(F.col("d") / radius, F.lit(float(alpha)))
    near = both.where(F.col("d") < radius).groupBy(F.col("i").alias("ind_id")).agg(F.sum(part if compat else 1 - part).alias("s"))
    own = 0.0 if compat else 1.0
    return pop.join(near, "ind_id", "left").select("ind_id", F.coalesce(F.try_divide("fitness", own + F.coalesce("s", F.lit(0.0))), F.col("fitness")).alias("fitness"))
