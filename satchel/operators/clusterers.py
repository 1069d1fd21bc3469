"""Bag clusterers.

Iterative ones are a driver loop over one assignment plan and one aggregation; k centres are all that the driver holds.
Density-based ones take their neighbours from a range join; components are contracted in Spark.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.views import long
from . import ranks, spatial
from .centres import held, mean_centroids, medoids
from .joins import assign_nearest, range_join
from .lineage import saved


def initial_bags(bags: DataFrame, k: int, seed: int = 10) -> DataFrame:
    """k different bags in a hashed order (equal bags count once)."""
    rows = bags.select("bag_idx", "bag", F.xxhash64("bag").alias("h")).groupBy("h").agg(F.min_by(F.struct("bag_idx", "bag"), "bag_idx").alias("b"))
    return rows.select("b.*").orderBy(F.xxhash64(F.lit(seed), "bag_idx"), "bag_idx").limit(k)


def _repaired(bags: DataFrame, found: DataFrame, centres: dict, distance: str) -> DataFrame:
    """Each empty cluster, in order, takes the bag that is nearest to it (the lowest index on ties); of one pass over bags."""
    empty = sorted(set(centres) - {r[0] for r in found.select("cluster").distinct().collect()})
    if not empty:
        return found
    mats = [np.atleast_2d(np.asarray(centres[c], float)) for c in empty]
    stack, starts = np.concatenate(mats), np.cumsum([0, *(len(m) for m in mats[:-1])])

    def nearest(batches):
        for pdf in batches:
            rows = [(c, d, i) for i, b in zip(pdf.bag_idx, pdf.bag, strict=True) for c, d in zip(empty, kernels.against(distance, np.stack(b).astype(float), stack, starts), strict=True)]
            yield pd.DataFrame(rows, columns=["c", "d", "bag_idx"]).sort_values(["d", "bag_idx"]).groupby("c", as_index=False).first()[["c", "d", "bag_idx"]]

    least = bags.select("bag_idx", "bag").mapInPandas(nearest, "c int, d double, bag_idx long").groupBy("c").agg(F.min(F.struct("d", "bag_idx")).alias("m"))
    taken = {r.m.bag_idx: r.c for r in least.orderBy("c").collect()}  # a row per empty cluster
    if not taken:
        return found
    to = F.create_map(*(F.lit(v) for pair in taken.items() for v in pair))
    return found.withColumn("cluster", F.coalesce(F.element_at(to, F.col("bag_idx")), F.col("cluster")).cast("int"))


def _means(bags: DataFrame, found: DataFrame) -> DataFrame:
    """centres.mean_centroids of bags, which are summed up before they are joined, so that no instances are shuffled."""

    def summed(batches):
        for pdf in batches:
            yield pd.DataFrame({"bag_idx": pdf.bag_idx, "n": [len(b) for b in pdf.bag], "sums": [np.stack(b).astype(float).sum(0) for b in pdf.bag]})

    sums = bags.select("bag_idx", "bag").mapInPandas(summed, "bag_idx long, n long, sums array<double>")
    rows = sums.join(found.where("cluster >= 0").select("bag_idx", "cluster"), "bag_idx")
    flat = rows.select("cluster", "n", F.posexplode("sums").alias("dim", "v")).groupBy("cluster", "dim").agg((F.sum("v") / F.sum("n")).alias("v"))
    return flat.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("c"))


def one_step(bags: DataFrame, clusters: DataFrame, distance: str = "maxmin", repair: bool = True) -> DataFrame:
    """Mean centroids of an assignment, and each bag to the nearest."""
    centres = held(mean_centroids(long(bags), clusters))
    found = assign_nearest(bags, centres, distance)
    return _repaired(bags, found, centres, distance) if repair else found


class KMeans:
    """Lloyd iterations with mean centroids; ``start``: indices of the bags whose means are the first centroids."""

    def __init__(self, k: int = 2, distance: str = "maxmin", most_iterations: int = 500, seed: int = 10, start: list[int] | None = None, repair: bool = True) -> None:
        self.k, self.distance, self.most, self.seed, self.start, self.repair = k, distance, most_iterations, seed, start, repair
        self.centres: dict[int, np.ndarray] = {}
        self.iterations = 0

    def _first(self, bags: DataFrame) -> dict[int, np.ndarray]:
        if self.start is not None:
            rows = {r.bag_idx: r.bag for r in bags.where(F.col("bag_idx").isin(self.start)).collect()}
            chosen = [rows[i] for i in self.start]
        else:
            chosen = [r.bag for r in initial_bags(bags, self.k, self.seed).collect()]
        return {c: self._centre(np.asarray(b, float)) for c, b in enumerate(chosen)}

    def _centre(self, bag: np.ndarray) -> np.ndarray:
        return bag.mean(0)

    def _update(self, bags: DataFrame, found: DataFrame) -> dict[int, np.ndarray]:
        return held(_means(bags, found))

    def fit(self, bags: DataFrame) -> DataFrame:
        """(bag_idx, cluster, d); the last assignment is always to mean centroids.

        Bags are kept once; an iteration reads them and shuffles their sums, and no instances."""
        bags = saved(bags.select("bag_idx", "bag"))
        centres, before = self._first(bags), None
        for self.iterations in range(1, self.most + 1):  # noqa: B007
            found = assign_nearest(bags, centres, self.distance)
            if self.repair:
                found = _repaired(bags, found, centres, self.distance)
            found = saved(found)
            if before is not None and found.select("bag_idx", "cluster").exceptAll(before.select("bag_idx", "cluster")).isEmpty():
                break
            before, centres = found, self._update(bags, found)
        self.centres = held(_means(bags, found))
        return assign_nearest(bags, self.centres, self.distance)

    def predict(self, bags: DataFrame) -> DataFrame:
        """Nearest centroid of unseen bags, batch or stream."""
        return assign_nearest(bags, self.centres, self.distance)


class KMedoids(KMeans):
    """k-means whose centres are bags: the medoid of each cluster."""

    def _centre(self, bag: np.ndarray) -> np.ndarray:
        return bag

    def _update(self, bags: DataFrame, found: DataFrame) -> dict[int, np.ndarray]:
        return {r.cluster: np.asarray(r.bag, float) for r in medoids(bags, found, self.distance).collect()}


class LikeClass:
    """The label as cluster."""

    def fit(self, bags: DataFrame) -> DataFrame:
        return bags.select("bag_idx", F.col("label").alias("cluster"))


def least_reachable(edges: DataFrame) -> DataFrame:
    """(node, least): the smallest node that edges (a, b) connect, by contraction in a hashed order."""
    def ranked(c):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))

    left = saved(edges.select("a", "b").where("a != b").distinct())
    to = saved(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("leader", F.col("node")))
    while not left.isEmpty():
        step = saved(left.union(left.select("b", "a")).groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("x"), F.least("m", ranked("a"))["v"].alias("p")))
        to = saved(to.join(step, to.leader == step.x, "left").select("node", F.coalesce("p", "leader").alias("leader")))
        ends = step.toDF("y", "q")
        left = saved(left.join(step, left.a == step.x).join(ends, left.b == ends.y).select(F.col("p").alias("a"), F.col("q").alias("b")).where("a != b").distinct())
    return to.join(to.groupBy("leader").agg(F.min("node").alias("least")), "leader").select("node", "least")


class DBSCAN:
    """Density clusters for symmetric distances.  Keys are ordered as strings, as is the visiting order.

    Clusters are numbered by their first core key; a border bag goes to the last cluster whose seed (its first core)
    is its neighbour, else to the first cluster that reaches it; noise is -2.
    """

    def __init__(self, epsilon: float = 0.9, min_points: int = 6, distance: str = "minmin") -> None:
        self.epsilon, self.min_points, self.distance = epsilon, min_points, distance

    def _links(self, bags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The cores, edges (a, b) that connect what neighbouring cores do, and (i, j) of other bags and their neighbouring cores."""
        if self.distance in spatial.BOUNDED:
            # neighbours are found twice and not kept: all pairs of a dense cluster are far more than connect it
            cells = spatial.Cells(bags, bags, self.epsilon, self.distance)
            degrees = cells.joined(finish=spatial.as_counts, schema="i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
            core = saved(degrees.where(F.col("n") >= self.min_points).select(F.col("i").alias("core")))
            links = saved(cells.joined(finish=spatial.as_links(True), schema="a long, b long, border boolean", marked=core.withColumnRenamed("core", "bag_idx")))
            return core, links.where("not border").select("a", "b"), links.where("border").select(F.col("a").alias("i"), F.col("b").alias("j"))
        near = saved(range_join(bags, bags, self.epsilon, self.distance).select("i", "j"))
        core = saved(near.groupBy("i").count().where(F.col("count") >= self.min_points).select(F.col("i").alias("core")))
        edges = near.join(core, near.i == core.core).drop("core").join(core, near.j == core.core).select(F.col("i").alias("a"), F.col("j").alias("b"))
        return core, edges, near.join(core, near.i == core.core, "left_anti")

    def fit(self, bags: DataFrame) -> DataFrame:
        core, edges, near = self._links(bags)
        joined = core.join(least_reachable(edges), core.core == F.col("node"), "left").select("core", F.coalesce("least", "core").alias("part"))
        seeds = joined.groupBy("part").agg(F.min_by("core", F.col("core").cast("string")).alias("seed"))
        order = sorted((str(r.seed), r.part, r.seed) for r in seeds.collect())  # one row per cluster
        spark = bags.sparkSession
        known = spark.createDataFrame([(p, c, s) for c, (_, p, s) in enumerate(order)], "part long, cluster int, seed long")
        cores = saved(joined.join(F.broadcast(known), "part").select("core", "cluster", "seed"))
        border = near.join(cores, near.j == cores.core)
        border = border.groupBy("i").agg(F.max(F.when(F.col("core") == F.col("seed"), F.col("cluster"))).alias("last"), F.min("cluster").alias("first")).select(F.col("i").alias("bag_idx"), F.coalesce("last", "first").alias("c"))
        both = cores.select(F.col("core").alias("bag_idx"), F.col("cluster").alias("c")).union(border)
        return bags.select("bag_idx").join(both, "bag_idx", "left").select("bag_idx", F.coalesce("c", F.lit(-2)).alias("cluster"))


UNDEFINED = 2147483647.0


class _Component:
    """A component whose bags are ordered: cores in memory, the neighbours of each bag in a file of the task."""

    def __init__(self) -> None:
        self.core, self.at, self.file = {}, {}, tempfile.SpooledTemporaryFile(max_size=1 << 24)

    def add(self, i: int, core, js, ds) -> None:
        if js is None:
            self.core[i] = core
        else:
            self.at.setdefault(i, []).append((self.file.tell(), len(js)))
            self.file.write(js)
            self.file.write(ds)

    def neighbours(self, i: int):
        for offset, size in self.at.get(i, ()):
            self.file.seek(offset)
            raw = self.file.read(2 * size)
            yield np.frombuffer(raw, np.int64, size // 8), np.frombuffer(raw, float, size // 8, size)

    def ordered(self, expand_all: bool, undefined: float) -> pd.DataFrame:
        """(start, step, bag_idx, core, reach), a run for each start in the order of keys."""
        ids = np.array(sorted(self.core))
        best, done, out = np.full(len(ids), undefined), np.zeros(len(ids), bool), []
        for start in sorted(self.core, key=str):
            k = int(np.searchsorted(ids, start))
            heap, step = [] if done[k] else [(undefined, str(start), k)], 0
            while heap:
                reach, _, k = heapq.heappop(heap)
                if done[k] or reach > best[k]:
                    continue
                done[k], i = True, int(ids[k])
                core = self.core[i]
                out.append((start, step, i, core, None if reach == undefined else reach))
                step += 1
                if pd.isna(core) and not expand_all:
                    continue
                for js, ds in self.neighbours(i):
                    to, d = np.searchsorted(ids, js), ds if pd.isna(core) else np.maximum(core, ds)
                    better = ~done[to] & (d < best[to])
                    best[to[better]] = d[better]
                    for r, t in zip(d[better].tolist(), to[better].tolist(), strict=True):
                        heapq.heappush(heap, (r, str(ids[t]), t))
        self.file.close()
        return pd.DataFrame(out, columns=["start", "step", "bag_idx", "core", "reach"]).astype({"core": float, "reach": float})


def _runs(expand_all: bool, undefined: float):
    """Orders components whose rows (part, i, core, js, ds) come one component after the other."""

    def order(batches):
        part, held = None, _Component()
        for pdf in batches:
            for p, i, core, js, ds in zip(pdf.part, pdf.i, pdf.core, pdf.js, pdf.ds, strict=True):
                if p != part and part is not None:
                    yield held.ordered(expand_all, undefined)
                    held = _Component()
                part = p
                held.add(i, core, js, ds)
        if part is not None:
            yield held.ordered(expand_all, undefined)

    return order


class OPTICS:
    """Cluster ordering.

    A run of the ordering stays inside one component of the graph of expanding bags and their neighbours, so components are
    ordered in tasks of their own; runs are put in the order of the keys (as strings) that they start from, and numbered by
    their sizes.  Bags that no expanding bag reaches are runs of their own, made without a task.  The ordering inside a
    component is sequential, so one task gets all edges of a component: it keeps them in a file of its own and holds a few
    numbers for each bag.  Nothing is held by the driver.
    """

    def __init__(self, epsilon: float = 0.9, min_points: int = 6, distance: str = "minmin", compat_expand_all: bool = False) -> None:
        self.epsilon, self.min_points, self.distance, self.expand_all = epsilon, min_points, distance, compat_expand_all

    def _cores(self, near: DataFrame) -> DataFrame:
        by = Window.partitionBy("i").orderBy("d", "j")
        kth = near.withColumn("place", F.row_number().over(by)).where(F.col("place") <= self.min_points)
        return kth.groupBy(F.col("i").alias("bag_idx")).agg(F.max(F.when(F.col("place") == self.min_points, F.col("d"))).alias("core"))

    def core_distances(self, bags: DataFrame) -> DataFrame:
        """bag_idx and core: the distance of the min_points-th neighbour (itself included), null if there are fewer."""
        if self.distance in spatial.BOUNDED:
            return self._least(spatial.Cells(bags, bags, self.epsilon, self.distance))
        return self._cores(range_join(bags, bags, self.epsilon, self.distance))

    def _least(self, cells: spatial.Cells) -> DataFrame:
        """core_distances from the min_points nearest of each two blocks."""
        return self._cores(cells.joined(finish=spatial.least_pairs(self.min_points)))

    def _near(self, bags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """core distances, edges (a, b) that connect what expanding bags reach, and rows (i, js, ds) of their neighbours."""
        if self.distance in spatial.BOUNDED:
            cells = spatial.Cells(bags, bags, self.epsilon, self.distance)
            core = saved(self._least(cells))
            marked = core if self.expand_all else core.where("core is not null")
            links = cells.joined(finish=spatial.as_links(False), schema="a long, b long, border boolean", marked=marked).select("a", "b")
            return core, links, cells.joined(finish=spatial.as_lists, schema="i long, js binary, ds binary", marked=marked)
        near = saved(range_join(bags, bags, self.epsilon, self.distance))
        core = saved(self._cores(near))
        used = near if self.expand_all else near.join(core.where("core is not null").select(F.col("bag_idx").alias("i")), "i", "left_semi")

        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"i": pdf.i.iloc[:1], "js": [pdf.j.to_numpy(np.int64).tobytes()], "ds": [pdf.d.to_numpy(float).tobytes()]})

        return core, used.select(F.col("i").alias("a"), F.col("j").alias("b")), used.groupBy("i").applyInPandas(packed, "i long, js binary, ds binary")

    def fit(self, bags: DataFrame) -> DataFrame:
        """(ord, bag_idx, core, reach)."""
        core, links, lists = self._near(bags)
        parts = saved(least_reachable(links))
        of = parts.select(F.col("node").alias("i"), F.col("least").alias("part"))
        nodes = core.withColumnRenamed("bag_idx", "i").join(of, "i").select("part", "i", "core", F.lit(None).cast("binary").alias("js"), F.lit(None).cast("binary").alias("ds"))
        edges = lists.join(of, "i").select("part", "i", F.lit(None).cast("double").alias("core"), "js", "ds")
        order = _runs(self.expand_all, UNDEFINED)
        rows = nodes.unionByName(edges).repartition("part").sortWithinPartitions("part", "i")
        runs = rows.mapInPandas(order, "start long, step long, bag_idx long, core double, reach double")
        alone = core.join(parts.withColumnRenamed("node", "bag_idx"), "bag_idx", "left_anti").select(F.col("bag_idx").alias("start"), F.lit(0).cast("long").alias("step"), "bag_idx", "core", F.lit(None).cast("double").alias("reach"))
        runs = saved(runs.unionByName(alone))
        sizes = runs.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
        placed, _ = ranks.running(sizes, [F.col("start").cast("string"), "start"], "n")
        found = runs.join(placed.select("start", "before"), "start")
        return found.select((F.col("before") + F.col("step")).cast("int").alias("ord"), "bag_idx", F.when(~F.isnan("core"), F.col("core")).alias("core"), F.when(~F.isnan("reach"), F.col("reach")).alias("reach"))


CLUSTERERS = {"kmeans": KMeans, "bamic": KMedoids, "dbscan": DBSCAN, "optics": OPTICS, "like_class": LikeClass}
