"""Silhouettes of whole populations of assignments, without a table of pairs.

Each pair of blocks of bags is a task that measures its distances once and adds them up by cluster of every assignment, so
what leaves it is a row per bag; the sums of distances to each cluster are all that silhouettes need.  If one label of an
assignment changes, the sums of every other bag change by one distance, so such neighbours of an assignment are rated from its
sums and the distances to the bags that change.  The work is quadratic in bags, as silhouettes are, tables are not.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from . import blocks, joins
from .lineage import saved


def _clusters(labels: DataFrame) -> list[tuple[int, int]]:
    """(ind_id, cluster) of a population, which is of a chosen size."""
    return sorted((r[0], r[1]) for r in labels.where("cluster >= 0").select("ind_id", "cluster").distinct().collect())


def _numbered(labels: DataFrame, names: list[tuple[int, int]]) -> DataFrame:
    """labels with ``column``, the place of their cluster in names."""
    types = {f.name: f.dataType.simpleString() for f in labels.schema}
    known = labels.sparkSession.createDataFrame([(i, c, k) for k, (i, c) in enumerate(names)], f"ind_id {types['ind_id']}, cluster {types['cluster']}, column int")
    return labels.join(F.broadcast(known), ["ind_id", "cluster"])  # a row per cluster of a population


def _marks(columns, width: int) -> np.ndarray:
    out = np.zeros((len(columns), width))
    for k, some in enumerate(columns):
        out[k, np.asarray(some, int)] = 1
    return out


def _summed(d: np.ndarray, marks: np.ndarray) -> np.ndarray:
    if np.isfinite(d).all():
        return d @ marks
    return np.stack([d[:, marks[:, c] > 0].sum(1) for c in range(marks.shape[1])], 1)


def cluster_sums(bags: DataFrame, labels: DataFrame, distance: str = "maxmin", block: int = joins.BLOCK) -> DataFrame:
    """(ind_id, i, cluster, s): the sum of the distances of bag i to all other bags of each cluster of each assignment."""
    names = _clusters(labels)
    width = len(names)
    mine = _numbered(labels, names).groupBy("bag_idx").agg(F.collect_list("column").alias("columns"))
    held = bags.select("bag_idx", F.flatten("bag").alias("flat"), F.size("bag").alias("size")).join(mine, "bag_idx")

    def prepare(part: pd.DataFrame, first) -> tuple:
        return part.bag_idx.to_numpy(), kernels.sheets(part.flat, part["size"], None if first is None else first[1].centre), _marks(part["columns"], width)

    def compare(x: tuple, y: tuple, same: bool) -> Iterator[pd.DataFrame]:
        to, back = kernels.both_ways(distance, x[1], y[1])
        if same:
            to[x[0][:, None] == y[0]] = 0
        yield pd.DataFrame({"i": x[0], "sums": list(_summed(to, y[2]))})
        if not same:
            yield pd.DataFrame({"i": y[0], "sums": list(_summed(back.T, x[2]))})

    parts = blocks.met(held, ["bag_idx"], F.size("flat"), block, prepare, compare, "i long, sums array<double>")
    added = parts.select("i", F.posexplode("sums").alias("column", "v")).groupBy("i", "column").agg(F.sum("v").alias("s"))
    of = F.lit([int(i) for i, _ in names]).cast("array<bigint>"), F.lit([int(c) for _, c in names]).cast("array<int>")
    return added.select(F.get(of[0], F.col("column")).alias("ind_id"), "i", F.get(of[1], F.col("column")).alias("cluster"), "s")


def silhouettes(bags: DataFrame, labels: DataFrame, distance: str = "maxmin", sums: DataFrame | None = None) -> DataFrame:
    """(ind_id, silhouette) of labels (ind_id, bag_idx, cluster): indices.silhouette for every assignment."""
    labels = labels.where("cluster >= 0").select("ind_id", "bag_idx", F.col("cluster").cast("int").alias("cluster"))
    labels = saved(labels.withColumn("ind_id", F.col("ind_id").cast("long")))
    if sums is None:
        if labels.isEmpty():
            return labels.select("ind_id", F.lit(0.0).alias("silhouette"))
        sums = cluster_sums(bags, labels, distance)
    n = labels.groupBy("ind_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    rows = sums.join(F.broadcast(n), ["ind_id", "cluster"]).join(labels.select("ind_id", F.col("bag_idx").alias("i"), F.col("cluster").alias("ci")), ["ind_id", "i"])
    own = F.col("cluster") == F.col("ci")
    d = F.try_divide(F.col("s"), F.col("n") - own.cast("int"))
    per = rows.groupBy("ind_id", "i").agg(F.max(F.when(own, d)).alias("a"), F.min(F.when(~own, d)).alias("b"))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    rated = per.groupBy("ind_id").agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(s)).alias("silhouette"), F.count(F.lit(1)).alias("bags"))
    return rated.where("bags > 1").select("ind_id", "silhouette")  # one bag has no pairs


def changed(bags: DataFrame, labels: DataFrame, loci: DataFrame, k: int, distance: str = "maxmin", block: int = joins.BLOCK) -> DataFrame:
    """(ind_id, bag_idx, label, silhouette) for each (ind_id, bag_idx) of loci and each label below k: the silhouette of the
    assignment whose bag has that label instead; labels (ind_id, bag_idx, cluster) has a row for every bag."""
    labels = saved(labels.select(F.col("ind_id").cast("long"), "bag_idx", F.col("cluster").cast("int").alias("cluster")))
    real = labels.where("cluster >= 0")
    every = {(i, c) for i in [r[0] for r in labels.select("ind_id").distinct().collect()] for c in range(k)}
    names = sorted(every | set(_clusters(labels)))
    sizes = {(r[0], r[1]): r[2] for r in real.groupBy("ind_id", "cluster").count().collect()}  # a row per cluster
    width, column = len(names), {name: c for c, name in enumerate(names)}
    columns_of = {i: [c for c, (x, _) in enumerate(names) if x == i] for i in {i for i, _ in names}}
    counts = np.array([sizes.get(name, 0) for name in names], float)
    sums = saved(cluster_sums(bags, labels, distance)) if sizes else None
    if sums is None:
        raise ValueError("no bag is assigned")

    base = silhouettes(bags, labels, distance, sums)
    wide = _numbered(sums, names).groupBy("i").agg(F.collect_list(F.struct("column", "s")).alias("sums")).withColumnRenamed("i", "bag_idx")
    mine = labels.groupBy("bag_idx").agg(F.collect_list(F.struct("ind_id", "cluster")).alias("labels"))
    flat = bags.select("bag_idx", F.flatten("bag").alias("flat"), F.size("bag").alias("size"))
    asked = saved(loci.select(F.col("ind_id").cast("long"), "bag_idx").join(labels, ["ind_id", "bag_idx"]).groupBy("bag_idx").agg(F.collect_list(F.struct("ind_id", "cluster")).alias("asked")))
    left = saved(flat.join(mine, "bag_idx").join(wide, "bag_idx", "left"))
    right = saved(flat.join(asked, "bag_idx"))
    n, m = (max(1, -(-t // joins._size(t, block))) for t in (left.count(), right.count()))
    a = left.withColumn("p", F.pmod(F.xxhash64("bag_idx"), F.lit(n)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    b = right.withColumn("s", F.pmod(F.xxhash64("bag_idx"), F.lit(m)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    schema = "ind_id long, bag_idx long, label int, s double, n long"

    def values(own: np.ndarray, s: np.ndarray, sizes_of: dict, ids: list[int], shift: dict) -> np.ndarray:
        """Silhouettes of bags of clusters own (columns), rows of s are their sums; shift: what to add to a column's sums."""
        some = [c for c in ids if sizes_of[c] > 0]
        near, away = np.zeros((len(own), 1)), np.full((len(own), 1), np.inf)
        with np.errstate(all="ignore"):
            for c in some:
                total, is_own = s[:, c][:, None] + shift.get(c, 0), (own == c)[:, None]
                near = np.where(is_own, total / max(1, sizes_of[c] - 1), near)
                away = np.where(is_own, away, np.fmin(away, total / sizes_of[c]))
            most = np.maximum(near, away)
            out = (away - near) / most
        alone = np.array([c < 0 or sizes_of[c] < 2 for c in own.tolist()]) | (len(some) < 2)
        return np.where(alone[:, None] | (most == 0), 0.0, out)

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64))]
        if len(x) and len(y):
            held = kernels.sheets(y.flat, y["size"])
            d, _ = kernels.both_ways(distance, kernels.sheets(x.flat, x["size"], held.centre), held)
            s, own = np.zeros((len(x), width)), {i: np.full(len(x), -1) for i in columns_of}
            for row, (some, labelled) in enumerate(zip(x.sums, x.labels, strict=True)):
                for e in some if some is not None else ():
                    s[row, e["column"]] = e["s"]
                for e in labelled:
                    if e["cluster"] >= 0:
                        own[e["ind_id"]][row] = column[e["ind_id"], e["cluster"]]
            ids, others = x.bag_idx.to_numpy(), y.bag_idx.to_numpy()
            groups: dict[tuple[int, int], list[int]] = {}
            for at, some in enumerate(y.asked):
                for e in some:
                    groups.setdefault((e["ind_id"], e["cluster"]), []).append(at)
            for (ind, cluster), places in groups.items():
                before = column[ind, cluster] if cluster >= 0 else None
                for label in range(k):
                    after = column[ind, label]
                    if after == before:
                        continue
                    now = {c: counts[c] + (c == after) - (c == before) for c in columns_of[ind]}
                    for at in range(0, len(places), 256):
                        some = np.array(places[at : at + 256])
                        gap = d[:, some]
                        itself = ids[:, None] == others[some]
                        gap = np.where(itself, 0.0, gap)
                        shift = {after: gap} if before is None else {after: gap, before: -gap}
                        found = np.broadcast_to(values(own[ind], s, now, columns_of[ind], shift), gap.shape).copy()
                        found[own[ind] < 0] = 0
                        counted = np.repeat((own[ind] >= 0)[:, None], len(some), 1)
                        for row, col in zip(*np.nonzero(itself), strict=True):  # the bag that changes
                            found[row, col] = values(np.array([after]), s[row : row + 1], now, columns_of[ind], {})[0, 0]
                            counted[row, col] = True
                        out.append((np.full(len(some), ind), others[some], np.full(len(some), label, np.int32), found.sum(0), counted.sum(0)))
        return pd.DataFrame(dict(zip(("ind_id", "bag_idx", "label", "s", "n"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    parts = a.groupBy("p", "q").cogroup(b.groupBy("r", "s")).applyInPandas(compare, schema)
    moved = parts.groupBy("ind_id", "bag_idx", "label").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    moved = moved.where("n > 1").select("ind_id", "bag_idx", "label", (F.col("s") / F.col("n")).alias("silhouette"))
    stay = right.select("bag_idx", F.explode("asked").alias("e")).select(F.col("e.ind_id").alias("ind_id"), "bag_idx", F.col("e.cluster").alias("label")).where((F.col("label") >= 0) & (F.col("label") < k))
    return moved.unionByName(stay.join(F.broadcast(base), "ind_id").select("ind_id", "bag_idx", "label", "silhouette"))
