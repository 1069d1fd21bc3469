"""Density-based validity (DBCV) of whole populations of assignments, without a table of pairs.

Distances are measured twice, by pairs of blocks: once for the core distances, which are sums by bag, and once for the mutual
reachability.  Of that, each task keeps the least gap of every cluster and a least spanning forest of every cluster's bags in
its two blocks; an edge that no such forest has is the longest of a cycle, so the trees of the clusters are among the rest.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from . import blocks, joins, silhouettes
from .indices import longest_links
from .lineage import saved

EDGES = 1 << 20  # edges that a task gathers before it drops those that close a cycle


def least_forest(r: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the edges of a least spanning tree: of rows against columns, or (same) of rows that are the columns,
    by the entries above the diagonal."""
    n, m = r.shape
    if same:
        r, m = np.triu(r, 1) + np.triu(r, 1).T, 0
    total = n + m
    if not n or total < 2 or not r.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, left = np.full(total, np.inf), np.ones(total, bool)
    back = np.where(np.arange(total) < n, 0 if same else n, 0)  # any neighbour, where weights aren't finite
    at, out = 0, []
    left[0] = False
    for _ in range(total - 1):
        others, weights = (slice(0, n), r[at]) if same else (slice(n, total), r[at]) if at < n else (slice(0, n), r[:, at - n])
        less = left[others] & (weights < best[others])
        best[others][less] = weights[less]
        back[others][less] = at
        at = int(np.where(left, best, np.inf).argmin())
        if not left[at]:
            at = int(np.flatnonzero(left)[0])
        left[at] = False
        out.append((at, back[at]))
    ends = np.array(out, np.int64)
    low, high = ends.min(1), ends.max(1)
    return low, high if same else high - n


def _acyclic(edges: pd.DataFrame) -> pd.DataFrame:
    """The edges (column, i, j, r) of least spanning forests, one of each column."""
    kept = []
    for _, some in edges.groupby("column", sort=False):
        some = some.sort_values("r", kind="stable", ignore_index=True)
        ids, ends = np.unique(np.concatenate([some.i, some.j]).astype(np.int64), return_inverse=True)
        up, stay = list(range(len(ids))), []
        for k, (a, b) in enumerate(ends.reshape(2, -1).T.tolist()):
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            if a != b:
                up[a] = b
                stay.append(k)
        kept.append(some.iloc[stay])
    return pd.concat(kept) if kept else edges


def _fold(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edges, gaps, n, most = [], {}, 0, EDGES
    for frame in found:
        is_gap = frame.i.isna()
        for c, r in zip(frame.column[is_gap], frame.r[is_gap], strict=True):
            gaps[c] = min(gaps.get(c, np.inf), r)
        edges.append(frame[~is_gap])
        n += len(edges[-1])
        if n > most:
            edges = [_acyclic(pd.concat(edges))]
            n = len(edges[0])
            most = max(EDGES, 2 * n)
    if edges:
        yield _acyclic(pd.concat(edges))
    if gaps:
        yield pd.DataFrame({"column": list(gaps), "i": pd.array([None] * len(gaps), "Int64"), "j": pd.array([None] * len(gaps), "Int64"), "r": list(gaps.values())})


def dbcv(bags: DataFrame, labels: DataFrame, distance: str = "maxmin", block: int = joins.BLOCK) -> DataFrame:
    """(ind_id, dbcv) of labels (ind_id, bag_idx, cluster): indices.dbcv of the pair table for every assignment."""
    labels = saved(labels.select(F.col("ind_id").cast("long").alias("ind_id"), "bag_idx", F.col("cluster").cast("int").alias("cluster")))
    real = labels.where("cluster >= 0")
    every = labels.groupBy("ind_id").agg(F.count(F.lit(1)).alias("_every"))
    n = real.groupBy("ind_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    names = silhouettes._clusters(real)
    if not names:
        return every.select("ind_id", F.lit(None).cast("double").alias("dbcv")).limit(0)
    width, inds = len(names), sorted({i for i, _ in names})
    place = {i: k for k, i in enumerate(inds)}
    of, to_ind, to_cluster = F.lit([place[i] for i, _ in names]), F.lit([int(i) for i, _ in names]).cast("array<bigint>"), F.lit([int(c) for _, c in names]).cast("array<int>")
    first = bags.select(F.size(F.col("bag")[0])).first()
    d = first[0] if first else 1
    flat = bags.select("bag_idx", F.flatten("bag").alias("flat"), F.size("bag").alias("size"))
    mine = silhouettes._numbered(real, names)

    def wide(rows: DataFrame) -> DataFrame:
        """Bags with the assignments, clusters (columns) and core distances of rows."""
        held = F.sort_array(F.collect_list(F.struct(F.get(of, F.col("column")).alias("at"), "column", "core")))
        return saved(flat.join(rows.groupBy("bag_idx").agg(held.alias("held")), "bag_idx").select("bag_idx", "flat", "size", *(F.col(f"held.{c}").alias(c) for c in ("at", "column", "core"))))

    def prepare(part: pd.DataFrame, before) -> tuple:
        columns, cores = np.full((len(inds), len(part)), -1), np.zeros((len(inds), len(part)))
        for k, (at, column, core) in enumerate(zip(part["at"], part["column"], part["core"], strict=True)):
            columns[at, k], cores[at, k] = column, core
        return part.bag_idx.to_numpy(), kernels.sheets(part.flat, part["size"], None if before is None else before[1].centre), columns, cores

    def weights(x: tuple, y: tuple, same: bool) -> Iterator[pd.DataFrame]:
        there, home = kernels.both_ways(distance, x[1], y[1])
        sides = [(x, y, there)] if same else [(x, y, there), (y, x, home.T)]
        for a, b, gaps in sides:
            with np.errstate(over="ignore"):
                w = (1 / np.maximum(gaps, 1e-12)) ** float(d)
            if same:
                np.fill_diagonal(w, 0)
            sums = np.zeros((len(inds), len(a[0])))
            for k in range(len(inds)):
                for c in np.unique(a[2][k]):
                    if c >= 0:
                        sums[k, a[2][k] == c] = w[a[2][k] == c][:, b[2][k] == c].sum(1)
            yield pd.DataFrame({"i": a[0], "sums": list(sums.T)})

    parts = blocks.met(wide(mine.withColumn("core", F.lit(0.0))), ["bag_idx"], F.size("flat"), block, prepare, weights, "i long, sums array<double>")
    added = parts.select(F.col("i").alias("bag_idx"), F.posexplode("sums").alias("at", "v")).groupBy("bag_idx", "at").agg(F.sum("v").alias("s"))
    sized = mine.withColumn("at", F.get(of, F.col("column"))).join(F.broadcast(n.withColumnRenamed("ind_id", "_i").withColumnRenamed("cluster", "_c")), (F.get(to_ind, F.col("column")) == F.col("_i")) & (F.get(to_cluster, F.col("column")) == F.col("_c")))  # a row per cluster
    core = F.pow(F.col("s") / (F.col("n") - 1), F.lit(-1.0 / d))
    cored = sized.where("n > 1").join(added, ["bag_idx", "at"]).select("bag_idx", "column", core.alias("core"))

    def reach(x: tuple, y: tuple, same: bool) -> Iterator[pd.DataFrame]:
        there, home = kernels.both_ways(distance, x[1], y[1])
        out = []
        for k in range(len(inds)):
            cores, mine, theirs = np.maximum(x[3][k][:, None], y[3][k]), x[2][k], y[2][k]
            r, back = np.maximum(there, cores), np.maximum(home, cores)
            apart = (mine[:, None] != theirs) & (mine >= 0)[:, None] & (theirs >= 0)
            for c in np.unique(mine[mine >= 0]):
                some, others = np.flatnonzero(mine == c), np.flatnonzero(theirs == c)
                one, two = least_forest(r[np.ix_(some, others)], same)
                one, two = some[one], others[two]
                out.append((np.full(len(one), c), x[0][one], y[0][two], r[one, two]))
            for own, least in ((mine, np.where(apart, r, np.inf).min(1)), (theirs, np.where(apart, back, np.inf).min(0))):
                for c in np.unique(own[own >= 0]):
                    low = least[own == c].min()
                    if apart[own == c].any() if own is mine else apart[:, own == c].any():
                        out.append((np.array([c]), None, None, np.array([low])))
        edges = [o for o in out if o[1] is not None]
        gaps = [o for o in out if o[1] is None]
        frames = []
        if edges:
            column, i, j, r = (np.concatenate(c) for c in zip(*edges, strict=True))
            frames.append(pd.DataFrame({"column": column, "i": pd.array(i, "Int64"), "j": pd.array(j, "Int64"), "r": r}))
        if gaps:
            column, r = (np.concatenate([g[k] for g in gaps]) for k in (0, 3))
            frames.append(pd.DataFrame({"column": column, "i": pd.array([None] * len(r), "Int64"), "j": pd.array([None] * len(r), "Int64"), "r": r}))
        yield from frames

    found = saved(blocks.met(wide(cored), ["bag_idx"], F.size("flat"), block, prepare, reach, "column int, i long, j long, r double", _fold))
    named = found.select(F.get(to_ind, F.col("column")).alias("ind_id"), F.get(to_cluster, F.col("column")).alias("cluster"), "i", "j", "r")
    sparse = longest_links(named.where("i is not null"), ["ind_id", "cluster"]).withColumnRenamed("longest", "sparse")
    gap = named.where("i is null").groupBy("ind_id", "cluster").agg(F.min("r").alias("gap"))
    v = n.join(sparse, ["ind_id", "cluster"], "left").join(gap, ["ind_id", "cluster"], "left").join(every, "ind_id")
    value = F.coalesce(F.try_divide(F.col("gap") - F.col("sparse"), F.greatest("gap", "sparse")), F.lit(0.0))
    return v.groupBy("ind_id").agg(F.sum(value * F.col("n") / F.col("_every")).alias("dbcv"))
