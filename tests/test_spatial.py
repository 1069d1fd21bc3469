"""Range and nearest joins by cells against all pairs: every bounded distance, ties, copies, wide bags and few bags."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.functions import kernels
from satchel.operators import joins, spatial


def bags_of(seed, n, d, spread):
    g = np.random.Generator(np.random.PCG64(seed))
    out = []
    for i in range(n):
        centre = g.uniform(0, spread, d)
        bag = np.round(centre + g.normal(0, 0.3, (int(g.integers(1, 5)), d)), 1)  # rounded, so that distances tie
        if i % 40 == 0:
            bag[0] += spread / 2  # a wide one
        out.append((i, bag.tolist()))
    return out + [(n + k, out[3][1]) for k in range(5)]  # copies


def table(spark, rows):
    return spark.createDataFrame(rows, "bag_idx long, bag array<array<double>>").repartition(4)


def all_pairs(left, right, distance):
    return {(i, j): kernels.distance(distance, x, y) for i, x in left for j, y in right}


@pytest.mark.parametrize(("distance", "d"), [("minmin", 1), ("maxmin", 2), ("meanmin", 9), ("mean", 2), ("earth_movers", 2)])
def test_range_join_equals_all_pairs(spark, monkeypatch, distance, d):
    monkeypatch.setattr(spatial, "BLOCK", 16)
    a, b = bags_of(1, 60, d, 12.0), bags_of(2, 70, d, 12.0)
    want = all_pairs(a, b, distance)
    near = sorted(want.values())
    for epsilon in (near[0], near[len(near) // 30]):
        found = {(r.i, r.j): r.d for r in joins.range_join(table(spark, a), table(spark, b), float(epsilon), distance).collect()}
        assert found == pytest.approx({k: v for k, v in want.items() if v <= epsilon})


def test_pairs_of_blocks_fall_with_the_radius(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 16)
    rows = table(spark, bags_of(3, 800, 2, 60.0))
    blocks = 51**2
    found = [spatial.Cells(rows, rows, e, "minmin").pairs_of_blocks() for e in (0.1, 2.0, 1000.0)]
    assert found[0] < found[1] < blocks * 4 and found[0] < blocks / 4
    assert spatial.Cells(rows, rows, 0.1, "cauchy_schwarz").cut == []


@pytest.mark.parametrize("distance", ["minmin", "mean", "mahalanobis"])
def test_nearest_join_equals_all_pairs(spark, monkeypatch, distance):
    monkeypatch.setattr(spatial, "BLOCK", 16)
    monkeypatch.setattr(spatial, "RUN", 24)
    a = bags_of(4, 90, 2, 30.0)
    want = all_pairs(a, a, distance)
    found = {(r.i, r["rank"]): r.j for r in joins.nearest_join(table(spark, a), table(spark, a), 3, distance).collect()}
    for i, _ in a:
        order = sorted((round(v, 9), j) for (x, j), v in want.items() if x == i and j != i)[:3]
        assert [found[i, k] for k in (1, 2, 3)] == [j for _, j in order]


def test_nearest_join_visits_fewer_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 16)
    rows = table(spark, bags_of(3, 800, 2, 60.0))
    assert spatial.nearest(rows, rows, 3).pairs_of_blocks() < (805 / 16) ** 2 / 2


def test_neighbours_of_few_or_odd_bags(spark):
    none = table(spark, [(0, [[0.0]])]).limit(0)
    one = table(spark, [(7, [[1.0, 2.0]])])
    assert joins.range_join(none, none, 1.0).count() == 0 and joins.nearest_join(none, none, 2).count() == 0
    assert [tuple(r) for r in joins.range_join(one, one, 0.0).collect()] == [(7, 7, 0.0)]
    assert joins.nearest_join(one, one, 2).count() == 0
    odd = table(spark, [(0, [[float("nan")]]), (1, [[1.0]]), (2, [[1.0], [float("inf")]])])
    found = {(r.i, r.j) for r in joins.range_join(odd, odd, 0.5).select("i", "j").collect()}
    assert found >= {(0, 0), (1, 1), (2, 2), (1, 2), (2, 1)} and (0, 1) not in found
    same = table(spark, [(i, [[3.0, 3.0]]) for i in range(50)])
    assert joins.range_join(same, same, 0.0).count() == 2500
    assert {r.j for r in joins.nearest_join(same, same, 2).where(F.col("i") > 1).collect()} == {0, 1}
