"""Operators that used to order, link or rank everything in one place, against plain sequential versions."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.operators import centres, clusterers, evolution, indices, joins, multiobjective, population, ranks, variation
from satchel.sources import files


def sequential_optics(near, min_points, expand_all=False):
    core = {i: sorted(d for _, d in v)[min_points - 1] if len(v) >= min_points else None for i, v in near.items()}
    done, out = set(), []
    for start in sorted(near, key=str):
        best, heap = {start: 2147483647.0}, [(2147483647.0, str(start), start)]
        while heap and start not in done or heap:
            reach, _, i = heapq.heappop(heap)
            if i in done or reach > best[i]:
                continue
            done.add(i)
            out.append((len(out), i, core[i], None if reach == 2147483647.0 else reach))
            if core[i] is not None or expand_all:
                for j, d in near[i]:
                    d = d if core[i] is None else max(core[i], d)
                    if j not in done and d < best.get(j, 2147483647.0):
                        best[j] = d
                        heapq.heappush(heap, (d, str(j), j))
    return out


@pytest.mark.parametrize("expand_all", [False, True])
def test_optics_order_equals_the_sequential_one(spark, expand_all):
    g = np.random.Generator(np.random.PCG64(6))
    # whole coordinates, so that distances tie; the sparse half has border and noise bags
    rows = [(i, [[float(v) for v in g.integers(0, 8 if i < 60 else 60, 2)]]) for i in range(120)]
    bags = spark.createDataFrame(rows, "bag_idx long, bag array<array<double>>").repartition(5)
    near = {i: [(j, float(np.hypot(*np.subtract(x[0], y[0])))) for j, y in rows if np.hypot(*np.subtract(x[0], y[0])) <= 2.3] for i, x in rows}
    found = clusterers.OPTICS(2.3, 5, compat_expand_all=expand_all).fit(bags).orderBy("ord").collect()
    want = sequential_optics(near, 5, expand_all)
    assert [(r.ord, r.bag_idx) for r in found] == [w[:2] for w in want]
    for r, w in zip(found, want, strict=True):
        assert (r.core, r.reach) == (pytest.approx(w[2]), pytest.approx(w[3]))


def test_optics_of_no_bags_and_of_noise(spark):
    none = spark.createDataFrame([], "bag_idx long, bag array<array<double>>")
    assert clusterers.OPTICS(1.0, 2).fit(none).count() == 0
    far = spark.createDataFrame([(i, [[100.0 * i]]) for i in (10, 9, 2)], none.schema)
    assert [(r.ord, r.bag_idx, r.core, r.reach) for r in clusterers.OPTICS(1.0, 2).fit(far).orderBy("ord").collect()] == [(0, 10, None, None), (1, 2, None, None), (2, 9, None, None)]


def test_longest_links_of_many_graphs(spark):
    g = random.Random(3)
    rows, want = [], {}
    for key, n in ((0, 2), (1, 3), (2, 30), (3, 41)):
        edges = [(g.randrange(20) / 4, i, j) for i in range(n) for j in range(i + 1, n)]  # many ties
        rows += [(key, key % 2, i, j, r) for r, i, j in edges]
        part, longest = list(range(n)), 0.0
        for r, i, j in sorted(edges):
            if part[i] != part[j]:
                part = [part[i] if p == part[j] else p for p in part]
                longest = r
        want[key, key % 2] = longest
    table = spark.createDataFrame(rows, "key long, other int, i long, j long, r double").repartition(4)
    found = indices.longest_links(table, ["key", "other"])
    assert {(r.key, r.other): r.longest for r in found.collect()} == want
    assert indices.longest_links(table.limit(0), ["key"]).count() == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_fronts_equal_longest_chains(spark, block):
    g = random.Random(5)
    points = {i: [float(g.randrange(12)) for _ in range(3)] for i in range(60)} | {100 + i: [float(i), float(i), 0.0] for i in range(20)}
    front: dict[int, int] = {}
    for i in sorted(points, key=lambda k: points[k], reverse=True):
        above = [front[j] + 1 for j in front if all(a >= b for a, b in zip(points[j], points[i])) and points[j] != points[i]]
        front[i] = max(above, default=0)
    pop = spark.createDataFrame(list(points.items()), "ind_id long, objectives array<double>").repartition(3)
    assert {r.ind_id: r.front for r in multiobjective.fronts(pop, block).collect()} == front
    assert multiobjective.fronts(pop.limit(0)).count() == 0


def test_places_sums_and_last_before(spark):
    g = random.Random(8)
    rows = [(i, g.randrange(5), float(g.randrange(9))) for i in range(500)] + [(i, 2, 1.0) for i in range(500, 900)]  # a hot value
    table = spark.createDataFrame(rows, "id long, k long, v double").repartition(9)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    placed = ranks.numbered(table, [F.col("k").desc(), "id"])
    assert [r.id for r in placed.orderBy("place").collect()] == [r[0] for r in order]
    assert sorted(r.place for r in ranks.numbered(table.select("k"), ["k"]).collect()) == list(range(900))
    summed, total = ranks.running(table, [F.col("k").desc(), "id"], "v")
    upto = dict(zip([r[0] for r in order], np.cumsum([0.0] + [r[2] for r in order])))
    assert total == sum(r[2] for r in rows) and {r.id: r.before for r in summed.collect()} == upto
    known = spark.createDataFrame([(0.5, 3), (0.5, 4), (2.0, 9)], "at double, who long")
    asked = spark.createDataFrame([(i, i / 4) for i in range(12)], "slot long, u double").repartition(3)
    found = {r.slot: r.who for r in ranks.last_before(known, "at", "who", asked, "u").collect()}
    assert found == {i: 3 if i / 4 < 0.5 else 4 if i / 4 < 2 else 9 for i in range(12)}
    assert ranks.numbered(table.limit(0), ["k"]).count() == 0 and ranks.running(table.limit(0), ["k"], "v")[1] == 0


def test_wheel_skips_weights_of_zero(spark):
    w = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 0.0), (4, 1.0), (5, 0.0)], "ind_id long, w double")
    slots = spark.createDataFrame([(i, i / 100) for i in range(100)], "slot long, u double")
    found = {r.slot: r.ind_id for r in population.spun(w, slots).collect()}
    assert found == {i: 2 if i < 75 else 4 for i in range(100)}


def test_medoid_and_own_centroid_use_their_cluster_only(spark):
    bags = spark.createDataFrame([(0, [[0.0], [2.0]], 0), (1, [[1.0]], 0), (2, [[9.0]], 1)], "bag_idx long, bag array<array<double>>, label int")
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "bag_idx long, cluster int")
    assert {(r.bag_idx, r.cluster): r.d for r in indices.to_own_centroid(bags, clusters).collect()} == {(0, 0): 1.0, (1, 0): 0.0, (2, 1): 0.0}
    assert joins.pair_table(bags).count() == 6


def test_survey_and_its_text(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 2.0]), (1, [5.0, 4.0]), (2, [7.0, 0.0])], "bag_idx long, x array<double>")
    clusters = spark.createDataFrame([(0, 0), (1, 1), (2, -2)], "bag_idx long, cluster int")
    table = centres.survey(rows, clusters)
    found = {(r.cluster, r.dim): (r.bags, r.instances, r["mean"]) for r in table.collect()}
    assert found == {(-1, 0): (3, 4, 4.0), (-1, 1): (3, 4, 2.0), (0, 0): (1, 2, 2.0), (0, 1): (1, 2, 2.0), (1, 0): (1, 1, 5.0), (1, 1): (1, 1, 4.0)}
    text = files.survey_text(table, ["a", "b"]).split("\n")
    assert text[0].split() == ["Attribute", "Full", "data", "0", "1"] and text[1].split() == ["(3)", "(1)", "(1)"] and text[2].split() == ["a", "4.0000", "2.0000", "5.0000"] and text[3].split() == ["+/-2.5820", "+/-1.4142"]


def test_reports_by_frequency_and_in_files(spark, tmp_path):
    report = evolution.Report(every=2, folder=str(tmp_path), whole=True)
    for g in range(5):
        report(g, spark.createDataFrame([(i, [i], float((i * g) % 7)) for i in range(9)], "ind_id long, genotype array<int>, fitness double"), True)
    assert [r["generation"] for r in report.generations] == [0, 2, 4]
    last = report.generations[-1]
    values = sorted(((i * 4) % 7, i) for i in range(9))
    assert (last["best"], last["worst"], last["median_id"]) == (6, 0, values[4][1]) and last["best_id"] == min(i for v, i in values if v == 6)
    assert spark.read.option("header", True).csv(str(tmp_path / "generations")).count() == 3
    assert sorted(p.name for p in tmp_path.glob("population-*")) == [f"population-{g:06d}" for g in (0, 2, 4)]


def test_repeated_and_sterile_mutation(spark):
    add = lambda g, seed, key: F.transform(g, lambda v: v + F.lit(seed % 10))
    pop = spark.createDataFrame([(i, [0]) for i in range(200)], "ind_id long, genotype array<int>")
    one = pop.limit(1).select(variation.mutated_repeatedly(add, 3)(F.col("genotype"), 5, F.col("ind_id")).alias("g")).first()
    assert one.g == [5 + 6 + 7]
    changed, sterile = variation.mutants(pop, add, 4, 0.3)
    ids = {r.ind_id for r in changed.collect()}
    assert 30 < len(ids) < 90 and ids.isdisjoint(r.ind_id for r in sterile.collect()) and changed.count() + sterile.count() == 200
    assert all(r.genotype == [5] for r in changed.collect())
