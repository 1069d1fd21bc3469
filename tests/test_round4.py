import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.functions import kernels
from satchel.operators import indices, joins, multiobjective, niches, population, transforms


def cut_down(x, size, k):
    """The definition, from a whole matrix of distances."""
    d = np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in x])
    np.fill_diagonal(d, -1)
    left = np.arange(len(x))
    while len(left) > size:
        among = d[np.ix_(left, left)]
        other = among.argsort(1, kind="stable")[:, min(k, len(left) - 1)]
        left = np.delete(left, other[among[np.arange(len(left)), other].argmin()])
    return left.tolist()


@pytest.mark.parametrize(("size", "k", "width"), [(5, 3, 256), (1, 1, 4), (2, 3, 4), (20, 2, 8), (0, 1, 8)])
def test_uncrowded_equals_its_definition(size, k, width):
    g = np.random.default_rng(size + k)
    for x in (g.random((60, 3)), np.repeat(g.integers(0, 3, (9, 2)), 8, 0).astype(float)):
        assert multiobjective.uncrowded(x, size, k, width).tolist() == cut_down(x, size, k)


def test_a_front_of_thousands_is_truncated_without_its_distances():
    x = np.repeat(np.random.default_rng(1).random((60, 3)), 100, 0)
    left = multiobjective.uncrowded(x, 5, 3)  # 6,000 rows: all distances would be sorted again for each of them
    assert len(left) == 5


def test_spea2_over_blocks_makes_no_table_of_pairs(spark):
    g = np.random.default_rng(3)
    x = np.concatenate([g.integers(0, 6, (120, 3)), g.integers(0, 3, (80, 3))]).astype(float)
    over = (x[:, None] >= x[None]).all(2) & (x[:, None] > x[None]).any(2)
    strength = over.sum(1)
    raw = (over * strength[:, None]).sum(0)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    kth = np.sort(d, 1)[:, 3]  # itself is the first
    pop = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ind_id long, objectives array<double>")
    found = multiobjective.spea2(pop, 3, block=16)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.orderBy("ind_id").collect():
        assert (r.strength, r.raw, round(r.density, 9)) == (strength[r.ind_id], raw[r.ind_id], round(1 / (kth[r.ind_id] + 2), 9))


def test_kernels_of_many_bags_equal_those_of_two(spark):
    g = np.random.default_rng(5)
    mats = [g.random((int(n), 3)) for n in g.integers(1, 8, 40)] + [np.ones((3, 3)), np.repeat(g.random((1, 3)), 4, 0)]
    plane = [np.round(g.random((int(n), 2)) * 9) for n in g.integers(1, 30, 40)]
    for bags in (mats, plane, [g.random((5, 64)) for _ in range(20)]):
        stack = kernels.Stack(bags)
        for bag in bags[:6]:
            for name in kernels.NAMES:
                many = kernels.against(name, bag, stack.rows, stack.starts, stack)
                pairs = kernels.PAIRWISE.get(name, lambda a, b, name=name: kernels.against(name, a, b, np.zeros(1, int))[0])
                with np.errstate(all="ignore"):
                    assert np.allclose(many, [pairs(bag, b) for b in bags], rtol=1e-9, atol=1e-12, equal_nan=True), name


def test_kernels_take_a_block_at_once():
    bags = [np.random.default_rng(k).random((5, 64)) for k in range(256)]
    stack = kernels.Stack(bags)
    began = time.perf_counter()
    for bag in bags[:40]:
        kernels.against("earth_movers", bag, stack.rows, stack.starts, stack)
    assert time.perf_counter() - began < 2.5  # one pair at a time took 7 s and more


@pytest.mark.parametrize("kind", ["hamming", "euclidean"])
def test_pairs_of_blocks_equal_all_pairs(spark, kind):
    g = np.random.default_rng(9)
    x = g.integers(0, 5, (70, 20))
    rows = spark.createDataFrame([(3 * k, (v if kind == "hamming" else v / 4).tolist()) for k, v in enumerate(x)], f"ind_id long, genotype array<{'int' if kind == 'hamming' else 'double'}>")
    want = {(3 * a, 3 * b): float((x[a] != x[b]).sum()) if kind == "hamming" else float(np.sqrt((((x[a] - x[b]) / 4) ** 2).sum())) for a in range(70) for b in range(a + 1, 70)}
    whole = niches.pairs_of(rows, kind, block=16)
    assert "Cartesian" not in (plan := population.genotype_distances(rows, kind)._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    assert {(r.i, r.j): round(r.d, 9) for r in whole.collect()} == {k: round(v, 9) for k, v in want.items()}
    limit = float(np.median(list(want.values())))
    near = niches.pairs_of(rows, kind, limit, True, block=16)
    assert {(r.i, r.j) for r in near.collect()} == {k for k, v in want.items() if v < limit}


def test_many_values_and_missing_ones_differ_as_they_should():
    x = np.array([[0.5, 1.0, np.nan], [2.0, 1.0, np.nan]])
    assert niches.differing(x, x).tolist() == [[0, 1], [1, 0]]
    y = np.arange(40.0).reshape(2, 20)
    assert niches.differing(y, y).tolist() == [[0, 20], [20, 0]]


def test_union_of_datasets_numbers_what_it_has_kept(spark):
    """The partitions that are counted must be those that are numbered; a plan that is run twice can deal rows anew."""
    bags = spark.range(0, 3000).select(F.col("id").alias("bag_idx"), F.array(F.array(F.lit(1.0))).alias("bag"), (F.col("id") % 2).cast("int").alias("label"))
    found = transforms.union_of_datasets([bags, bags.withColumn("label", 1 - F.col("label"))])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # read back, not dealt again
    rows = sorted((r.bag_idx, r.label) for r in found.collect())
    assert [i for i, _ in rows] == list(range(3000)) and [y for _, y in rows] == [0] * 1500 + [1] * 1500


def test_pair_tables_of_more_bags_send_each_bag_no_more_often():
    for n in (1_000, 20_000, 120_000):
        assert -(-n // joins._size(n, joins.BLOCK)) <= joins.BLOCKS
    assert joins._size(10**7, joins.BLOCK) == joins.MOST  # two blocks are what a task holds


def test_the_pair_table_meets_clusters_without_being_dealt_again(spark):
    bags = spark.range(60).select(F.col("id").alias("bag_idx"), F.array(F.array(F.rand(3), F.rand(4))).alias("bag"))
    clusters = bags.select("bag_idx", (F.col("bag_idx") % 3).cast("int").alias("cluster"))
    pairs = joins.pair_table(bags)
    plan = indices.silhouette(pairs, clusters)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
