import numpy as np
import pytest

from satchel.operators import blocks, density, indices, joins


@pytest.mark.parametrize(("part", "edges"), [(1024, 1 << 20), (6, 10)])
def test_dbcv_without_pairs_equals_that_of_the_pair_table(spark, monkeypatch, part, edges):
    monkeypatch.setattr(blocks, "PART", part)
    monkeypatch.setattr(density, "EDGES", edges)
    g = np.random.default_rng(5)
    rows = [(k, (g.normal(size=(int(g.integers(1, 4)), 2)) + 4 * (k % 3)).tolist()) for k in range(40)]
    bags = spark.createDataFrame(rows, "bag_idx long, bag array<array<double>>")
    of = {0: lambda k: k % 3, 1: lambda k: k % 2, 2: lambda k: -1 if k % 5 == 0 else 0 if k % 3 else 1, 3: lambda k: 7 if k == 4 else 0, 4: lambda k: 1}
    labels = spark.createDataFrame([(i, k, f(k)) for i, f in of.items() for k in range(40)], "ind_id long, bag_idx long, cluster int")
    want = {r.ind_id: r.dbcv for r in indices.dbcv(bags, labels, joins.pair_table(bags), ("ind_id",)).collect()}
    monkeypatch.setattr(joins, "pair_table", lambda *a, **k: pytest.fail("a table of pairs"))
    found = {r.ind_id: r.dbcv for r in density.dbcv(bags, labels, block=9).collect()}
    assert set(found) == set(want) and all(found[i] == pytest.approx(want[i], abs=1e-9) for i in want)
