import numpy as np
import pytest

from satchel.operators import blocks, indices, joins, silhouettes


def test_sums_by_cluster_send_a_bag_once_for_each_large_block(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(blocks, "PART", 6)
    monkeypatch.setattr(blocks, "met", lambda *a, met=blocks.met, **k: sent.append(a) or met(*a, **k))
    g = np.random.default_rng(4)
    rows = [(k, g.normal(size=(int(g.integers(1, 4)), 3)).tolist()) for k in range(40)]
    bags = spark.createDataFrame(rows, "bag_idx long, bag array<array<double>>")
    labels = spark.createDataFrame([(t, k, k % t if k % 7 else -1) for t in (2, 3) for k in range(40)], "ind_id long, bag_idx long, cluster int")
    want = {r.ind_id: r.silhouette for r in indices.silhouette(joins.pair_table(bags), labels, ("ind_id",)).collect()}
    sent.clear()
    found = {r.ind_id: r.silhouette for r in silhouettes.silhouettes(bags, labels).collect()}
    assert len(sent) == 1 and found == {i: pytest.approx(s, abs=1e-9) for i, s in want.items()}
