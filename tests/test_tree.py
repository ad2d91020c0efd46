"""Tree of cells: bounded sizes, exact when all are probed, recall on few vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearline.operators import ann as N
from nearline.operators import quantize as Z
from nearline.operators import search as S
from nearline.operators import tree as T
from nearline.plans import REGISTRY
from nearline.plans import q_ann
from tests.conftest import SMALL
from tests.test_quantize import clustered, nearest, pairs, table


def test_descent_equals_a_scan_of_all_leaves():
    rng = np.random.default_rng(4)
    tree = T.CellTree(np.zeros((1, 5)))
    tree.grow(0, rng.standard_normal((6, 5)))
    tree.grow(2, rng.standard_normal((4, 5)))
    tree.grow(8, rng.standard_normal((3, 5)))
    X, leaves = rng.standard_normal((50, 5)), tree.leaves
    assert sorted(leaves) == [1, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13]
    row, node, dist = tree.nearest(X, 20)
    d = ((X[:, None] - tree.centres[leaves][None]) ** 2).sum(2) - (X * X).sum(1)[:, None]
    assert len(node) == 50 * len(leaves)
    assert (node.reshape(50, -1) == leaves[np.argsort(d, axis=1)]).all()
    assert np.allclose(dist.reshape(50, -1), np.sort(d, axis=1))
    greedy = tree.nearest(X, 1)
    assert (greedy[0] == np.arange(50)).all() and set(greedy[1]) <= set(leaves)


def test_cells_are_bounded_and_search_reaches_recall(spark):
    X = clustered(2500)
    X[:900] = X[0] + np.random.default_rng(9).standard_normal((900, 16)) * 0.05  # one crowded place
    r, q = table(spark, X), table(spark, X[900:1050], first=0)
    tree = T.tree_fit(r, rounds=3)
    index = T.tree_assign(r, tree)
    sizes = [x["count"] for x in index.groupBy("cell").count().collect()]
    due = len(X) / 50
    assert sum(sizes) == len(X) and max(sizes) <= 4 * due and 25 <= len(tree.leaves) <= 200
    block, _ = Z.metric_of("l2")
    run = T.tree_search(q, index, tree, k=10, nprobe=8, score=block)
    want = nearest(X[900:1050], X, 10)
    assert len(pairs(run) & want) >= 0.9 * len(want)
    assert Z.scanned_share(q, index, tree.leaf_centres, 8) < 1 / 3


def test_equal_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(60, None), (61, [None, 1.0]), (62, [3.0, 4.0])]
    r = spark.createDataFrame(rows, "id bigint, rep array<float>")
    tree = T.tree_fit(r, cells=6, rounds=2)
    index = T.tree_assign(r, tree)
    assert index.count() == 61
    run = T.tree_search(r, index, tree, k=3, nprobe=len(tree.leaves), decimals=6)
    assert sorted(run.collect()) == sorted(S.knn_exact(r, r, k=3, decimals=6).collect())
    with pytest.raises(ValueError):
        T.tree_fit(r.limit(0))


@pytest.mark.parametrize("name", ["v8_residual_trained", "v7_tree_trained", "v10_multiprobe_trained"])
def test_registered_trained_searches_reach_recall(spark, name):
    rows = {x.id: x.rep for x in q_ann._clustered(spark, SMALL).collect()}
    X = np.asarray([rows[i] for i in sorted(rows)])
    assert sorted(rows) == list(range(len(X)))
    want = nearest(X, X, 10)
    got = pairs(REGISTRY[name].build(spark, SMALL))
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
