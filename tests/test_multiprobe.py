"""Probe order, opened buckets and search of multi-probe hashing against brute force."""

import itertools

import numpy as np
import pytest

from nearline.operators import multiprobe as M
from nearline.operators import quantize as Z
from tests.test_quantize import clustered, pairs, table


@pytest.mark.parametrize("hashes", [1, 2, 4])
def test_rank_sets_list_every_bucket_once(hashes):
    sets = M.rank_sets(hashes, 3 ** hashes + 5)
    assert len(sets) == len(set(sets)) == 3 ** hashes and sets[0] == ()
    places = np.random.default_rng(hashes).uniform(-3, 3, (40, hashes))
    keys = M.probe_keys(places, sets)
    for row, at in zip(keys, np.floor(places)):
        assert {tuple(k) for k in row} == {tuple(at + np.array(d)) for d in itertools.product((-1, 0, 1), repeat=hashes)}
    if hashes > 1:
        assert sets[1] == (0,)
    assert M.rank_sets(hashes, 3) == sets[:3]


def test_first_probes_cross_the_nearest_boundary():
    keys = M.probe_keys(np.array([[0.1, 5.8, 2.45]]), M.rank_sets(3, 3))[0].tolist()
    assert keys[:2] == [[0, 5, 2], [-1, 5, 2]] and keys[2] == [0, 6, 2]


def test_search_finds_the_best_of_the_opened_buckets(spark):
    X = clustered(400, dim=8)
    r, q = table(spark, X), table(spark, X[:25])
    model = M.probing_fit(r, k=5, tables=2, bucket_rows=20)
    index = M.hash_cells(r, model)
    assert index.count() == 800
    run = M.multiprobe_search(q, index, model, k=5, probes=4, score=Z.minus_squared_l2)
    homes, sets = np.floor(model.places(X)).astype(int), M.rank_sets(model.planes.shape[1], 4)
    want, opened = set(), 0
    for i in range(25):
        found = set()
        for t in range(2):
            keys = {tuple(k) for k in M.probe_keys(model.places(X[i:i + 1])[:, t], sets)[0]}
            inside = [d for d in range(len(X)) if tuple(homes[d, t]) in keys]
            opened += len(inside)
            found |= set(inside)
        best = sorted(found, key=lambda d: (round(((X[i] - X[d]) ** 2).sum(), 6), d))[:5]
        want |= {(i, d) for d in best}
    assert pairs(run) == want
    assert abs(M.opened_share(q, index, model, 4) - opened / (25 * len(X))) < 1e-12


def test_unusable_and_equal_vectors(spark):
    r = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0])], "id bigint, rep array<float>")
    model = M.probing_fit(r, k=2)
    run = M.multiprobe_search(r, M.hash_cells(r, model), model, k=3, probes=2)
    assert pairs(run) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    with pytest.raises(ValueError):
        M.probing_fit(r.limit(0))


def test_keys_are_not_sent(spark):
    """Only ids and vectors are exchanged: many probes make no row longer, and no group smaller."""
    X = clustered(300, dim=8)
    r = table(spark, X)
    model = M.probing_fit(r, k=5, tables=4, bucket_rows=5)
    index = M.hash_cells(r, model)
    run = M.multiprobe_search(r, index, model, k=5, probes=20, score=Z.minus_squared_l2)
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    met = [line for line in plan.splitlines() if "FlatMapCoGroupsInArrow" in line or "CoGroup" in line]
    assert met and not any("keys" in line for line in met) and "buckets(" not in plan
    assert len(pairs(run)) == 1500
