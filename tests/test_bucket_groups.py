"""Hash buckets: each query meets a group of documents once, whatever their buckets."""

import numpy as np
import pytest

from nearline.operators import ann as N
from nearline.operators import multiprobe as M
from nearline.operators import quantize as Z
from nearline.operators import search as S


def _table(spark, X, kind="bigint"):
    return spark.createDataFrame([(f"v{i:04}" if kind == "string" else i, x.tolist()) for i, x in enumerate(X)], f"id {kind}, rep array<double>")


@pytest.mark.parametrize("width", [0.2, 3.0])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_lsh_in_many_groups(spark, monkeypatch, width, kind):
    """Narrow buckets (met one by one) and wide ones (all pairs scored), several groups, ties, fewer than k found."""
    for name, value in (("GROUP_ROWS", 60), ("TASK_QUERIES", 30), ("FIRST_DOCS", 16), ("SCORE_CELLS", 256)):
        monkeypatch.setattr(S, name, value)
    X = np.random.default_rng(2).normal(size=(150, 6))
    X[40:60] = X[40]
    model = N.Projections(X[:3].copy(), np.full(3, 0.1), width)
    run = N.lsh_search(_table(spark, X, kind), _table(spark, X, kind), model, k=5, decimals=6)
    plan = run._jdf.queryExecution().toString()
    assert "CoGroupsInArrow" in plan and "collect_list" not in plan  # no packed pair for each bucket
    B = np.floor((X @ model.planes.T + model.offsets) / width)
    name = (lambda i: f"v{i:04}") if kind == "string" else int
    want = []
    for i in range(len(X)):
        found = np.flatnonzero((B == B[i]).any(1))
        best = sorted((-round(float(X[i] @ X[d]), 6), d) for d in found)[:5]
        want += [(name(i), name(d), r + 1) for r, (_, d) in enumerate(best)]
    assert sorted((r.qid, r.docid, r["rank"]) for r in run.collect()) == sorted(want)


def test_a_local_group_gives_k_rows_a_query(spark):
    """Candidates of several tables leave a task once."""
    X = np.random.default_rng(3).normal(size=(80, 4))
    r = _table(spark, X)
    model = M.HashTables(np.random.default_rng(4).normal(size=(5, 1, 4)), np.zeros((5, 1)), 2.0)
    index = M.hash_cells(r, model)
    assert index.count() == 400 and index.where("keys is not null").count() == 80
    out = []
    kernel = N._buckets_scorer(3, None, 16, Z.minus_squared_l2)
    asked = M._hash_keys(r, model, 2, "qid").selectExpr("qid as i", "rep as v", "keys").toArrow()
    held = index.where("keys is not null").selectExpr("id as i", "rep as v", "keys").toArrow()
    out = kernel(asked, held)
    assert out.num_rows <= 3 * 80 and len(set(zip(out["qid"].to_pylist(), out["docid"].to_pylist()))) == out.num_rows
