"""Exact and cell search send a query once for each group of documents, not for each shard."""

import numpy as np
import pyarrow as pa

from nearline.operators import ann as N
from nearline.operators import search as S


def _rows(spark, X):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(X)], "id long, rep array<double>")


def _want(X, k):
    P = np.round(X @ X.T, 6) + 0.0
    return {i: sorted(range(len(X)), key=lambda j: (-P[i, j], j))[:k] for i in range(len(X))}


def _got(run):
    out = {}
    for r in run.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["docid"])
    return out


def test_small_shards_share_a_task(spark, monkeypatch):
    X = np.round(np.random.default_rng(1).normal(size=(300, 4)), 1)  # many ties
    r, seen = _rows(spark, X), []
    real = S.meet_groups
    monkeypatch.setattr(S, "meet_groups", lambda q, d, n, m, *a: seen.append(n) or real(q, d, n, m, *a))
    assert _got(S.knn_exact(r, r, k=7, query_block=32, shard_rows=4, decimals=6)) == _want(X, 7)
    assert seen == [1]  # 75 shards before


def test_cells_share_a_group_and_large_ones_are_split(spark, monkeypatch):
    X = np.round(np.random.default_rng(2).normal(size=(200, 4)), 1)
    r = _rows(spark, X)
    cents = X[:16]
    monkeypatch.setattr(N, "document_groups", lambda n, parts: 5)
    run = N.ivf_search(r, N.ivf_assign(r, cents), cents, k=6, nprobe=16, shard_rows=1, query_block=8, decimals=6)
    assert _got(run) == _want(X, 6)
    assert N._cell_groups({0: 3, 1: 4, 2: 25, 5: 2, 7: 9}, 10) == [
        (0, 0, 1, 0, 1), (1, 2, 2, 0, 3), (2, 2, 2, 1, 3), (3, 2, 2, 2, 3), (4, 5, 5, 0, 1), (5, 7, 7, 0, 1)]


def test_running_best_meets_documents_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "FIRST_DOCS", 16)
    X = np.round(np.random.default_rng(3).normal(size=(400, 3)), 1)
    best = S.BestRows(400, 5, 6)
    monkeypatch.setattr(S, "SCORE_CELLS", 400 * 40)
    best.meet(np.arange(400), X, np.arange(400), X, S.inner_product)
    t = best.table(pa.array(range(400)), pa.array(range(400))).to_pydict()
    got = {}
    for q, d in zip(t["qid"], t["docid"]):
        got.setdefault(q, []).append(d)
    assert got == _want(X, 5)
