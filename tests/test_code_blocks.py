"""Codes are scored as blocks of decoded vectors; the depth of a re-rank comes from ranks, not from lists of candidates."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearline.operators import ann as N
from nearline.operators import quantize as Z
from nearline.operators.search import CodeScorer, inner_product
from tests.test_groups import _rows


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_codes_score_as_sums_over_slices(spark, metric):
    rng = np.random.default_rng(2)
    Q, books, cents = rng.normal(size=(9, 8)), [rng.normal(size=(5, 2)) for _ in range(4)], rng.normal(size=(3, 8))
    codes = np.concatenate([rng.integers(0, 3, (40, 1)), rng.integers(0, 5, (40, 4))], axis=1)
    word = np.concatenate([B[codes[:, j + 1]] for j, B in enumerate(books)], axis=1)
    for score, at, X in ((N.pq_scorer(spark, books, metric), codes[:, 1:], word), (Z.residual_scorer(spark, cents, books, metric), codes, word + cents[codes[:, 0]])):
        assert isinstance(score, CodeScorer)  # a group is decoded once
        want = Q @ X.T if metric == "ip" else -((Q[:, None, :] - X[None]) ** 2).sum(2)
        assert np.allclose(score(Q, at), want)


def _group(ids, X, codes, cells):
    lists = lambda a, kind: pa.array(list(a), pa.list_(kind))
    return pa.table({"i": pa.array(ids), "v": lists(codes, pa.int32()), "vector": lists(X, pa.float64()), "cell": pa.array(cells, pa.int32())})


def test_only_candidates_by_codes_enter():
    """Equal code scores at the last candidate go to the smaller ids; a group within the depth needs no codes."""
    rng = np.random.default_rng(4)
    X, ids, cells = rng.normal(size=(60, 4)), rng.permutation(60), rng.integers(0, 3, 60)
    codes = rng.integers(0, 3, (60, 1))
    q = pa.table({"i": pa.array(np.arange(7)), "v": pa.array(list(X[:7]), pa.list_(pa.float64())), "cells": pa.array([[0, 2]] * 6 + [[1]], pa.list_(pa.int32()))})
    by_code = lambda Q, C: np.repeat(C[:, 0][None, :].astype(float), len(Q), axis=0)
    got = N._reranking_scorer(13, 5, None, by_code, inner_product)(q, _group(ids, X, codes, cells)).to_pylist()
    for n, probed in enumerate([{0, 2}] * 6 + [{1}]):
        near = sorted((-int(c[0]), int(i), j) for j, (c, i, cell) in enumerate(zip(codes, ids, cells)) if cell in probed)[:13]
        want = sorted((-float(X[n] @ X[j]), i) for _, i, j in near)[:5]
        assert [i for _, i in want] == [r["docid"] for r in got if r["qid"] == n]

    def never(Q, C):
        raise AssertionError("codes scored")
    got = N._reranking_scorer(60, 5, None, never, inner_product)(q, _group(ids, X, codes, cells)).to_pylist()
    assert len(got) == 35


def test_depth_by_rank_is_the_depth_of_the_lists(spark):
    rng = np.random.default_rng(8)
    X = np.round(rng.normal(size=(400, 8)), 2)
    X[200:260] = X[:60]  # equal codes
    r = _rows(spark, X)
    twice = r.union(r.where(F.col("id") < 90))  # repeated ids
    books, cents = N.pq_books(X[:6], 4), X[:5]
    for rows in (r, twice):
        sample, exact = N.exact_sample(rows, rows, k=10, rows=30)
        index = N.pq_encode(N.with_vector(N.ivf_assign(rows, cents)), books)
        for recall in (0.2, 0.6, 0.95):
            want = N.depth_for(recall, exact, lambda n: N.pq_search(sample, index, books, k=n), index.count())
            assert N.depth_by_rank(recall, sample, exact, index, N.pq_scorer(spark, books)) == want
        want = N.depth_for(0.5, exact, lambda n: N.ivf_pq_search(sample, index, cents, books, k=n, nprobe=3), index.count())
        assert N.depth_by_rank(0.5, sample, exact, index, N.pq_scorer(spark, books), probes=N.ivf_probes(sample, cents, 3)) == want
