"""Norm-bounded search: equals the full search in any case, and reads less where lengths differ."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearline.operators import norms as N
from nearline.operators import search as S

SCHEMA = "id long, rep array<double>"


def table(spark, X, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in x]) for i, x in enumerate(X)], SCHEMA).repartition(3)


def rows(run):
    return sorted((r["qid"], r["rank"], r["docid"], round(r["score"], 9)) for r in run.collect())


def test_skips_short_vectors_and_stays_exact(spark):
    rng = np.random.default_rng(2)
    X = rng.standard_normal((900, 12)) * np.exp(-4 * rng.random((900, 1)))
    d, q, seen = table(spark, X), table(spark, rng.standard_normal((70, 12)), 5000), []
    got = N.knn_norm_bounded(q, d, k=5, block_rows=40, query_block=16, growth=2, report=seen)
    assert rows(got) == rows(S.knn_exact(q, d, k=5))
    read = sum(x[2] for x in seen)
    assert read < 0.6 * 70 * 900, read
    assert [x[0] for x in seen[1:]] == [x[1] for x in seen[:-1]]


def test_equal_lengths_read_everything(spark):
    X = np.random.default_rng(3).standard_normal((200, 24))
    X /= np.sqrt((X * X).sum(1, keepdims=True))
    d, seen = table(spark, X), []
    got = N.knn_norm_bounded(d, d, k=30, block_rows=50, report=seen)
    assert rows(got) == rows(S.knn_exact(d, d, k=30)) and sum(x[2] for x in seen) == 200 * 200


@pytest.mark.parametrize("decimals, k", [(None, 4), (1, 1), (None, 100)])
def test_ties_zeros_negative_scores_and_few_rows(spark, decimals, k):
    X = [[1, 0], [1, 0], [0, 0], [-1, -1], [0.001, 0], [3, -3], [1, 0], [0, 0], [0.04, 0.04], [0.06, 0]] * 3
    Q = [[0, 0], [-5, -5], [1, 0], [0, 1], [0.001, 0.001], [-1, 1]]
    d, q = table(spark, X), table(spark, Q)
    got = N.knn_norm_bounded(q, d, k=k, block_rows=3, query_block=2, growth=4, decimals=decimals)
    assert rows(got) == rows(S.knn_exact(q, d, k=k, decimals=decimals))


def test_null_vectors_text_ids_empty_tables_and_clashing_columns(spark):
    d = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [None, 1.0]), ("d", [0.1, 0.0]), ("a", [1.0, 2.0])],
                              "id string, rep array<double>").withColumns({c: F.lit("x") for c in ("s", "norm", "row", "i", "v", "at")})
    got = N.knn_norm_bounded(d, d, k=2, block_rows=1)
    assert rows(got) == rows(S.knn_exact(d, d, k=2))
    none = table(spark, [])
    assert N.knn_norm_bounded(none, none, k=3).count() == 0
    assert N.knn_norm_bounded(table(spark, [[1, 2]]), none, k=3).count() == 0
    assert N.knn_norm_bounded(none, table(spark, [[1, 2]]), k=3).count() == 0


def test_blocks_are_stored_in_falling_norm_and_reused(spark):
    X = np.random.default_rng(5).standard_normal((130, 6)) * np.linspace(1, 9, 130)[:, None]
    index = N.norm_blocks(table(spark, X), block_rows=20)
    assert [n for _, n in index.blocks] == [20] * 6 + [10]
    tops = [t for t, _ in index.blocks]
    assert tops == sorted(tops, reverse=True)
    q = table(spark, X[:9], 900)
    assert rows(N.knn_norm_bounded(q, index, k=3)) == rows(S.knn_exact(q, table(spark, X), k=3))


def test_a_query_is_sent_once_for_a_group_of_blocks(spark, monkeypatch):
    """It was sent once for each of the blocks that it may reach."""
    X = np.random.default_rng(6).standard_normal((120, 4))
    sent = []
    meet = N.meet_groups

    def watched(q, d, *args):
        sent.append(q.count())
        return meet(q, d, *args)

    monkeypatch.setattr(N, "meet_groups", watched)
    monkeypatch.setattr(N, "STEP_ROWS", 7)
    d = table(spark, X / np.sqrt((X * X).sum(1, keepdims=True)))
    got = N.knn_norm_bounded(d, d, k=3, block_rows=5, query_block=8, growth=100)
    assert sent == [120, 120]  # 24 blocks in two waves
    assert rows(got) == rows(S.knn_exact(d, d, k=3))
