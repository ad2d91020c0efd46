"""Posting blocks: built from arrays, searched a group of ranges at a time."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearline.operators import encode as E
from nearline.operators import lexical as L
from nearline.operators import postings as P
from nearline.operators import search as S


def _brute(X, Q, k, names=lambda d: int(d)):
    want = []
    for q in range(len(Q)):
        scores, share = np.round(X @ Q[q], 6), ((X != 0) & (Q[q] != 0)).any(1)
        best = sorted((-scores[d] + 0.0, names(d)) for d in np.flatnonzero(share))[:k]
        want += [(q, d, r + 1, -s + 0.0) for r, (s, d) in enumerate(best)]
    return sorted(want)


@pytest.mark.parametrize("group_postings", [1 << 20, 300])
@pytest.mark.parametrize("string_ids", [False, True])
def test_groups_give_the_exact_top_k(spark, monkeypatch, group_postings, string_ids):
    monkeypatch.setattr(P, "GROUP_POSTINGS", group_postings)
    monkeypatch.setattr(P, "BUILD_DOCS", 64)
    monkeypatch.setattr(S, "TASK_QUERIES", 7)
    rng = np.random.default_rng(5)
    X = (rng.random((400, 60)) < 1 / np.arange(1, 61)) * rng.random((400, 60))
    X[50:90] = X[50]  # ties
    Q = (rng.random((20, 60)) < 0.2) * rng.random((20, 60))
    name = (lambda d: f"x{d}") if string_ids else int
    weights = spark.createDataFrame([(name(i), int(j), float(X[i, j])) for i, j in zip(*np.nonzero(X))], f"doc {'string' if string_ids else 'long'}, term int, w double")
    queries = spark.createDataFrame([(int(i), int(j), float(Q[i, j])) for i, j in zip(*np.nonzero(Q))], "qid long, term int, qw double")
    blocks = P.posting_blocks(weights.repartition(5), weights.groupBy("doc").agg(F.max("w").alias("key")), range_docs=16, buckets=4)
    assert blocks.blocks.agg(F.sum("n")).first()[0] == weights.count() and not blocks.blocks.groupBy("term", "rng").count().where("count > 1").count()
    run = P.search_blocks(queries, blocks, k=6, decimals=6)
    got, want = sorted(tuple(r) for r in run.collect()), _brute(X, Q, 6, name)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)
    plan = run._jdf.queryExecution().toString()
    assert "Generate inline" not in plan and "CoGroupsInArrow" in plan  # no row for each posting


def test_weights_of_numbered_terms(spark):
    """Stored weights are those of the postings, whatever number a term has."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30) if (i * j) % 7 < 3)) for i in range(90)], "id bigint, text string")
    idx = L.bm25_index(L.analyze(docs))
    got = L.bm25_blocks(idx, range_docs=8).blocks.select("term", F.explode(F.arrays_zip("docs", "weights")).alias("p")).select("term", "p.*").collect()
    want = {(r.term, r.doc_id): r.w for r in idx.postings.collect()}
    assert len(got) == len(want) and all(abs(r.weights - want[r.term, r.docs]) < 1e-12 for r in got)


def test_term_ids_of_batches(spark):
    rows = [(1, ["aa", "bb", "aa"]), (None, ["é"]), (2, None), (3, []), (1, ["zz", None])]
    df = spark.createDataFrame(rows, "id bigint, terms array<string>")
    got = E.md5_term_ids(df, 30000).collect()
    code = lambda t: None if t is None else int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 30000
    assert sorted(((r.id, r.terms) for r in got), key=repr) == sorted(((i, [code(t) for t in ts or []]) for i, ts in rows), key=repr)
