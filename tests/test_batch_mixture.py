"""A batch meets in one task; nothing is joined for each token and pair of documents."""

import math
from collections import Counter

from nearline.operators import losses as A

ROWS = [(0, 1, "ab cd ab ef cd gh"), (0, 2, "ab ab cd xy"), (0, 3, "gh ef ef cd ab"), (0, 4, None), (0, 5, "zz"),
        (1, 6, "ab cd ef gh ab"), (2, 7, "ab cd cd gh"), (2, None, "cd gh ab")]


def _want(rows, temperature, lam):
    corpus = Counter(w for _, _, t in rows for w in (t or "").split())
    total, out = sum(corpus.values()), {}
    for b, i, text in rows:
        own = (text or "").split()
        half = len(own) // 2
        others = [(t or "").split() for c, j, t in rows if c == b and None not in (i, j) and j != i]
        q = Counter(own[:half])
        size = lambda c: max(math.sqrt(sum(x * x for x in c.values())), 1e-12)
        z = [sum(q[w] * n for w, n in Counter(o).items()) / (size(q) * size(Counter(o))) / temperature for o in others]
        e = [math.exp(x - max(z)) for x in z]
        logs = []
        for w in own[half:]:
            mix = sum(x * o.count(w) / max(1, len(o)) for x, o in zip(e, others)) / sum(e) if e else 0.0
            share = lam if e else 1.0
            logs.append(math.log(share * corpus[w] / total + (1 - share) * mix))
        if logs:
            out[b, i] = -sum(logs) / len(logs)
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "BATCH_CELLS", 10)
    df = spark.createDataFrame(ROWS, "batch_id bigint, doc_id bigint, text string")
    loss = A.retrieval_weighted_lm_loss(df, df, lam=0.1, temperature=0.5)
    got = {(r.batch_id, r.doc_id): r.loss for r in loss.collect()}
    want = _want(ROWS, 0.5, 0.1)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    plan = loss._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the corpus distribution only


def test_rows_of_one_id_count_as_one_document(spark):
    rows = [(0, 1, "ab cd ab ef"), (0, 1, "ab cd ab ef"), (0, 2, "ab ef"), (0, 3, "cd ab")]
    df = spark.createDataFrame(rows, "batch_id bigint, doc_id bigint, text string")
    got = {r.doc_id: r.loss for r in A.retrieval_weighted_lm_loss(df, df, temperature=0.5).collect()}
    assert sorted(got) == [1, 2, 3] and all(math.isfinite(x) for x in got.values())
