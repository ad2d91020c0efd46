"""Rows instead of ids, block postings, cells over many tasks, cached gradients, loud failures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearline.operators import ann as N
from nearline.operators import encode as E
from nearline.operators import lexical as L
from nearline.operators import losses as A
from nearline.operators import postings as P
from nearline.operators import sampling as M
from nearline.operators import search as S
from nearline.operators import tokenize as K
from nearline.plans import REGISTRY
from nearline.session import materialize, stored_tables
from tests.conftest import SMALL

REPEATED = [(1, "aa bb"), (1, "cc dd"), (None, "aa bb cc"), (2, ""), (3, None), (None, "zz")]


@pytest.mark.parametrize("lookup_bytes", [None, 0])
def test_tokenize_by_row(spark, lookup_bytes):
    df = spark.createDataFrame(REPEATED, "id bigint, text string").repartition(3)
    vocab = K.fit_vocab(spark.createDataFrame([("aa bb cc",), ("aa bb dd",), ("aa",)], "text string"))
    at = {r.term: r.term_id for r in vocab.collect()}
    got = sorted((r.id, r.text, r.input_ids) for r in K.tokenize(df, vocab, lookup_bytes=lookup_bytes).collect() if r.id is not None)
    want = [(1, "aa bb", [1, at["aa"], at["bb"]]), (1, "cc dd", [1, at["cc"], at["dd"]]), (2, "", [1]), (3, None, [1])]
    assert [g for g in got] == want
    none = {r.text: r.input_ids for r in K.tokenize(df, vocab, lookup_bytes=lookup_bytes).where("id is null").collect()}
    assert none == {"aa bb cc": [1, at["aa"], at["bb"], at["cc"]], "zz": [1, K.UNK_ID]}
    views = K.training_views(df.selectExpr("0L as batch_id", "'s' as src", "cast(id as int) as pos", "id as doc_id", "text"), vocab, max_len=16)
    assert views.count() == len(REPEATED)
    assert sorted(r.lm_input_ids[1] for r in views.where("doc_id = 1").collect()) == sorted([at["aa"], at["cc"]])


def test_vocabulary_counts_rows(spark):
    df = spark.createDataFrame([(1, "aa aa bb"), (1, "aa"), (None, "bb"), (2, None)], "id bigint, text string")
    got = {r.term: (r.cf, r.df) for r in K.fit_vocab(df).collect()}
    assert got["aa"] == (3, 2) and got["bb"] == (2, 2)


def test_user_tokenizer_keeps_rows(spark):
    df = spark.createDataFrame(REPEATED, "id bigint, text string").withColumn("input_ids", F.lit("old"))
    tok = K.HashTokenizer(100)
    got = sorted(((r.id, r.text, r.input_ids) for r in K.tokenize_with(df, K.HashTokenizer).collect()), key=repr)
    assert got == sorted(((i, t, K.HashTokenizer().encode([t or ""])[0]) for i, t in REPEATED), key=repr)
    assert tok.encode(["Aa b"]) == tok.encode(["aa"])


def test_encoders_by_row_and_length(spark):
    df = spark.createDataFrame(REPEATED, "id bigint, text string")
    idx = L.bm25_index(L.analyze(spark.createDataFrame([(1, "aa bb"), (2, "aa cc dd")], "id bigint, text string")))
    reps = E.hashing_encode(df, idx, dim=8).collect()
    one = {t: E.hashing_encode(spark.createDataFrame([(0, t)], "id bigint, text string"), idx, dim=8).first().rep for _, t in REPEATED}
    assert sorted(map(repr, (r.rep for r in reps))) == sorted(map(repr, one.values()))

    class Spy:
        dim = 1

        def encode(self, batch):
            return np.array([[float(len(t.split()))] for t in batch])

    long = spark.createDataFrame([(1, " w" * 500), (2, None), (3, "a b")], "id bigint, text string")
    got = {r.id: r.rep for r in E.encode(long, Spy, passage_max_len=20, out_type="array<double>").collect()}
    assert got == {1: [20.0], 2: [0.0], 3: [3.0]}
    assert E.encode(long, Spy, passage_max_len=None, out_type="array<double>").where("id = 1").first().rep == [501.0]


def test_negative_zero_never_leaves_the_encoder(spark):
    terms = [f"t{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(terms[i % 7::7])) for i in range(20)], "id bigint, text string")
    idx = L.bm25_index(L.analyze(docs))
    for parts in (1, 5):
        for r in E.hashing_encode(docs.repartition(parts), idx, dim=4).collect():
            assert not any(v == 0 and np.copysign(1, v) < 0 for v in r.rep)
    runs = [{r.id: r.rep for r in E.hashing_encode(docs.repartition(p), idx, dim=4).collect()} for p in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2]


def test_index_refuses_repeated_ids(spark):
    for rows in ([(1, ["a"]), (1, ["b"])], [(None, ["a"])]):
        with pytest.raises(Exception, match="document ids must be set and differ"):
            L.bm25_index(spark.createDataFrame(rows, "id bigint, terms array<string>"))


def test_stemmer_rules(spark):
    """Words of the published description of the three plural rules."""
    words = {"skies": "sky", "ponies": "pony", "eies": "eie", "retrieves": "retrieve", "aes": "ae", "trees": "tree", "shoes": "shoe",
             "cats": "cat", "corpus": "corpus", "class": "class", "is": "is", "queries": "query", "a": "a", "hypotheses": "hypothese"}
    df = spark.createDataFrame([(1, list(words)), (1, ["dogs"]), (None, None)], "id bigint, terms array<string>")
    got = df.select(F.transform("terms", lambda t: L.stem(t)).alias("s")).first().s
    assert got == list(words.values())
    docs = spark.createDataFrame([(1, "dogs cats"), (1, "dogs"), (None, "skies")], "id bigint, text string")
    by_rule = sorted(map(repr, L.analyze(docs, stemmer=L.PLURALS).collect()))
    by_call = sorted(map(repr, L.analyze(docs, stemmer=lambda t: t[:-3] + "y" if t.endswith("ies") else t.rstrip("s")).collect()))
    assert by_rule == by_call
    plan = L.analyze(docs, stemmer=L.PLURALS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("signed", [False, True])
def test_block_search_equals_brute_force(spark, signed):
    rng = np.random.default_rng(3)
    n, terms = 600, 80
    df_of = 1 / np.arange(1, terms + 1)
    X = (rng.random((n, terms)) < df_of) * (rng.normal(size=(n, terms)) if signed else rng.random((n, terms)))
    X[100:160] = X[100]  # ties
    Q = (rng.random((25, terms)) < 0.2) * (rng.normal(size=(25, terms)) if signed else 1.0)
    weights = spark.createDataFrame([(int(i), f"t{j}", float(X[i, j])) for i, j in zip(*np.nonzero(X))], "doc long, term string, w double")
    queries = spark.createDataFrame([(int(i), f"t{j}", float(Q[i, j])) for i, j in zip(*np.nonzero(Q))], "qid long, term string, qw double")
    order = weights.groupBy("doc").agg(F.max("w").alias("key"))
    blocks = P.posting_blocks(weights, order, range_docs=16, buckets=4)
    read = {}
    got = [tuple(r) for r in P.search_blocks(queries, blocks, k=7, first=1, decimals=6, read=read).collect()]
    want = []
    for q in range(25):
        scores = np.round(X @ Q[q], 6)
        share = ((X != 0) & (Q[q] != 0)).any(1)
        best = sorted((-scores[d] + 0.0, d) for d in np.flatnonzero(share))[:7]
        want += [(q, int(d), r + 1, -s + 0.0) for r, (s, d) in enumerate(best)]
    assert [g[:3] for g in sorted(got)] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in sorted(got)], [w[3] for w in sorted(want)], atol=2e-6)
    if not signed:
        assert read["first"]["postings"] + read["essential"]["postings"] + read["other"]["postings"] < read["all"]["postings"]
    plan = P._only_terms(queries.withColumn("tb", P.term_bucket("term", 4)).where("qid = 0"), blocks).blocks._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "tb" in plan.split("PartitionFilters: [")[1][:200] and "In(term" in plan
    assert P.search_blocks(queries.limit(0), blocks, k=3).count() == 0


def test_one_hot_cell_fills_many_tasks(spark):
    d = spark.range(4000).selectExpr("id", "array(cast(id as float), 1f) as rep", "0 as cell")
    q = spark.range(300).selectExpr("id as qid", "array(1f, cast(id as float)) as rep", "0 as cell")
    pairs = N.cell_pairs(q, d, query_block=100, shard_rows=100)
    got = pairs.select(F.size("q_ids").alias("a"), F.size("d_ids").alias("b"), F.spark_partition_id().alias("p")).collect()
    assert sum(r.a * r.b for r in got) == 300 * 4000
    assert len({r.p for r in got}) >= 12
    few = N.cell_pairs(q, d, query_block=10, shard_rows=100_000)
    assert len({r.p for r in few.select(F.spark_partition_id().alias("p")).collect()}) >= 8
    run = N.cell_search(q, d, k=2, query_block=64, shard_rows=500).where("qid = 3").orderBy("rank").collect()
    assert [(r.docid, r.score) for r in run] == [(3999, 4002.0), (3998, 4001.0)]


def test_rerank_splits_a_block_that_all_queries_touch(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(200, 6))
    reps = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, rep array<double>")
    run = spark.createDataFrame([(q, d) for q in range(200) for d in range(0, 200, 1 + q % 5)], "qid long, docid long")
    got = sorted(tuple(r) for r in N.rerank(run, reps, reps, k=4, block=50, rows=30).collect())
    want = []
    for q in range(200):
        best = sorted((-(X[q] @ X[d]), d) for d in range(0, 200, 1 + q % 5))[:4]
        want += [(q, d, r + 1, -s) for r, (s, d) in enumerate(best)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])


def test_sample_negatives_raises(spark):
    g = spark.createDataFrame([(7, [])], "group_id bigint, negatives array<string>")
    with pytest.raises(Exception, match="no negatives to sample from in group 7"):
        M.sample_negatives(g, group_size=4).collect()


def _batches(spark, d=4, string_ids=False):
    rng = np.random.default_rng(0)
    name = (lambda i: f"x{i}") if string_ids else int
    q, p, t = [], [], []
    for b in range(3):
        for i in range(4):
            q.append((b, name(b * 10 + i), rng.standard_normal(d).tolist()))
            p.append((b, name(b * 10 + 5 + i), rng.standard_normal(d).tolist()))
            t.append((name(b * 10 + i), name(b * 10 + 5 + (i + 1) % 4)))
    kind = "string" if string_ids else "bigint"
    return (spark.createDataFrame(q, f"batch_id bigint, qid {kind}, rep array<double>"),
            spark.createDataFrame(p, f"batch_id bigint, pid {kind}, rep array<double>"),
            spark.createDataFrame(t, f"qid {kind}, target {kind}"))


@pytest.mark.parametrize("objective", [A.contrastive_objective(0.3), A.margin_objective(0.4)])
def test_cached_gradient(spark, objective):
    q, p, t = _batches(spark)
    W = np.eye(4) + 0.1 * np.random.default_rng(2).standard_normal((4, 4))
    g, loss = A.adapter_gradient(q, p, t, W, objective)
    for args in ((q, p, t), _batches(spark, string_ids=True)):
        g2, loss2 = A.cached_gradient(*args, W, objective, chunk=3)
        assert np.allclose(g, g2, atol=1e-12) and abs(loss - loss2) < 1e-12
    eps = 1e-6
    for i, j in [(0, 0), (1, 2), (3, 1)]:
        step = np.zeros((4, 4))
        step[i, j] = eps
        up, down = (A.adapter_gradient(q, p, t, W + s, objective)[1] for s in (step, -step))
        assert abs((up - down) / (2 * eps) - g[i, j]) < 1e-5


@pytest.mark.parametrize("gradient", [A.adapter_gradient, A.cached_gradient])
def test_missing_targets_raise(spark, gradient):
    q, p, t = _batches(spark)
    with pytest.raises(Exception, match="no target passage for query 0"):
        gradient(q, p, t.where("qid <> 0"), np.eye(4))
    with pytest.raises(Exception, match="target 99 of query 0 is not in batch 0"):
        gradient(q, p, t.withColumn("target", F.expr("if(qid = 0, 99, target)")), np.eye(4))
    with pytest.raises(ValueError):
        A.contrastive_objective(0)


def test_adapter_fit_with_another_objective(spark):
    q, p, t = _batches(spark)
    _, losses = A.fit_linear_adapter(q, p, t, dim=4, steps=6, lr=0.5, objective=A.margin_objective(0.5), gradient=A.cached_gradient)
    assert losses[-1] < losses[0]


def test_stored_tables_are_released(spark):
    with stored_tables(spark) as mine:
        df = materialize(spark.range(10), "scoped")
        assert df.count() == 10 and len(mine) == 1
        path = mine[0]
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_pca_projection_equals_numpy(spark):
    reps = spark.read.parquet(f"{SMALL}/embeddings.parquet").selectExpr("vec_id as id", "embedding as rep")
    rows = reps.collect()
    X = np.array([r.rep for r in rows], dtype=np.float64)
    _, vectors = np.linalg.eigh(np.cov(X.T))
    want = X @ vectors[:, ::-1][:, :16]
    got = {r.id: r.rep for r in REGISTRY["v9_pca_reduce"].build(spark, SMALL).collect()}
    Y = np.array([got[r.id] for r in rows])
    sign = np.sign((Y * want).sum(0))
    assert np.allclose(Y, want * sign, atol=1e-6)
    assert len(S.knn_exact(reps, reps, k=1).collect()) == len(rows)
