"""Property tests and hand-made edge cases (the rows-only operators included)."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearline.functions import text as TX
from nearline.functions import tokens as TK
from nearline.functions.vectors import l2_normalize
from nearline.operators import ann as N
from nearline.operators import factory as U
from nearline.operators import encode as E
from nearline.operators import lexical as L
from nearline.operators import losses as A
from nearline.operators import sampling as M
from nearline.operators import search as S
from nearline.operators.indexing import with_global_index
from nearline.plans import REGISTRY
from nearline.sources import io
from tests.conftest import MEDIUM, SMALL


def _reps(spark, sf=SMALL):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"),
                                                                F.col("embedding").alias("rep"))


def _numpy_topk(q_ids, Q, d_ids, D, k):
    S_ = np.round(Q @ D.T, 6)
    out = {}
    for r, qid in enumerate(q_ids):
        order = sorted(range(len(d_ids)), key=lambda j: (-S_[r, j], d_ids[j]))[:k]
        out[qid] = [(int(d_ids[j]), float(S_[r, j])) for j in order]
    return out


def test_knn_exact_equals_numpy_bruteforce(spark):
    r = _reps(spark, MEDIUM)
    pdf = r.toPandas()
    ids = pdf["id"].to_numpy()
    X = np.stack(pdf["rep"].map(lambda v: np.asarray(v, dtype=np.float64)))
    want = _numpy_topk(ids, X, ids, X, 7)
    for kw in ({}, {"query_block": 16, "shard_rows": 50}):
        run = S.knn_exact(r, r, k=7, decimals=6, **kw).collect()
        got = {}
        for row in sorted(run, key=lambda x: (x.qid, x["rank"])):
            got.setdefault(row.qid, []).append((row.docid, row.score))
        assert got == want


def test_k_larger_than_index(spark):
    r = _reps(spark).limit(5)
    run = S.knn_exact(r, r, k=50)
    counts = {x["qid"]: x["n"] for x in run.groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert set(counts.values()) == {5}


def test_equal_scores_break_by_docid(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, rep array<float>")
    d = spark.createDataFrame([(9, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [1.0, 0.0])], "id bigint, rep array<float>")
    run = S.knn_exact(q, d, k=2).orderBy("rank").collect()
    assert [r.docid for r in run] == [3, 5]


def test_ivf_full_probe_equals_exact(spark):
    r = _reps(spark)
    cents = N.ivf_fit(r, 4, seed=1)
    a = N.ivf_search(r, N.ivf_assign(r, cents), cents, k=5, nprobe=4, shard_rows=32, query_block=16, decimals=6)
    b = S.knn_exact(r, r, k=5, decimals=6)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_factory_specs(spark):
    r = _reps(spark)
    flat = U.make_index("Flat", r)(r, k=3)
    assert flat.count() == 3 * r.count()
    with pytest.raises(ValueError):
        U.make_index("HNSW32", r)


def test_index_combinations_and_append(spark):
    r = _reps(spark)
    exact = {(x.qid, x.docid) for x in S.knn_exact(r, r, k=10).collect()}
    for spec in ("PQ8", "IVF4,PQ8", "PCA16,Flat", "PCA32,IVF4,Flat"):
        run = U.make_index(spec, r, ks=32, metric="ip")(r, k=10, **({"nprobe": 4} if "IVF" in spec else {}))
        got = {(x.qid, x.docid) for x in run.collect()}
        assert len(got) == len(exact) and len(got & exact) > len(exact) // 10
    books = N.pq_books(N.first_vectors(r, 32), 8)
    codes = N.pq_encode(r, books)
    by_table = N.pq_search(r, codes, books, k=5, decimals=6).collect()
    assert sorted(by_table) == sorted(S.knn_exact(r, N.pq_decode(codes, books), k=5, decimals=6).collect())


@pytest.mark.parametrize("name", ["v7_ivf_trained", "v7_ivf_trained_string_ids", "v8_pq_trained", "v8_ivf_pq_trained"])
def test_trained_searches_reach_recall(spark, name):
    """At least 0.9 of the exact top 10, with exact scores."""
    x = _reps(spark).collect()
    ids, V = [r.id for r in x], np.array([r.rep for r in x], dtype=np.float64)
    scores = np.round(V @ V.T, 6)
    at = {i: k for k, i in enumerate(ids)}
    want = {(ids[a], ids[b]) for a in range(len(ids)) for b in np.lexsort((ids, -scores[a]))[:10]}
    run = [(int(str(r.qid).lstrip("v")), int(str(r.docid).lstrip("v")), r.score) for r in REGISTRY[name].build(spark, SMALL).collect()]
    assert len(run) == len({r[:2] for r in run}) == len(want)
    assert all(abs(scores[at[q], at[d]] - s) < 2e-6 for q, d, s in run)
    assert len({r[:2] for r in run} & want) >= 0.9 * len(want)


def test_unusable_vectors_take_no_part(spark):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [None, 1.0]), ("d", [0.5, 0.5])]
    r = spark.createDataFrame(rows, "id string, rep array<float>")
    want = {("a", "a", 1), ("a", "d", 2), ("d", "a", 1), ("d", "d", 2)}
    assert {(x.qid, x.docid, x["rank"]) for x in S.knn_exact(r, r, k=5).collect()} == want
    cents = np.eye(2)
    run = N.ivf_search(r, N.ivf_assign(r, cents), cents, k=5, nprobe=2)
    assert {(x.qid, x.docid, x["rank"]) for x in run.collect()} == want


def test_stored_shards_are_split_and_checked(spark):
    r = _reps(spark)
    one = r.withColumn("shard", F.lit(3))
    got = S.knn_sharded(r, one, k=5, shard_rows=40, decimals=6).collect()
    assert sorted(got) == sorted(S.knn_exact(r, r, k=5, decimals=6).collect())
    with pytest.raises(Exception, match="no shard for document"):
        S.knn_sharded(r, r.withColumn("shard", F.lit(None).cast("int")), k=5).collect()


def test_bm25_batches_take_string_ids(spark):
    docs = spark.createDataFrame([("x", ["red", "fox"]), ("y", ["red", "fox", "den"]), ("z", ["owl"])],
                                 "id string, terms array<string>")
    n = L.build_batches(L.bm25_index(docs), top_k=3).collect()
    assert {(r.seed, r.docid) for r in n} == {("x", "y"), ("y", "x")}
    batches = L.neighbour_batches(spark.createDataFrame(n), docs.withColumn("source", F.lit("s"))).collect()
    assert {r.batch_id: r.doc_ids for r in batches} == {"x": ["x", "y"], "y": ["y", "x"], "z": ["z"]}


def test_uneven_groups_raise(spark):
    g = spark.createDataFrame([(0, ["a"]), (1, [])], "group_idx int, negatives array<string>")
    with pytest.raises(Exception, match="uneven group"):
        M.target_index(g, 2).collect()


def test_global_index_is_dense_permutation(spark):
    df = spark.range(0, 1000).withColumn("h", F.md5(F.col("id").cast("string")))
    out = with_global_index(df, ["h", "id"], "idx", num_partitions=7).collect()
    assert sorted(r.idx for r in out) == list(range(1000))
    by_h = sorted(out, key=lambda r: (r.h, r.id))
    assert [r.idx for r in by_h] == list(range(1000))


def test_shards_disjoint_and_cover(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "k")
    for mode in ("contiguous", "strided", "hash"):
        rows = io.shard(df, 4, "k", mode=mode).collect()
        assert sorted(r.k for r in rows) == list(range(103))
        sizes = sorted(np.bincount([r.shard for r in rows]).tolist())
        if mode == "contiguous":
            assert sizes == [25, 26, 26, 26]


def test_sample_negatives_branches(spark):
    P = "struct<docid:string,title:string,text:string>"
    rows = [(1, "q", [("p", "", "p")], []),
            (2, "q", [("p", "", "p")], [("a", "", "a"), ("b", "", "b")]),
            (3, "q", [("p", "", "p")], [(c, "", c) for c in "vwxyz"])]
    g = spark.createDataFrame(rows, f"group_id bigint, query string, positives array<{P}>, negatives array<{P}>")
    some = g.where("size(negatives) > 0")
    out = {r.group_id: [x.docid for x in r.negatives] for r in M.sample_negatives(some, group_size=5, epoch=1).collect()}
    assert len(out[2]) == 4 and set(out[2]) <= {"a", "b"}  # draws with replacement
    assert len(out[3]) == 4 and len(set(out[3])) == 4
    one = M.sample_negatives(g, group_size=1).collect()
    assert all(r.negatives == [] for r in one)
    rot = {r.group_id: [x.docid for x in (r.negatives or [])] for r in M.rotate_negatives(g, group_size=4, epoch=1).collect()}
    assert rot[3] == ["y", "z", "v"]                      # offset 3, window wraps
    assert M.count_unsampleable(g, 5).first()[0] == 1


def test_token_edge_cases(spark):
    df = spark.createDataFrame([([1, 5, 6, 7, 2], [1, 2, 3, 4, 5, 6, 7])], "a array<int>, b array<int>")
    r = df.select(TK.first_half("a", 2).alias("fh"), TK.truncate_append_eos("b", 5, True, 2).alias("t"),
                  TK.pad_fixed("b", 157, 0, 16).alias("p"), TK.lm_labels(F.array(F.lit(4), F.lit(2), F.lit(9)), 2).alias("l"),
                  TK.first_half_mask("a", 2, 8).alias("m")).first()
    assert r.fh == [1, 5, 2]
    assert r.t == [1, 2, 3, 4, 2]
    assert len(r.p) == 160
    assert r.l == [4, -100, 9]
    assert r.m == [1, 1, 0, 0, 0, 0, 0, 0]


def test_text_formatting(spark):
    df = spark.createDataFrame([("  x  ", "", " q ")], "text string, title string, q string")
    r = df.select(TX.format_passage("text", "title", "p: ").alias("p"), TX.format_query("q", "query: ").alias("q"),
                  TX.add_prefix("text", "p: ").alias("a")).first()
    assert r.p == "p:  x"
    assert r.q == "query: q"
    assert r.a == "p:   x  "


def test_batch_lines_both_shapes(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "b.jsonl"), "w") as f:
        f.write(json.dumps(["a", "b", "c"]) + "\n")
        f.write(json.dumps({"src": "stackoverflow", "text": ["x", "y", "z"]}) + "\n")
    rows = sorted(io.read_batches(spark, d, top_k=2).collect(), key=lambda r: r.src)
    assert [(r.src, r.texts) for r in rows] == [("", ["a", "b"]), ("stackoverflow", ["x", "y"])]
    fh = [r[0] for r in spark.createDataFrame([("stackoverflow",), ("x",)], "src string")
          .select(TX.first_half_applies("src")).collect()]
    assert fh == [False, True]


def test_softmax_rows_sum_to_one_and_edge_cases(spark):
    m = spark.read.parquet(f"{SMALL}/embeddings.parquet").select(
        F.floor(F.col("vec_id") / 16).alias("batch_id"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("rep"))
    w = A.softmax_weights(A.inbatch_similarity(m), temperature=1e-4)
    sums = [r.s for r in w.groupBy("batch_id", "i").agg(F.sum("weight").alias("s")).collect()]
    assert np.allclose(sums, 1.0)
    single = spark.createDataFrame([(0, 1, [1.0, 0.0])], "batch_id bigint, doc_id bigint, rep array<double>")
    assert A.softmax_weights(A.inbatch_similarity(single), 0.05).count() == 0
    with pytest.raises(ValueError):
        A.softmax_weights(A.inbatch_similarity(single), 0.0)


def test_pooling_and_normalize_edges(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [0, 0], [0.0, 0.0])], "h array<array<double>>, m array<int>, z array<double>")
    r = df.select(E.pool("h", "m", "mean").alias("mean"), E.pool("h", "m", "eos").alias("last"),
                  E.pool("h", "m", "cls").alias("first"), l2_normalize("z").alias("n")).first()
    assert r.mean is None and r.last is None and r.first == [1.0, 2.0] and r.n == [0.0, 0.0]
    with pytest.raises(ValueError):
        E.pool("h", "m", "max")


def test_generic_encode_path(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    reps = E.encode(docs, lambda: E.HashingEncoder(16), is_query=False).collect()
    assert len(reps) == docs.count()
    norms = [np.linalg.norm(r.rep) for r in reps]
    assert np.allclose([n for n in norms if n > 0], 1.0, atol=1e-5)


def test_adapter_gradient_matches_finite_differences(spark):
    rng = np.random.default_rng(0)
    d = 4
    rows_q, rows_p, rows_t = [], [], []
    for b in range(3):
        for i in range(3):
            rows_q.append((b, b * 10 + i, rng.standard_normal(d).tolist()))
            rows_p.append((b, b * 10 + 5 + i, rng.standard_normal(d).tolist()))
            rows_t.append((b * 10 + i, b * 10 + 5 + i))
    q = spark.createDataFrame(rows_q, "batch_id bigint, qid bigint, rep array<double>")
    p = spark.createDataFrame(rows_p, "batch_id bigint, pid bigint, rep array<double>")
    t = spark.createDataFrame(rows_t, "qid bigint, target bigint")
    W = np.eye(d) + 0.1 * rng.standard_normal((d, d))
    g, loss = A.adapter_gradient(q, p, t, W)
    eps = 1e-6
    for (i, j) in [(0, 0), (1, 2), (3, 1)]:
        Wp, Wm = W.copy(), W.copy()
        Wp[i, j] += eps
        Wm[i, j] -= eps
        fd = (A.adapter_gradient(q, p, t, Wp)[1] - A.adapter_gradient(q, p, t, Wm)[1]) / (2 * eps)
        assert abs(fd - g[i, j]) < 1e-5
    # the loss equals the SQL-style table aggregate on normalised reps
    from nearline.functions.vectors import l2_normalize
    tr = lambda df: df.withColumn("rep", l2_normalize(F.col("rep")))  # W = I case below
    base = A.contrastive_loss(tr(q), tr(p), t, reduction="mean").first()[0]
    assert abs(A.adapter_gradient(q, p, t, np.eye(d))[1] - base) < 1e-9
