"""V1, E7, V11 and the in-batch weighting / loss queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nearline.functions.hashing import hex8, md5_key
from nearline.functions.text import words
from nearline.functions.vectors import cosine, dot, l2_normalize, scale
from nearline.operators import losses as A
from nearline.operators import search as S
from nearline.operators.lexical import ENGLISH_STOPWORDS
from nearline.plans.registry import register
from nearline.plans.sqlparts import KNN10, DOC_BATCHES, STOP_LIST, hex8 as sql_hex8, md5k, words as sql_words
from nearline.session import scratch_path, table
from nearline.sources import fixtures as X
from nearline.sources import io

NORM = "list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-12::DOUBLE))"


def _n(v):
    return NORM.format(v=v)


@register("v1_dot_cosine", f"""
SELECT q.vec_id AS qid, d.vec_id AS docid,
       round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS dot,
       round(list_inner_product({_n('q.embedding::DOUBLE[]')}, {_n('d.embedding::DOUBLE[]')}), 6) AS cosine
FROM embeddings q JOIN embeddings d ON d.vec_id = q.vec_id + 1
""")
def v1_dot_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a"))
    d = e.select((F.col("vec_id") - 1).alias("qid"), F.col("vec_id").alias("docid"), F.col("embedding").alias("b"))
    return q.join(d, "qid").select("qid", "docid", F.round(dot("a", "b"), 6).alias("dot"),
                                   F.round(cosine("a", "b"), 6).alias("cosine"))


@register("e7_l2_normalize", f"""
WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 2.0::DOUBLE) AS v FROM embeddings)
SELECT vec_id AS id, list_transform({_n('v')}, lambda x: round(x, 6)) AS rep FROM e
""")
def e7_l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.transform(l2_normalize(scale("embedding", 2.0)), lambda x: F.round(x, 6)).alias("rep"))


@register("v11_add_vectors", KNN10)
def v11_add_vectors(spark, sf_dir):
    r = X.reps(spark, sf_dir)
    path = scratch_path(spark, "index")
    io.write_reps(r.where(F.col("label") < 5).select("id", "rep", F.lit(0).alias("shard")), path)
    new = r.where(F.col("label") >= 5).select("id", "rep")
    index = S.add_vectors(io.read_reps(spark, path).select("id", "rep"), new)
    return S.knn_exact(index, index, k=10, decimals=6)


MEMBERS_SQL = """
m AS (SELECT vec_id // 16 AS batch_id, CAST(vec_id % 16 AS INTEGER) AS pos, vec_id, embedding::DOUBLE[] AS v
      FROM embeddings)
"""


@register("a1_inbatch_similarity", f"""
WITH {MEMBERS_SQL}
SELECT a.batch_id, a.vec_id AS i, b.vec_id AS j, round(list_inner_product({_n('a.v')}, {_n('b.v')}), 6) AS score
FROM m a JOIN m b ON a.batch_id = b.batch_id
""")
def a1_inbatch_similarity(spark, sf_dir):
    p = A.inbatch_similarity(X.embedding_batches(spark, sf_dir))
    return p.withColumn("score", F.round("score", 6))


@register("a2_softmax_weights", f"""
WITH {MEMBERS_SQL},
p AS (SELECT a.batch_id, a.vec_id AS i, b.vec_id AS j,
             list_inner_product({_n('a.v')}, {_n('b.v')}) / 0.05::DOUBLE AS z
      FROM m a JOIN m b ON a.batch_id = b.batch_id WHERE a.vec_id <> b.vec_id),
e AS (SELECT batch_id, i, j, exp(z - max(z) OVER (PARTITION BY batch_id, i)) AS e FROM p)
SELECT batch_id, i, j, round(e / sum(e) OVER (PARTITION BY batch_id, i), 6) AS weight FROM e
""")
def a2_softmax_weights(spark, sf_dir):
    p = A.inbatch_similarity(X.embedding_batches(spark, sf_dir))
    w = A.softmax_weights(p, temperature=0.05, exclude_diagonal=True)
    return w.select("batch_id", "i", "j", F.round("weight", 6).alias("weight"))


def _qp(spark, sf_dir):
    m = X.embedding_batches(spark, sf_dir)
    q = m.where(F.col("pos") % 2 == 0).select("batch_id", F.col("doc_id").alias("qid"), "rep")
    p = m.where(F.col("pos") % 2 == 1).select("batch_id", F.col("doc_id").alias("pid"), "rep")
    t = q.select("qid", (F.col("qid") + 1).alias("target"))
    return q, p, t


def _ce_sql(join_key: str, scale_expr: str = "", factor: str = "", members: str = "SELECT * FROM m", out: str = "") -> str:
    return f"""
WITH {MEMBERS_SQL},
mm AS ({members}),
q AS (SELECT batch_id, vec_id AS qid, v FROM mm WHERE pos % 2 = 0),
p AS (SELECT batch_id, vec_id AS pid, v FROM mm WHERE pos % 2 = 1),
s AS (SELECT q.batch_id, q.qid, p.pid, list_inner_product(q.v, p.v){scale_expr} AS score
      FROM q JOIN p ON {join_key}),
l AS (SELECT batch_id, qid, any_value(mx) + ln(sum(exp(score - mx))) AS lse
      FROM (SELECT *, max(score) OVER (PARTITION BY batch_id, qid) AS mx FROM s) x GROUP BY batch_id, qid)
SELECT {out}l.qid, round((l.lse - s.score){factor}, 6) AS loss
FROM l JOIN s ON s.batch_id = l.batch_id AND s.qid = l.qid AND s.pid = l.qid + 1
"""


OVERLAP = "SELECT batch_id, vec_id, v, pos FROM m UNION ALL SELECT batch_id + 1000000, vec_id, v, pos FROM m WHERE pos < 6"


@register("a3_contrastive_loss", _ce_sql("q.batch_id = p.batch_id"))
def a3_contrastive_loss(spark, sf_dir):
    q, p, t = _qp(spark, sf_dir)
    return A.contrastive_loss(q, p, t, scope="batch").select("qid", F.round("loss", 6).alias("loss"))


@register("a3_contrastive_overlap", _ce_sql("q.batch_id = p.batch_id", members=OVERLAP, out="l.batch_id, "))
def a3_contrastive_overlap(spark, sf_dir):
    """Batches that share queries: each query has a loss in each of its batches."""
    q, p, t = _qp(spark, sf_dir)
    m = X.embedding_batches(spark, sf_dir).where(F.col("pos") < 6).withColumn("batch_id", F.col("batch_id") + 1_000_000)
    q = q.union(m.where(F.col("pos") % 2 == 0).select("batch_id", "doc_id", "rep"))
    p = p.union(m.where(F.col("pos") % 2 == 1).select("batch_id", "doc_id", "rep"))
    return A.contrastive_loss(q, p, t, scope="batch").select("batch_id", "qid", F.round("loss", 6).alias("loss"))


@register("a4_contrastive_global", _ce_sql("q.batch_id // 4 = p.batch_id // 4", factor=" * 4.0::DOUBLE"))
def a4_contrastive_global(spark, sf_dir):
    q, p, t = _qp(spark, sf_dir)
    loss = A.contrastive_loss(q, p, t, scope="global", world_size=4, scale_loss=True)
    return loss.select("qid", F.round("loss", 6).alias("loss"))


@register("a5_scale_by_dim", _ce_sql("q.batch_id = p.batch_id", scale_expr=" / 64.0::DOUBLE"))
def a5_scale_by_dim(spark, sf_dir):
    q, p, t = _qp(spark, sf_dir)
    loss = A.contrastive_loss(q, p, t, scope="batch", scale_by_dim=True, dim=64)
    return loss.select("qid", F.round("loss", 6).alias("loss"))


def token_logp(spark, sf_dir):
    """token_logp(batch_id, doc_id, pos, label, logp) over benchmark words.

    Stopwords play padding (label -100); labels and log-probabilities come from
    md5 so every engine derives the same values.
    """
    b = table(spark, sf_dir, "benchmark")
    t = b.select(F.col("item_id").alias("doc_id"), F.posexplode(words("text")).alias("pos", "term"))
    stop = F.array(*[F.lit(w) for w in ENGLISH_STOPWORDS])
    label = F.when(F.array_contains(stop, F.col("term")), F.lit(-100)).otherwise(F.pmod(hex8(F.md5("term")), F.lit(50000)))
    logp = F.log((hex8(md5_key(42, "doc_id", "pos")) + 1).cast("double") / F.lit(4294967296.0))
    return t.select(F.floor(F.col("doc_id") / 4).cast("bigint").alias("batch_id"), "doc_id",
                    F.col("pos").cast("int").alias("pos"), label.cast("int").alias("label"), logp.alias("logp"))


TOKEN_LOGP_SQL = f"""
tw AS (SELECT item_id AS doc_id, {sql_words('text')} AS w FROM benchmark),
tl AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM tw),
token_logp AS (
  SELECT doc_id // 4 AS batch_id, doc_id, CAST(pos AS INTEGER) AS pos,
         CAST(CASE WHEN list_contains({STOP_LIST}, term) THEN -100 ELSE {sql_hex8('md5(term)')} % 50000 END AS INTEGER) AS label,
         ln(({sql_hex8(md5k("'42'", 'doc_id', 'pos'))} + 1)::DOUBLE / 4294967296.0::DOUBLE) AS logp
  FROM tl)
"""


@register("a6_lm_loss", f"""
WITH {TOKEN_LOGP_SQL}
SELECT doc_id, round(avg(-logp), 6) AS lm_loss, count(*)::BIGINT AS n_tokens FROM token_logp
WHERE label <> -100 GROUP BY doc_id
""")
def a6_lm_loss(spark, sf_dir):
    loss = A.lm_loss(token_logp(spark, sf_dir), by="doc_id")
    return loss.select("doc_id", F.round("lm_loss", 6).alias("lm_loss"), "n_tokens")


@register("a7_dual_loss", f"""
WITH {TOKEN_LOGP_SQL},
ib AS ({_ce_sql("q.batch_id = p.batch_id").replace("round((l.lse - s.score), 6)", "(l.lse - s.score)")}),
sq AS (SELECT batch_id, avg(-logp) AS lm_loss FROM token_logp WHERE label <> -100 GROUP BY batch_id)
SELECT round((SELECT avg(loss) FROM ib), 6) AS inbatch_loss, round((SELECT avg(lm_loss) FROM sq), 6) AS seq_loss,
       round((SELECT avg(loss) FROM ib) + (SELECT avg(lm_loss) FROM sq), 6) AS total_loss
""")
def a7_dual_loss(spark, sf_dir):
    q, p, t = _qp(spark, sf_dir)
    ib = A.contrastive_loss(q, p, t, scope="batch")
    sq = A.lm_loss(token_logp(spark, sf_dir), by="batch_id")
    d = A.dual_loss(ib, sq, enabled=True)
    return d.select(*[F.round(c, 6).alias(c) for c in ("inbatch_loss", "seq_loss", "total_loss")])


@register("a10_metric_log", """
SELECT CAST(floor(event_id / 100) AS BIGINT) AS window, min(event_id) AS first_step, max(event_id) AS last_step,
       round(avg(value), 6) AS mean_loss, count(*)::BIGINT AS n
FROM events GROUP BY 1
""")
def a10_metric_log(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return A.metric_log(log, every=100).withColumn("mean_loss", F.round("mean_loss", 6))


@register("a9_adapter_loss", f"""
WITH {MEMBERS_SQL},
s AS (SELECT q.vec_id AS qid, p.vec_id AS pid, list_inner_product({_n('q.v')}, {_n('p.v')}) AS score
      FROM m q JOIN m p ON q.batch_id = p.batch_id WHERE q.pos % 2 = 0 AND p.pos % 2 = 1),
l AS (SELECT qid, ln(sum(exp(score))) - any_value(score) FILTER (pid = qid + 1) AS loss FROM s GROUP BY qid)
SELECT round(avg(loss), 6) AS loss FROM l
""")
def a9_adapter_loss(spark, sf_dir):
    """The objective of the adapter fit at W = I."""
    q, p, t = _qp(spark, sf_dir)
    _, loss = A.adapter_gradient(q, p, t, np.eye(64))
    return spark.createDataFrame([(round(loss, 6),)], "loss double")


@register("u5_cached_gradient", f"""
WITH {MEMBERS_SQL},
u AS (SELECT batch_id, vec_id, pos, v, {_n('v')} AS u, sqrt(list_inner_product(v, v)) AS z FROM m),
s AS (SELECT q.vec_id AS qid, p.vec_id AS pid, list_inner_product(q.u, p.u) AS score, q.u AS uq, p.u AS up
      FROM u q JOIN u p ON q.batch_id = p.batch_id WHERE q.pos % 2 = 0 AND p.pos % 2 = 1),
g AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY qid) - CASE WHEN pid = qid + 1 THEN 1 ELSE 0 END AS g FROM s),
by_rep AS (SELECT id, d, sum(x) AS x FROM (
    SELECT qid AS id, generate_subscripts(up, 1) AS d, g * unnest(up) AS x FROM g
    UNION ALL SELECT pid, generate_subscripts(uq, 1), g * unnest(uq) FROM g) GROUP BY id, d),
r AS (SELECT id, list(x ORDER BY d) AS du FROM by_rep GROUP BY id),
dz AS (SELECT v, list_transform(du, lambda x, i: (x - u[i] * list_inner_product(u, du)) / z) AS dz FROM r JOIN u ON u.vec_id = r.id),
rows_ AS (SELECT v, unnest(dz) AS a, generate_subscripts(dz, 1) - 1 AS i FROM dz),
cells AS (SELECT i, generate_subscripts(v, 1) - 1 AS j, a * unnest(v) AS x FROM rows_)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
  round(sum(x) / (SELECT count(DISTINCT qid) FROM s), 6) + 0.0::DOUBLE AS g FROM cells GROUP BY ALL
""")
def u5_cached_gradient(spark, sf_dir):
    """The two-phase gradient of the contrastive objective at W = I."""
    g, _ = A.cached_gradient(*_qp(spark, sf_dir), np.eye(64), chunk=32)
    rows = [(i, j, round(float(g[i, j]), 6) + 0.0) for i in range(g.shape[0]) for j in range(g.shape[1])]
    return spark.createDataFrame(rows, "i int, j int, g double")


@register("a9_fit_linear_adapter")
def a9_fit_linear_adapter(spark, sf_dir):
    """Three gradient steps on the even/odd in-batch pairs; W returned as (i, j, w) rows."""
    q, p, t = _qp(spark, sf_dir)
    W, losses = A.fit_linear_adapter(q, p, t, dim=64, steps=3, lr=0.5)
    rows = [(i, j, float(W[i, j])) for i in range(W.shape[0]) for j in range(W.shape[1])]
    return spark.createDataFrame(rows, "i int, j int, w double")


A8_SQL = f"""
WITH {DOC_BATCHES},
tw AS (SELECT batch_id, doc_id, {sql_words('text')} AS w FROM batch_member),
toks AS (SELECT batch_id, doc_id, len(w) AS n, floor(len(w) * 0.5::DOUBLE) AS half,
                unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM tw),
qc AS (SELECT batch_id, doc_id, term, count(*) AS qc FROM toks WHERE pos < half GROUP BY 1, 2, 3),
dc AS (SELECT batch_id, doc_id, term, count(*) AS dc, any_value(n) AS n FROM toks GROUP BY 1, 2, 3),
qn AS (SELECT batch_id, doc_id, sqrt(sum(qc * qc)) AS qn FROM qc GROUP BY 1, 2),
dn AS (SELECT batch_id, doc_id, sqrt(sum(dc * dc)) AS dn FROM dc GROUP BY 1, 2),
ov AS (SELECT a.batch_id, a.doc_id AS i, b.doc_id AS j, sum(a.qc * b.dc) AS ov
       FROM qc a JOIN dc b ON a.batch_id = b.batch_id AND a.term = b.term GROUP BY 1, 2, 3),
pairs AS (SELECT a.batch_id, a.doc_id AS i, b.doc_id AS j,
                 coalesce(ov.ov, 0) / (greatest(coalesce(qn.qn, 0.0), 1e-12::DOUBLE) * greatest(coalesce(dn.dn, 0.0), 1e-12::DOUBLE)) / 0.05::DOUBLE AS z
          FROM batch_member a JOIN batch_member b ON a.batch_id = b.batch_id AND a.doc_id <> b.doc_id
          LEFT JOIN ov ON ov.batch_id = a.batch_id AND ov.i = a.doc_id AND ov.j = b.doc_id
          LEFT JOIN qn ON qn.batch_id = a.batch_id AND qn.doc_id = a.doc_id
          LEFT JOIN dn ON dn.batch_id = b.batch_id AND dn.doc_id = b.doc_id),
e AS (SELECT batch_id, i, j, exp(z - max(z) OVER (PARTITION BY batch_id, i)) AS e FROM pairs),
wts AS (SELECT batch_id, i, j, e / sum(e) OVER (PARTITION BY batch_id, i) AS weight FROM e),
second AS (SELECT batch_id, doc_id AS i, pos, term FROM toks WHERE pos >= half),
mix AS (SELECT s.batch_id, s.i, s.pos, sum(w.weight * coalesce(dc.dc / dc.n, 0.0)) AS mix
        FROM second s JOIN wts w ON s.batch_id = w.batch_id AND s.i = w.i
        LEFT JOIN dc ON dc.batch_id = w.batch_id AND dc.doc_id = w.j AND dc.term = s.term
        GROUP BY 1, 2, 3),
ct AS (SELECT unnest({sql_words('text')}) AS term FROM documents),
bg AS (SELECT term, count(*) / (SELECT count(*) FROM ct) AS pbg FROM ct GROUP BY 1),
has AS (SELECT DISTINCT batch_id, i FROM wts),
t AS (SELECT s.batch_id, s.i, s.pos, CASE WHEN h.i IS NULL THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS lam,
             bg.pbg, coalesce(m.mix, 0.0) AS mix
      FROM second s LEFT JOIN mix m ON m.batch_id = s.batch_id AND m.i = s.i AND m.pos = s.pos
      JOIN bg ON bg.term = s.term LEFT JOIN has h ON h.batch_id = s.batch_id AND h.i = s.i)
SELECT batch_id, i AS doc_id, round(-avg(ln(lam * pbg + (1.0 - lam) * mix)), 6) AS loss FROM t GROUP BY 1, 2
"""


@register("a8_retrieval_weighted_lm_loss", A8_SQL)
def a8_retrieval_weighted_lm_loss(spark, sf_dir):
    m = X.document_batches(spark, sf_dir)
    loss = A.retrieval_weighted_lm_loss(m, table(spark, sf_dir, "documents"), lam=0.1, temperature=0.05)
    return loss.select("batch_id", "doc_id", F.round("loss", 6).alias("loss"))
