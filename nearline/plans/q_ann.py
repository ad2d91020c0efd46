"""Approximate search over ``embeddings``.

Queries named after a fit (``full_probe``, ``pca``, ``trained``) train their model;
the others take the vectors of smallest id as centroids, codebooks or projections,
which SQL reproduces: they check the kernels, and miss many neighbours.  The
``trained`` ones probe as many cells and re-rank as many candidates as a sample of
queries needs to find ``SAMPLE_RECALL`` of its exact neighbours.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nearline.operators import ann as N
from nearline.operators import factory as U
from nearline.operators import metrics as R
from nearline.operators import multiprobe as M
from nearline.operators import quantize as Z
from nearline.operators import search as S
from nearline.operators import tree as T
from nearline.plans.registry import register
from nearline.plans.sqlparts import KNN10
from nearline.session import materialize
from nearline.sources import fixtures as X

NLIST, NPROBE, SUBS, BOOK, TABLES = 8, 2, 8, 16, 4
WIDTH, OFFSET = 0.5, 0.123
TRAINED_BOOK, SAMPLE_RECALL, CELLS_RECALL = 64, 0.95, 0.98


def _reps(spark, sf_dir):
    return X.reps(spark, sf_dir).select("id", "rep")


def _string_ids(reps):
    return reps.select(F.concat(F.lit("v"), F.col("id")).alias("id"), "rep")


def ranked(cands: str) -> str:
    """Top 10 of candidates (qid, docid, s)."""
    return f"""SELECT qid, docid, CAST(rank AS BIGINT) AS rank, score FROM (
  SELECT qid, docid, round(s, 6) AS score,
         row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, docid) AS rank FROM ({cands}) c) t
WHERE rank <= 10"""


VECTORS = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
# cells(id, v, cell, near): cells by distance to the first NLIST vectors, near = 1 for the closest.
CELL_SQL = f"""cent AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cell, v AS c FROM e QUALIFY cell < {NLIST}),
cells AS (SELECT id, v, cell, row_number() OVER (PARTITION BY id ORDER BY
                 list_inner_product(c, c) - 2 * list_inner_product(v, c), cell) AS near FROM e, cent)"""
CELLS = f"{VECTORS}, {CELL_SQL}"
IVF_RUN = ranked(f"""SELECT q.id AS qid, d.id AS docid, list_inner_product(q.v, d.v) AS s
  FROM cells q JOIN cells d ON q.cell = d.cell AND q.near <= {NPROBE} AND d.near = 1""")
# codes(id, j, code) and dec(id, r): the nearest of the first BOOK vectors in each slice, and their concatenation.
CODES = f"""book AS (SELECT row_number() OVER (ORDER BY id) - 1 AS code, v AS c FROM e QUALIFY code < {BOOK}),
slices AS (SELECT id, j, list_slice(v, j * len(v) // {SUBS} + 1, (j + 1) * len(v) // {SUBS}) AS x
           FROM e, range({SUBS}) r(j)),
books AS (SELECT code, j, list_slice(c, j * len(c) // {SUBS} + 1, (j + 1) * len(c) // {SUBS}) AS y
          FROM book, range({SUBS}) r(j)),
best AS (SELECT id, s.j, y FROM slices s JOIN books b ON s.j = b.j
         QUALIFY row_number() OVER (PARTITION BY id, s.j ORDER BY
                 list_inner_product(y, y) - 2 * list_inner_product(x, y), code) = 1),
dec AS (SELECT id, flatten(list(y ORDER BY j)) AS r FROM best GROUP BY id)"""


def _ivf_fitted(spark, sf_dir):
    r = _reps(spark, sf_dir)
    cents = N.ivf_fit(r, NLIST, seed=42)
    return N.ivf_search(r, N.ivf_assign(r, cents), cents, k=10, nprobe=NLIST, shard_rows=64, query_block=32, decimals=6)


def _ivf(r):
    cents = N.first_vectors(r, NLIST)
    return N.ivf_search(r, N.ivf_assign(r, cents), cents, k=10, nprobe=NPROBE, shard_rows=64, query_block=32, decimals=6)


def _pq_books(r):
    return N.pq_books(N.first_vectors(r, BOOK), SUBS)


@register("v7_ivf_full_probe", KNN10)
def v7_ivf_full_probe(spark, sf_dir):
    """IVF with every list probed must equal exact search."""
    return _ivf_fitted(spark, sf_dir)


@register("v7_ivf_search", f"WITH {CELLS} {IVF_RUN}")
def v7_ivf_search(spark, sf_dir):
    return _ivf(_reps(spark, sf_dir))


@register("v2_knn_string_ids", """
SELECT qid, docid, rank, score FROM (
  SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS BIGINT) AS rank
  FROM (SELECT 'v' || q.vec_id AS qid, 'v' || d.vec_id AS docid,
               round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
        FROM embeddings q, embeddings d) p) t
WHERE rank <= 10
""")
def v2_knn_string_ids(spark, sf_dir):
    r = _string_ids(_reps(spark, sf_dir))
    return S.knn_exact(r, r, k=10, decimals=6)


@register("v7_ivf_string_ids", f"""
WITH {VECTORS.replace('vec_id AS id', "'v' || vec_id AS id")},
{CELL_SQL} {IVF_RUN}
""")
def v7_ivf_string_ids(spark, sf_dir):
    return _ivf(_string_ids(_reps(spark, sf_dir)))


@register("v8_pq_search", f"""
WITH {VECTORS}, {CODES} {ranked("SELECT q.id AS qid, d.id AS docid, list_inner_product(q.v, d.r) AS s FROM e q, dec d")}
""")
def v8_pq_search(spark, sf_dir):
    r = _reps(spark, sf_dir)
    books = _pq_books(r)
    return N.pq_search(r, N.pq_encode(r, books), books, k=10, decimals=6)


@register("v8_ivf_pq_search", f"""
WITH {CELLS}, {CODES} {ranked(f'''SELECT q.id AS qid, d.id AS docid, list_inner_product(q.v, x.r) AS s
  FROM cells q JOIN cells d ON q.cell = d.cell AND q.near <= {NPROBE} AND d.near = 1 JOIN dec x ON x.id = d.id''')}
""")
def v8_ivf_pq_search(spark, sf_dir):
    r = _reps(spark, sf_dir)
    books, cents = _pq_books(r), N.first_vectors(r, NLIST)
    index = N.pq_encode(N.ivf_assign(r, cents), books)
    return N.ivf_pq_search(r, index, cents, books, k=10, nprobe=NPROBE, decimals=6)


def _trained_cells(r, recall):
    sample, exact = N.exact_sample(r, r, k=10)
    cents = N.ivf_fit(r, NLIST, seed=42)
    index = N.ivf_assign(r, cents)
    return sample, exact, cents, index, N.probes_for(recall, sample, exact, index, cents)


def _ivf_trained(r):
    _, _, cents, index, nprobe = _trained_cells(r, SAMPLE_RECALL)
    return N.ivf_search(r, index, cents, k=10, nprobe=nprobe, decimals=6)


@register("v7_ivf_trained")
def v7_ivf_trained(spark, sf_dir):
    return _ivf_trained(_reps(spark, sf_dir))


@register("v7_ivf_trained_string_ids")
def v7_ivf_trained_string_ids(spark, sf_dir):
    return _ivf_trained(_string_ids(_reps(spark, sf_dir)))


@register("v8_pq_trained")
def v8_pq_trained(spark, sf_dir):
    r = _reps(spark, sf_dir)
    sample, exact = N.exact_sample(r, r, k=10)
    books = N.pq_fit(r, SUBS, ks=TRAINED_BOOK)
    codes = materialize(N.pq_encode(N.with_vector(r), books), "pq_codes")
    score = N.pq_scorer(spark, books)
    depth = N.depth_by_rank(SAMPLE_RECALL, sample, exact, codes, score)
    probes = r.where(S.usable("rep")).select(F.col("id").alias("qid"), "rep", F.array(F.lit(0)).alias("cells"))
    return N.probe_rerank(probes, codes.withColumn("cell", F.lit(0)), depth, k=10, decimals=6, score=score)


@register("v8_ivf_pq_trained")
def v8_ivf_pq_trained(spark, sf_dir):
    r = _reps(spark, sf_dir)
    sample, exact, cents, cells, nprobe = _trained_cells(r, CELLS_RECALL)
    books = N.pq_fit(r, SUBS, ks=TRAINED_BOOK)
    index = materialize(N.pq_encode(N.with_vector(cells), books), "pq_codes")
    score = N.pq_scorer(spark, books)
    depth = N.depth_by_rank(SAMPLE_RECALL, sample, exact, index, score, probes=N.ivf_probes(sample, cents, nprobe))
    return N.probe_rerank(N.ivf_probes(r, cents, nprobe), index, depth, k=10, decimals=6, score=score)


@register("v9_pca_reduce")
def v9_pca_reduce(spark, sf_dir):
    r = _reps(spark, sf_dir)
    return N.pca_reduce(r, N.pca_fit(r, 16))


@register("v9_pca_full_search", KNN10)
def v9_pca_full_search(spark, sf_dir):
    """A projection on all principal components keeps every inner product."""
    r = _reps(spark, sf_dir)
    return U.make_index(f"PCA{N.first_vectors(r, 1).shape[1]},Flat", r, metric="ip")(r, k=10, decimals=6)


@register("v10_lsh_search", f"""
WITH {VECTORS},
plane AS (SELECT row_number() OVER (ORDER BY id) - 1 AS t, v AS p FROM e QUALIFY t < {TABLES}),
h AS (SELECT id, t, CAST(floor((list_inner_product(v, p) + {OFFSET}::DOUBLE) / {WIDTH}::DOUBLE) AS BIGINT) AS b
      FROM e, plane),
pairs AS (SELECT DISTINCT q.id AS qid, d.id AS docid FROM h q JOIN h d ON q.t = d.t AND q.b = d.b)
{ranked('''SELECT qid, docid, list_inner_product(q.v, d.v) AS s FROM pairs JOIN e q ON q.id = qid JOIN e d ON d.id = docid''')}
""")
def v10_lsh_search(spark, sf_dir):
    r = _reps(spark, sf_dir)
    model = N.Projections(N.first_vectors(r, TABLES), np.full(TABLES, OFFSET), WIDTH)
    return N.lsh_search(r, r, model, k=10, decimals=6)


@register("u4_index_add", KNN10)
def u4_index_add(spark, sf_dir):
    """An index fitted on half of the vectors, the other half added, every list probed."""
    r = _reps(spark, sf_dir)
    half = U.make_index(f"IVF{NLIST},Flat", r.where(F.col("id") % 2 == 0), metric="ip")
    return half.add(r.where(F.col("id") % 2 != 0))(r, k=10, nprobe=NLIST, decimals=6)


@register("r7_run_overlap_full_probe", "SELECT vec_id AS qid, 1.0::DOUBLE AS overlap_10 FROM embeddings")
def r7_run_overlap_full_probe(spark, sf_dir):
    r = _reps(spark, sf_dir)
    return R.run_overlap(_ivf_fitted(spark, sf_dir), S.knn_exact(r, r, k=10, decimals=6), k=10)


@register("r7_run_overlap", f"""
WITH {CELLS}, a AS ({IVF_RUN}), x AS ({KNN10})
SELECT x.qid, round(count(a.docid) / count(*)::DOUBLE, 6) AS overlap_10
FROM x LEFT JOIN a ON a.qid = x.qid AND a.docid = x.docid GROUP BY x.qid
""")
def r7_run_overlap(spark, sf_dir):
    r = _reps(spark, sf_dir)
    return R.run_overlap(_ivf(r), S.knn_exact(r, r, k=10, decimals=6), k=10)


# ---------------------------------------------------------------- squared distance, residual codes, rotation

#: Vectors of three lengths, so that distance and inner product rank apart.
LONG = "e AS (SELECT vec_id AS id, [x * (1 + vec_id % 3) for x in embedding::DOUBLE[]] AS v FROM embeddings)"
L2 = "round(2 * list_inner_product({q}, {d}) - list_inner_product({q}, {q}) - list_inner_product({d}, {d}), 6) + 0.0::DOUBLE"


def _long(spark, sf_dir):
    return _reps(spark, sf_dir).withColumn("rep", F.transform("rep", lambda x: x.cast("double") * (1 + F.col("id") % 3)))


def _clustered(spark, sf_dir, centres=40):
    """Each vector of ``embeddings`` around one of the first ``centres``: data that cells can split."""
    r = _reps(spark, sf_dir)
    base = r.where(F.col("id") < centres).select(F.col("id").alias("c"), F.col("rep").alias("m"))
    near = F.zip_with("rep", "m", lambda x, y: x.cast("double") * 0.4 + y)
    return r.join(F.broadcast(base), F.pmod("id", F.lit(centres)) == F.col("c")).select("id", near.alias("rep"))


@register("v2_knn_l2", f"WITH {LONG} " + ranked(f"SELECT q.id AS qid, d.id AS docid, {L2.format(q='q.v', d='d.v')} AS s FROM e q, e d"))
def v2_knn_l2(spark, sf_dir):
    r = _long(spark, sf_dir)
    return S.knn_exact(r, r, k=10, decimals=6, score=Z.minus_squared_l2)


# Residual codes: words are the slices of the first BOOK residuals; rec is centroid plus decoded residual.
RESIDUAL = f"""home AS (SELECT x.id, x.cell, c, [v[i] - c[i] for i in range(1, len(v) + 1)] AS u
         FROM cells x JOIN cent USING (cell) WHERE near = 1),
book AS (SELECT row_number() OVER (ORDER BY id) - 1 AS code, u AS w FROM home QUALIFY code < {BOOK}),
slices AS (SELECT id, j, list_slice(u, j * len(u) // {SUBS} + 1, (j + 1) * len(u) // {SUBS}) AS x FROM home, range({SUBS}) r(j)),
books AS (SELECT code, j, list_slice(w, j * len(w) // {SUBS} + 1, (j + 1) * len(w) // {SUBS}) AS y FROM book, range({SUBS}) r(j)),
best AS (SELECT id, s.j, y FROM slices s JOIN books b ON s.j = b.j
         QUALIFY row_number() OVER (PARTITION BY id, s.j ORDER BY
                 list_inner_product(y, y) - 2 * list_inner_product(x, y), code) = 1),
dec AS (SELECT id, flatten(list(y ORDER BY j)) AS r FROM best GROUP BY id),
rec AS (SELECT id, cell, [c[i] + r[i] for i in range(1, len(c) + 1)] AS v FROM home JOIN dec USING (id))"""


def _residual_sql(score):
    return f"WITH {LONG}, {CELL_SQL}, {RESIDUAL} " + ranked(
        f"SELECT q.id AS qid, d.id AS docid, {score} AS s FROM cells q JOIN rec d ON q.cell = d.cell AND q.near <= {NPROBE}")


def _residual_fixed(spark, sf_dir, metric):
    r = _long(spark, sf_dir)
    cents = N.first_vectors(r, NLIST)
    cells = N.ivf_assign(r, cents)
    books = N.pq_books(N.first_vectors(Z.residuals(cells, cents), BOOK), SUBS)
    index = materialize(Z.residual_encode(cells, cents, books), "residual_codes")
    return Z.residual_search(r, index, cents, books, k=10, nprobe=NPROBE, metric=metric, decimals=6)


@register("v8_residual_l2", _residual_sql(L2.format(q="q.v", d="d.v")))
def v8_residual_l2(spark, sf_dir):
    return _residual_fixed(spark, sf_dir, "l2")


@register("v8_residual_ip", _residual_sql("list_inner_product(q.v, d.v)"))
def v8_residual_ip(spark, sf_dir):
    return _residual_fixed(spark, sf_dir, "ip")


@register("v8_residual_trained")
def v8_residual_trained(spark, sf_dir):
    """Trained cells and residual codes under squared distance; candidates re-ranked by their vectors."""
    r = materialize(_clustered(spark, sf_dir), "clustered")
    block, _ = Z.metric_of("l2")
    sample, exact = N.exact_sample(r, r, k=10, score=block)
    cents = N.ivf_fit(r, 2 * NLIST, seed=42)
    cells = N.ivf_assign(r, cents)
    nprobe = N.probes_for(CELLS_RECALL, sample, exact, cells, cents)
    books = Z.residual_books(cells, cents, SUBS, ks=TRAINED_BOOK)
    index = materialize(Z.residual_encode(N.with_vector(cells), cents, books), "residual_codes")
    score = Z.residual_scorer(spark, cents, books, "l2")
    depth = N.depth_by_rank(SAMPLE_RECALL, sample, exact, index, score, probes=N.ivf_probes(sample, cents, nprobe))
    return N.probe_rerank(N.ivf_probes(r, cents, nprobe), index, depth, k=10, decimals=6, score=score, block=block)


@register("u4_rotated_full_probe", f"WITH {LONG} " + ranked(f"SELECT q.id AS qid, d.id AS docid, {L2.format(q='q.v', d='d.v')} AS s FROM e q, e d"))
def u4_rotated_full_probe(spark, sf_dir):
    """A learned rotation keeps every distance: with all cells probed the result is exact."""
    r = _long(spark, sf_dir)
    return U.make_index(f"OPQ{SUBS},IVF{NLIST},Flat", r, ks=BOOK)(r, k=10, nprobe=NLIST, decimals=6)


# ---------------------------------------------------------------- cells that grow with the table

@register("v7_tree_full_probe", KNN10)
def v7_tree_full_probe(spark, sf_dir):
    """About sqrt(n) cells from a tree; with all of them probed the result is exact."""
    r = _reps(spark, sf_dir)
    tree = T.tree_fit(r)
    return T.tree_search(r, T.tree_assign(r, tree), tree, k=10, nprobe=len(tree.leaves), decimals=6)


@register("v7_tree_trained")
def v7_tree_trained(spark, sf_dir):
    """Squared distance over clustered vectors, as many cells probed as a sample of queries needs."""
    r = materialize(_clustered(spark, sf_dir), "clustered")
    block, _ = Z.metric_of("l2")
    sample, exact = N.exact_sample(r, r, k=10, score=block)
    tree = T.tree_fit(r)
    index = T.tree_assign(r, tree)
    nprobe = N.probes_for(SAMPLE_RECALL, sample, exact, index, tree.leaf_centres)
    return T.tree_search(r, index, tree, k=10, nprobe=nprobe, decimals=6, score=block)


@register("v10_multiprobe_trained")
def v10_multiprobe_trained(spark, sf_dir):
    """Hash tables with fitted width; as many buckets of each opened as a sample of queries needs."""
    r = materialize(_clustered(spark, sf_dir), "clustered")
    block, _ = Z.metric_of("l2")
    sample, exact = N.exact_sample(r, r, k=10, score=block)
    model = M.probing_fit(r)
    index = M.hash_cells(r, model)
    probes = N.depth_for(SAMPLE_RECALL, exact, lambda n: M.multiprobe_search(sample, index, model, k=10, probes=n, score=block), 4096, k=1)
    return M.multiprobe_search(r, index, model, k=10, probes=probes, decimals=6, score=block)
