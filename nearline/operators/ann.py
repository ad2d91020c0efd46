"""Approximate search: IVF, PQ, PCA and LSH.

Cells of a model (IVF lists, leaves of a tree) are searched by ``probe_search``:
runs of cells form groups of at most about 65,536 vectors, a query is sent once for each
group that holds cells of it, and a task keeps one running top-k per query.
Hash buckets are searched by ``bucket_search``: vectors carry the buckets of all
tables and are dealt by id, and a task finds which of its pairs share one.
``cell_search`` takes cells of any kind and number: vectors
carry a cell id, big cells are split into
sub-blocks of about ``shard_rows`` vectors, queries are packed per probed cell
in blocks of ``query_block``, and each (query block, document block) pair of
the same cell is scored by one numpy product inside a task that emits only its
local top-k.  Pairs are dealt by (cell, document block, query group), so a hot
cell is work for many tasks.

Fitting is separate from search: centroids, codebooks and projections are plain
arrays, fitted by Spark ML on a seeded sample or given by the caller.  Only such
model-sized arrays reach the driver and are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearline.operators.search import (GROUP_ROWS, SCORE_CELLS, BestRows, CodeScorer, _pack, block_scorer, decoded, document_groups, empty_run, id_order, inner_product,
                                       knn_exact, matrix, meet_groups, query_groups, rank_results, run_schema, usable, whole)
from nearline.session import materialize


def _blocks_per_cell(df: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``b``, the sub-block of the row inside its cell (cells split by count), and (cell, nb)."""
    nb = df.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(size)), F.lit(1)).cast("int").alias("nb"))
    nb = materialize(nb, "cell_blocks")
    return df.join(nb, "cell").withColumn("b", F.pmod(F.xxhash64("i"), F.col("nb")).cast("int")).drop("nb"), nb


def cell_pairs(q_cells: DataFrame, d_cells: DataFrame, query_block: int, shard_rows: int, d_col: str = "rep") -> DataFrame:
    """(q_ids, q_flat, d_ids, d_flat): every query block with every document block of its cell.

    Pairs are dealt by (cell, document block, query group), so the blocks of one
    hot cell go to as many tasks as those of many cells.  Query blocks are sent once for each
    document block; document blocks once for each query group, of which there is one
    unless the document blocks are too few for the tasks.
    """
    parts = int(q_cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, q_nb = _blocks_per_cell(q_cells.select("cell", F.col("qid").alias("i"), F.col("rep").alias("v")), query_block)
    d, d_nb = _blocks_per_cell(d_cells.select("cell", F.col("id").alias("i"), F.col(d_col).alias("v")), shard_rows)
    blocks, most = d_nb.agg(F.sum("nb")).first()[0] or 1, q_nb.agg(F.max("nb")).first()[0] or 1
    groups = max(1, min(int(most), -(-4 * parts // int(blocks))))
    number = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    qp = _pack(q, ["cell", "b"], "i", "v", "q").withColumn("g", F.col("b") % groups).drop("b")
    qp = qp.join(d_nb, "cell").withColumn("b", number(F.col("nb"))).drop("nb")
    dp = _pack(d, ["cell", "b"], "i", "v", "d").withColumn("g", number(F.lit(groups)))
    # The explicit count keeps the few packed rows, each a matrix product, in many tasks.
    keys = ["cell", "b", "g"]
    return qp.repartition(4 * parts, *keys).join(dp.repartition(4 * parts, *keys), keys).select("q_ids", "q_flat", "d_ids", "d_flat")


def cell_search(q_cells: DataFrame, d_cells: DataFrame, k: int, query_block: int = 128, shard_rows: int = 4096,
                decimals: int | None = None, dedupe: bool = False, d_col: str = "rep",
                score=inner_product) -> DataFrame:
    """Top-k among documents that share a cell with the query.

    ``q_cells(qid, rep, cell)`` has one row per probed cell, ``d_cells(id,
    <d_col>, cell)`` one per vector; pass stored tables, both are read twice.
    With ``dedupe`` a document reached through several cells counts once.
    """
    schema = run_schema(q_cells, "qid", d_cells, "id")
    local = cell_pairs(q_cells, d_cells, query_block, shard_rows, d_col).mapInPandas(block_scorer(k, decimals, score), schema)
    if dedupe:
        local = local.groupBy("qid", "docid").agg(F.max("score").alias("score"))
    return rank_results(local, k).select("qid", "docid", "rank", "score")


def _cell_groups(sizes: dict[int, int], rows: int = GROUP_ROWS) -> list[tuple[int, int, int, int, int]]:
    """(group, first cell, last cell, part, parts): runs of cells of about ``rows`` vectors; a larger cell is split into parts."""
    out, lo, held = [], None, 0
    for cell in sorted(sizes):
        if lo is not None and held + sizes[cell] > rows:
            out.append((len(out), lo, last, 0, 1))
            lo, held = None, 0
        if sizes[cell] > rows:
            parts = -(-sizes[cell] // rows)
            out += [(len(out) + b, cell, cell, b, parts) for b in range(parts)]
        else:
            lo, held, last = cell if lo is None else lo, held + sizes[cell], cell
    return out if lo is None else [*out, (len(out), lo, last, 0, 1)]


def _cells_scorer(k: int, decimals: int | None, query_block: int, score):
    """Kernel over queries (i, v, cells) and documents (i, v, cell) of a group: the best k of each query in its cells."""
    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return empty_run(q, d)
        d = id_order(d)
        q_ids, d_ids, cells = whole(q.column("i")), whole(d.column("i")), whole(q.column("cells"))
        Q, D = matrix(whole(q.column("v"))).astype(np.float64), matrix(whole(d.column("v")))
        asked = cells.flatten().to_numpy(zero_copy_only=False)
        asking = np.repeat(np.arange(len(Q)), cells.value_lengths().to_numpy(zero_copy_only=False))
        by_ask = np.argsort(asked, kind="stable")
        asked, asking = asked[by_ask], asking[by_ask]
        held = whole(d.column("cell")).to_numpy(zero_copy_only=False)
        places = np.argsort(held, kind="stable")  # by cell, then id
        held = held[places]
        best = BestRows(len(Q), k, decimals)
        for cell in np.unique(held):
            at = places[slice(*np.searchsorted(held, [cell, cell + 1]))]
            rows = asking[slice(*np.searchsorted(asked, [cell, cell + 1]))]
            by_block, X = decoded(score, D[at])
            for lo in range(0, len(rows), query_block):
                some = rows[lo:lo + query_block]
                best.meet(some, Q[some], at, X, by_block)
        return best.table(q_ids, d_ids)

    return run


def probe_search(probes: DataFrame, d_cells: DataFrame, k: int, query_block: int = 128, shard_rows: int = 4096,
                 decimals: int | None = None, d_col: str = "rep", score=inner_product, kernel=None, extra=()) -> DataFrame:
    """Top-k among the documents of the cells that each query probes.

    ``probes(qid, rep, cells)`` has one row per query, with its distinct cells;
    ``d_cells(id, <d_col>, cell)`` one per vector, in one cell.  Cells are numbered
    from 0 and are as many as the centroids, so one count a cell reaches the
    driver.  Neighbouring cells form groups of ``shard_rows`` to ``GROUP_ROWS`` vectors, larger with the table,
    and a query is sent once for each group that holds cells of it.  Pass stored tables.
    """
    parts = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = run_schema(probes, "qid", d_cells, "id")
    sizes = {r["cell"]: r["count"] for r in d_cells.groupBy("cell").count().collect()}
    total = sum(sizes.values())
    groups = _cell_groups(sizes, max(shard_rows, -(-total // document_groups(total, parts))))
    ranges = lambda: F.broadcast(probes.sparkSession.createDataFrame(groups, "dg int, lo int, hi int, part int, parts int"))
    d = d_cells.select(F.col("id").alias("i"), F.col(d_col).alias("v"), "cell", *extra)
    d = d.join(ranges(), F.col("cell").between(F.col("lo"), F.col("hi")) & (F.pmod(F.xxhash64("i"), F.col("parts")) == F.col("part")))
    q_groups = query_groups(probes.count(), max(1, len(groups)), parts)
    q = probes.select(F.col("qid").alias("i"), F.col("rep").alias("v"), "cells", F.pmod(F.xxhash64("qid"), F.lit(q_groups)).cast("int").alias("qg"))
    inside = F.filter("cells", lambda c: c.between(F.col("lo"), F.col("hi")))
    q = q.crossJoin(ranges()).withColumn("cells", inside).where(F.size("cells") > 0).select("dg", "qg", "i", "v", "cells")
    kernel = _cells_scorer(k, decimals, query_block, score) if kernel is None else kernel
    local = meet_groups(q, d.select("dg", "i", "v", "cell", *extra), max(1, len(groups)), q_groups, kernel, schema)
    return rank_results(local, k).select("qid", "docid", "rank", "score")


#: Numbers that the buckets of a group of queries hold at most.
KEY_VALUES = 1 << 23


def _bucket_codes(q: pa.Array, d: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By table, the numbers of the buckets of queries (rows, probes) and of documents (rows): equal where the keys are."""
    def keys(a: pa.Array) -> np.ndarray:
        tables, probes = a.flatten(), a.flatten().flatten()
        shape = len(a), len(tables) // len(a), len(probes) // len(tables), -1
        return probes.flatten().to_numpy(zero_copy_only=False).reshape(shape)

    A, B = keys(q), keys(d)
    return _numbered((A[:, t], B[:, t, 0]) for t in range(A.shape[1]))


def _numbered(tables) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """``_bucket_codes`` of the keys of each table: of queries (rows, probes, numbers) and of documents (rows, numbers)."""
    out = [], []
    for A, B in tables:
        both = np.ascontiguousarray(np.concatenate([A.reshape(-1, A.shape[2]), B]))
        code = np.unique(both.view(np.dtype((np.void, both.dtype.itemsize * both.shape[1]))).ravel(), return_inverse=True)[1]
        out[0].append(code[:A.shape[0] * A.shape[1]].reshape(A.shape[:2]))
        out[1].append(code[A.shape[0] * A.shape[1]:])
    return out


def _buckets_scorer(k: int, decimals: int | None, query_block: int, score, hashed=None):
    """Kernel over queries and documents (i, v, keys) of a group: the best k of each query among those of its buckets.

    With ``hashed(Q, D)``, the keys of each table as ``_numbered`` takes them, there is no column ``keys``.
    Where the buckets of all tables hold more than the documents, every pair is scored once, and
    only pairs that could enter a top k are asked whether they share a bucket; else bucket by
    bucket, and a pair met in an earlier table is left out.
    """
    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return empty_run(q, d)
        d = id_order(d)
        q_ids, d_ids = whole(q.column("i")), whole(d.column("i"))
        Q, D, places = matrix(whole(q.column("v"))).astype(np.float64), matrix(whole(d.column("v"))), np.arange(d.num_rows)
        asked, held = _bucket_codes(whole(q.column("keys")), whole(d.column("keys"))) if hashed is None else _numbered(hashed(Q, D))

        def shared(tables):
            def some(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
                out = np.zeros(np.broadcast_shapes(rows.shape, at.shape), dtype=bool)
                for t in tables:
                    for probe in asked[t].T:
                        out |= probe[rows] == held[t][at]
                return out
            return some

        best, tables = BestRows(len(Q), k, decimals), range(len(held))
        sizes = [np.bincount(h, minlength=max(a.max(), h.max()) + 1) for a, h in zip(asked, held)]
        twice = len(pc.unique(d_ids)) < len(d_ids)  # rows of one id take places of each bucket's best k
        if not twice and sum(int(n[a].sum()) for n, a in zip(sizes, asked)) >= len(Q) * len(D):
            for lo in range(0, len(Q), query_block):
                rows = np.arange(lo, min(len(Q), lo + query_block))
                best.meet(rows, Q[rows], places, D, score, shared(tables))
            return best.table(q_ids, d_ids)
        out = []
        for t in tables:
            asking, cells = np.repeat(np.arange(len(Q)), asked[t].shape[1]), asked[t].ravel()
            by_ask, by_cell = np.argsort(cells, kind="stable"), np.argsort(held[t], kind="stable")
            cells, homes = cells[by_ask], held[t][by_cell]
            met = shared(tables[:t])
            for cell in np.intersect1d(cells, homes):
                at = by_cell[slice(*np.searchsorted(homes, [cell, cell + 1]))]
                rows = asking[by_ask[slice(*np.searchsorted(cells, [cell, cell + 1]))]]
                one = BestRows(len(Q), k, decimals) if twice else best
                for lo in range(0, len(rows), query_block):
                    some = rows[lo:lo + query_block]
                    one.meet(some, Q[some], at, D[at], score, None if twice or not t else lambda r, c, met=met: ~met(r, c))
                if twice:
                    out.append(one.table(q_ids, d_ids))
        return pa.concat_tables(out) if out else best.table(q_ids, d_ids)

    return run


def bucket_search(queries: DataFrame, index: DataFrame, k: int, values: int, query_block: int = 1024, decimals: int | None = None,
                  score=inner_product, hashed=None) -> DataFrame:
    """Top-k among documents that share a bucket of any table with the query; each document counts once.

    ``queries(qid, rep, keys)`` and ``index(id, rep, keys)`` have a row a vector; keys
    are the buckets by table and probe, of documents one a table, each an array of
    numbers.  ``values`` is how many numbers a query's keys hold.  Documents are dealt by id into groups of
    at most about ``GROUP_ROWS``, whatever their buckets, and a query is sent once for each.
    With ``hashed(Q, D)`` (see ``_buckets_scorer``) the tasks make the keys from the vectors: keys, which may be
    longer than these, are not sent, and ``values`` counts the numbers that a query takes at once.
    """
    keys = [] if hashed else ["keys"]
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = run_schema(queries, "qid", index, "id")
    n_q, d_groups = queries.count(), document_groups(index.count(), parts)
    q_groups = max(query_groups(n_q, d_groups, parts), -(-n_q * values // KEY_VALUES))
    q = queries.select(F.col("qid").alias("i"), F.col("rep").alias("v"), *keys, F.pmod(F.xxhash64("qid"), F.lit(q_groups)).cast("int").alias("qg"))
    q = q.withColumn("dg", F.explode(F.sequence(F.lit(0), F.lit(d_groups - 1))))
    d = index.select(F.pmod(F.xxhash64("id"), F.lit(d_groups)).cast("int").alias("dg"), F.col("id").alias("i"), F.col("rep").alias("v"), *keys)
    local = meet_groups(q, d, d_groups, q_groups, _buckets_scorer(k, decimals, query_block, score, hashed), schema)
    local = local.groupBy("qid", "docid").agg(F.max("score").alias("score"))
    return rank_results(local, k).select("qid", "docid", "rank", "score")


def first_vectors(reps: DataFrame, n: int) -> np.ndarray:
    """The ``n`` vectors of smallest id, as a deterministic model (centroids, codebooks, projections)."""
    rows = reps.where(usable("rep")).orderBy("id").limit(int(n)).select("rep").collect()
    return np.asarray([r[0] for r in rows], dtype=np.float64)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _nearest(X: np.ndarray, C: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` rows of C nearest to each row of X (squared L2, ties to the first)."""
    d = (C * C).sum(1)[None, :] - 2.0 * (X @ C.T)
    return np.argsort(d, axis=1, kind="stable")[:, :n]


# ---------------------------------------------------------------- IVF (V7)

def _to_vec(df: DataFrame, col: str = "rep") -> DataFrame:
    return df.where(usable(col)).withColumn("features", array_to_vector(F.col(col).cast("array<double>")))


def ivf_fit(reps: DataFrame, nlist: int, sample_fraction: float = 1.0, seed: int = 42, max_iter: int = 20) -> np.ndarray:
    """Train ``nlist`` centroids with Spark ML KMeans on a seeded sample of all shards."""
    data = reps if sample_fraction >= 1.0 else reps.sample(fraction=sample_fraction, seed=seed)
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="features").fit(_to_vec(data))
    return np.asarray(model.clusterCenters(), dtype=np.float64)


def _top_cells(df: DataFrame, centroids: np.ndarray, nprobe: int, id_col: str, rep: str) -> DataFrame:
    """(id, rep, cells): the ``nprobe`` nearest centroids of each vector, nearest first."""
    bc = df.sparkSession.sparkContext.broadcast(centroids)
    nprobe = min(int(nprobe), centroids.shape[0])

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        return pd.Series(list(_nearest(_matrix(v), bc.value, nprobe).astype(np.int32)) if len(v) else [], dtype=object)

    return df.where(usable(rep)).select(F.col(id_col).alias("id"), F.col(rep).alias("rep"), cells(rep).alias("cells"))


def ivf_assign(reps: DataFrame, centroids: np.ndarray, id_col: str = "id", rep: str = "rep") -> DataFrame:
    """Index side, stored: each vector in the cell of its nearest centroid."""
    return materialize(_top_cells(reps, centroids, 1, id_col, rep).select("id", "rep", F.element_at("cells", 1).alias("cell")), "ivf_cells")


def ivf_probes(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """Stored (qid, rep, cells) of a search."""
    return materialize(_top_cells(queries, centroids, nprobe, "id", "rep").withColumnRenamed("id", "qid"), "ivf_probes")


def ivf_search(queries: DataFrame, index_cells: DataFrame, centroids: np.ndarray, k: int = 10, nprobe: int = 1,
               **kw) -> DataFrame:
    """V7: probe the ``nprobe`` nearest cells per query; ``nprobe = nlist`` is exact."""
    return probe_search(ivf_probes(queries, centroids, nprobe), index_cells, k, **kw)


# ---------------------------------------------------------------- PQ (V8)

def pq_fit(reps: DataFrame, m: int, ks: int = 256, seed: int = 42, max_iter: int = 20,
           sample_fraction: float = 1.0) -> list[np.ndarray]:
    """One KMeans codebook per sub-vector (``m`` equal slices of the dimension)."""
    data = reps if sample_fraction >= 1.0 else reps.sample(fraction=sample_fraction, seed=seed)
    data = data.where(usable("rep"))
    dim = len(data.select("rep").first()[0])
    if dim % m:
        raise ValueError("dimension must be divisible by m")
    sub = dim // m
    books = []
    for j in range(m):
        part = data.select(F.slice("rep", j * sub + 1, sub).alias("rep"))
        books.append(ivf_fit(part, ks, seed=seed + j, max_iter=max_iter))
    return books


def pq_books(vectors: np.ndarray, m: int) -> list[np.ndarray]:
    """Codebooks cut from given vectors: the j-th holds the j-th slice of each."""
    if vectors.shape[1] % m:
        raise ValueError("dimension must be divisible by m")
    return np.split(vectors, m, axis=1)


def pq_encode(reps: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """All columns but ``rep``, and codes ARRAY<INT>: the nearest (L2) centroid of each sub-vector."""
    bc = reps.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<int>")
    def codes(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        parts = np.split(_matrix(v), len(bc.value), axis=1)
        best = [_nearest(X, C, 1)[:, 0] for X, C in zip(parts, bc.value)]
        return pd.Series(list(np.stack(best, 1).astype(np.int32)))

    keep = [c for c in reps.columns if c != "rep"]
    return reps.where(usable("rep")).select(*keep, codes("rep").alias("codes"))


def pq_decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, rep): the concatenated centroids of each code."""
    bc = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<double>")
    def decode(c: pd.Series) -> pd.Series:
        if len(c) == 0:
            return pd.Series([], dtype=object)
        at = np.stack([np.asarray(x) for x in c])
        return pd.Series(list(np.concatenate([B[at[:, j]] for j, B in enumerate(bc.value)], axis=1)))

    return codes.select("id", decode("codes").alias("rep"))


def pq_scorer(spark, books: list[np.ndarray], metric: str = "ip"):
    """Asymmetric score of a block of codes: that of the query and the decoded vector, minus the squared distance for ``l2``."""
    from nearline.operators.quantize import metric_of

    block, _ = metric_of(metric)
    bc = spark.sparkContext.broadcast(books)
    return CodeScorer(lambda codes: np.concatenate([C[codes[:, j]] for j, C in enumerate(bc.value)], axis=1), block)


def pq_search(queries: DataFrame, codes: DataFrame, books: list[np.ndarray], k: int = 10, metric: str = "ip", **kw) -> DataFrame:
    """V8: asymmetric-distance search; only codes are stored, moved and scored."""
    return knn_exact(queries, codes, k=k, d_vec="codes", score=pq_scorer(queries.sparkSession, books, metric), **kw)


def ivf_pq_search(queries: DataFrame, index_cells: DataFrame, centroids: np.ndarray, books: list[np.ndarray],
                  k: int = 10, nprobe: int = 1, **kw) -> DataFrame:
    """PQ codes inside IVF cells; ``index_cells(id, codes, cell)`` comes from ``pq_encode(ivf_assign(...))``."""
    return ivf_search(queries, index_cells, centroids, k, nprobe, d_col="codes",
                      score=pq_scorer(queries.sparkSession, books), **kw)


# ---------------------------------------------------------------- recall (V7, V8)

def rerank(run: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 10, decimals: int | None = None,
           block: int = 8192, rows: int = 16384, score=None) -> DataFrame:
    """The candidates of a run scored by their own vectors; the top k of each query.

    ``score(A, B)`` gives the score of each row of A with that of B (the inner product unless given).

    Documents are dealt into blocks of about ``block`` vectors.  A query's vector is sent once
    for each block that holds candidates of it, with their list, so what moves
    grows with queries times the blocks they touch (at most the run's depth).  A
    block that more than ``rows`` queries touch, such as one of a document that all find, is
    split by query and its vectors are sent once for each part.
    """
    queries, corpus = (df.where(usable("rep")).select("id", "rep") for df in (queries, corpus))
    count = max(1, -(-corpus.count() // block))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    lists = materialize(run.groupBy("qid", at("docid").alias("y")).agg(F.collect_list("docid").alias("ds")), "rerank_lists")
    parts = lists.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("nz"))
    q = (lists.join(queries.select(F.col("id").alias("qid"), "rep"), "qid").join(parts, "y")
         .withColumn("z", F.pmod(F.xxhash64("qid"), F.col("nz")).cast("int")).select("y", "z", "qid", "ds", F.col("rep").alias("qv")))
    d = (corpus.withColumn("y", at("id")).join(parts, "y")
         .withColumn("z", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)))
         .select(F.col("y").alias("dy"), F.col("z").alias("dz"), F.col("id").alias("did"), F.col("rep").alias("dv")))
    schema = run_schema(queries, "id", corpus, "id")

    by_row = score or (lambda A, B: np.einsum("ij,ij->i", A, B))

    def score_block(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"qid": q["qid"][:0], "docid": d["did"][:0], "score": np.zeros(0)})
        Q, D, ids = _matrix(q["qv"]), _matrix(d["dv"]), pd.Index(d["did"])
        sizes = q["ds"].map(len).to_numpy()
        a = np.repeat(np.arange(len(q)), sizes)
        docs = np.concatenate([np.asarray(x) for x in q["ds"]])
        b, first = ids.get_indexer(docs), 1 << 16
        got = np.concatenate([by_row(Q[a[lo:lo + first]], D[b[lo:lo + first]]) for lo in range(0, len(a), first)])
        ok = b >= 0
        got = got if decimals is None else np.round(got, decimals) + 0.0
        return pd.DataFrame({"qid": q["qid"].to_numpy()[a[ok]], "docid": docs[ok], "score": got[ok]})

    out = q.groupBy("y", "z").cogroup(d.groupBy("dy", "dz")).applyInPandas(score_block, schema)
    return rank_results(out, k).select("qid", "docid", "rank", "score")


#: Queries that are scored with whole groups of candidates at a time.
CAND_QUERIES = 512


def _reranking_scorer(depth: int, k: int, decimals: int | None, score, block):
    """Kernel of ``probe_rerank``: documents have codes (v), vectors and cells."""
    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return empty_run(q, d)
        d = id_order(d)
        q_ids, d_ids, cells = whole(q.column("i")), whole(d.column("i")), whole(q.column("cells"))
        held = whole(d.column("cell")).to_numpy(zero_copy_only=False)
        places = np.argsort(held, kind="stable")  # by cell, then id
        homes, n = np.unique(held), len(places)
        cuts = np.r_[np.searchsorted(held[places], homes), n]
        Q, X = matrix(whole(q.column("v"))).astype(np.float64), matrix(whole(d.column("vector"))).astype(np.float64)[places]
        asked, ends = cells.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))]
        choose = n > depth  # else every document is a candidate, whatever its codes
        if choose:
            by_code, D = decoded(score, matrix(whole(d.column("v")))[places])
            column = np.argsort(places)
            odd = not (np.isfinite(Q).all() and np.isfinite(D).all())
        best, step = BestRows(len(Q), k, decimals), max(1, SCORE_CELLS // n) if choose else max(1, min(CAND_QUERIES, SCORE_CELLS // k))
        for lo in range(0, len(Q), step):
            rows = np.arange(lo, min(len(Q), lo + step))
            mine, of = asked[ends[lo]:ends[rows[-1] + 1]], np.repeat(rows - lo, np.diff(ends[lo:rows[-1] + 2]))
            home = np.minimum(np.searchsorted(homes, mine), len(homes) - 1)
            ok = homes[home] == mine
            asks = np.zeros((len(rows), len(homes)), dtype=bool)
            asks[of[ok], home[ok]] = True
            allowed = None
            if choose:
                S = np.full((len(rows), n), -np.inf)
                for h, some in enumerate(asks.T):
                    part = slice(cuts[h], cuts[h + 1])
                    if some.all():
                        S[:, part] = by_code(Q[rows], D[part])
                    elif some.any():
                        S[some, part] = by_code(Q[rows[some]], D[part])
                if odd:
                    S[np.isnan(S)] = np.finfo(np.float64).min
                least = np.partition(S, n - depth, axis=1)[:, n - depth]  # score of the last candidate
                room, last = depth - (S > least[:, None]).sum(1), np.full(len(rows), n)
                ties = S == least[:, None]
                for r in np.flatnonzero((ties.sum(1) > room) & (least > -np.inf)):  # of equal scores the smaller places
                    last[r] = np.partition(places[ties[r]], room[r] - 1)[room[r] - 1]

                def allowed(r: np.ndarray, at: np.ndarray, S=S, least=least, last=last, lo=lo) -> np.ndarray:
                    s, r = S[r - lo, column[at]], r - lo
                    return (s > least[r]) | ((s == least[r]) & (at <= last[r]))
            for h, some in enumerate(asks.T):
                if some.any():
                    part = slice(cuts[h], cuts[h + 1])
                    best.meet(rows[some], Q[rows[some]], places[part], X[part], block, allowed)
        return best.table(q_ids, d_ids)

    return run


def with_vector(reps: DataFrame) -> DataFrame:
    """``reps`` with its vectors once more, as ``vector``, which an encoder keeps beside the codes."""
    return reps.withColumn("vector", F.col("rep"))


def probe_rerank(probes: DataFrame, index: DataFrame, depth: int, k: int = 10, decimals: int | None = None,
                 score=inner_product, by_row=None, block=None) -> DataFrame:
    """Candidates by codes, scored again by their own vectors, in one step: no list of candidates leaves a task.

    ``probes(qid, rep, cells)`` and ``index(id, codes, cell, vector)`` as in ``probe_search``.  Of each group of documents the best ``depth`` of a query's cells are
    scored again, so these are all of the best ``depth`` of the table, and more where there are several groups.
    ``block(Q, X)`` scores all pairs (the inner product unless given); ``by_row(A, B)``, if it alone is given, rows one by one.
    Where a group holds more than ``depth`` documents, a pair is scored by codes and by vectors, both as blocks.
    """
    if block is None:
        block = inner_product if by_row is None else lambda Q, X: np.stack([by_row(np.broadcast_to(q, X.shape), X) for q in Q])
    return probe_search(probes, index, k, decimals=decimals, d_col="codes", kernel=_reranking_scorer(depth, k, decimals, score, block), extra=("vector",))


def exact_sample(queries: DataFrame, corpus: DataFrame, k: int = 10, rows: int = 200, score=inner_product) -> tuple[DataFrame, DataFrame]:
    """``rows`` queries (those of least id hash), and their exact top k (qid, docid); both stored."""
    some = materialize(queries.where(usable("rep")).orderBy(F.xxhash64("id"), "id").limit(rows), "recall-queries")
    return some, materialize(knn_exact(some, corpus, k=k, score=score).select("qid", "docid"), "recall-exact")


def probes_for(recall: float, sample: DataFrame, exact: DataFrame, index_cells: DataFrame, centroids: np.ndarray) -> int:
    """The fewest cells to probe so that they hold a share ``recall`` of the sampled queries' exact neighbours."""
    bc = sample.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        return pd.Series(list(_nearest(_matrix(v), bc.value, len(bc.value)).astype(np.int32)) if len(v) else [], dtype=object)

    near = sample.select(F.col("id").alias("qid"), F.posexplode(cells("rep")).alias("near", "cell"))
    home = index_cells.select(F.col("id").alias("docid"), "cell")
    found = exact.join(home, "docid").join(near, ["qid", "cell"]).groupBy("near").count().collect()
    counts = np.zeros(len(centroids))
    for r in found:
        counts[r["near"]] = r["count"]
    held = np.cumsum(counts)
    return int(np.searchsorted(held, recall * held[-1])) + 1 if held[-1] else len(centroids)


def depth_for(recall: float, exact: DataFrame, search: Callable[[int], DataFrame], most: int, k: int = 10) -> int:
    """The least k, 2k, 4k ... whose candidates hold a share ``recall`` of the exact neighbours; ``most`` if none does.

    ``search(depth)`` returns the sampled queries' candidates.
    """
    wanted, depth = recall * exact.count(), k
    while depth < most and search(depth).join(exact, ["qid", "docid"], "left_semi").count() < wanted:
        depth *= 2
    return min(depth, most)


#: Decimals to which code scores are compared where they were computed in blocks of different shapes.
RANK_DECIMALS = 9


def depth_by_rank(recall: float, sample: DataFrame, exact: DataFrame, index: DataFrame, score, k: int = 10, probes: DataFrame | None = None) -> int:
    """``depth_for`` of a search by codes, from the ranks of the exact neighbours: no list of candidates is made.

    ``index(id, codes)`` is read twice.  First the scores of the exact neighbours (at most k a sampled
    query, so they and the sample are sent to the tasks), then for each how many rows of the index precede it.
    With ``probes(qid, rep, cells)`` only those of ``index(id, codes, cell)`` in a query's cells are candidates.
    """
    spark = index.sparkSession
    wanted, rows = recall * exact.count(), sample.where(usable("rep") & F.col("id").isNotNull()).select("id", "rep").collect()
    cells = {r["qid"]: list(r["cells"]) for r in probes.select("qid", "cells").collect()} if probes is not None else None
    of: dict = {}
    for n, r in enumerate(rows):
        of.setdefault(r["id"], []).append(n)
    asked: dict = {}
    for r in exact.where(F.col("docid").isNotNull()).distinct().collect():
        if r["qid"] in of:
            asked.setdefault(r["docid"], []).append(r["qid"])
    most = index.count()
    Q = np.asarray([r["rep"] for r in rows], dtype=np.float64)
    sent = spark.sparkContext.broadcast((Q, None if cells is None else [cells[r["id"]] for r in rows]))
    index = index.select("id", "codes", *(["cell"] if cells is not None else []))
    kind = index.schema["id"].dataType.simpleString()

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        """(sampled queries, rows of the batch): minus infinity where a query does not probe the row's cell."""
        Q, probed = sent.value
        S = np.round(score(Q, matrix(batch.column("codes"))), RANK_DECIMALS)
        if probed is not None:
            held = batch.column("cell").to_numpy(zero_copy_only=False)
            for row, some in zip(S, probed):
                row[~np.isin(held, some)] = -np.inf
        return S

    def own(batches):
        for b in batches:
            if b.num_rows:
                S = scores(b)
                found = {(q, doc, float(s)) for at, doc in enumerate(b.column("id").to_pylist()) for q in asked.get(doc, ()) for s in S[of[q], at] if s > -np.inf}
                if found:
                    q, doc, s = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([of[x][0] for x in q], pa.int32()), pa.array(doc, b.schema.field("id").type), pa.array(s, pa.float64())], ["q", "doc", "s"])

    items = sorted({(r["q"], r["s"], r["doc"]) for r in index.where(F.col("id").isin(list(asked))).mapInArrow(own, f"q int, doc {kind}, s double").collect()})
    if not items:
        return min(k, most) if wanted <= 0 else most
    mates = {lines[0]: lines for lines in of.values()}

    def precede(batches):
        above, same = np.zeros(len(items), dtype=np.int64), np.zeros(len(items), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                S, ids = scores(b), b.column("id")
                for n, (q, s, doc) in enumerate(items):
                    for row in S[mates[q]]:
                        above[n] += np.count_nonzero(row > s)
                        tie = np.flatnonzero(row == s)
                        if len(tie):
                            mine, doc_ = ids.take(pa.array(tie)), pa.scalar(doc, ids.type)
                            above[n] += pc.sum(pc.less(mine, doc_)).as_py() or 0
                            same[n] += pc.sum(pc.equal(mine, doc_)).as_py() or 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(items)), pa.int32()), pa.array(above), pa.array(same)], ["n", "above", "same"])

    ranks = index.mapInArrow(precede, "n int, above long, same long").groupBy("n").agg(F.sum("above").alias("above"), F.sum("same").alias("same")).collect()
    above, same = (np.array([r[c] for r in ranks]) for c in ("above", "same"))
    depth = k
    while depth < most and np.clip(depth - above, 0, same).sum() < wanted:
        depth *= 2
    return min(depth, most)


# ---------------------------------------------------------------- PCA (V9)

def pca_fit(reps: DataFrame, dim: int):
    return PCA(k=dim, inputCol="features", outputCol="pca").fit(_to_vec(reps))


def pca_reduce(reps: DataFrame, model) -> DataFrame:
    """V9: (id, rep) projected on the fitted principal components."""
    out = model.transform(_to_vec(reps))
    return out.select("id", vector_to_array("pca").alias("rep"))


# ---------------------------------------------------------------- LSH

@dataclass(frozen=True)
class Projections:
    """One hash table per row of ``planes``: bucket = floor((plane . x + offset) / width).

    ``multiprobe.probing_fit`` fits tables of several planes instead.
    """

    planes: np.ndarray
    offsets: np.ndarray
    width: float


def _lsh_keys(df: DataFrame, model: Projections, id_name: str) -> DataFrame:
    """Stored (id, rep, keys): the bucket of each table."""
    bc = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<bigint>")
    def buckets(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        m = bc.value
        return pd.Series(list(np.floor((_matrix(v) @ m.planes.T + m.offsets) / m.width).astype(np.int64)))

    h = df.where(usable("rep")).select(F.col("id").alias(id_name), "rep", buckets("rep").alias("b"))
    return materialize(h.select(id_name, "rep", F.transform("b", lambda b: F.array(F.array(b))).alias("keys")), "lsh_keys")


def lsh_search(queries: DataFrame, corpus: DataFrame, model: Projections, k: int = 10, **kw) -> DataFrame:
    """Candidates share a bucket in at least one hash table (unit vectors:
    L2 order equals inner-product order); scored exactly, each candidate once."""
    return bucket_search(_lsh_keys(queries, model, "qid"), _lsh_keys(corpus, model, "id"), k, len(model.planes), **kw)
