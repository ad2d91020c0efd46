"""Inner-product search and ranking.

Exact top-k never materialises query x document rows.  Shards of about
``shard_rows`` vectors are dealt into groups of at most about 65,536, the queries into
groups too, and each (document group, query group) pair is one task's work: it
scores ``query_block`` queries at a time by numpy matrix products, keeps a
running top-k per query and emits only that.  So a query is sent, and gives k
rows, once for each group and not for each shard.  The merge is a
``row_number() <= k`` window, which Spark plans as a ``WindowGroupLimit`` that
already trims each task's output before the shuffle.

The pairs are dealt out with an explicit partition count, which adaptive
execution leaves alone: the groups are few and small in bytes, but each pair
stands for a matrix product.  With few document groups the queries are split
into more groups, so that all cores have work.

Ids may have any orderable type; kernels rank on positions in id order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearline.session import materialize


def rank_results(cands: DataFrame, k: int, qid: str = "qid", docid: str = "docid",
                 score: str = "score") -> DataFrame:
    """V5: rank 1..k per query by score descending, docid ascending on ties."""
    w = Window.partitionBy(qid).orderBy(F.col(score).desc(), F.col(docid).asc())
    return (cands.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= k))


def _count(df: DataFrame) -> int:
    return int(df.count())


def usable(vec: str) -> Column:
    """Rows that take part in a search: a vector without null components."""
    return F.col(vec).isNotNull() & ~F.coalesce(F.exists(F.col(vec), lambda x: x.isNull()), F.lit(False))


def run_schema(q: DataFrame, q_id: str, d: DataFrame, d_id: str) -> str:
    """Schema of candidate rows, with the id types of both sides."""
    return f"qid {q.schema[q_id].dataType.simpleString()}, docid {d.schema[d_id].dataType.simpleString()}, score double"


def _pack(df: DataFrame, key, id_col: str, vec_col: str, prefix: str) -> DataFrame:
    """One row per key: ids and the row-major flattened vectors of that key."""
    keys = [key] if isinstance(key, str) else list(key)
    g = df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(id_col).alias("i"),
                                                      F.col(vec_col).alias("v"))).alias("m"))
    return g.select(*keys,
                    F.transform("m", lambda s: s["i"]).alias(f"{prefix}_ids"),
                    F.flatten(F.transform("m", lambda s: s["v"])).alias(f"{prefix}_flat"))


def _topk_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the best k per row; equal scores go by column, which is id order."""
    m = scores.shape[1]
    if m <= k or np.isnan(scores).any():
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    out = np.empty((scores.shape[0], k), dtype=np.int64)
    part = np.partition(-scores, k - 1, axis=1)[:, k - 1]
    for r, s in enumerate(scores):
        t = -part[r]
        above = np.flatnonzero(s > t)
        out[r] = np.concatenate([above, np.flatnonzero(s == t)[:k - above.size]])
    return out


def inner_product(Q: np.ndarray, D: np.ndarray) -> np.ndarray:
    return Q @ D.T


class CodeScorer:
    """``score`` of the vectors that codes stand for: a block of documents is decoded once and multiplied, whatever the number of slices."""

    def __init__(self, decode, score):
        self.decode, self.score = decode, score

    def __call__(self, Q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.score(Q, self.decode(codes))


def decoded(score, D: np.ndarray):
    """``score`` and documents, those of a ``CodeScorer`` as vectors."""
    return (score.score, score.decode(D)) if isinstance(score, CodeScorer) else (score, D)


def top_pairs(qi: np.ndarray, Q: np.ndarray, di: np.ndarray, flat: np.ndarray, k: int, decimals: int | None,
              score=inner_product) -> pd.DataFrame:
    """Top-k (qid, docid, score) of each query row of ``Q`` among the documents of one block."""
    order = np.argsort(di, kind="stable")
    di = di[order]
    D = flat.reshape(di.size, -1)[order]
    S = score(Q, D if D.dtype.kind in "iu" else D.astype(np.float64))
    if decimals is not None:
        S = np.round(S, decimals) + 0.0  # no negative zero
    idx = _topk_rows(S, k)
    rows = np.repeat(np.arange(qi.size), idx.shape[1])
    cols = idx.reshape(-1)
    return pd.DataFrame({"qid": qi[rows], "docid": di[cols], "score": S[rows, cols]})


def block_scorer(k: int, decimals: int | None, score=inner_product):
    """Kernel over rows (q_ids, q_flat, d_ids, d_flat): the local top-k of each query of each pair.

    ``score(Q, D)`` returns the (queries x documents) matrix of a pair.
    """
    def run(it):
        for pdf in it:
            for q_ids, q_flat, d_ids, d_flat in zip(pdf["q_ids"], pdf["q_flat"], pdf["d_ids"], pdf["d_flat"]):
                qi = np.asarray(q_ids)
                Q = np.asarray(q_flat, dtype=np.float64).reshape(qi.size, -1)
                yield top_pairs(qi, Q, np.asarray(d_ids), np.asarray(d_flat), k, decimals, score)
    return run


def _stored_shards(d: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """Number the blocks of stored shards (column ``s``): a shard above ``shard_rows`` rows is split.

    Only one row per stored shard reaches the driver.
    """
    sizes = sorted((r[0], r[1]) for r in d.groupBy("s").agg(F.count(F.lit(1))).collect())
    blocks = [math.ceil(n / shard_rows) for _, n in sizes]
    starts = np.cumsum([0, *blocks]).tolist()
    info = d.sparkSession.createDataFrame([(s, b, at) for (s, _), b, at in zip(sizes, blocks, starts)],
                                          "s int, nb int, at int")
    d = d.join(info, "s").withColumn("s", (F.col("at") + F.pmod(F.xxhash64("i"), F.col("nb"))).cast("int"))
    return d.select("s", "i", "v"), starts[-1]


#: Documents, or queries, of a group: a task holds one group of each.
GROUP_ROWS = 65_536
#: Queries that are worth a task of their own.
TASK_QUERIES = 1024
#: Scores that a task holds at once, and least documents of a group; a fourth of these give a query its first k-th score.
SCORE_CELLS, FIRST_DOCS = 1 << 21, 4096


class BestRows:
    """The best ``k`` documents (by position) of each of ``n`` queries so far; equal scores go to the smaller position."""

    def __init__(self, n: int, k: int, decimals: int | None):
        self.k, self.decimals = k, decimals
        self.slack = 0.0 if decimals is None else 10.0 ** -decimals
        self.scores, self.places = np.full((n, k), -np.inf), np.full((n, k), -1, dtype=np.int64)
        self.floor = np.full(n, -np.inf)

    def _rounded(self, s: np.ndarray) -> np.ndarray:
        return s if self.decimals is None else np.round(s, self.decimals) + 0.0  # no negative zero

    def meet(self, rows: np.ndarray, Q: np.ndarray, places: np.ndarray, D: np.ndarray, score, allowed=None) -> None:
        """Score the queries ``rows`` with documents in order of place; only what can enter a top k is kept.

        ``allowed(rows, places)``, arrays of one shape or shapes that broadcast, tells which pairs count; asked for those that could enter.
        """
        lo = 0
        while lo < len(D) and len(rows):
            fresh = np.flatnonzero(self.places[rows, -1] < 0)
            wide = max(self.k, SCORE_CELLS // len(rows))
            part = slice(lo, lo + (min(wide, max(FIRST_DOCS // 4, 2 * self.k)) if len(fresh) else wide))
            S, at = score(Q, D[part]), places[part]
            if len(fresh):  # fewer than k documents so far: the best k of these
                first = self._rounded(S[fresh])
                counts = None if allowed is None else allowed(rows[fresh][:, None], at[None, :])
                if counts is not None:
                    first[~counts] = -np.inf
                idx = _topk_rows(first, self.k)
                ok = slice(None) if counts is None else np.take_along_axis(counts, idx, axis=1).ravel()
                self._add(np.repeat(rows[fresh], idx.shape[1])[ok], at[idx.ravel()][ok], np.take_along_axis(first, idx, axis=1).ravel()[ok])
            hits = S < self.floor[rows][:, None]
            np.logical_not(hits, out=hits)
            hits[fresh] = False
            r, c = np.divmod(np.flatnonzero(hits), hits.shape[1])
            if allowed is not None and len(r):
                ok = allowed(rows[r], at[c])
                r, c = r[ok], c[ok]
            if len(r):
                self._add(rows[r], at[c], self._rounded(S[r, c]))
            lo = part.stop

    def _add(self, rows: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
        u, inv = np.unique(rows, return_inverse=True)
        R = np.concatenate([np.repeat(np.arange(len(u)), self.k), inv])
        P, S = np.concatenate([self.places[u].ravel(), places]), np.concatenate([self.scores[u].ravel(), scores])
        order = np.lexsort((P, -S, P < 0, R))
        R = R[order]
        order = order[np.arange(len(R)) - np.searchsorted(R, R) < self.k]
        self.places[u], self.scores[u] = P[order].reshape(-1, self.k), S[order].reshape(-1, self.k)
        self.floor[u] = np.where(self.places[u, -1] >= 0, self.scores[u, -1] - self.slack, -np.inf)

    def table(self, q_ids: pa.Array, d_ids: pa.Array) -> pa.Table:
        row, col = np.nonzero(self.places >= 0)
        return pa.table({"qid": q_ids.take(pa.array(row)), "docid": d_ids.take(pa.array(self.places[row, col])),
                         "score": pa.array(self.scores[row, col])})


def whole(column: pa.ChunkedArray) -> pa.Array:
    chunks = column.combine_chunks()
    return pa.concat_arrays(chunks.chunks) if isinstance(chunks, pa.ChunkedArray) else chunks


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column; components that are not integers as doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return (flat if flat.dtype.kind in "iu" else flat.astype(np.float64)).reshape(len(vectors), -1)


def id_order(t: pa.Table, col: str = "i") -> pa.Table:
    """Rows in order of their ids, as Spark orders them."""
    return t.take(pc.sort_indices(whole(t.column(col)), null_placement="at_start")) if t.num_rows else t


def empty_run(q: pa.Table, d: pa.Table) -> pa.Table:
    return pa.table({"qid": whole(q.column("i"))[:0], "docid": whole(d.column("i"))[:0], "score": pa.array([], pa.float64())})


def _group_scorer(k: int, decimals: int | None, query_block: int, score):
    """Kernel over a group of queries and one of documents (i, v): the best k of each query."""
    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return empty_run(q, d)
        d = id_order(d)
        q_ids, d_ids = whole(q.column("i")), whole(d.column("i"))
        Q, places = matrix(whole(q.column("v"))).astype(np.float64), np.arange(d.num_rows)
        by_block, D = decoded(score, matrix(whole(d.column("v"))))
        best = BestRows(len(Q), k, decimals)
        block = min(query_block, max(1, SCORE_CELLS // k))
        for lo in range(0, len(Q), block):
            rows = np.arange(lo, min(len(Q), lo + block))
            best.meet(rows, Q[rows], places, D, by_block)
        return best.table(q_ids, d_ids)

    return run


def document_groups(n_d: int, parts: int) -> int:
    """Groups of documents: none above ``GROUP_ROWS``, and about as many as the query groups of as many tasks."""
    return max(1, -(-n_d // GROUP_ROWS), min(math.ceil(math.sqrt(2 * parts)), -(-n_d // FIRST_DOCS)))


def query_groups(n_q: int, d_groups: int, parts: int) -> int:
    """Groups of queries: none above ``GROUP_ROWS``, and enough tasks unless the queries are few."""
    return max(1, -(-n_q // GROUP_ROWS), min(-(-2 * parts // d_groups), -(-n_q // TASK_QUERIES)))


def meet_groups(q: DataFrame, d: DataFrame, d_groups: int, q_groups: int, kernel, schema: str) -> DataFrame:
    """Rows of ``kernel(queries, documents)`` for each (dg, qg) of ``q(dg, qg, ...)``; ``d(dg, ...)`` goes to every query group."""
    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))))
    # The explicit count keeps the few groups, each a matrix product, in many tasks.
    n = max(parts, min(2 * d_groups * q_groups, 4 * parts))
    keys = ["dg", "qg"]
    pairs = q.repartition(n, *keys).groupBy(*keys).cogroup(d.repartition(n, *keys).groupBy(*keys))
    return pairs.applyInArrow(kernel, schema)


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int = 1000, q_id: str = "id",
              q_vec: str = "rep", d_id: str = "id", d_vec: str = "rep",
              query_block: int = 1024, shard_rows: int = 4096, shard_col: str | None = None,
              num_shards: int | None = None, decimals: int | None = None, score=inner_product) -> DataFrame:
    """V2: exact inner-product top-k -> run(qid, docid, rank, score), ids in their own types.

    ``min(k, n)`` rows per query; equal scores go to the smaller document id.
    ``decimals`` rounds scores before ranking (off unless asked for).  A null
    vector, or one with a null component, takes no part.  With ``shard_col`` a
    document without a shard raises.  Shards are dealt whole into groups of at most about
    ``GROUP_ROWS`` documents, and a query is sent once for each group.
    """
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = run_schema(queries, q_id, corpus, d_id)
    q = queries.where(usable(q_vec)).select(F.col(q_id).alias("i"), F.col(q_vec).alias("v"))
    n_d = _count(corpus.select(d_id))
    if shard_col is None:
        num_shards = num_shards or max(1, math.ceil(n_d / shard_rows))
        d = corpus.where(usable(d_vec)).select(F.col(d_id).alias("i"), F.col(d_vec).alias("v"))
        d = d.withColumn("s", F.pmod(F.xxhash64("i"), F.lit(num_shards)).cast("int"))
    else:
        stray = F.raise_error(F.concat(F.lit("no shard for document "), F.col(d_id).cast("string")))
        shard = F.col(shard_col).cast("int")
        outside = shard.isNull() | (shard < 0)
        if num_shards is not None:
            outside = outside | (shard >= num_shards)
        d = corpus.withColumn("_nl_s", F.when(outside, stray.cast("int")).otherwise(shard)).where(usable(d_vec))
        d, num_shards = _stored_shards(
            d.select(F.col("_nl_s").alias("s"), F.col(d_id).alias("i"), F.col(d_vec).alias("v")), shard_rows)
        num_shards = max(1, num_shards)
    n_q = _count(queries.select(q_id))
    d_groups = min(num_shards, document_groups(n_d, parts))
    q_groups = query_groups(n_q, d_groups, parts)
    q = q.withColumn("qg", F.pmod(F.xxhash64("i"), F.lit(q_groups)).cast("int"))
    q = q.withColumn("dg", F.explode(F.sequence(F.lit(0), F.lit(d_groups - 1))))
    d = d.withColumn("dg", F.pmod(F.col("s"), F.lit(d_groups))).select("dg", "i", "v")
    local = meet_groups(q, d, d_groups, q_groups, _group_scorer(k, decimals, query_block, score), schema)
    return rank_results(local, k).select("qid", "docid", "rank", "score")


def knn_batched(queries: DataFrame, corpus: DataFrame, k: int = 1000, query_block: int = 128, **kw) -> DataFrame:
    """V3: same result as V2 with memory bounded by ``query_block`` queries per task."""
    return knn_exact(queries, corpus, k=k, query_block=query_block, **kw)


def knn_sharded(queries: DataFrame, corpus: DataFrame, k: int = 1000, shard_col: str = "shard", **kw) -> DataFrame:
    """V4: top-k inside each stored shard, then merged; equals V2."""
    return knn_exact(queries, corpus, k=k, shard_col=shard_col, **kw)


def rounded(score: Column, decimals: int | None) -> Column:
    return score if decimals is None else F.round(score, decimals)


def knn_sparse(q_sparse: DataFrame, d_sparse: DataFrame, k: int = 1000, decimals: int | None = None) -> DataFrame:
    """V6: sparse dot product on postings (id, term_id, weight).

    An equi-join on ``term_id``: each query term meets that term's postings.  The
    query side is small in practice and AQE turns the join into a broadcast when
    its measured size allows; otherwise the skew-join split handles hot terms.
    """
    q = q_sparse.select(F.col("id").alias("qid"), "term_id", F.col("weight").alias("qw"))
    d = d_sparse.select(F.col("id").alias("docid"), "term_id", F.col("weight").alias("dw"))
    scores = (q.join(d, "term_id").groupBy("qid", "docid")
              .agg(rounded(F.sum(F.col("qw") * F.col("dw")), decimals).alias("score")))
    return rank_results(scores, k).select("qid", "docid", "rank", "score")


def sparse_blocks(d_sparse: DataFrame, range_docs: int = 256, buckets: int = 16, path: str | None = None):
    """V6: sparse vectors (id, term_id, weight) as posting blocks, in order of their largest weight."""
    from nearline.operators.postings import blocks_of, pack_documents

    weights = d_sparse.select(F.col("id").alias("doc"), F.col("term_id").alias("term"), F.col("weight").alias("w"))
    packed = materialize(pack_documents(weights), "sparse_documents")
    return blocks_of(packed, packed.groupBy("doc").agg(F.max(F.array_max("ws")).alias("key")), range_docs, buckets, path)


def knn_sparse_blocks(q_sparse: DataFrame, blocks, k: int = 1000, decimals: int | None = None, **kw) -> DataFrame:
    """V6 on posting blocks: the run of ``knn_sparse``, reading only blocks that can reach the top k."""
    from nearline.operators.postings import search_blocks

    q = q_sparse.select(F.col("id").alias("qid"), F.col("term_id").alias("term"), F.col("weight").alias("qw"))
    return search_blocks(q, blocks, k, decimals=decimals, **kw)


def add_vectors(index: DataFrame, new: DataFrame) -> DataFrame:
    """Append vectors to an index (same columns, by name)."""
    return index.unionByName(new)


def stringify_ids(run: DataFrame, cols=("qid", "docid")) -> DataFrame:
    """Ids as strings."""
    for c in cols:
        run = run.withColumn(c, F.col(c).cast(T.StringType()))
    return run


def assign_hash_shards(df: DataFrame, key: str, shard_rows: int = 4096, num_shards: int | None = None,
                       shard_col: str = "shard") -> DataFrame:
    """Hash shards of about ``shard_rows`` rows each (count taken once if not given)."""
    if num_shards is None:
        num_shards = max(1, math.ceil(_count(df) / shard_rows))
    return df.withColumn(shard_col, F.pmod(F.xxhash64(F.col(key)), F.lit(int(num_shards))).cast("int"))
