"""Exact top-k inner products with block-at-a-time pruning.

Vectors are integer rows whose components play the part of terms.  Documents are
put in range order of a sign code and their id, and cut into blocks; a block
keeps the maximum and the minimum of each term beside its rows (its forward
index).  For a query the sum over terms of the larger of weight * maximum and
weight * minimum bounds every score in the block.  The block of highest bound is
scored first; the others follow in falling order of the highest bound that any
query of the group has there, for the queries whose bound is not below the k-th
score found so far.

A task holds one slab (some blocks) and one group of queries at a time, carries
their k-th scores from slab to slab of a cell, and returns k rows per query and
cell; the rest is a top-k by rank over cells.  Query groups are dealt to a
fixed number of cells, so nothing is broadcast and no side is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SLAB, QUERIES = 128, 4096, 1024
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id long, dim int, v array<long>) of the rows that take part: floor(scale * x), x as double."""
    x = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    return rows.select("id", F.size("x").alias("dim"), F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _packed(limit: int):
    """mapInArrow function: rows of one dimension, in order, as packed matrices of at most ``limit`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(dims)) + 1, len(dims)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                for a in range(int(lo), int(hi), limit):
                    part = batch.slice(a, min(limit, int(hi) - a))
                    ids = part.column("id").to_numpy()
                    v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    small = not len(v) or np.abs(v.astype(np.float64)).max() < 2**31 - 1
                    yield pa.RecordBatch.from_pydict({
                        "dim": pa.array([int(dims[lo])], pa.int32()), "first": pa.array([int(ids[0])], pa.int64()),
                        "ids": pa.array([ids.tobytes()], pa.binary()), "wide": pa.array([not small]),
                        "rows": pa.array([(v.astype(np.int32) if small else v).tobytes()], pa.binary())})
    return run


PACKED = "dim int, first long, ids binary, wide boolean, rows binary"


def _matrix(raw: bytes, wide: bool, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64 if wide else np.int32).astype(np.int64).reshape(n, -1)


def _no_rows(nq: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, ids, how many) of ``nq`` queries that have met no row."""
    return np.full((nq, k), LEAST), np.full((nq, k), MOST), np.zeros(nq, dtype=np.int64)


def _merge(held, at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> None:
    """Put rows (query position, id, score) into the best so far; equal scores go to the smaller id."""
    best, best_id, found = held
    who, turn = np.unique(at, return_inverse=True)
    owner = np.concatenate([np.repeat(np.arange(len(who)), k), turn])
    none = np.concatenate([(np.arange(k)[None, :] >= found[who][:, None]).ravel(), np.zeros(len(at), dtype=bool)])
    all_s, all_i = np.concatenate([best[who].ravel(), score]), np.concatenate([best_id[who].ravel(), ids])
    order = np.lexsort((all_i, ~all_s, none, owner))
    first = np.searchsorted(owner[order], np.arange(len(who)))
    order = order[first[:, None] + np.arange(k)[None, :]]
    best[who], best_id[who] = all_s[order], all_i[order]
    found[who] = np.minimum(k, found[who] + np.bincount(turn, minlength=len(who)))


def search_slab(query_ids, queries, ids, rows, k: int, block: int = BLOCK, held=None):
    """Top-k of each query in one slab: (query positions, ids, scores); rows of the query's own id are left out.

    ``held`` (scores, ids, how many) has the best of earlier slabs; it is brought up to
    date, and its k-th scores spare blocks of this one.
    """
    nq, d = queries.shape
    held = held or _no_rows(nq, k)
    best, best_id, found = held
    if not k:
        return np.zeros(0, np.int64), best_id.ravel(), best.ravel()
    most = d * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    exact = most < 2**52
    kind = np.float32 if most < 2**23 else np.float64 if exact else np.int64  # sums below 2**24 and 2**53 are exact in floats and doubles
    q, r = queries.astype(kind), rows.astype(kind)
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(r, starts), np.minimum.reduceat(r, starts)
    if exact:
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    else:  # a bound could overflow: visit every block
        bound = np.full((nq, len(starts)), np.inf)
    lowest = -np.inf if exact else LEAST

    def visit(x: int, who: np.ndarray) -> None:
        at = slice(starts[x], starts[x] + block)
        score = (q if len(who) == nq else q[who]) @ r[at].T
        may = score >= np.where(found[who] < k, lowest, best[who, -1]).astype(kind)[:, None]
        may &= ids[at][None, :] != query_ids[who][:, None]
        if score.shape[1] > k and np.count_nonzero(may) > 4 * k * len(who):
            part = np.where(may, score, lowest).astype(kind, copy=False)
            may &= score >= np.partition(part, -k, axis=1)[:, -k, None]
        a, c = np.nonzero(may)
        if len(a):
            _merge(held, who[a], ids[at][c], score[a, c].astype(np.int64), k)

    opened = np.argmax(bound, axis=1)  # the most promising block of a query gives its first k-th score
    for x in np.unique(opened):
        some = np.flatnonzero((opened == x) & ((found < k) | (bound[:, x] >= best[:, -1])))
        if len(some):
            visit(x, some)
    for x in np.argsort(-bound.max(axis=0, initial=lowest), kind="stable"):
        live = np.flatnonzero((opened != x) & ((found < k) | (bound[:, x] >= best[:, -1])))
        if len(live):
            visit(x, live)
    real = np.arange(k)[None, :] < found[:, None]
    return np.repeat(np.arange(nq), found), best_id[real], best[real]


def block_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
               vec_col: str = "embedding", scale: int = 256, cells: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query row, ties to the smaller id.

    Scores are inner products of floor(scale * x).  Null vectors, vectors with a
    null or non-finite component and null ids take no part.  Rows with the
    query's own id are not candidates.  Vectors of another dimension than the
    query's are not candidates.  Repeated candidate rows stand as often as they
    occur; a repeated query (same id and vector) is answered once.  Fewer than k
    candidates: all of them.  Scores beyond 64 bits wrap.  Empty tables give no rows.
    """
    spark = vectors.sparkSession
    cells = cells or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = integer_vectors(vectors, id_col, vec_col, scale)
    code = F.aggregate(F.slice("v", 1, 16), F.lit(0).cast("long"), lambda a, x: a * 2 + (x >= 0).cast("long"))
    ordered = rows.withColumn("code", code).repartitionByRange("dim", "code", "id").sortWithinPartitions("dim", "code", "id")
    slabs = (ordered.select("id", "dim", "v").mapInArrow(_packed(SLAB), PACKED)
             .withColumn("cell", F.pmod(F.xxhash64("first", "ids"), F.lit(cells)).cast("int")))
    wanted = integer_vectors(queries, id_col, vec_col, scale).dropDuplicates(["id", "v"])
    groups = (wanted.repartitionByRange("dim", "id").sortWithinPartitions("dim", "id").mapInArrow(_packed(QUERIES), PACKED)
              .select("dim", F.col("ids").alias("q_ids"), F.col("wide").alias("q_wide"), F.col("rows").alias("q_rows"),
                      F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None

        def answer() -> pa.RecordBatch:
            best, best_id, found = held
            real, at = np.arange(k)[None, :] < found[:, None], np.repeat(np.arange(len(found)), found)
            mark = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in q], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_pydict({"query_id": qid[at], "mark": mark[at], "vec_id": best_id[real], "score": best[real]})

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if group != (r["q_ids"], r["q_wide"], r["q_rows"]):  # the slabs of a group follow each other
                    if held is not None:
                        yield answer()
                    group, qid = (r["q_ids"], r["q_wide"], r["q_rows"]), np.frombuffer(r["q_ids"], np.int64)
                    q = _matrix(r["q_rows"], r["q_wide"], len(qid))
                    held = _no_rows(len(qid), k)
                ids = np.frombuffer(r["ids"], np.int64)
                search_slab(qid, q, ids, _matrix(r["rows"], r["wide"], len(ids)), k, held=held)
        if held is not None:
            yield answer()

    # The explicit count keeps the few packed rows, each a matrix product, in many tasks; a group repeats in each cell, so it must not be broadcast.
    pairs = groups.repartition(cells, "cell", "dim").hint("merge").join(slabs.repartition(cells, "cell", "dim"), ["cell", "dim"])
    found = pairs.select("q_ids", "q_wide", "q_rows", "ids", "wide", "rows").mapInArrow(
        run, "query_id long, mark long, vec_id long, score long")
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
