"""Exact inner-product search bounded by norms (V2-V4 for vectors of unequal length).

No inner product exceeds the product of two norms.  Documents are stored once
in falling order of norm, in blocks of ``block_rows``; a search meets them in
waves.  After each wave a query knows its k-th score, and of the blocks that
follow it needs only those whose largest norm, times its own, can still reach
that score.  As norms fall, these are a prefix: a query that needs nothing of
the next block is finished.  Runs of the blocks of a wave are groups: a query is
sent once for each group that it may reach, and inside of it meets block after
block as long as one can still enter its best k so far.

The result equals ``knn_exact``.  Vectors of one length gain nothing: then no
bound falls below a k-th score, and all blocks are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearline.operators.indexing import with_global_index
from nearline.operators.search import (BestRows, document_groups, empty_run, id_order, inner_product, matrix, meet_groups, query_groups, rank_results, run_schema, usable,
                                       whole)
from nearline.session import materialize

#: Relative room for the rounding of doubles in norms and products.
ROOM = 1e-9


def norm(vec: str) -> Column:
    return F.sqrt(F.aggregate(F.col(vec), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


@dataclass
class NormBlocks:
    """Stored vectors (s, i, v) in falling order of norm, and (largest norm, rows) of each block."""

    rows: DataFrame
    blocks: list[tuple[float, int]]


def norm_blocks(corpus: DataFrame, d_id: str = "id", d_vec: str = "rep", block_rows: int = 4096) -> NormBlocks:
    """Store ``corpus`` in blocks of falling norm; only one row per block reaches the driver.

    A null vector, or one with a null component, takes no part.  A vector whose
    norm is not a number comes first and is never skipped.
    """
    d = corpus.where(usable(d_vec)).select(F.col(d_id).alias("i"), F.col(d_vec).alias("v"))
    d = materialize(d.withColumn("norm", norm("v")).withColumn("row", F.monotonically_increasing_id()), "norms")
    low = F.when(F.isnan("norm"), F.lit(float("-inf"))).otherwise(-F.col("norm"))
    places = with_global_index(d.select("row", low.alias("low")), ["low", "row"], "at")
    d = d.join(places.select("row", (F.col("at") / block_rows).cast("int").alias("s")), "row").select("s", "i", "v", "norm")
    d = materialize(d, "norm-blocks")
    found = d.groupBy("s").agg(F.max("norm"), F.count(F.lit(1))).orderBy("s").collect()
    return NormBlocks(d.drop("norm"), [(r[1], r[2]) for r in found])


#: Documents of neighbouring blocks that meet a block of queries at once.
STEP_ROWS = 1024


def _kernel(k: int, decimals: int | None, query_block: int, tops: list[float]):
    """Kernel over queries (i, v, norm, floor) and a run of blocks (i, v, s): what can enter the best k of each query."""
    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return empty_run(q, d)
        d = id_order(d)
        q_ids, d_ids = whole(q.column("i")), whole(d.column("i"))
        Q, D = matrix(whole(q.column("v"))).astype(np.float64), matrix(whole(d.column("v")))
        q_norm, floor = (whole(q.column(c)).to_numpy(zero_copy_only=False) for c in ("norm", "floor"))
        held = whole(d.column("s")).to_numpy(zero_copy_only=False)
        places = np.argsort(held, kind="stable")  # by block, then id
        held = held[places]
        steps, lo = [], 0
        while lo < len(held):  # whole blocks, in falling order of norm
            hi = int(np.searchsorted(held, held[min(lo + STEP_ROWS, len(held)) - 1], side="right"))
            steps.append((tops[held[lo]], np.sort(places[lo:hi])))
            lo = hi
        best = BestRows(len(Q), k, decimals)
        for lo in range(0, len(Q), query_block):
            rows = np.arange(lo, min(len(Q), lo + query_block))
            for top, at in steps:
                # A bound that is not a number keeps the query.
                rows = rows[~(q_norm[rows] * top * (1 + ROOM) < np.maximum(floor[rows], best.floor[rows]))]
                if not len(rows):
                    break
                best.meet(rows, Q[rows], at, D[at], inner_product)
        best.places[best.scores < floor[:, None]] = -1
        return best.table(q_ids, d_ids)

    return run


def knn_norm_bounded(queries: DataFrame, corpus: DataFrame | NormBlocks, k: int = 1000, q_id: str = "id", q_vec: str = "rep",
                     d_id: str = "id", d_vec: str = "rep", query_block: int = 256, block_rows: int = 4096,
                     growth: int = 4, decimals: int | None = None, report: list | None = None) -> DataFrame:
    """The run of ``knn_exact``, without the document blocks whose norms cannot reach a query's k-th score.

    The first wave holds the blocks that give k scores, each further one
    ``growth`` times as many.  ``report`` takes (first block, end block, vector
    pairs of queries and blocks that they may reach, vector pairs of all queries and blocks) per wave.
    Nulls, ties and id types are treated as ``knn_exact`` does.
    """
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = corpus if isinstance(corpus, NormBlocks) else norm_blocks(corpus, d_id, d_vec, block_rows)
    schema = run_schema(queries, q_id, index.rows, "i")
    q = queries.where(usable(q_vec)).select(F.col(q_id).alias("i"), F.col(q_vec).alias("v"))
    q = materialize(q.withColumn("norm", norm("v")).withColumn("row", F.monotonically_increasing_id()), "norm-queries")
    total = q.count()
    best, at = spark.createDataFrame([], schema), 0
    kernel = _kernel(k, decimals, query_block, [float(top) for top, _ in index.blocks])
    slack = 0.0 if decimals is None else 10.0 ** -decimals
    tops = spark.createDataFrame([(s, float(top), n) for s, (top, n) in enumerate(index.blocks)], "s int, top double, rows long")
    end, size, needed = 0, 0, 0
    for _, n in index.blocks:
        if needed >= k:
            break
        needed, size = needed + n, size + 1
    while at < len(index.blocks):
        end = min(len(index.blocks), at + size)
        floors = best.groupBy("qid").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("got"))
        live = q.join(floors, q["i"].eqNullSafe(floors["qid"]), "left")
        live = live.withColumn("floor", F.when(F.col("got") >= k, F.col("kth") - slack).otherwise(F.lit(float("-inf"))))
        # The least norm of a document that can still enter; a query of norm 0 scores 0 everywhere.
        live = live.withColumn("reach", F.when((F.col("floor") <= 0) | (F.col("norm") == 0), 0.0)
                               .otherwise(F.col("floor") / (F.col("norm") * (1 + ROOM))))
        live = live.where(F.col("reach") <= F.lit(float(index.blocks[at][0]))).select("i", "v", "norm", "floor", "reach", "row")
        live = materialize(live, "norm-live")
        left = live.count()
        if left == 0:
            break
        if report is not None:
            met = live.join(tops.where(F.col("s").between(at, end - 1)), F.col("reach") <= F.col("top"))
            report.append((at, end, met.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], total * sum(n for _, n in index.blocks[at:end])))
        # A run of blocks is a group; a query is sent once for each group that it may reach.
        run = math.ceil((end - at) / document_groups(sum(n for _, n in index.blocks[at:end]), parts))
        firsts = range(at, end, run)
        q_groups = query_groups(left, len(firsts), parts)
        groups = spark.createDataFrame([(g, float(index.blocks[s][0])) for g, s in enumerate(firsts)], "dg int, top double")
        asking = live.crossJoin(F.broadcast(groups)).where(F.col("reach") <= F.col("top"))
        asking = asking.select("dg", F.pmod(F.xxhash64("row"), F.lit(q_groups)).cast("int").alias("qg"), "i", "v", "norm", "floor")
        docs = index.rows.where(F.col("s").between(at, end - 1)).select(((F.col("s") - at) / run).cast("int").alias("dg"), "i", "v", "s")
        local = meet_groups(asking, docs, len(firsts), q_groups, kernel, schema)
        best = materialize(rank_results(best.unionByName(local), k).select("qid", "docid", "score"), "norm-best")
        at, size = end, size * growth
    return rank_results(best, k).select("qid", "docid", "rank", "score")
