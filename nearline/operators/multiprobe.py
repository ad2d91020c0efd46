"""V10 with several probes a table: locality-sensitive hashing that also opens neighbouring buckets.

A table's bucket is the vector of ``floor((plane . x + offset) / width)`` of its
planes.  A query opens its own bucket and those that differ by one in some planes, in
the order of how close the query lies to the boundaries crossed.  The order of
boundary *ranks* is the same for all queries (their expected distances depend only
on the number of planes), so it is made once and mapped to each query's own ranking.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearline.operators.ann import _matrix, bucket_search
from nearline.operators.quantize import minus_squared_l2
from nearline.operators.search import knn_exact, usable
from nearline.session import materialize


@dataclass(frozen=True)
class HashTables:
    """``planes`` (tables, hashes, dim), ``offsets`` (tables, hashes), one bucket ``width``."""

    planes: np.ndarray
    offsets: np.ndarray
    width: float

    def places(self, X: np.ndarray) -> np.ndarray:
        """(rows, tables, hashes): the projections in units of the width."""
        return (np.einsum("nd,thd->nth", X, self.planes) + self.offsets[None]) / self.width


def rank_sets(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The first ``probes`` sets of boundary ranks (from 0) by expected squared distance; the first is empty.

    Ranks below ``hashes`` are the nearer boundaries, nearest first; rank
    ``2 * hashes - 1 - r`` is the other side of the plane of rank r, so no set holds both.
    """
    top, n = 2 * hashes, hashes
    near = np.arange(1, n + 1)
    low = near * (near + 1) / (4 * (n + 1) * (n + 2))
    # A far side is one width less the near side: E(1 - z)^2.
    far = 1 - near / (n + 1) + low
    cost = np.concatenate([low, far[::-1]])
    out: list[tuple[int, ...]] = [()]
    heap = [(float(cost[0]), (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if not any(top - 1 - r in chosen for r in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < top:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], chosen[:-1] + (last + 1,)))
            heapq.heappush(heap, (total + cost[last + 1], chosen + (last + 1,)))
    return out


def probe_keys(places: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """(rows, sets, hashes): the buckets that a query at ``places(rows, hashes)`` opens, in order."""
    base = np.floor(places).astype(np.int64)
    inside = places - base
    step = np.where(inside < 0.5, -1, 1)
    order = np.argsort(np.minimum(inside, 1 - inside), axis=1, kind="stable")
    n = places.shape[1]
    out = np.repeat(base[:, None, :], len(sets), axis=1)
    rows = np.arange(len(places))
    for s, chosen in enumerate(sets):
        for rank in chosen:
            plane = order[:, rank if rank < n else 2 * n - 1 - rank]
            out[rows, s, plane] += step[rows, plane] * (1 if rank < n else -1)
    return out


def probing_fit(reps: DataFrame, k: int = 10, tables: int = 6, bucket_rows: int = 64, scale: float = 2.0, rows: int = 200,
                seed: int = 42) -> HashTables:
    """Random planes; width and number of planes fitted to the data.

    The width is ``scale`` times the median distance of the ``rows`` vectors of least id hash (a
    bounded sample) to their exact k-th neighbour among all; as many planes as bring a
    bucket to about ``bucket_rows`` of the vectors, judged by the sample's spread.
    """
    reps = reps.where(usable("rep")).select("id", "rep")
    some = materialize(reps.orderBy(F.xxhash64("id"), "id").limit(rows), "lsh-sample")
    X = _matrix(pd.Series([r["rep"] for r in some.select("rep").collect()]))
    if not len(X):
        raise ValueError("no usable vector to fit hash tables on")
    far = knn_exact(some, reps, k=k + 1, score=minus_squared_l2).groupBy("qid").agg(F.min("score").alias("s"))
    radius = float(np.sqrt(-far.agg(F.expr("percentile(s, 0.5)")).first()[0]))
    rng = np.random.default_rng(seed)
    spread = float(np.std(X @ rng.standard_normal((X.shape[1], 64)), axis=0).mean())
    width = max(scale * radius, spread / 64, 1e-9)
    # A normal projection fills about sqrt(4 pi) * deviation / width buckets evenly.
    bins = max(1.5, np.sqrt(4 * np.pi) * spread / width)
    hashes = int(np.clip(round(np.log(max(1.0, reps.count() / bucket_rows)) / np.log(bins)), 1, 24))
    return HashTables(rng.standard_normal((tables, hashes, X.shape[1])), rng.uniform(0, width, (tables, hashes)), width)


def _hash_keys(reps: DataFrame, model: HashTables, probes: int, id_name: str) -> DataFrame:
    """(id, rep, keys): the first ``probes`` buckets of each table, by table."""
    bc = reps.sparkSession.sparkContext.broadcast((model, rank_sets(model.planes.shape[1], probes)))

    @F.pandas_udf("array<array<array<bigint>>>")
    def buckets(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        model, sets = bc.value
        at = model.places(_matrix(v))
        keys = np.stack([probe_keys(at[:, t], sets) for t in range(at.shape[1])], axis=1)
        return pd.Series(keys.tolist())

    return reps.where(usable("rep")).select(F.col("id").alias(id_name), "rep", buckets("rep").alias("keys"))


def hash_cells(reps: DataFrame, model: HashTables, probes: int = 1, id_name: str = "id") -> DataFrame:
    """Stored (id, rep, cell, keys): a row for each of the first ``probes`` buckets of each table; the first has all keys."""
    cells = _hash_keys(reps, model, probes, id_name).select(id_name, "rep", "keys", F.posexplode("keys").alias("t", "own"))
    cells = cells.select(id_name, "rep", "t", "keys", F.posexplode("own").alias("probe", "key"))
    first = F.when((F.col("t") == 0) & (F.col("probe") == 0), F.col("keys"))
    return materialize(cells.select(id_name, "rep", F.struct("t", "key").alias("cell"), first.alias("keys")), "hash_cells")


def multiprobe_search(queries: DataFrame, index: DataFrame, model: HashTables, k: int = 10, probes: int = 8, **kw) -> DataFrame:
    """Top k among the vectors in the first ``probes`` buckets of each table; each candidate counts once.

    ``index`` is ``hash_cells(corpus, model)``.  ``score=`` goes to the kernel.  Only ids and vectors
    are sent; the tasks make the buckets of both sides from them.
    """
    tables, hashes = model.planes.shape[:2]
    bc = queries.sparkSession.sparkContext.broadcast((model, rank_sets(hashes, probes)))

    def hashed(Q: np.ndarray, D: np.ndarray):
        model, sets = bc.value
        at, homes = model.places(Q), np.floor(model.places(D)).astype(np.int64)
        return ((probe_keys(at[:, t], sets), homes[:, t]) for t in range(tables))

    values = len(bc.value[1]) * max(tables, hashes)  # a table's keys at a time, then a number for each of all
    q = queries.where(usable("rep")).select(F.col("id").alias("qid"), "rep")
    return bucket_search(q, index.where(F.col("keys").isNotNull()).select("id", "rep"), k, values, hashed=hashed, **kw)


def opened_share(queries: DataFrame, index: DataFrame, model: HashTables, probes: int) -> float:
    """Mean number of stored rows in a query's buckets, as a share of the vectors (tables counted each)."""
    asked = hash_cells(queries, model, probes, "qid").groupBy("cell").agg(F.count(F.lit(1)).alias("asks"))
    held = index.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    seen = asked.join(held, "cell").agg(F.sum(F.col("asks") * F.col("rows"))).first()[0] or 0
    return seen * model.planes.shape[0] / max(1, queries.where(usable("rep")).count() * index.count())
