"""V7 with a coarse quantiser that grows: a tree of centroids with about sqrt(n) leaves.

The root splits into about the fourth root of n nodes, and every leaf that holds
more than twice its due splits again, so the size of cells is bounded however the
vectors cluster (only equal vectors cannot be told apart; the search kernel splits
their cell by count).  A vector is assigned by descending from node to child, which
compares it with a few children a level and never with all leaves.

All leaves of a level are split together: one job a round adds up the vectors of
every child, and only sums as large as the model reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearline.operators.ann import _matrix, probe_search
from nearline.operators.search import usable
from nearline.session import materialize


@dataclass
class CellTree:
    """Node 0 is the root; ``children[i]`` are the nodes below node i (none: a leaf)."""

    centres: np.ndarray
    children: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, dtype=int)])

    @property
    def leaves(self) -> np.ndarray:
        """Nodes without children; the position in this array is the number of the cell."""
        return np.asarray([i for i, c in enumerate(self.children) if not len(c)])

    @property
    def leaf_centres(self) -> np.ndarray:
        return self.centres[self.leaves]

    def grow(self, node: int, centres: np.ndarray) -> None:
        self.children[node] = np.arange(len(self.children), len(self.children) + len(centres))
        self.children += [np.zeros(0, dtype=int) for _ in centres]
        self.centres = np.concatenate([self.centres, centres])

    def nearest(self, X: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf node, distance less |x|^2) of up to ``beam`` near leaves of each row, nearest first.

        At each level the ``beam`` nearest nodes of a row are kept and opened.
        """
        row, node, dist = np.arange(len(X)), np.zeros(len(X), dtype=int), np.zeros(len(X))
        inner = np.asarray([len(c) > 0 for c in self.children])
        while len(node) and inner[node].any():
            shut = ~inner[node]
            found = [(row[shut], node[shut], dist[shut])]
            for at in np.unique(node[~shut]):
                rows, kids = row[node == at], self.children[at]
                C = self.centres[kids]
                d = (C * C).sum(1)[None, :] - 2.0 * (X[rows] @ C.T)
                found.append((np.repeat(rows, len(kids)), np.tile(kids, len(rows)), d.ravel()))
            row, node, dist = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((node, dist, row))
            row, node, dist = row[order], node[order], dist[order]
            first = np.searchsorted(row, row)
            keep = np.arange(len(row)) - first < beam
            row, node, dist = row[keep], node[keep], dist[keep]
        return row, node, dist


def _children_sums(rows: DataFrame, seeds: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{leaf: (sums, counts)} of the vectors of ``rows(leaf, rep)`` by nearest seed of their leaf."""
    bc = rows.sparkSession.sparkContext.broadcast(seeds)

    def partial(batches):
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for leaf, part in pdf.groupby("leaf"):
                X, C = _matrix(part["rep"]), bc.value[leaf]
                sums, counts = total.setdefault(leaf, (np.zeros_like(C), np.zeros(len(C), dtype=np.int64)))
                at = np.argmin((C * C).sum(1)[None, :] - 2.0 * (X @ C.T), axis=1)
                np.add.at(sums, at, X)
                counts += np.bincount(at, minlength=len(C))
        for leaf, (sums, counts) in total.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"leaf": np.full(len(at), leaf, dtype=np.int32), "child": at.astype(np.int32), "n": counts[at], "s": list(sums[at])})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"leaf": pdf["leaf"][:1], "child": pdf["child"][:1], "n": [int(pdf["n"].sum())], "s": [_matrix(pdf["s"]).sum(0)]})

    schema = "leaf int, child int, n long, s array<double>"
    out = {leaf: (np.zeros_like(C), np.zeros(len(C), dtype=np.int64)) for leaf, C in seeds.items()}
    for r in rows.mapInPandas(partial, schema).groupBy("leaf", "child").applyInPandas(add, schema).collect():
        out[r["leaf"]][0][r["child"]], out[r["leaf"]][1][r["child"]] = r["s"], r["n"]
    return out


def tree_fit(reps: DataFrame, cells: int | None = None, rows: int = 2_000_000, rounds: int = 6, levels: int = 8) -> CellTree:
    """Tree for ``cells`` cells (the square root of the usable vectors unless given).

    Fitted on the ``rows`` vectors of least id hash, a bounded sample of larger
    tables.  A leaf splits while it holds more than twice its due of the sample,
    at most ``levels`` times, into one child for each due share.
    """
    reps = reps.where(usable("rep")).select("id", F.col("rep").cast("array<double>").alias("rep"))
    total = reps.count()
    if not total:
        raise ValueError("no usable vector to fit cells on")
    cells = cells or math.ceil(math.sqrt(total))
    sample = reps if total <= rows else reps.orderBy(F.xxhash64("id"), "id").limit(rows)
    placed = materialize(sample.withColumn("leaf", F.lit(0)), "tree-rows")
    due = max(1.0, min(total, rows) / cells)
    fan = max(2, math.ceil(math.sqrt(cells)))
    tree = CellTree(np.zeros((1, len(placed.select("rep").first()[0]))))
    settled: set[int] = set()
    for _ in range(levels):
        sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
        wide = {leaf: min(2 * fan, math.ceil(n / due)) if leaf else min(fan, cells)
                for leaf, n in sizes.items() if n > 2 * due and leaf not in settled}
        if not wide:
            break
        want = placed.sparkSession.createDataFrame(list(wide.items()), "leaf int, wide int")
        open_rows = placed.join(F.broadcast(want), "leaf")  # one row for each leaf to split
        w = Window.partitionBy("leaf").orderBy(F.xxhash64("id", "leaf"), "id")
        picked = open_rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * fan).where("r <= wide").select("leaf", "rep").collect()
        seeds: dict[int, np.ndarray] = {}
        for leaf in wide:
            seeds[leaf] = np.unique(np.asarray([r["rep"] for r in picked if r["leaf"] == leaf], dtype=np.float64), axis=0)
        rows_in = open_rows.select("leaf", "rep")
        for _ in range(rounds):
            for leaf, (sums, counts) in _children_sums(rows_in, seeds).items():
                seeds[leaf] = sums[counts > 0] / counts[counts > 0][:, None]
        for leaf, C in seeds.items():
            settled.add(leaf)
            if len(C) > 1:
                tree.grow(leaf, C)
        placed = materialize(placed.select("id", "rep", _leaf(placed, tree)), "tree-rows")
    return tree


def _leaf(df: DataFrame, tree: CellTree):
    """Column: the leaf node that a vector descends to."""
    bc = df.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def leaf(v: pd.Series) -> pd.Series:
        return pd.Series(bc.value.nearest(_matrix(v), 1)[1] if len(v) else [], dtype="int32")

    return leaf("rep").alias("leaf")


def _cells(df: DataFrame, tree: CellTree, nprobe: int, beam: int):
    """Column: numbers of the ``nprobe`` nearest cells that a beam of ``beam`` nodes finds."""
    number = np.full(len(tree.children), -1)
    number[tree.leaves] = np.arange(len(tree.leaves))
    bc = df.sparkSession.sparkContext.broadcast((tree, number))

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        tree, number = bc.value
        row, node, _ = tree.nearest(_matrix(v), beam)
        parts = np.split(number[node].astype(np.int32), np.searchsorted(row, np.arange(1, len(v))))
        return pd.Series([p[:nprobe] for p in parts], dtype=object)

    return cells("rep")


def tree_assign(reps: DataFrame, tree: CellTree) -> DataFrame:
    """Index side, stored: (id, rep, cell), each usable vector in the cell that it descends to."""
    reps = reps.where(usable("rep"))
    return materialize(reps.select("id", "rep", F.element_at(_cells(reps, tree, 1, 1), 1).alias("cell")), "tree_cells")


def tree_search(queries: DataFrame, index: DataFrame, tree: CellTree, k: int = 10, nprobe: int = 8, beam: int | None = None,
                **kw) -> DataFrame:
    """Top k among the ``nprobe`` nearest cells of each query; with all cells probed it is exact.

    ``beam`` nodes are kept at each level (at least ``nprobe``; twice as many unless
    given).  ``score=`` and ``d_col=`` go to the kernel, so codes of residuals to
    ``tree.leaf_centres`` can be searched too.
    """
    queries = queries.where(usable("rep"))
    beam = max(nprobe, beam or 2 * nprobe)
    probes = queries.select(F.col("id").alias("qid"), "rep", _cells(queries, tree, nprobe, beam).alias("cells"))
    return probe_search(materialize(probes, "tree_probes"), index, k, **kw)
