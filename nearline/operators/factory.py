"""U4: indexes by factory string."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from nearline.operators import ann as N
from nearline.operators import quantize as Z
from nearline.operators.search import add_vectors, knn_exact
from nearline.session import materialize


@dataclass(frozen=True)
class Index:
    """A fitted index: call it to search, ``add`` to append vectors without refitting."""

    store: DataFrame
    transform: Callable[[DataFrame], DataFrame]
    place: Callable[[DataFrame], DataFrame]
    find: Callable[..., DataFrame]

    def __call__(self, queries: DataFrame, k: int = 10, **kw) -> DataFrame:
        return self.find(self.transform(queries), self.store, k=k, **kw)

    def add(self, reps: DataFrame) -> "Index":
        return replace(self, store=add_vectors(self.store, self.place(self.transform(reps))))


def make_index(spec: str, reps: DataFrame, seed: int = 42, ks: int = 256, metric: str = "l2") -> Index:
    """U4: index by factory string: [PCA<d>,][OPQ<m>,]Flat | IVF<n>,Flat | PQ<m> | IVF<n>,PQ<m>.

    ``metric`` is ``l2`` (scores are minus the squared distance) or ``ip``.  ``ks``
    is the size of a PQ codebook; after IVF, PQ codes residuals of the centroids.
    OPQ rotates before all later parts.  Other parts raise.
    """
    parts = [p.strip() for p in spec.split(",") if p.strip()]
    if not parts:
        raise ValueError("empty index spec")
    block, _ = Z.metric_of(metric)
    steps: list[Callable[[DataFrame], DataFrame]] = []

    def transform(df: DataFrame) -> DataFrame:
        df = df.select("id", "rep")
        for step in steps:
            df = step(df)
        return df

    def sized(part: str) -> tuple[str, int]:
        kind = part.rstrip("0123456789")
        return kind, int(part[len(kind):] or 0)

    named = [sized(p) for p in parts]
    kinds = [kind for kind, _ in named]
    before = 0
    for kind in ("PCA", "OPQ"):
        before += kinds[before:before + 1] == [kind]
    if kinds[before:] not in (["Flat"], ["PQ"], ["IVF", "Flat"], ["IVF", "PQ"]):
        raise ValueError(f"unsupported index spec {spec!r}")
    for kind, size in named[:before]:
        if kind == "PCA":
            model = N.pca_fit(transform(reps), size)
            steps.append(lambda df, model=model: N.pca_reduce(df, model))
        else:
            rotation = Z.opq_fit(transform(reps), size, ks=ks)
            steps.append(lambda df, rotation=rotation: Z.rotate(df, rotation))
    (first, cells), (last, m) = named[before], named[-1]
    data = transform(reps)
    cents = N.ivf_fit(data, cells, seed=seed) if first == "IVF" else None
    books = None
    if last == "PQ":
        books = N.pq_fit(data, m, ks=ks, seed=seed) if cents is None else Z.residual_books(N.ivf_assign(data, cents), cents, m, ks, seed)

    def place(df: DataFrame) -> DataFrame:
        if cents is not None:
            df = N.ivf_assign(df, cents)
            return df if books is None else materialize(Z.residual_encode(df, cents, books), "residual_codes")
        return df if books is None else materialize(N.pq_encode(df, books), "pq_codes")

    def find(queries: DataFrame, store: DataFrame, k: int, nprobe: int = 1, **kw) -> DataFrame:
        if cents is None and books is None:
            return knn_exact(queries, store, k=k, score=block, **kw)
        if cents is None:
            return N.pq_search(queries, store, books, k=k, metric=metric, **kw)
        if books is None:
            return N.ivf_search(queries, store, cents, k=k, nprobe=nprobe, score=block, **kw)
        return Z.residual_search(queries, store, cents, books, k=k, nprobe=nprobe, metric=metric, **kw)

    return Index(place(data), transform, place, find)
