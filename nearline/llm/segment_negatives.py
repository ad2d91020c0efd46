"""Hard negatives by segment summaries.

Every vector is stored with the mean and the deviation of its segments, on some
levels from one segment to many.  Within a segment of n components

    x . y = n mean(x) mean(y) + (x - mean(x)) . (y - mean(y)),

and the last product lies within n dev(x) dev(y) of zero.  Summed over segments,
means' products plus or minus deviations' products bound the score of a pair from
both sides.  The levels are tried from coarse to fine, each on the pairs that
the one before left, and what is left after the finest is scored exactly.

A pair is left while its score may lie in a window that an anchor asks for and
may still enter that window's best k.  The positives of an anchor are one search
(same label, no window), its negatives another (other label, one window for each
positive).  Tasks hold one slab of stored rows and one group of anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearline.session import materialize

SLAB, GROUP, BLOCK = 4096, 128, 1024
LEVELS = (1, 4, 16)
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def labelled_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, dim, label string, v, mark) of the rows that take part: floor(scale * x), x as double."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
                     F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
                      & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    rows = rows.select("id", F.size("x").alias("dim"), "label", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))
    return rows.withColumn("mark", F.xxhash64("label", "v"))


def cuts(dim: int, parts: int) -> np.ndarray:
    """Starts of at most ``parts`` segments of nearly equal length."""
    parts = max(1, min(parts, dim))
    return np.arange(parts) * dim // parts


def summaries(rows: np.ndarray, levels=LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level sqrt(n) * mean and sqrt(n) * deviation of every segment, as doubles."""
    x, out = rows.astype(np.float64), []
    for parts in levels:
        at = cuts(x.shape[1], parts)
        n = np.diff(np.r_[at, x.shape[1]]).astype(np.float64)
        mean = np.add.reduceat(x, at, axis=1) / n
        apart = x - np.repeat(mean, n.astype(int), axis=1)
        out.append((mean * np.sqrt(n), np.sqrt(np.add.reduceat(apart * apart, at, axis=1))))
    return out


def _as_bytes(level: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    return b"".join(part.tobytes() for pair in level for part in pair)


def _from_bytes(raw: bytes, n: int, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    flat, at, out = np.frombuffer(raw, np.float64), 0, []
    for parts in LEVELS:
        w = len(cuts(dim, parts))
        pair = []
        for _ in range(2):
            pair.append(flat[at:at + n * w].reshape(n, w))
            at += n * w
        out.append(tuple(pair))
    return out


def _packed(limit: int, extra: tuple[str, ...] = ()):
    """mapInArrow function: rows in order of their dimension as packed matrices of at most ``limit`` rows, with summaries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            turns = np.r_[0, np.flatnonzero(np.diff(dims)) + 1, len(dims)]
            for lo, hi in zip(turns[:-1], turns[1:]):
                for a in range(int(lo), int(hi), limit):
                    part = batch.slice(a, min(limit, int(hi) - a))
                    n, dim = part.num_rows, int(dims[lo])
                    v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)
                    out = {"dim": pa.array([dim], pa.int32()), "rows": pa.array([v.tobytes()], pa.binary()),
                           "summary": pa.array([_as_bytes(summaries(v)) if dim else b""], pa.binary()),
                           "labels": pa.array([part.column("label").to_pylist()], pa.list_(pa.string()))}
                    for c in ("id", *extra):
                        out[f"{c}s"] = pa.array([part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                                                 if pa.types.is_list(part.column(c).type)
                                                 else part.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary())
                    yield pa.RecordBatch.from_pydict(out)
    return run


def store(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
          scale: int = 256, cells: int | None = None) -> DataFrame:
    """Stored slabs of rows with the summaries of their segments, dealt over ``cells``."""
    cells = cells or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = labelled_vectors(vectors, id_col, vec_col, label_col, scale)
    packed = (rows.repartition("id", "mark").sortWithinPartitions("dim", "id").select("id", "dim", "label", "v")
              .mapInArrow(_packed(SLAB), "dim int, rows binary, summary binary, labels array<string>, ids binary"))
    return materialize(packed.withColumn("cell", F.pmod(F.xxhash64("ids", "rows"), F.lit(cells)).cast("int")), "segment-slabs")


def _best(owner: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k best (score falling, id rising), owner after owner."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return order[rank < k]


def search(anchor_ids, anchors, rows_ids, rows, a_sum, r_sum, fits, low, high, k: int, stats: list | None = None):
    """The k best rows of each window of each anchor in one slab: (flat window number, ids, scores).

    ``fits`` (anchors x rows) marks the pairs whose labels qualify; ``low`` and
    ``high`` (anchors x windows) are inclusive.  ``stats`` collects the pairs
    that qualify, those left after each level, and those within a window's bounds.
    """
    (nq, dim), wide = anchors.shape, low.shape[1]
    largest = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0))
    exact = dim * largest < 2**52
    slack = 1.0 + 1e-9 * dim * largest  # rounding of the bounds
    got_w, got_i, got_s = (np.zeros(0, np.int64) for _ in range(3))
    floor_ = low.astype(np.float64)  # the least score that still enters a window
    left = np.zeros(len(LEVELS) + 1, np.int64)
    for at in range(0, len(rows), BLOCK):
        part = slice(at, at + BLOCK)
        alive = fits[:, part] & (anchor_ids[:, None] != rows_ids[None, part])
        left[0] += alive.sum()
        for step, ((am, ad), (rm, rd)) in enumerate(zip(a_sum, r_sum) if exact else ()):
            near = np.flatnonzero(alive.any(axis=0))
            middle, apart = am @ rm[part][near].T, ad @ rd[part][near].T + slack
            may = np.zeros(middle.shape, bool)
            for j in range(wide):
                may |= (middle + apart >= floor_[:, j, None]) & (middle - apart <= high[:, j, None])
            alive[:, near] &= may
            left[step + 1] += alive.sum()
        near = np.flatnonzero(alive.any(axis=0))
        if not len(near):
            continue
        kind = np.float64 if exact else np.int64
        score = (anchors.astype(kind) @ rows[part][near].astype(kind).T).astype(np.int64)
        alive = alive[:, near]
        new_w, new_i, new_s = [got_w], [got_i], [got_s]
        for j in range(wide):
            a, r = np.nonzero(alive & (score >= floor_[:, j, None]) & (score >= low[:, j, None]) & (score <= high[:, j, None]))
            new_w.append(a * wide + j)
            new_i.append(rows_ids[part][near][r])
            new_s.append(score[a, r])
        w, i, s = (np.concatenate(x) for x in (new_w, new_i, new_s))
        top = _best(w, i, s, k)
        got_w, got_i, got_s = w[top], i[top], s[top]
        count = np.bincount(got_w, minlength=nq * wide)
        last = np.cumsum(count)[count >= k] - 1
        full = got_w[last]
        floor_[full // wide, full % wide] = np.maximum(floor_[full // wide, full % wide], got_s[last])
    if stats is not None:
        stats.append(left)
    return got_w, got_i, got_s


def _windows(slabs: DataFrame, anchors: DataFrame, same_label: bool, wide: int, k: int, cells: int) -> DataFrame:
    """(id, mark, window, hit, score): the k best rows of each slab for each window of each anchor."""
    groups = (anchors.repartitionByRange("dim", "id").sortWithinPartitions("dim", "id")
              .mapInArrow(_packed(GROUP, ("mark", "low", "high")), "dim int, rows binary, summary binary, labels array<string>, "
                          "ids binary, marks binary, lows binary, highs binary"))
    names = ("rows", "summary", "labels", "ids")
    groups = groups.select("dim", *[F.col(c).alias(f"a_{c}") for c in names], "marks", "lows", "highs",
                           F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    # The explicit count keeps the few packed rows, each a matrix product, in many tasks.  A group repeats in
    # each cell, which the plan's estimate of its size leaves out: without the hint it is broadcast through the driver.
    pairs = groups.repartition(cells, "cell").hint("merge").join(slabs.repartition(cells, "cell"), ["cell", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                a_ids, ids, marks = (np.frombuffer(r[c], np.int64) for c in ("a_ids", "ids", "marks"))
                dim = r["dim"]
                if not dim:
                    continue
                a, d = (np.frombuffer(r[c], np.int64).reshape(-1, dim) for c in ("a_rows", "rows"))
                code = {x: n for n, x in enumerate({*r["a_labels"], *r["labels"]})}
                la, ld = (np.array([code[x] for x in r[c]]) for c in ("a_labels", "labels"))
                fits = (la[:, None] == ld[None, :]) == same_label
                low, high = (np.frombuffer(r[c], np.int64).reshape(-1, wide) for c in ("lows", "highs"))
                w, hit, score = search(a_ids, a, ids, d, _from_bytes(r["a_summary"], len(a), dim),
                                       _from_bytes(r["summary"], len(d), dim), fits, low, high, k)
                yield pa.RecordBatch.from_pydict({"id": a_ids[w // wide], "mark": marks[w // wide], "win": (w % wide).astype(np.int32),
                                                  "hit": hit, "score": score})

    return pairs.mapInArrow(run, "id long, mark long, win int, hit long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id", "mark", "win").orderBy(F.desc("score"), "hit")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256,
                   cells: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its ``positives`` best other rows of its label; for
    each, the ``negatives`` best rows of another label with low * positive score
    <= 100 * score <= high * positive score are returned.  Scores are inner
    products of floor(scale * x); ties go to the smaller id.

    Null ids, labels or vectors and vectors with a null or non-finite component
    take no part, nor do vectors of another dimension than the anchor's.  Rows of
    the anchor's own id are neither positives nor negatives.  Repeated rows stand
    as often as they occur; a repeated anchor (same id, label, vector) is answered
    once.  Fewer than asked for: all of them; an anchor without positives or a
    positive without negatives has no row.  Only the three named columns are read, so
    other columns may have any name.  Empty tables give no rows.
    """
    cells = cells or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slabs = store(vectors, id_col, vec_col, label_col, scale, cells)
    wanted = labelled_vectors(anchors, id_col, vec_col, label_col, scale).dropDuplicates(["id", "label", "v"])
    wanted = materialize(wanted, "negative-anchors")
    first = wanted.withColumns({"low": F.lit(LEAST + 1), "high": F.lit(MOST)})
    chosen = materialize(_ranked(_windows(slabs, first, True, 1, positives, cells), positives), "positives")
    lists = chosen.groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct("rank", "hit", "score"))).alias("p"))
    number = F.sequence(F.lit(0), F.lit(positives - 1))
    edge = lambda f, none: F.transform(number, lambda j: F.coalesce(f(F.get("p", j)["score"]), F.lit(none).cast("long")))
    second = (wanted.join(lists, ["id", "mark"])
              .withColumn("low", edge(lambda s: F.ceil((F.lit(low) * s).cast("decimal(38,0)") / 100).cast("long"), 1))
              .withColumn("high", edge(lambda s: F.floor((F.lit(high) * s).cast("decimal(38,0)") / 100).cast("long"), 0)))
    found = _ranked(_windows(slabs, second.select("id", "dim", "label", "v", "mark", "low", "high"), False, positives, negatives, cells),
                    negatives)
    pos = chosen.select("id", "mark", (F.col("rank") - 1).alias("win"), F.col("hit").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    return (found.join(pos, ["id", "mark", "win"])
            .select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("hit").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
