"""SimHash near-dedup by multi-index hashing.

Fingerprints are cut into ``distance // 2 + 1`` segments, so two fingerprints
within ``distance`` bits differ by at most one bit in some segment.  The table
holds each distinct fingerprint under its exact segment values; a probe
enumerates the Hamming ball of that radius around each of its own segment
values, fetches the table's matches and verifies the complete distance.

Equal fingerprints are collapsed first, so copies cost one row.  A segment value
shared by more than ``crowd`` fingerprints is taken out of the plain join: its
members and their ball are cut into blocks, every pair of blocks is compared in
its own task, and each task returns only a spanning forest of the links that it
found (no pairs of a group are listed, and no link between groups is lost).
Components come from alternating star contraction over stored edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearline.llm import bytearrays as B
from nearline.session import materialize

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
HASH_SEED = 42


def block_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints of a block of documents, as unsigned 64-bit integers."""
    data = LOWER[data]
    s, e, firsts = B.words(data, offsets)
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    if not len(s):
        return out
    # All words, each followed by one space: a shingle is one slice of this text.
    ends = np.cumsum(e - s + 1)
    begin = ends - (e - s + 1)
    text = np.full(ends[-1], 32, dtype=np.uint8)
    body = np.ones(ends[-1], dtype=bool)
    body[ends - 1] = False
    text[body] = data[~B.SPACE[data]]
    raw = text.tobytes()
    counts = np.diff(firsts)
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    ends_at = np.cumsum(n)
    word = np.arange(ends_at[-1]) + np.repeat(firsts[:-1] - (ends_at - n), n)
    last = word + np.repeat(np.minimum(counts, shingle), n) - 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest,
                             map(raw.__getitem__, map(slice, begin[word].tolist(), (ends[last] - 1).tolist())),
                             repeat(HASH_SEED)), dtype=np.uint64, count=len(word))
    full = np.flatnonzero(n)
    step = 1 << 16
    ones = np.zeros((len(n), 64), dtype=np.int64)
    for lo in range(0, len(hashes), step):
        part = hashes[lo:lo + step]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = full[np.searchsorted(ends_at[full], lo, side="right"):np.searchsorted(ends_at[full], lo + len(part) - 1, side="right") + 1]
        at = np.maximum(ends_at[own] - n[own] - lo, 0)
        ones[own] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    fp = np.packbits(2 * ones > n[:, None], axis=1)
    return np.ascontiguousarray(fp).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id long, fp long) and the long columns ``carry`` of every row; the 64 bits of fp are the fingerprint.

    A text without words (or null) has fingerprint zero; one with fewer words
    than ``shingle`` has its whole word sequence as its only shingle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.binary_block(batch.column("body"))
            fps = [block_fingerprints(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], shingle)
                   for i, j in B.chunks(offsets)]
            fp = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), *[batch.column(c) for c in carry]],
                                             names=["doc_id", "fp", *carry])

    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *[f"{c} long" for c in carry]]))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; within ``distance`` bits some segment differs by one bit at most."""
    if not 0 <= distance <= 62:
        raise ValueError("distance must lie between 0 and 62 bits")
    m = distance // 2 + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _value(fp, first: int, width: int):
    got = F.shiftrightunsigned(fp, first)
    return got if width == 64 else got.bitwiseAND(F.lit((1 << width) - 1))


def _ball(key: str, width: int, radius: int):
    own = F.array(F.col(key))
    if not radius:
        return own
    return F.concat(own, F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                                     lambda j: F.col(key).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))))


def _forest(distance: int, table: pa.Table) -> pa.Table:
    """Links between two blocks of fingerprints, as a star for each component that they form."""
    fp = table["fp"].to_numpy().astype(np.int64)
    member = table["member"].to_numpy(zero_copy_only=False).astype(bool)
    a, b = np.unique(fp[member]), np.unique(fp[~member])
    near = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= distance
    top = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while near.size:
        na = np.minimum(la, np.where(near, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(near, na[:, None], top).min(axis=0))
        if np.array_equal(na, la) and np.array_equal(nb, lb):
            break
        la, lb = na, nb
    x, y = np.concatenate([la, lb]), np.concatenate([a, b])
    keep = x != y
    return pa.table({"a": x[keep], "b": y[keep]})


def links(fps: DataFrame, distance: int = 3, crowd: int = 128, block: int = 512) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``); their components are those of all links."""
    radius = distance // len(segments(distance))
    index, probes = None, None
    for k, (first, width) in enumerate(segments(distance)):
        part = fps.select(F.lit(k).alias("seg"), _value(F.col("fp"), first, width).alias("key"), "fp")
        ball = part.select("seg", F.explode(_ball("key", width, radius)).alias("key"), F.col("fp").alias("a"))
        index = part if index is None else index.union(part)
        probes = ball if probes is None else probes.union(ball)
    hot = materialize(index.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd), "simhash-hot")
    crowded = hot.limit(1).count() > 0
    table = index.join(hot.select("seg", "key"), ["seg", "key"], "left_anti") if crowded else index
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = (probes.join(table.withColumnRenamed("fp", "b"), ["seg", "key"])
             .where((F.col("a") < F.col("b")) & near).select("a", "b").distinct())
    if not crowded:
        return pairs
    # Crowded values: members hold the value itself, the ball holds all values within the radius.
    balls = None
    for k, (_, width) in enumerate(segments(distance)):
        part = hot.where(F.col("seg") == k).select("seg", "key", F.explode(_ball("key", width, radius)).alias("near"))
        balls = part if balls is None else balls.union(part)
    members = index.join(hot.select("seg", "key"), ["seg", "key"]).withColumn("member", F.lit(True))
    others = (balls.join(index.select("seg", F.col("key").alias("near"), "fp"), ["seg", "near"])
              .select("seg", "key", "fp").withColumn("member", F.lit(False)))
    rows = materialize(members.select("seg", "key", "fp", "member").union(others), "simhash-crowd")
    blocks = (rows.groupBy("seg", "key")
              .agg(F.ceil(F.count_if("member") / block).cast("int").alias("na"),
                   F.ceil(F.count_if(~F.col("member")) / block).cast("int").alias("nb")))
    rows = rows.join(blocks, ["seg", "key"])
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("member"), F.col("na")).otherwise(F.col("nb"))).cast("int")
    span = F.sequence(F.lit(0), F.when(F.col("member"), F.col("nb")).otherwise(F.col("na")) - 1)
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(span))
    dealt = dealt.select("seg", "key", "fp", "member", F.when(F.col("member"), F.col("own")).otherwise(F.col("other")).alias("x"),
                         F.when(F.col("member"), F.col("other")).otherwise(F.col("own")).alias("y"))

    def forest(table: pa.Table) -> pa.Table:
        return _forest(distance, table)

    found = dealt.groupBy("seg", "key", "x", "y").applyInArrow(forest, "a long, b long")
    return pairs.union(found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component; nodes without an edge are left out.

    Alternating large-star and small-star steps; each round is stored in the
    checkpoint folder, so a lost executor never replays earlier rounds.
    """
    sign = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    cur = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .where("a <> b").distinct(), "edges")
    seen = tuple(cur.agg(*sign).first())
    while True:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        cur = materialize(small.where("a <> b").distinct(), "edges")
        now = tuple(cur.agg(*sign).first())
        if now == seen:
            return cur.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links.

    Null or word-less texts share fingerprint zero and link like any other.  A
    row with a null id belongs to its fingerprint's component but never names
    it; a component of null ids only has a null component_id.  Repeated rows
    stay repeated.  Other columns are ignored.  An empty table gives no rows.
    """
    marks = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    classes = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    stars = components(links(classes.select("fp"), distance))
    roots = (classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("root", F.coalesce("root", "fp")))
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialize(roots.join(names, "root").select("fp", "component_id"), "simhash-components")
    return marks.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    distance: int = 3) -> DataFrame:
    """One input row of each component: that of least id (null ids last), then of least hash of the text, then of the row.

    The choice rests on the rows alone, not on their order, so a replayed task
    makes it again.  Of rows that are equal in every column one stays.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    # xxhash64 passes over nulls, so the flags tell which columns they are in.
    text_mark, row_mark = F.xxhash64(F.col(text_col)), F.xxhash64(*names, *[c.isNull() for c in names])
    marks = fingerprints(docs.withColumns({"__text_mark": text_mark, "__row_mark": row_mark}), id_col, text_col, shingle,
                         carry=("__text_mark", "__row_mark"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__text_mark").alias("text"), F.col("__row_mark").alias("row"))
    classes = materialize(marks.groupBy("fp").agg(F.min(key).alias("least")), "simhash-classes")
    stars = components(links(classes.select("fp"), distance))
    least = (classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left")
             .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least")))
    keys = ["__id", "__text_mark", "__row_mark"]  # the row's mark tells a null id from zero
    stays = materialize(least.select(F.coalesce("least.doc_id", F.lit(0)).alias("__id"), F.col("least.text").alias("__text_mark"),
                                     F.col("least.row").alias("__row_mark")), "simhash-stays")
    rows = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__text_mark": text_mark, "__row_mark": row_mark})
    return rows.join(stays, keys, "left_semi").dropDuplicates(keys).select(*names)


def hex_fingerprint(fp="fp"):
    """16 lowercase hex digits of a fingerprint column."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
