"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id, stored row number), so equal texts
are neighbours.  Splitters for equal bytes are found without sorting: each round
counts, in one aggregation, the exact bytes and rows below up to ``probes``
candidate keys inside every interval that still holds an unmet splitter, and
narrows those intervals to the bin in which the wanted byte count falls.  Only
these bounded histograms reach the driver.  Then the rows are exchanged once, by
range of the same key, and numbered in that order; shard and slot follow from
the exact row counts below the splitters.

A text that holds a third of all rows is cut inside its own run of equal hashes
(by id, then by row number), so it cannot overload a shard or a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearline.operators.indexing import with_global_index
from nearline.session import materialize

ROW_BYTES = 16
LEVELS = ("h", "d", "t")
RANGE = {"h": (0, 2**62 - 1), "d": (-(2**63), 2**63 - 1), "t": (0, 2**63 - 1)}


def sort_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored narrow rows: doc_id, size, text_crc32 and the key (h, d, t)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.shiftrightunsigned(F.xxhash64(text), 2).alias("h"))
    rows = rows.withColumn("d", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    return materialize(rows.withColumn("t", F.monotonically_increasing_id()), "shard-keys")


def _histogram(keys: DataFrame, states: list[tuple], probes: int) -> dict[int, list]:
    """Per interval: (least key, greatest key, bytes, rows) of its non-empty bins, in order."""
    case = None
    for i, (prefix, lo, hi) in enumerate(states):
        col = LEVELS[len(prefix)]
        test = F.col(col).between(lo, hi)
        for name, value in zip(LEVELS, prefix):
            test = test & (F.col(name) == F.lit(value))
        width = -(-(hi - lo + 1) // probes)
        wide = col != "h"
        at = f"cast({col} as decimal(38,0)) - ({lo})" if wide else f"{col} - {lo}L"
        step = str(width) if wide else f"{width}L"
        bin_ = F.struct(F.lit(i).alias("i"), F.expr(f"cast(({at}) div {step} as int)").alias("bin"), F.col(col).alias("v"))
        case = F.when(test, bin_) if case is None else case.when(test, bin_)
    got = (keys.select(case.alias("x"), "size").where("x is not null")
           .groupBy("x.i", "x.bin").agg(F.min("x.v").alias("lo"), F.max("x.v").alias("hi"),
                                        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    out: dict[int, list] = {i: [] for i in range(len(states))}
    for r in sorted(got.collect(), key=lambda r: (r["i"], r["bin"])):
        out[r["i"]].append((r["lo"], r["hi"], r["bytes"], r["n"]))
    return out


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.001, probes: int = 1024) -> list[tuple[int, int]]:
    """(bytes, rows) strictly below each of the ``shards - 1`` splitters, exact.

    A splitter is met when its bytes lie within ``tolerance`` of a shard of the
    wanted count, or when it stands beside the single row that holds that byte.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slack = tolerance * total / shards
    start = ((), *RANGE["h"], 0, 0)
    open_ = {s: start for s in range(1, shards)}
    done: dict[int, tuple[int, int]] = {}
    while open_ and total:
        states = sorted({x[:3] for x in open_.values()})
        bins = _histogram(keys, states, probes)
        for s, (prefix, lo, hi, below, rows) in list(open_.items()):
            want = total * s / shards
            for least, most, size, n in bins[states.index((prefix, lo, hi))]:
                if below + size >= want:
                    break
                below, rows = below + size, rows + n
            near = (below, rows) if want - below <= below + size - want else (below + size, rows + n)
            if abs(near[0] - want) <= slack or n == 1:
                done[s] = near
                del open_[s]
            elif least < most:
                open_[s] = (prefix, least, most, below, rows)
            else:
                prefix = (*prefix, least)
                open_[s] = (prefix, *RANGE[LEVELS[len(prefix)]], below, rows)
    return [done.get(s, (0, 0)) for s in range(1, shards)]


def histogram_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                     tolerance: float = 0.001, probes: int = 1024) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law ``bytes``.

    Shards have nearly equal bytes (UTF-8 size of the text plus 16 a row).  A
    null text counts as empty; a null id sorts before all ids of its text;
    repeated rows are told apart by their stored row number.  Slots number the
    rows of a shard from 0 without gaps.  Other columns are ignored; an empty
    table gives no rows, and with fewer rows than shards some shards are empty.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    keys = sort_keys(docs, id_col, text_col)
    cuts = [rows for _, rows in splitters(keys, shards, tolerance, probes)]
    ordered = with_global_index(keys, list(LEVELS), "at")
    first = F.array(*[F.lit(x).cast("long") for x in (0, *cuts)])
    shard = F.lit(0)
    for x in cuts:
        shard = shard + (F.col("at") >= F.lit(x)).cast("int")
    return (ordered.withColumn("shard", shard)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("at") - F.get(first, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
