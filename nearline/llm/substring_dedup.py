"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``block`` words
(the anchors).  A repeat of ``window`` >= 2 * block - 1 words always contains
one whole anchor of the document that it repeats, so probing the anchor index
with every rolling window of ``block`` words finds at least one hit in each
repeat.  Hits are then extended: every run of ``window`` words around a hit is
compared with the runs around hits of all other documents, by a 64-bit hash
inside a bucket that a second, independent hash chooses, and overlapping
verified runs merge into the maximal exact repeats.

Shape of the job (all exchanges are on hash-bucketed, packed arrays):

1. documents are grouped into packs by a hash of id and text;
2. each pack sends one row per bucket with the distinct hashes of its rolling
   windows, each with the largest document of the pack that holds it and the
   smallest that holds it at a block boundary (the index entry);
3. a bucket reduces each hash over the packs and returns one flag a hash, so a
   passage with a million copies costs an entry a pack, never one a copy;
4. packs send the window-length runs around flagged hashes, again one entry a
   run and pack, with its smallest document and its places there; later
   documents of the same pack are known to repeat it and skip the comparison;
   buckets keep the runs whose smallest document is in another pack.

Anchor hashes are 40 bits within a bucket: a false hit only costs a comparison
in step 4.  Packs and buckets are multiples of ``spark.sql.shuffle.partitions``, so
their size stays bounded as the cluster setting follows the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearline.llm import bytearrays as B

WORD, WORD2 = B.RollingHash(11), B.RollingHash(12)
BLOCK, WINDOW, WINDOW2 = B.RollingHash(13), B.RollingHash(14), B.RollingHash(15)
LOW40 = B.U64((1 << 40) - 1)
NO_DOC = np.iinfo(np.int64).max

PROBE = "pack long, bucket int, n long, ids binary, last binary, anchors binary, anchored binary, low binary, high binary"
HITS = "pack long, bucket int, n long, bits binary"
RUNS = "pack long, bucket int, n long, ids binary, docs binary, counts binary, starts binary, hashes binary"
FOUND = "pack long, starts binary"
OUT = ("doc_id long, text_kept string, n_words long, n_removed long, "
       "removed array<struct<start:long,end:long>>")


def _table(rows: list[dict], schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


class _Pack:
    """Word hashes of one pack of documents, in a canonical order."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("mark", "ascending")])
        self.pack = table["pack"][0].as_py()
        ids = table["doc_id"].combine_chunks()
        self.null = np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc_ids, self.texts = ids, table["body"]
        self.data, self.offsets = B.binary_block(table["body"])

    def hash(self, window: int) -> None:
        (self.word, self.word2), self.firsts = B.word_hashes(self.data, self.offsets, [WORD, WORD2])
        counts = np.diff(self.firsts)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.usable = np.repeat((counts >= window) & ~self.null, counts)

    def probes(self, block: int, buckets: int):
        """Starts of usable rolling blocks, and their distinct (bucket, hash) codes."""
        h = B.windows(self.word, block, BLOCK)
        at = np.flatnonzero((self.usable & B.fits(self.firsts, block))[:len(h)])
        h = h[at]
        code = (h >> B.U64(40)) % B.U64(buckets)
        code <<= B.U64(40)
        code |= h & LOW40
        del h
        return at, _Distinct(np.argsort(code, kind="stable"), code)


class _Distinct:
    """Equal codes of a pack as groups; inside a group entries stay in order of place, so of document."""

    def __init__(self, order: np.ndarray, *codes: np.ndarray):
        self.order = order
        new = np.zeros(len(order), dtype=bool)
        new[:1] = True
        for code in codes:
            ordered = code[order]
            new[1:] |= ordered[1:] != ordered[:-1]
        self.starts = np.flatnonzero(new)
        self.first = order[self.starts]
        self.counts = np.diff(np.r_[self.starts, len(order)])

    def by_bucket(self, bucket: np.ndarray):
        """(bucket, groups in order of their first place); ``bucket`` of each group must ascend."""
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)]):
            if hi > lo:
                yield int(bucket[lo]), lo + np.argsort(self.first[lo:hi])


def _local(ids: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes]:
    """Ids of the documents that occur in ``docs`` (ascending), and docs renumbered among them."""
    seen, at = np.unique(docs, return_inverse=True)
    return B.pack_ints(ids[seen]), B.pack_ints(at)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
                    block: int = 7, packs_per_partition: int = 2, buckets_per_partition: int = 2) -> DataFrame:
    """Remove every word covered by a ``window``-word run that also starts in a document with a smaller id.

    Returns one row per input row: doc_id, text_kept (kept words joined by one
    space), n_words, n_removed and the removed word ranges (end exclusive; the
    maximal repeats).  Windows are judged on the input.

    Null text: no words.  Null id: the row is returned whole and neither removes
    nor loses words, as no id is smaller.  Rows that share an id do not remove
    words from each other.  Texts shorter than the window are kept whole.  Other
    columns are ignored, whatever their names.  An empty table gives no rows.
    """
    if window < 2 * block - 1:
        raise ValueError("window must be at least 2 * block - 1 words, else a repeat may hold no whole block")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs, buckets = parts * packs_per_partition, parts * buckets_per_partition
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    base = base.withColumn("mark", F.xxhash64("body"))
    base = base.withColumn("pack", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(packs)))
    probe_schema, hit_schema, run_schema, found_schema = (_arrow(x) for x in (PROBE, HITS, RUNS, FOUND))

    def probe(table: pa.Table) -> pa.Table:
        p = _Pack(table)
        p.hash(window)
        at, groups = p.probes(block, buckets)
        h = B.windows(p.word, block, BLOCK)[at[groups.first]]
        doc = p.doc[at]
        last = doc[groups.order[groups.starts + groups.counts - 1]]
        none = len(p.ids)
        aligned = np.where((at - p.firsts[doc]) % block == 0, doc, none)[groups.order]
        anchor = np.minimum.reduceat(aligned, groups.starts) if len(aligned) else aligned
        rows = []
        for b, sel in groups.by_bucket(((h >> B.U64(40)) % B.U64(buckets)).astype(np.int64)):
            key, low = h[sel] & LOW40, anchor[sel]
            anchored = low < none
            seen, local = np.unique(np.concatenate([last[sel], low[anchored]]), return_inverse=True)
            rows.append({"pack": p.pack, "bucket": b, "n": len(sel), "ids": B.pack_ints(p.ids[seen]),
                         "last": B.pack_ints(local[:len(sel)]), "anchors": B.pack_ints(local[len(sel):]),
                         "anchored": np.packbits(anchored).tobytes(),
                         "low": key.astype(np.uint32).tobytes(), "high": (key >> B.U64(32)).astype(np.uint8).tobytes()})
        return _table(rows, probe_schema)

    def match(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        key = np.concatenate([np.frombuffer(r["low"], np.uint32).astype(B.U64)
                              | (np.frombuffer(r["high"], np.uint8).astype(B.U64) << B.U64(32)) for r in rows])
        ends = np.cumsum([r["n"] for r in rows])
        last, anchor = np.empty(len(key), dtype=np.int64), np.full(len(key), NO_DOC)
        for r, e in zip(rows, ends):
            ids = B.unpack_ints(r["ids"])
            last[e - r["n"]:e] = ids[B.unpack_ints(r["last"])]
            at = np.flatnonzero(np.unpackbits(np.frombuffer(r["anchored"], np.uint8), count=r["n"]))
            if len(at):
                anchor[e - r["n"] + at] = ids[B.unpack_ints(r["anchors"])]
        hit = _hits(key, last, anchor)
        return _table([{"pack": r["pack"], "bucket": r["bucket"], "n": r["n"],
                        "bits": np.packbits(hit[e - r["n"]:e]).tobytes()}
                       for r, e in zip(rows, ends) if hit[e - r["n"]:e].any()], hit_schema)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return run_schema.empty_table()
        p = _Pack(left)
        p.hash(window)
        at, groups = p.probes(block, buckets)
        h = B.windows(p.word, block, BLOCK)[at[groups.first]]
        bits = {r["bucket"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in right.to_pylist()}
        flag = np.zeros(len(h), dtype=np.uint8)
        for b, sel in groups.by_bucket(((h >> B.U64(40)) % B.U64(buckets)).astype(np.int64)):
            if b in bits:
                flag[sel] = bits[b]
        hit = np.zeros(len(p.word) + 1, dtype=np.int64)
        hit[at[groups.order]] = np.repeat(flag, groups.counts)
        before = np.cumsum(np.r_[0, hit])
        del at, groups, h, flag, hit
        w1 = B.windows(p.word, window, WINDOW)
        starts = np.flatnonzero((p.usable & B.fits(p.firsts, window))[:len(w1)])
        starts = starts[before[starts + window - block + 1] > before[starts]]
        if not len(starts):
            return run_schema.empty_table()
        bucket = (B.windows(p.word2, window, WINDOW2)[starts] % B.U64(buckets)).astype(np.int64)
        w1 = w1[starts]
        runs = _Distinct(np.lexsort((w1, bucket)), bucket, w1)
        doc = p.doc[starts]
        later = p.ids[doc[runs.order]] > np.repeat(p.ids[doc[runs.first]], runs.counts)
        mine = runs.counts - np.add.reduceat(later.astype(np.int64), runs.starts)  # places in the smallest document come first
        rows = [{"pack": p.pack, "bucket": int(p.pack % buckets), "n": 0, "ids": b"", "docs": b"", "counts": b"", "hashes": b"",
                 "starts": B.pack_ints(np.sort(starts[runs.order[later]]))}] if later.any() else []
        for b, sel in runs.by_bucket(bucket[runs.first]):
            ids, local = _local(p.ids, doc[runs.first[sel]])
            n = mine[sel]
            places = np.repeat(runs.starts[sel] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            rows.append({"pack": p.pack, "bucket": b, "n": len(sel), "ids": ids, "docs": local, "counts": B.pack_ints(n),
                         "starts": B.pack_ints(starts[runs.order[places]]), "hashes": w1[runs.first[sel]].tobytes()})
        return _table(rows, run_schema)

    def verify(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [{"pack": r["pack"], "starts": r["starts"]} for r in rows if not r["n"]]  # known to be later
        rows = [r for r in rows if r["n"]]
        if rows:
            key = np.concatenate([np.frombuffer(r["hashes"], B.U64) for r in rows])
            doc = np.concatenate([B.unpack_ints(r["ids"])[B.unpack_ints(r["docs"])] for r in rows])
            later, e = _later(key, doc), 0
            for r in rows:
                keep = later[e:e + r["n"]]
                e += r["n"]
                if keep.any():
                    places = B.unpack_ints(r["starts"])[np.repeat(keep, B.unpack_ints(r["counts"]))]
                    out.append({"pack": r["pack"], "starts": B.pack_ints(places)})
        return _table(out, found_schema)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _Pack(left)
        found = [B.unpack_ints(x) for x in right["starts"].to_pylist()] if right.num_rows else []
        return _kept(p, np.concatenate(found) if found else np.zeros(0, dtype=np.int64), window)

    probes = base.groupBy("pack").applyInArrow(probe, PROBE)
    hits = probes.groupBy("bucket").applyInArrow(match, HITS)
    runs = base.groupBy("pack").cogroup(hits.groupBy("pack")).applyInArrow(extend, RUNS)
    found = runs.groupBy("bucket").applyInArrow(verify, FOUND)
    return base.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(remove, OUT)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    new = np.r_[True, np.diff(key[order]) != 0]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _hits(key: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Entries of which some probe meets an anchor of a smaller document, or some anchor is met by a larger one."""
    order, starts, group = _groups(key)
    smallest = np.minimum.reduceat(anchor[order], starts)[group]
    largest = np.maximum.reduceat(last[order], starts)[group]
    out = np.empty(len(key), dtype=bool)
    out[order] = (smallest < last[order]) | (anchor[order] < largest)
    return out


def _later(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries whose key also occurs in a smaller document."""
    order, starts, group = _groups(key)
    d = doc[order]
    out = np.empty(len(key), dtype=bool)
    out[order] = np.minimum.reduceat(d, starts)[group] < d
    return out


def _kept(p: _Pack, starts: np.ndarray, window: int) -> pa.Table:
    """Kept texts, counts and removed ranges of a pack, given the starts of its repeated runs."""
    n = len(p.ids)
    texts, n_words, n_removed, spans = [], np.zeros(n, np.int64), np.zeros(n, np.int64), []
    starts = np.sort(starts)
    seen = 0
    for i, j in B.chunks(p.offsets):
        data, at = p.data[p.offsets[i]:p.offsets[j]], p.offsets[i:j + 1] - p.offsets[i]
        s, e, firsts = B.words(data, at)
        mine = starts[np.searchsorted(starts, seen):np.searchsorted(starts, seen + len(s))] - seen
        seen += len(s)
        edge = np.zeros(len(s) + window + 1, dtype=np.int64)
        np.add.at(edge, mine, 1)
        np.add.at(edge, mine + window, -1)
        gone = np.cumsum(edge)[:len(s)] > 0
        kept = np.flatnonzero(~gone)
        # Bytes of kept words, each followed by one space that replaces what follows the word.
        size = e - s + 1
        out_end = np.cumsum(size[kept])
        total = int(out_end[-1]) if len(kept) else 0
        out = np.full(total, 32, dtype=np.uint8)
        if total:
            step = np.ones(total, dtype=np.int64)
            begin = out_end - size[kept]
            step[begin[1:]] = s[kept[1:]] - (s[kept[:-1]] + size[kept[:-1]]) + 1
            step[0] = s[kept[0]]
            src = np.cumsum(step)
            body = np.ones(total, dtype=bool)
            body[out_end - 1] = False
            out[body] = data[src[body]]
        raw = out.tobytes()
        bounds = np.r_[0, out_end][np.searchsorted(kept, firsts)]
        n_words[i:j] = np.diff(firsts)
        n_removed[i:j] = np.diff(np.r_[0, np.cumsum(gone)][firsts])
        texts += [raw[a:max(a, b - 1)].decode("utf-8") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        # Maximal removed ranges, cut at document ends.
        flag = np.r_[gone, False]
        cut = np.zeros(len(s) + 1, dtype=bool)
        cut[firsts] = True
        opens = np.flatnonzero(flag[:-1] & (cut[:-1] | ~np.r_[False, flag[:-2]][:len(s)]))
        closes = np.flatnonzero(flag[:-1] & (cut[1:] | ~flag[1:])) + 1
        owner = np.searchsorted(opens, firsts)
        base = np.repeat(firsts[:-1], np.diff(owner))
        pairs = [{"start": a, "end": b} for a, b in zip((opens - base).tolist(), (closes - base).tolist())]
        spans += [pairs[a:b] for a, b in zip(owner[:-1].tolist(), owner[1:].tolist())]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": p.doc_ids, "text_kept": pa.array(texts, pa.string()), "n_words": n_words,
                     "n_removed": n_removed, "removed": pa.array(spans, span)})
