"""Byte-level BPE encoding and decoding with a segment tree per piece.

Text is cut into pieces by the usual byte-level pattern (contractions, words
with one leading space, numbers, other symbols, white space).  A piece that is
itself a token is done.  Otherwise a segment tree over its byte positions holds,
at each leaf, the rank of the pair that starts at that live position; each inner
node holds the minimum of ``rank * size + position``, so the root is the leftmost
pair of least rank.  A merge updates three leaves (the merged pair, its dead
right half and the live left neighbour) and their paths to the root.

Pieces of up to ``VECTOR_SIZE`` bytes are merged side by side: one numpy step
performs one merge in every unfinished piece.  Longer pieces use the same tree
one at a time.  Equal pieces of a block are encoded once; the decoded bytes are
compared with the input, so an encoding never rests on a hash alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearline.llm import bytearrays as B

VECTOR_SIZE = 128
SMALL = 1 << 18  # bytes of text that a task works on at once
CACHE_TOKENS = 2_000_000
PIECE = B.RollingHash(21)
NONE = np.int64(2**62)

#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, BLANK = range(4)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point, as the pattern sees it."""
    import regex

    out = np.full(0x110000, OTHER, dtype=np.uint8)
    at = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
    every = at.tobytes().decode("utf-32-le")
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        out[at[[m.start() for m in regex.finditer(name, every)]]] = kind
    out[WHITE_SPACE] = BLANK
    return out


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which pieces start; ``first`` marks the first character of each document."""
    n = len(points)
    kind = char_classes()[points]
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    joined = np.zeros(n, dtype=bool)
    joined[1:] = (points[:-1] == 32) & ~first[1:n]
    start = run & (blank | ~joined)
    start[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:n]
    # A lone apostrophe that starts a piece takes a contraction's ending with it.
    quote = np.flatnonzero((points == 39) & run & ~joined)
    quote = quote[quote + 1 < n]
    quote = quote[run[quote + 1] & ~first[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        padded = np.r_[points, np.zeros(2, points.dtype)]
        a, b = padded[quote + 1], padded[quote + 2]
        same = ~np.r_[first, True, True][quote + 2]
        short = np.isin(a, [ord(x) for x in "stmd"])
        long = same & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for at, size in ((quote[short], 1), (quote[long], 2)):
            start[at + 1] = False
            rest = at + 1 + size
            rest = rest[rest < n]
            rest = rest[~run[rest]]
            start[rest] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of a byte-level BPE file and the lookups that its encoder needs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begin = np.r_[0, np.cumsum(self.length)][:-1]
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.single < 0).any():
            raise ValueError("the vocabulary must hold every single byte")
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.shift = B.U64(64 - max(4, int(len(pairs) * 4).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64)
        self.values = np.full(len(self.keys), NONE, dtype=np.int64)
        slots = self._slot(np.array(list(pairs), dtype=np.int64))
        for key, value, slot in zip(pairs, pairs.values(), slots.tolist()):
            while self.keys[slot] != -1:
                slot = (slot + 1) & (len(self.keys) - 1)
            self.keys[slot], self.values[slot] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(B.U64) * B.U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NONE where they don't merge."""
        key = left << 32 | right
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.values[slot], NONE)
        open_ = np.flatnonzero((got != key) & (got != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out

    def merge_short(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, size: int):
        """Tokens of pieces of at most ``size`` bytes (a power of two): (flat tokens, counts)."""
        m, col = len(begin), np.arange(len(begin))
        pos = np.arange(size)[:, None]
        real = pos < length[None, :]
        ids = np.where(real, self.single[data[np.minimum(begin[None, :] + pos, len(data) - 1)]], -1)
        nxt = np.where(pos + 1 < length[None, :], pos + 1, size)
        prv = np.broadcast_to(pos - 1, (size, m)).copy()
        tree = np.full((2 * size, m), NONE)
        pair = real[1:] & real[:-1]
        r = self.rank(ids[:-1][pair], ids[1:][pair])
        leaf = np.full((size - 1, m), NONE)
        leaf[pair] = np.where(r == NONE, NONE, r * size + np.broadcast_to(pos[:-1], pair.shape)[pair])
        tree[size:2 * size - 1] = leaf
        level = size
        while level > 1:
            tree[level // 2:level] = np.minimum(tree[level:2 * level:2], tree[level + 1:2 * level:2])
            level //= 2
        live = real
        act = col[tree[1] < NONE]
        while len(act):
            best = tree[1, act]
            token, i = best // size, best % size
            j = nxt[i, act]
            k = nxt[j, act]
            ids[i, act] = token
            live[j, act] = False
            nxt[i, act] = k
            right = k < size
            prv[k[right], act[right]] = i[right]
            tree[size + j, act] = NONE
            new = np.full(len(act), NONE)
            got = self.rank(token[right], ids[k[right], act[right]])
            new[right] = np.where(got == NONE, NONE, got * size + i[right])
            tree[size + i, act] = new
            p = prv[i, act]
            left = p >= 0
            got = self.rank(ids[p[left], act[left]], token[left])
            tree[size + p[left], act[left]] = np.where(got == NONE, NONE, got * size + p[left])
            node = size + np.concatenate([i, j, p[left]])
            who = np.concatenate([act, act, act[left]])
            while node[0] > 1:
                node = node >> 1
                tree[node, who] = np.minimum(tree[2 * node, who], tree[2 * node + 1, who])
            act = act[tree[1, act] < NONE]
        return ids.T[live.T], live.sum(axis=0)

    def merge_long(self, piece: bytes) -> list[int]:
        """Tokens of one piece of any length."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none, pairs = int(NONE), self.pairs
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        nxt, prv = [*range(1, n + 1)], [*range(-1, n - 1)]
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = size + at
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < none:
            token, i = divmod(tree[1], size)
            j = nxt[i]
            k = nxt[j]
            ids[i], nxt[i], ids[j] = token, k, -1
            put(j, none)
            rank = pairs.get(token << 32 | ids[k]) if k < n else None
            put(i, none if rank is None else rank * size + i)
            if k < n:
                prv[k] = i
            p = prv[i]
            if p >= 0:
                rank = pairs.get(ids[p] << 32 | token)
                put(p, none if rank is None else rank * size + p)
        return [t for t in ids if t >= 0]

    def pieces(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each piece: (flat tokens, counts)."""
        raw = data.tobytes()
        whole = np.fromiter((self.ranks.get(raw[b:b + n], -1) for b, n in zip(begin.tolist(), length.tolist())),
                            dtype=np.int64, count=len(begin))
        counts = np.ones(len(begin), dtype=np.int64)
        rest = np.flatnonzero(whole < 0)
        size = 2
        flat_parts, owners = [whole[whole >= 0]], [np.flatnonzero(whole >= 0)]
        while len(rest):
            if size > VECTOR_SIZE:
                for x in rest.tolist():
                    got = np.array(self.merge_long(raw[begin[x]:begin[x] + length[x]]), dtype=np.int64)
                    counts[x] = len(got)
                    flat_parts.append(got)
                    owners.append(np.full(len(got), x))
                break
            mine = rest[length[rest] <= size]
            rest = rest[length[rest] > size]
            for lo in range(0, len(mine), 1 << 13):
                part = mine[lo:lo + (1 << 13)]
                got, n = self.merge_short(data, begin[part], length[part], size)
                counts[part] = n
                flat_parts.append(got)
                owners.append(np.repeat(part, n))
            size *= 2
        owner = np.concatenate(owners)
        return np.concatenate(flat_parts)[np.argsort(owner, kind="stable")], counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of tokens."""
        return _gather(self.flat, self.begin[ids], self.length[ids])


def _gather(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of slices of ``values``."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes blocks of documents; remembers a bounded number of pieces between blocks."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=B.U64)
        self.begin = self.count = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int32)

    def _learn(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        tokens, counts = self.vocab.pieces(data, begin, length)
        at = np.r_[0, np.cumsum(counts)][:-1] + len(self.pool)
        self.pool = np.concatenate([self.pool, tokens.astype(np.int32)])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.begin = np.concatenate([self.begin, at])[order]
        self.count = np.concatenate([self.count, counts])[order]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat tokens, token offsets by document, bytes that the tokens decode to) of UTF-8 texts."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), data
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        place = np.r_[0, np.cumsum(width)]
        first = np.zeros(len(points) + 1, dtype=bool)
        first[np.searchsorted(place, offsets)] = True
        begin = place[piece_starts(points, first)]
        length = np.diff(np.r_[begin, len(data)])
        key = PIECE.of_bytes(data, begin, begin + length)
        distinct, sample, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.pool) > CACHE_TOKENS:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        known = np.r_[self.keys, B.U64(0)][at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        known &= at < len(self.keys)
        fresh = sample[~known]
        if len(fresh):
            self._learn(distinct[~known], data, begin[fresh], length[fresh])
            at = np.searchsorted(self.keys, distinct)
        count = self.count[at][which]
        tokens = _gather(self.pool, self.begin[at][which], count)
        decoded = self.vocab.decode(tokens)
        if not np.array_equal(decoded, data):  # two pieces share a hash
            tokens, count = self.vocab.pieces(data, begin, length)
            tokens = tokens.astype(np.int32)
            decoded = self.vocab.decode(tokens)
        piece = np.searchsorted(begin, offsets)
        return tokens, np.r_[0, np.cumsum(count)][piece], decoded


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every row: the tokens of its whole text, without special tokens.

    ``with_decoded`` adds ``decoded``, the bytes that these ids decode to, in the
    same pass (``decode`` does it for stored ids).

    A null or empty text has no tokens.  Ids may be null or repeated: each row
    is encoded by itself.  Other columns are ignored.  ``vocab_path`` must be
    readable on every executor.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(vocab_path))
        for batch in batches:
            data, offsets = B.binary_block(batch.column("body"))
            for i, j in B.chunks(offsets, SMALL):
                tokens, ends, decoded = encoder.block(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                cols = [batch.column("doc_id").slice(i, j - i),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int32()))]
                if with_decoded:
                    cols.append(_binary(decoded, np.r_[0, np.cumsum(encoder.vocab.length[tokens])][ends]))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][:len(cols)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded binary" * with_decoded)


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) to rows that have token ids; null ids decode to no bytes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            step = 256
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                lists = part.column(ids_col).fill_null([]) if part.column(ids_col).null_count else part.column(ids_col)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                counts = lists.value_lengths().to_numpy(zero_copy_only=False)
                done = vocab.decode(ids)
                ends = np.r_[0, np.cumsum(vocab.length[ids])][np.r_[0, np.cumsum(counts)]]
                yield pa.RecordBatch.from_arrays([*part.columns, _binary(done, ends)], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
