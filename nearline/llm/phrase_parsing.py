"""Phrase collocations by prefix-free parsing.

The words of a document, with a stop for every end of a piece, are cut at
windows of four words whose hash says so.  A chunk runs from one such window to
the end of the next, so neighbours overlap by that window, equal passages give equal
chunks wherever they stand, and copies meet in one dictionary row with a
frequency.  Phrases of up to five words are counted in the distinct chunks only,
weighted by frequency; a phrase belongs to the chunk in which it starts before
the last window, so those of an overlap count once.  Every document ends in four
stops, which no phrase holds.

Phrases grow word by word: one of n words can only be frequent if both of its
parts of n - 1 words are, which a Bloom filter of the frequent ones tells (it may
let more pass, never fewer, and its size is bounded).  Chunks, counts and scores
are exchanged by their text, after sums in each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearline.llm.arrowwords import coded, ranges, slices, split_words
from nearline.llm.bytearrays import U64, mix
from nearline.session import materialize

WINDOW = 4  # words of a trigger; phrases have at most WINDOW + 1
STOP = "."  # never part of a word
PIECE_ENDS = "[.,;:!?\n-\r]+"
STEP = U64(0x9E3779B97F4A7C15)
FILTER_BITS = 1 << 30
COUNTED = "lang string, phrase string, f long"


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), dtype=U64, count=len(words))


def _rolled(first: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Hash of (first, word[i] ... word[i + n - 1]) at each place i; the last n - 1 places are meaningless."""
    h = first.copy()
    for j in range(n):
        h = h * STEP + np.roll(word, -j)
    return mix(h)


def _joined(words: pa.Array, at: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Word ranges as strings, words joined by one space."""
    offsets = np.r_[0, np.cumsum(sizes)]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.take(pa.array(ranges(at, sizes))))
    return pc.binary_join(lists, " ").cast(pa.string())


def _parse(spread: int):
    def one(part: pa.RecordBatch) -> pa.Table:
        texts = pc.ascii_lower(pc.fill_null(part.column("text"), "").cast(pa.large_string()))
        texts = pc.replace_substring(pc.replace_substring_regex(texts, PIECE_ENDS, f" {STOP} "), "\t", " ")
        sizes, words = split_words(texts, " ", pattern=False)
        code, names = coded(words)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        stop = np.flatnonzero(names.to_numpy(zero_copy_only=False) == STOP)
        is_stop = code == stop[0] if len(stop) else np.zeros(len(code), bool)
        # One stop stands for several, and none at the start.
        new_doc = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
        keep = ~(is_stop & (new_doc | np.r_[True, is_stop[:-1]])) if len(doc) else is_stop
        code, doc = code[keep], doc[keep]
        # WINDOW stops behind every document.
        names = pa.chunked_array([names.cast(pa.string()), pa.array([STOP])]).combine_chunks()
        count = np.bincount(doc, minlength=len(sizes))
        ends = np.cumsum(count + WINDOW) if len(count) else np.zeros(0, np.int64)
        full = np.full(int(ends[-1]) if len(ends) else 0, len(names) - 1)
        starts = ends - count - WINDOW
        real = ranges(starts, count)
        full[real] = code
        if not len(code):
            return pa.table({"lang": pa.array([], pa.string()), "chunk": pa.array([], pa.string()), "freq": pa.array([], pa.int64())})
        h = _hashes(names)[full]
        trigger = np.zeros(len(full), bool)
        trigger[real] = (_rolled(np.zeros(len(full), U64), h, WINDOW) % U64(spread) == 0)[real]
        trigger[starts[count > 0]] = True
        begin = np.flatnonzero(trigger)
        owner = np.searchsorted(ends, begin, side="right")
        last = np.r_[owner[1:] != owner[:-1], True]
        until = np.where(last, ends[owner] - WINDOW, np.r_[begin[1:], 0])
        chunk = _joined(names.take(pa.array(full)), begin, until - begin + WINDOW)
        lang = pc.fill_null(part.column("lang"), "und").take(pa.array(owner))
        table = pa.table({"lang": lang, "chunk": chunk})
        got = table.group_by(["lang", "chunk"]).aggregate([([], "count_all")])
        return got.rename_columns(["lang", "chunk", "freq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield from one(part).select(["lang", "chunk", "freq"]).to_batches(max_chunksize=1 << 15)
    return run


def parse(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", spread: int = 32) -> DataFrame:
    """Dictionary (lang, chunk, freq), stored: one window in ``spread`` ends a chunk."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    chunks = rows.mapInArrow(_parse(spread), "lang string, chunk string, freq long")
    return materialize(chunks.groupBy("lang", "chunk").agg(F.sum("freq").alias("freq")), "phrase-chunks")


class FrequentFilter:
    """Bloom filter of (lang, phrase); the broadcast holds at most FILTER_BITS bits."""

    PROBES = (U64(0), U64(21), U64(42))

    def __init__(self, frequent: DataFrame):
        rows = frequent.count()
        self.bits = min(FILTER_BITS, 1 << max(16, (16 * rows - 1).bit_length()))
        bits = self.bits

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, words = split_words(batch.column("phrase"), " ", pattern=False)
                code, names = coded(words)
                lang, langs = coded(batch.column("lang").cast(pa.large_string()))
                h, n = _hashes(names)[code], len(sizes)
                key, at = _hashes(langs)[lang], np.cumsum(sizes) - sizes
                for j in range(int(sizes.max(initial=0))):
                    more = np.flatnonzero(sizes > j)
                    key[more] = key[more] * STEP + h[at[more] + j]
                spot = np.unique(np.concatenate([FrequentFilter.spots(mix(key), p, bits) for p in FrequentFilter.PROBES])) if n else np.zeros(0, U64)
                yield pa.RecordBatch.from_pydict({"slot": (spot >> U64(6)).astype(np.int64),
                                                  "mask": (U64(1) << (spot & U64(63))).view(np.int64)})

        masks = frequent.select("lang", "phrase").mapInArrow(places, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
        got = masks.toArrow()
        table = np.zeros(self.bits // 64, dtype=U64)
        table[got.column("slot").to_numpy()] = got.column("mask").to_numpy().view(U64)
        self.table = frequent.sparkSession.sparkContext.broadcast(table)

    @staticmethod
    def spots(key: np.ndarray, probe: np.uint64, bits: int) -> np.ndarray:
        return mix(key + probe) & U64(bits - 1)

    def holds(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for p in self.PROBES:
            spot = self.spots(key, p, self.bits)
            out &= (self.table.value[spot >> U64(6)] >> (spot & U64(63))) & U64(1) == 1
        return out


def _count_slice(part: pa.Table, n: int, known: FrequentFilter | None) -> pa.Table | None:
    sizes, words = split_words(part.column("chunk").combine_chunks(), " ", pattern=False)
    code, names = coded(words)
    lang, langs = coded(part.column("lang").combine_chunks().cast(pa.large_string()))
    stop = np.flatnonzero(names.to_numpy(zero_copy_only=False) == STOP)
    stop = int(stop[0]) if len(stop) else -1
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    end = np.cumsum(sizes)[chunk]
    ok = np.arange(len(code)) < end - WINDOW  # phrases that start here belong to this chunk
    for j in range(n):
        ok &= np.roll(code, -j) != stop
    at = np.flatnonzero(ok)
    if known is not None and len(at):
        key = _rolled(_hashes(langs)[lang[chunk]], _hashes(names)[code], n - 1)
        at = at[known.holds(key[at])]
        at = at[known.holds(key[at + 1])]
    if not len(at):
        return None
    group = lang[chunk[at]]
    for j in range(n):  # exact codes of the phrases, a word at a time
        _, first, group = np.unique(group * len(names) + code[at + j], return_index=True, return_inverse=True)
    freq = part.column("freq").combine_chunks().to_numpy(zero_copy_only=False)[chunk[at]]
    total = np.zeros(len(first), np.int64)
    np.add.at(total, group, freq)
    some = at[first]
    phrase = _joined(words.cast(pa.string()), some, np.full(len(some), n))
    return pa.table({"lang": langs.cast(pa.string()).take(pa.array(lang[chunk[some]])), "phrase": phrase, "f": total})


def _counter(n: int, known: FrequentFilter | None, limit: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held):
            out = _count_slice(pa.Table.from_batches(held), n, known)
            return [] if out is None else out.to_batches(max_chunksize=1 << 15)

        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "chunk", limit):
                held.append(part)
                size += part.column("chunk").nbytes
                if size >= limit:
                    yield from done(held)
                    held, size = [], 0
        if held:
            yield from done(held)
    return run


def frequent_phrases(chunks: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f, size) of every phrase of 1 to ``longest`` words with f >= least, (lang, n) all words)."""
    found, known, totals = [], None, None
    for n in range(1, longest + 1):
        counts = chunks.mapInArrow(_counter(n, known), COUNTED).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        if n == 1:
            counts = materialize(counts, "word-counts")
            totals = materialize(counts.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
        level = materialize(counts.where(F.col("f") >= least).withColumn("size", F.lit(n)), f"phrases-{n}")
        found.append(level)
        if n < longest:
            known = FrequentFilter(level)
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, scale: int = 1000,
                 spread: int = 32, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language.

    Words are lower-cased (A-Z) runs without space and tab inside pieces, which
    end at ``. , ; : ! ?`` and line ends; f(phrase) counts all its contiguous
    occurrences within pieces.  Candidates have 2 to ``longest`` words (at most
    five) and a = f >= ``least``.  The cut with the least floor(scale * a * n / (l * r))
    counts (ties: the earliest).  A candidate inside a longer one with
    100 * f(longer) >= percent * a is dropped.  Order: score and a falling, phrase rising.

    A null text is empty, a null language is ``und``.  Whole texts are parsed; a long
    text without a trigger is one chunk, of at most its own length.  Repeated
    rows count as often as they stand.  Ids and other columns are not read, so
    they may have any name.  Empty tables give no rows.
    """
    if not 2 <= longest <= WINDOW + 1:
        raise ValueError(f"longest must lie in 2 to {WINDOW + 1}, got {longest}")
    chunks = parse(docs, text_col, lang_col, spread)
    phrases, totals = frequent_phrases(chunks, least, longest)
    cand = phrases.where(F.col("size") > 1).withColumn("w", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    split = cand.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    split = split.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"),
                         part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    f_of = lambda name, to: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(to))
    split = split.join(f_of("head", "l"), ["lang", "head"]).join(f_of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    split = split.withColumn("over", F.lit(scale).cast("decimal(5,0)") * F.col("a").cast("decimal(16,0)") * F.col("n").cast("decimal(16,0)"))
    split = split.withColumn("under", wide("l") * wide("r"))
    split = split.withColumn("score", F.expr("over div under"))
    best = split.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    # Parts of longer candidates, with the largest frequency of those.
    inner = cand.where(F.col("size") > 2).select("lang", "f", "w", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    inner = inner.select("lang", "f", "w", "m", F.explode(F.expr("sequence(1, size(w) - m + 1)")).alias("at"))
    inner = inner.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = (best.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("b.a") * percent)))
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("b.a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score"))
