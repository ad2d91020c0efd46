"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot has one 64-bit word for
every 64 languages, in which each language has its own bit.  Looking up an n-gram
ands the words at its ``HASHES`` slots, and the result is the mask of all languages
whose filter contains it.  For a text the masks of its n-grams are counted per
language (popcount of each bit slice); each count is corrected by that
language's false-positive rate, fill ** HASHES, and the largest corrected share
decides.

n-grams are ``gram`` bytes of the UTF-8 text with A-Z in lower case, digits,
ASCII symbols and white space runs folded to one separator per byte.  A
language's filter holds the n-grams that are typical of it: at least
``least_count`` times in its training sample and at a rate of at least ``ratio``
of the best language's rate.  The size of the filter is set by parameters and the
number of languages, so it travels with the task whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nearline.llm import bytearrays as B
from nearline.session import materialize

HASHES = 3
SMALL = 1 << 18  # bytes of text that a task works on at once when it predicts
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:65] = 32
FOLD[65:91] += 32
FOLD[91:97] = 32
FOLD[123:128] = 32


def grams(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of each document (bordered by separators), and n-gram offsets by document.

    n-grams that span two separators in a row say nothing and are left out.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    starts = offsets[:-1] + 2 * np.arange(n) + 1
    padded = np.full(len(data) + 2 * n, 32, dtype=np.uint8)
    inside = np.ones(len(padded), dtype=bool)
    inside[starts - 1] = False
    inside[starts + lengths] = False
    padded[inside] = FOLD[data]
    value = np.zeros(max(0, len(padded) - size + 1), dtype=B.U64)
    for i in range(size):
        value = (value << B.U64(8)) | padded[i:i + len(value)]
    blank = padded == 32
    double = np.r_[0, np.cumsum(blank[1:] & blank[:-1])]  # document borders are two separators in a row
    keep = double[size - 1:size - 1 + len(value)] == double[:len(value)]
    at = np.flatnonzero(keep)
    return B.mix(value[at]), np.searchsorted(at, np.r_[starts - 1, len(padded)])


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    words: np.ndarray  # uint64, a power of two of them for every 64 languages
    gram: int
    prior: str  # the language of most training rows

    def size(self) -> int:
        return len(self.words) // max(1, -(-len(self.languages) // 64))

    def slots(self, hashes: np.ndarray, k: int, size: int | None = None) -> np.ndarray:
        step = (hashes >> B.U64(32)) | B.U64(1)
        return ((hashes + B.U64(k) * step) & B.U64((size or self.size()) - 1)).astype(np.int64)

    def masks(self, hashes: np.ndarray, group: int = 0) -> np.ndarray:
        """Which of the languages 64 * group and up contain each n-gram."""
        words = self.words[group * self.size():(group + 1) * self.size()]
        got = words[self.slots(hashes, 0)]
        for k in range(1, HASHES):
            got &= words[self.slots(hashes, k)]
        return got

    def false_positives(self) -> np.ndarray:
        words = self.words.reshape(-1, self.size())
        return np.array([np.mean((words[i // 64] >> B.U64(i % 64)) & B.U64(1)) ** HASHES for i in range(len(self.languages))])

    def shares(self, data: np.ndarray, offsets: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each document's n-grams that each language contains (documents x languages), and n-gram counts.

        ``wrong`` are the false positives.
        """
        hashes, at = grams(data, offsets, self.gram)
        n = np.diff(at)
        out = np.zeros((len(n), len(self.languages)))
        for i in range(len(self.languages)):
            if i % 64 == 0:
                masks = self.masks(hashes, i // 64)
            total = np.r_[0, np.cumsum((masks >> B.U64(i % 64)) & B.U64(1), dtype=np.int64)]
            hits = total[at[1:]] - total[at[:-1]]
            if wrong[i] < 1:
                out[:, i] = (hits / np.maximum(n, 1) - wrong[i]) / (1 - wrong[i])
        return np.clip(out, 0, 1), n


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          sample_rows: int = 2000, gram: int = 5, least_count: int = 3, ratio: float = 0.2,
          fill: float = 0.25, slots: int = 1 << 16) -> LanguageFilter:
    """Fit the filter on at most ``sample_rows`` rows of each language (those of least id hash).

    Rows with a null text, or whose language is null or ``und``, teach nothing.  Every other
    language is learned, with all of its typical n-grams: the filter has ``slots`` slots, or as many
    more as keep at most a share ``fill`` of them set for any language.
    """
    rows = labelled.where((F.col(lang_col) != "und") & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(3), id_col).alias("at"), F.col(text_col).cast("binary").alias("body"))
    counts = sorted(rows.groupBy("lang").count().collect(), key=lambda r: r["lang"])
    if not counts:
        return LanguageFilter((), np.zeros(1, B.U64), gram, "und")
    languages = tuple(r["lang"] for r in counts)
    # The share of each language's hash range that holds about sample_rows rows.
    limits = [(r["lang"], i, int(-(2**63) + 2**64 * min(1.0, 1.5 * sample_rows / r["count"])) - 1) for i, r in enumerate(counts)]
    limits = labelled.sparkSession.createDataFrame(limits, "lang string, l int, most long")
    ranked = (rows.join(F.broadcast(limits), "lang").where(F.col("at") <= F.col("most"))
              .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("at", F.xxhash64("body"))))
              .where(F.col("n") <= sample_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("l").to_numpy()
            data, offsets = B.binary_block(batch.column("body"))
            for i, j in B.chunks(offsets):
                h, at = grams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], gram)
                owner = np.repeat(langs[i:j], np.diff(at))
                for l in np.unique(owner):
                    g, n = np.unique(h[owner == l], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"l": np.full(len(g), l, np.int32), "gram": g.view(np.int64), "n": n})

    seen = materialize(ranked.select("l", "body").mapInArrow(count, "l int, gram long, n long")
                       .groupBy("gram", "l").agg(F.sum("n").alias("n")), "language-grams")
    total = {r["l"]: r["n"] for r in seen.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    totals = labelled.sparkSession.createDataFrame([(i, float(max(1, total.get(i, 0)))) for i in range(len(languages))], "l int, total double")
    rates = seen.join(F.broadcast(totals), "l").withColumn("rate", F.col("n") / F.col("total"))
    own = (rates.withColumn("best", F.max("rate").over(Window.partitionBy("gram")))
           .where((F.col("n") >= least_count) & (F.col("rate") >= ratio * F.col("best"))).select("l", "n", "gram"))
    own = materialize(own, "language-typical")
    most = own.groupBy("l").count().agg(F.max("count")).first()[0] or 0
    slots = max(slots, 1 << (int(HASHES * most / fill) - 1).bit_length() if most else 0)
    words = np.zeros(slots * -(-len(languages) // 64), B.U64)
    model = LanguageFilter(languages, words, gram, max(counts, key=lambda r: r["count"])["lang"])
    empty = LanguageFilter(languages, words[:0], gram, model.prior)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l, h = batch.column("l").to_numpy().astype(np.int64), batch.column("gram").to_numpy().view(B.U64)
            for k in range(HASHES):
                yield pa.RecordBatch.from_pydict({"slot": empty.slots(h, k, slots) + l // 64 * slots,
                                                  "mask": (B.U64(1) << (l % 64).astype(B.U64)).view(np.int64)})

    bits = own.select("l", "gram").mapInArrow(places, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    words[bits.column("slot").to_numpy()] = bits.column("mask").to_numpy().view(B.U64)
    return model


def predict(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input column and lang_pred, lang_score (0 to 1); input columns with those names are replaced.

    A null text, or one without a letter, is ``und`` with score 0.  A text whose
    n-grams no language contains gets the language of most training rows, score
    0.  Equal shares go to the first language by name.  A model without
    languages calls everything ``und``.  Empty tables give no rows.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    base = docs.select(*[F.col(f"`{c}`") for c in names])
    body, letters = (next(n for n in (stem + "_" * k for k in range(len(names) + 1)) if n not in names)
                     for stem in ("__lang_body", "__lang_letters"))
    plain = text_col in names and docs.schema[text_col].dataType == StringType()  # its bytes are read in place, not sent twice
    body = text_col if plain else body
    work = (base if plain else base.withColumn(body, F.col(text_col).cast("binary"))).withColumn(
        letters, F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    held = model
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", lang_pred string, lang_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong = held.false_positives()
        for batch in batches:
            data, offsets = B.binary_block(batch.column(body).cast(pa.binary()))
            letter = batch.column(letters).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in B.chunks(offsets, SMALL):  # small batches go back, so a task holds few texts at once
                pred, score = np.full(j - i, "und", dtype=object), np.zeros(j - i)
                if held.languages:
                    share, _ = held.shares(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], wrong)
                    some = share.sum(axis=1) > 0
                    pred = np.where(some, np.array(held.languages, dtype=object)[share.argmax(axis=1)], held.prior)
                    score = np.where(some, share.max(axis=1), 0.0)
                pred[~letter[i:j]], score[~letter[i:j]] = "und", 0.0
                cols = [batch.column(c).slice(i, j - i) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "lang_score"])

    return work.mapInArrow(run, schema)
