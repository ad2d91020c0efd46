"""Words of a bounded slice of documents as dictionary codes, by Arrow's string functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts hold about ``limit`` bytes; a longer text stands alone.

    The parts are copies: ``ascii_lower`` and others misread a large string array cut from another.
    """
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(size) // limit
    turns = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(size)] if len(size) else np.zeros(1, int)
    for lo, hi in zip(turns[:-1], turns[1:]):
        yield batch.take(pa.array(np.arange(lo, hi)))


def split_words(texts: pa.Array, separators: str, pattern: bool) -> tuple[np.ndarray, pa.Array]:
    """(words of each text, all words one after another); null and empty texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.split_pattern_regex(texts, separators) if pattern else pc.split_pattern(texts, separators)
    words, ends = lists.flatten(), lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
    real = pc.not_equal(words, "")
    upto = np.cumsum(real.to_numpy(zero_copy_only=False))
    kept = np.r_[0, upto][ends] if len(ends) else np.zeros(0, np.int64)
    return np.diff(np.r_[0, kept]), words.filter(real)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, the distinct words)."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1 ... (sizes[i] numbers), one range after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
