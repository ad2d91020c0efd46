"""Token-array columns (K3-K9): truncation, padding, masks, labels, first half."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_up(n: int, multiple: int | None) -> int:
    if not multiple:
        return int(n)
    return int(math.ceil(n / multiple) * multiple)


def truncate_append_eos(ids, max_len: int, append_eos: bool, eos_id: int) -> Column:
    """K3: keep ``max_len - 1`` ids and add EOS, or keep ``max_len`` ids."""
    if append_eos:
        return F.concat(F.slice(_c(ids), 1, max_len - 1), F.array(F.lit(eos_id)))
    return F.slice(_c(ids), 1, max_len)


def pad_to(ids, length, pad_id: int) -> Column:
    """Right-pad to ``length`` (an int or a Column)."""
    L = length if isinstance(length, Column) else F.lit(int(length))
    return F.concat(_c(ids), F.array_repeat(F.lit(pad_id), F.greatest(L - F.size(_c(ids)), F.lit(0)).cast("int")))


def pad_fixed(ids, max_len: int, pad_id: int, multiple: int | None = 16) -> Column:
    """K4: pad to ``max_len`` rounded up to ``multiple`` (157 -> 160)."""
    return pad_to(ids, round_up(max_len, multiple), pad_id)


def attention_mask(n_real, length) -> Column:
    """K6: ones for real tokens, zeros for padding."""
    n = _c(n_real)
    L = length if isinstance(length, Column) else F.lit(int(length))
    return F.concat(F.array_repeat(F.lit(1), n.cast("int")),
                    F.array_repeat(F.lit(0), F.greatest(L - n, F.lit(0)).cast("int")))


def lm_labels(ids, pad_id: int) -> Column:
    """K7: copy of ids with every pad id replaced by -100 (EOS too when pad = EOS)."""
    return F.transform(_c(ids), lambda x: F.when(x == pad_id, F.lit(IGNORE)).otherwise(x))


def half_length(ids, eos_id: int, ratio: float = 0.5) -> Column:
    """Length of the first half: int(n * ratio) after removing one trailing EOS."""
    a = _c(ids)
    n = F.size(a) - F.when(F.element_at(a, -1) == eos_id, 1).otherwise(0)
    return F.floor(n * F.lit(float(ratio))).cast("int")


def first_half(ids, eos_id: int, ratio: float = 0.5) -> Column:
    """K8: strip one trailing EOS, keep int(n * ratio) ids, always append EOS."""
    return F.concat(F.slice(_c(ids), 1, half_length(ids, eos_id, ratio)), F.array(F.lit(eos_id)))


def first_half_mask(ids, eos_id: int, length, ratio: float = 0.5) -> Column:
    """K9: ones for the half, zeros up to ``length`` (the LM view's padded length)."""
    return attention_mask(half_length(ids, eos_id, ratio), length)
