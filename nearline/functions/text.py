"""Text formatting columns (P1-P3, P7) and word extraction (B1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII whitespace trimmed by the formatting operators, and the
# word pattern of the lexical analyzer.
WS_CLASS = r"[\t\n\x0B\f\r ]"
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(col) -> Column:
    """Remove leading and trailing ASCII whitespace."""
    return F.regexp_replace(_c(col), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def format_query(query, prefix: str = "") -> Column:
    """strip(prefix + strip(query))."""
    return strip_ws(F.concat(F.lit(prefix), strip_ws(query)))


def format_passage(text, title=None, prefix: str = "") -> Column:
    """strip(prefix + strip(title) + ' ' + strip(text)); a missing title is ''."""
    t = F.lit("") if title is None else F.coalesce(_c(title), F.lit(""))
    return strip_ws(F.concat(F.lit(prefix), strip_ws(t), F.lit(" "), strip_ws(text)))


def add_prefix(col, prefix: str, enabled: bool = True) -> Column:
    """Raw concatenation, no stripping."""
    return F.concat(F.lit(prefix), _c(col)) if enabled else _c(col)


def concat_title(text, title) -> Column:
    """Title + ' ' + text, no stripping; null if either side is null."""
    return F.concat(_c(title), F.lit(" "), _c(text))


def words(col) -> Column:
    """Lower-cased words of two or more letters, digits or underscores, in order."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_PATTERN), 0)


def first_half_applies(src, excluded=("stackoverflow",)) -> Column:
    """P5: the first-half query view is used unless the batch source is excluded."""
    return ~_c(src).isin(list(excluded))
