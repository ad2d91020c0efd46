"""Vector arithmetic on ARRAY<FLOAT|DOUBLE> columns.

Higher-order functions are evaluated in double precision.  They are not
code-generated, so the numpy block operators are the scale path for scoring
many pairs; these helpers serve per-row work (normalisation, in-batch pairs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(v, eps: float = 1e-12) -> Column:
    """v / max(||v||, eps); a zero vector stays zero.

    Lambda arguments hold the vector and its norm, which are so evaluated once and not for each component.
    """
    scaled = lambda a: F.transform(F.array(F.greatest(norm(a), F.lit(eps))), lambda n: F.transform(a, lambda x: x / n))[0]
    return F.transform(F.array(as_double(v)), scaled)[0]


def cosine(a, b) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def scale(v, factor) -> Column:
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(as_double(v), lambda x: x * f)
