"""Every registered query with an SQL oracle equals DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        # Zeros differ by sign, as in the driver's comparison.
        return "nan" if math.isnan(v) else "-0.0" if v == 0 and math.copysign(1, v) < 0 else round(v, 9) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in sorted(v.items()))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in (x.asDict(recursive=True) for x in df.collect())), key=repr)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    want = sorted((tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_every_query_has_rows_or_oracle(spark):
    names = set(E.queries())
    assert set(E.oracle_sql()) <= names
    assert len(names) >= 60


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["qid", "ndcg_10"]
    assert df.count() >= 0
