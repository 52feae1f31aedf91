"""Every registered query against its DuckDB twin (the driver's gate, on sf0.001)."""
import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

ORACLE = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rel = duck(SF_SMALL).sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    a = _canon([tuple(r) for r in df.collect()], df.columns)
    b = _canon(rel.fetchall(), rel.columns)
    assert a == b


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "date_break" in df.columns
