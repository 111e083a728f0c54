"""Driver contract: entry(), and every registered query against its DuckDB twin on sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from rivulet.plans.registry import TABLES
from tests.conftest import SF_SMALL

# the optional package has its own tests
QUERIES = {k: v for k, v in E.queries().items() if k not in E.LLM_QUERIES and k != "pipeline"}
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


def _norm(v):
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["event_id", "user_id", "event_type", "value", "value_x2", "tag", "branch", "bonus"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    if name not in ORACLES:
        assert got is not None
        return
    rel = duck.execute(ORACLES[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(ocols) == cols
    idx = sorted(range(len(ocols)), key=lambda i: ocols[i])
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == exp
