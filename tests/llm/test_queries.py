import duckdb
import pytest

import __spark_entry__ as E
from rivulet.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    rel = con.execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    got = QUERIES[name](spark, SF_SMALL)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = QUERIES[name](spark, SF_SMALL)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert set(ids) == {r.doc_id for r in docs.select("doc_id").collect()}
    if name != "op3_packing":
        assert len(ids) == docs.count()
