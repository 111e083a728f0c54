"""SQL reader, binding, optional fragments, incremental reads and lookups."""

import pytest
from rivulet.operators.sqlstep import dml_delete, dml_insert, lookup, sql_once
from rivulet.sources.sql import bind_params, incremental_read, optional_fragments, sql_read
from rivulet.state import StateTable
from tests.conftest import rows


@pytest.fixture()
def config_rows(spark):
    return spark.createDataFrame([("test", f"test_{i}", i) for i in range(1, 11)], "plugin string, name string, value bigint")


def test_sql_reader_with_table_placeholder(spark, config_rows):
    out = sql_read(spark, "SELECT name FROM {cfg} WHERE value <= 2", {"cfg": config_rows})
    assert sorted(r[0] for r in out.collect()) == ["test_1", "test_2"]


def test_bound_parameters(spark, config_rows):
    out = sql_read(spark, "SELECT name FROM {cfg} WHERE value > :v AND plugin = :p", {"cfg": config_rows},
                   {"v": 8, "p": "test"})
    assert out.count() == 2


@pytest.mark.parametrize("bad", [[1, 2, 3], True, 1.5, {"a": 1}])
def test_parameter_types(bad):
    with pytest.raises(TypeError):
        bind_params({"x": bad})


def test_optional_fragments():
    q = "SELECT * FROM t WHERE 1=1 [[AND a = :a]] [[AND b = :b]] [[AND c = :c]]"
    assert optional_fragments(q, {"a": 0, "b": "", "c": None}) == "SELECT * FROM t WHERE 1=1 AND a = :a  "


def test_incremental_marks_and_dry_run(spark, tmp, config_rows):
    st = StateTable(spark, f"{tmp}/state")
    marks = []
    for _ in range(3):
        batch = incremental_read(config_rows, "value", st, limit=3)
        assert batch.observed().count() == 3
        batch.commit()
        marks.append(st.get("value"))
    assert marks == [3, 6, 9]
    dry = incremental_read(config_rows, "value", st, limit=3, dry_run=True)
    assert rows(dry.df, "value") == [(10,)]
    assert dry.commit() is False and st.get("value") == 9
    last = incremental_read(config_rows, "value", st, limit=3)
    last.commit()
    empty = incremental_read(config_rows, "value", st, limit=3)
    assert empty.df.count() == 0 and empty.commit() is False and st.get("value") == 10


def test_mark_is_last_row_not_max(spark, tmp):
    df = spark.createDataFrame([(1, 30), (2, 10), (3, 20)], "id bigint, v bigint")
    st = StateTable(spark, f"{tmp}/s")
    b = incremental_read(df, "v", st, order_by="id")
    b.commit()
    assert st.get("v") == 20


def test_lookup_zero_one_many(spark):
    recs = spark.createDataFrame([(i,) for i in range(1, 6)], "id bigint")
    table = spark.createDataFrame([(2, "b"), (3, "c1"), (3, "c2"), (4, "d")], "ref bigint, val string")
    out = {r["id"]: (r["count"], r["data"]["val"] if r["data"] else None)
           for r in lookup(recs, table, {"id": "ref"}).collect()}
    assert out == {1: (0, None), 2: (1, "b"), 3: (2, None), 4: (1, "d"), 5: (0, None)}


def test_lookup_bad_sql(spark):
    with pytest.raises(Exception):
        sql_read(spark, "SELEC nonsense").collect()


def test_sql_once_and_dml(spark, config_rows):
    one = sql_once(spark, "SELECT max(value) AS m FROM {cfg}", {"cfg": config_rows}).first()
    assert one["count"] == 1 and one["data"]["m"] == 10
    many = sql_once(spark, "SELECT value FROM {cfg}", {"cfg": config_rows}).first()
    assert many["count"] == 10 and many["data"] is None
    added = dml_insert(config_rows, config_rows.where("value = 1"))
    assert added.count() == 11
    keys = spark.createDataFrame([(1,), (2,)], "value bigint")
    assert dml_delete(config_rows, keys, "value").count() == 8


def test_incremental_timestamp_counter(spark, tmp):
    import datetime as dt
    rows_ = [(i, dt.datetime(2024, 1, 1, 0, 0, i)) for i in range(5)]
    df = spark.createDataFrame(rows_, "id bigint, ts timestamp_ntz")
    st = StateTable(spark, f"{tmp}/ts")
    first = incremental_read(df, "ts", st, limit=3)
    assert first.df.count() == 3
    first.commit()
    assert st.get("ts") == "2024-01-01T00:00:02"
    second = incremental_read(df, "ts", st)
    assert sorted(r["id"] for r in second.df.collect()) == [3, 4]
