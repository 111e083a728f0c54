"""Row control: gates, take-until, find, state across runs, keyed update, per-record functions."""

import pytest
from pyspark.sql import functions as F

from rivulet.operators.control import (
    GateError, find_first, find_first_in_array, gate, gate_inline, iteration_number, keyed_update,
    observe_counts, take_until, violations,
)
from rivulet.operators.ordering import offset_limit, with_row_index
from rivulet.operators.transform import last_values
from rivulet.operators.udf import apply_step, map_records, with_error_policy
from rivulet.sources.sql import incremental_read
from rivulet.state import StateTable
from tests.conftest import rows

ABC = [(1, 2, 3), (1, 3, 3), (4, 5, 6)]


def test_gate(spark):
    df = spark.createDataFrame(ABC, "a bigint, b bigint, c bigint")
    assert gate(df, F.lit(False)) is df
    with pytest.raises(GateError):
        gate(df, "a > 3")
    with pytest.raises(GateError):
        gate(df)
    assert violations(df, "a > 3").count() == 1
    assert violations(df, F.lit(None).cast("boolean")).count() == 3
    with pytest.raises(Exception):
        gate_inline(df, "b = 5").collect()


def test_take_until(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 9, 3, 9])], "k bigint, v bigint")
    assert rows(take_until(df, "v > 5", "k").orderBy("k"), "v") == [(1,), (2,)]
    assert take_until(df, "v > 100", "k").count() == 5


def test_find_first(spark):
    df = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (1, 2, "assistant"), (2, 0, "user")],
                               "conv bigint, turn bigint, role string")
    got = {r["conv"]: r["found"]["turn"] for r in find_first(df, "role = 'assistant'", "turn", "conv").collect()}
    assert got == {1: 1}
    arr = spark.createDataFrame([([1, 4, 6],), ([1],)], "xs array<int>")
    assert rows(arr.select(find_first_in_array("xs", lambda x: x > 3).alias("f"))) == [(4,), (None,)]


def test_set_variable_across_runs(spark, tmp):
    st = StateTable(spark, f"{tmp}/vars")
    df = spark.createDataFrame([(0, *r) for r in ABC], "i bigint, a bigint, b bigint, c bigint") \
        .withColumn("i", F.monotonically_increasing_id())
    batch = incremental_read(df, "b", st, name="b")
    batch.observed().write.format("noop").mode("overwrite").save()
    batch.commit()
    assert st.get("b") == 5
    again = incremental_read(df, "b", st, name="b")
    assert again.df.count() == 0
    more = spark.createDataFrame([(7,), (9,), (500,)], "b bigint")
    nxt = incremental_read(more, "b", st, name="b")
    assert nxt.df.count() == 3
    nxt.commit()
    assert st.get("b") == 500
    assert st.save({"b": 500}) is False  # unchanged value: no write


def test_set_variable_iso_strings(spark, tmp):
    st = StateTable(spark, f"{tmp}/iso")
    df = spark.createDataFrame([(1, "2022-01-01T01:02:03"), (2, "2022-01-03T01:02:03"), (3, "2022-01-02T01:02:03")],
                               "a bigint, createdAt string")
    mark = last_values(df, {"m": F.col("createdAt")}, F.col("createdAt")).first()["m"]
    st.save({"createdAt": mark})
    assert st.get("createdAt") == "2022-01-03T01:02:03"
    st.save({"createdAt": "2022-12-01T01:02:03"}, dry_run=True)
    assert st.get("createdAt") == "2022-01-03T01:02:03"


def test_iteration_and_row_index(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", (F.col("id") * 7919) % 1000)
    out = iteration_number(df, ["k", "id"])
    got = [r["iteration"] for r in out.orderBy("k", "id").collect()]
    assert got == list(range(1000))
    page = offset_limit(df, ["k", "id"], offset=10, limit=5)
    assert sorted(r["row_index"] for r in page.collect()) == [11, 12, 13, 14, 15]
    assert with_row_index(df.limit(0), ["id"]).count() == 0


def test_observe_counts(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "v bigint")
    obs_df, obs = observe_counts(df, "step", {"big": "v > 1"})
    assert obs_df.where("v > 1").count() == 2
    assert obs.get == {"rows": 3, "big": 2}


def test_keyed_update(spark):
    target = spark.createDataFrame([(1, "a", "x", "pw"), (2, "b", "y", "pw")], "id bigint, name string, city string, password string")
    upd = spark.createDataFrame([(1, "A1", None, 1), (1, "A2", None, 2), (9, "Z", "z", 1)],
                                "id bigint, name string, city string, ts bigint")
    out = {r["id"]: (r["name"], r["city"]) for r in keyed_update(target, upd, "id", ["name", "city"], "ts").collect()}
    assert out == {1: ("A2", "x"), 2: ("b", "y")}
    with pytest.raises(ValueError):
        keyed_update(target, upd, "id", ["password"])


def test_map_records_rules(spark):
    df = spark.createDataFrame([(1, "keep"), (2, "drop"), (3, "change")], "id bigint, act string")

    def fn(r):
        if r["act"] == "drop":
            return False
        if r["act"] == "keep":
            return None
        return {"id": r["id"], "act": "changed"}

    assert sorted(rows(map_records(df, fn, "id bigint, act string"))) == [(1, "keep"), (3, "changed")]


def test_error_policy(spark):
    df = spark.createDataFrame([(1,), (0,), (4,)], "k bigint")
    ok, errors = with_error_policy(df, lambda r: 8 / r["k"], "double", keep=["k"])
    assert sorted(rows(ok)) == [(1, 8.0), (4, 2.0)]
    assert rows(errors, "k") == [(0,)] and "ZeroDivisionError" in errors.first()["error"]
    ok2, _ = with_error_policy(df, lambda r: 8 / r["k"], "double", policy="abortflow", keep=["k"])
    with pytest.raises(Exception):
        ok2.collect()


def test_apply_step(spark):
    df = spark.range(3)
    assert apply_step(df, lambda d: d.where("id > 0")).count() == 2


def test_error_policy_shared_runs_once(spark):
    df = spark.createDataFrame([(1,), (0,), (4,)], "k bigint")
    ok, errors = with_error_policy(df, lambda r: 8 / r["k"], "double", keep=["k"], shared=True)
    assert ok.count() == 2 and errors.count() == 1


def test_udf_code_ships_by_value():
    from pyspark import cloudpickle
    import rivulet.operators.udf  # noqa: F401  (registers the package)
    assert "rivulet" in cloudpickle.list_registry_pickle_by_value()


def test_row_index_with_pruned_payload(spark):
    # payload columns that a downstream projection drops must not change the numbering
    df = spark.range(0, 20000, 1, 8).select(
        F.col("id"), ((F.col("id") * 7919) % 20000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pay"))
    out = with_row_index(df, ["k", "id"], num_partitions=8).select("k", "row_index")
    got = sorted((r["row_index"], r["k"]) for r in out.collect())
    assert [k for _, k in got] == sorted(k for _, k in got) and [i for i, _ in got] == list(range(1, 20001))
