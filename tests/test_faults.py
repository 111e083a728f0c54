"""Cases that once gave wrong rows without an error, and bounded batches and walks."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.functions.vocab import date_text
from rivulet.operators.graph import reachable
from rivulet.operators.history import schedule_retry_update
from rivulet.operators.joins import salted_join
from rivulet.sinks.writers import concat_skip_headers, write_json_array
from rivulet.sources.csv import read_csv
from rivulet.sources.sql import incremental_keyset, incremental_read
from rivulet.state import StateTable


def test_rows_without_a_counter_come_with_the_first_run(spark, tmp):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 7), (5, 6)], "id int, c int")
    st = StateTable(spark, f"{tmp}/s")
    b = incremental_read(df, "c", st, limit=2)
    assert sorted(r.id for r in b.df.collect()) == [1, 2, 3, 5]
    b.commit()
    assert st.get("c") == 6 and [r.id for r in incremental_read(df, "c", st).df.collect()] == [4]
    only = incremental_read(df.where("c IS NULL"), "c", StateTable(spark, f"{tmp}/n"))
    assert only.df.count() == 2 and only.new_mark() is None


@pytest.mark.parametrize("kind", ["int", "date", "decimal(10,2)", "timestamp", "string"])
def test_keyset_batches_read_each_row_once(spark, tmp, kind):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 1, 1, 1, 1, rnd.randint(0, 9)])) for i in range(200)]
    rnd.shuffle(rows)
    c = {"date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("c")), "timestamp": F.timestamp_seconds(F.col("c") * 1.5)}.get(kind, F.col("c").cast(kind))
    df = spark.createDataFrame(rows, "id int, c int").withColumn("c", c)
    st, got = StateTable(spark, f"{tmp}/s"), []
    for _ in range(20):
        b = incremental_keyset(df, "c", "id", st, 30)
        part = [r.id for r in b.df.collect()]
        assert len(part) <= 30
        got += part
        assert incremental_keyset(df, "c", "id", st, 30, dry_run=True).commit() is False
        if not b.commit():
            break
    assert sorted(got) == list(range(200)) and len(got) == 200
    assert incremental_keyset(df.limit(0), "c", "id", StateTable(spark, f"{tmp}/e"), 5).df.count() == 0
    with pytest.raises(ValueError):
        incremental_keyset(df, "c", "id", st, 0)


def test_json_array_by_a_column_with_repeats_and_nulls(spark, tmp):
    import glob
    import json
    rows = [(None, 1), (None, 2), (3, 3), (3, 4), (9, 5), (9, 6)]
    write_json_array(spark.createDataFrame(rows, "k int, v int"), f"{tmp}/a", "k")
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp}/a/part-*")))
    got = [(r.get("k"), r["v"]) for r in json.loads(text)]
    assert sorted(got, key=repr) == sorted(rows, key=repr) and [k for k, _ in got] == [None, None, 3, 3, 9, 9]
    write_json_array(spark.createDataFrame([(None, 1)], "k int, v int"), f"{tmp}/b", "k")
    assert json.loads("".join(open(f).read() for f in glob.glob(f"{tmp}/b/part-*"))) == [{"v": 1}]


def test_concat_keeps_the_order_given(spark, tmp_path):
    for d in "az":
        (tmp_path / d).mkdir()
        (tmp_path / d / "part").write_text(f"head {d}\n1{d}\n2{d}\n")
    lines = lambda paths, **o: [r.line for r in concat_skip_headers(spark, paths, **o).orderBy("file_no", "block", "line_no").collect()]
    z, a = f"{tmp_path}/z/part", f"{tmp_path}/a/part"
    assert lines([z, a]) == ["head z", "1z", "2z", "1a", "2a"]
    assert lines([f"{tmp_path}/z/*", f"{tmp_path}/a/*"]) == ["head z", "1z", "2z", "1a", "2a"]
    assert lines([a, z], target_exists=True) == ["1a", "2a", "1z", "2z"]
    assert lines([z, z]) == ["head z", "1z", "2z", "1z", "2z"]


def test_salts_do_not_hang_on_the_order_of_rows(spark):
    """A task that runs again with its rows in another order gives each the same salt, so none is lost or doubled."""
    rows = [(i, 0, {"m": i}) for i in range(400)]
    small = spark.createDataFrame([(0, "x")], "k int, v string")
    salts = []
    for order in (1, -1):
        big = spark.createDataFrame(rows[::order], "id int, k int, m map<string,int>").coalesce(1)
        plan = salted_join(big, small, ["k"], "left", 8)
        assert plan.count() == 400 and plan.columns == ["k", "id", "m", "v"]
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "rand(" not in text and "xxhash64" in text
        salts.append({r.id: r.s for r in big.select("id", F.pmod(F.xxhash64("id", "k", F.spark_partition_id()), F.lit(8)).alias("s")).collect()})
    assert salts[0] == salts[1] and len(set(salts[0].values())) == 8


def test_csv_of_no_bytes(spark, tmp_path):
    (tmp_path / "f.csv").write_text("")
    assert read_csv(spark, str(tmp_path)).count() == 0
    assert [d.count() for d in read_csv(spark, str(tmp_path), continue_on_error=True, row_numbers=True)] == [0, 0]


def test_two_failures_of_one_step_are_one_retry(spark):
    s = spark.createDataFrame([(1, 1, 100, 0), (2, 2, 50, 1)], "dataflowid int, stepid int, nextruntime int, retrycount int")
    f = spark.createDataFrame([(1, 1, 110, 200), (1, 1, 120, 210)], "dataflowid int, stepid int, retrytime int, scheduledtime int")
    got = schedule_retry_update(s, f, 1).select("dataflowid", "nextruntime", "retrycount").collect()
    assert sorted(map(tuple, got)) == [(1, 120, 1), (2, 50, 1)]


def test_date_letters_of_the_zone(spark):
    df = spark.createDataFrame([(0,), (1720000000,), (1704067200,), (82799,)], "t bigint")
    read = lambda: [r[0] for r in df.select(date_text("t", "B I Z")).collect()]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        assert read() == ["041 0 0", "449 0 0", "041 0 0", "999 0 0"]
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert [x.split()[1:] for x in read()] == [["0", "-18000"], ["1", "-14400"], ["0", "-18000"], ["0", "-18000"]]
        spark.conf.set("spark.sql.session.timeZone", "Australia/Sydney")
        assert [x.split()[1:] for x in read()][1:3] == [["0", "36000"], ["1", "39600"]]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_walk_with_cycles_and_copies(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (3, 4), (9, 1), (None, 5), (4, None), (4, 4)]
    df = spark.createDataFrame(edges, "src int, dst int")
    start = spark.createDataFrame([(1,), (1,), (None,)], "node int")
    assert sorted(map(tuple, reachable(df, start).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert reachable(df, start.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        reachable(df, start, max_rounds=2)
