"""Tables whose changes rewrite only touched files; queue source and stream numbers."""

import pytest

from rivulet.operators.filetable import create_table, delete_from_table, read_table, table_files, update_table


def files(spark, path, v=None):
    return {r["file"] for r in table_files(spark, path, v).collect()}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_only_touched_files_are_rewritten(spark, tmp):
    df = spark.createDataFrame([(i, f"v{i}", i % 3) for i in range(100)] + [(None, "none", 0)], "k int, v string, w int")
    path = f"{tmp}/t"
    assert create_table(df, path, "k", "k DIV 10") == 1
    before = files(spark, path)
    assert len(before) == 11
    up = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (57, None, 1), (1000, "x", 1), (None, "y", 1)], "k int, v string, n int")
    assert update_table(spark, path, up, "k", ["v"], "n") == 2
    after = files(spark, path)
    assert len(before & after) == 9 and not after - before <= before
    want = {(i, {5: "b", 57: None}.get(i, f"v{i}"), i % 3) for i in range(100)} | {(None, "none", 0)}
    assert set(rows(read_table(spark, path))) == want
    assert rows(read_table(spark, path, 1)) == rows(df)
    assert delete_from_table(spark, path, spark.createDataFrame([(20,), (21,), (None,)], "k int"), "k") == 3
    assert {r for r in want if r[0] not in (20, 21)} == set(rows(read_table(spark, path)))
    assert len(before & files(spark, path)) == 8


def test_nothing_to_change_makes_no_version(spark, tmp):
    df = spark.createDataFrame([(1, "a"), (9, "b")], "k int, v string")
    path = f"{tmp}/t"
    create_table(df, path, "k")
    none = spark.createDataFrame([(5, "x")], "k int, v string")
    assert update_table(spark, path, none, "k", ["v"]) == 1 == delete_from_table(spark, path, none.limit(0), "k")
    assert delete_from_table(spark, path, df, "k") == 2 and read_table(spark, path).count() == 0
    with pytest.raises(ValueError):
        create_table(df, path, "k")
    with pytest.raises(ValueError):
        read_table(spark, f"{tmp}/absent")


def test_queue_offsets_and_partitions(spark, tmp):
    from rivulet.streaming.source import _QueueReader
    schema = spark.createDataFrame([], "id bigint, v string").schema
    reader = _QueueReader(schema, {"path": f"{tmp}/q", "rowsperpartition": "10"})
    assert reader.initialOffset() == reader.latestOffset() == {"id": -1}
    for ids in (range(25), range(1000, 1003)):
        spark.createDataFrame([(i, f"v{i}") for i in ids], schema).repartition(2).write.mode("append").parquet(f"{tmp}/q")
    assert reader.latestOffset() == {"id": 1002}
    take = lambda a, b: sorted(i for p in reader.partitions({"id": a}, {"id": b}) for batch in reader.read(p) for i in batch.column(0).to_pylist())
    assert take(-1, 1002) == [*range(25), 1000, 1001, 1002] and take(3, 12) == list(range(4, 13)) and take(24, 999) == []
    assert len(reader.partitions({"id": -1}, {"id": 1002})) < 12


def test_stream_numbers_go_on_over_runs(spark, tmp):
    from rivulet.streaming.source import numbered, queue_stream
    schema = "id bigint, k string, v double"
    data = [(i, None if i % 7 == 0 else "ab"[i % 2], None if i % 5 == 0 else float(i)) for i in range(60)]
    for run in range(3):
        spark.createDataFrame(data[run * 20:run * 20 + 20], schema).repartition(2).write.mode("append").parquet(f"{tmp}/q")
        out = numbered(queue_stream(spark, f"{tmp}/q", schema), "k", "id", "v")
        out.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/c").trigger(availableNow=True).start().awaitTermination()
    seen, want = {}, []
    for i, k, v in data:
        n, last = seen.get(k, (0, None))
        want.append((i, n, last))
        seen[k] = (n + 1, None if v is None else str(v))
    assert sorted((r.id, r.iteration, r.previous) for r in spark.read.parquet(f"{tmp}/out").collect()) == want
