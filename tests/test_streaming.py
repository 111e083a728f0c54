"""Event queue through Structured Streaming: consume once, dry run, fan-out, running last value."""

import pytest
from rivulet.streaming.queue import capture, drain, last_value_per_key, run_available_now

SCHEMA = "id bigint, flow bigint, name string, payload string, ts bigint"


def _queue(spark, path, start, n):
    spark.createDataFrame([(i, i % 2, "created" if i % 3 else "deleted", f'{{"n": {i}}}', i) for i in range(start, start + n)],
                          SCHEMA).write.mode("append").parquet(path)


def test_drain_consumes_once_and_dry_run(spark, tmp):
    q, ck = f"{tmp}/q", f"{tmp}/ck"
    _queue(spark, q, 0, 6)
    drain(spark.readStream.schema(SCHEMA).parquet(q), f"{tmp}/dry", ck, dry_run=True)
    drain(spark.readStream.schema(SCHEMA).parquet(q), f"{tmp}/out", ck)
    assert spark.read.parquet(f"{tmp}/out").count() == 6
    drain(spark.readStream.schema(SCHEMA).parquet(q), f"{tmp}/out", ck)
    assert spark.read.parquet(f"{tmp}/out").count() == 6
    _queue(spark, q, 6, 3)
    drain(spark.readStream.schema(SCHEMA).parquet(q), f"{tmp}/out", ck)
    assert spark.read.parquet(f"{tmp}/out").count() == 9


def test_capture_fans_out(spark, tmp):
    q = f"{tmp}/q2"
    _queue(spark, q, 0, 6)
    listeners = spark.createDataFrame([(100, 1, "created"), (200, 2, "created"), (300, 3, "deleted")],
                                      "dataflowid bigint, stepid bigint, eventname string")
    out = f"{tmp}/cap"
    drain(capture(spark.readStream.schema(SCHEMA).parquet(q), listeners, name_col="name", payload_col="payload"),
          out, f"{tmp}/ck2")
    got = spark.read.parquet(out)
    assert got.count() == 4 * 2 + 2 * 1
    assert got.where("stepid = 3").count() == 2


def test_last_value_stream(spark, tmp):
    q = f"{tmp}/q3"
    _queue(spark, q, 0, 10)
    sink = f"{tmp}/lv"

    def w(df, _):
        df.write.mode("overwrite").parquet(sink)

    run_available_now(last_value_per_key(spark.readStream.schema(SCHEMA).parquet(q), "flow", "id", ["ts"]),
                      f"{tmp}/ck3", w, output_mode="complete")
    got = {r["flow"]: (r["events"], r["last_value"]) for r in spark.read.parquet(sink).collect()}
    assert got == {0: (5, 8), 1: (5, 9)}


def test_bad_policy(spark, tmp):
    with pytest.raises(ValueError):
        run_available_now(spark.readStream.schema(SCHEMA).parquet(tmp), f"{tmp}/c", lambda d, i: None, policy="later")


def test_immediate_policy_runs_until_stopped(spark, tmp):
    q = f"{tmp}/q4"
    _queue(spark, q, 0, 4)
    seen = []
    run = run_available_now(spark.readStream.schema(SCHEMA).parquet(q), f"{tmp}/ck4",
                            lambda df, i: seen.append(df.count()), policy="immediately")
    try:
        run.processAllAvailable()
        assert run.isActive and sum(seen) == 4
    finally:
        run.stop()


def test_update_mode_upsert_log(spark, tmp):
    from rivulet.streaming.queue import read_latest, upsert_log
    q, sink, ck = f"{tmp}/q5", f"{tmp}/ul", f"{tmp}/ck5"
    _queue(spark, q, 0, 6)
    agg = lambda: last_value_per_key(spark.readStream.schema(SCHEMA).parquet(q), "flow", "id", ["ts"])
    run_available_now(agg(), ck, upsert_log(sink, "flow"), output_mode="update")
    _queue(spark, q, 6, 1)  # only flow 0 changes
    run_available_now(agg(), ck, upsert_log(sink, "flow"), output_mode="update")
    got = {r["flow"]: (r["events"], r["last_value"]) for r in read_latest(spark, sink, "flow").collect()}
    assert got == {0: (4, 6), 1: (3, 5)}


def test_capture_salted_equals_plain(spark):
    ev = spark.createDataFrame([(i, i % 2, "created" if i % 3 else "deleted", "{}", i) for i in range(30)], SCHEMA)
    listeners = spark.createDataFrame([(0, 1, "created"), (1, 2, "created"), (0, 3, "deleted")],
                                      "dataflowid bigint, stepid bigint, eventname string")
    a = capture(ev, listeners, "name", "payload", flow_col="flow")
    b = capture(ev, listeners, "name", "payload", flow_col="flow", salt_buckets=4)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert a.count() == 25  # 20 "created" (one listener per flow) + 5 "deleted" in flow 0
