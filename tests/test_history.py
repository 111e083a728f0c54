"""Run history, queue and schedule queries on the reference's table fixtures."""

from rivulet.operators import history as H
from tests.conftest import rows

SCHED = "dataflowid bigint, stepid bigint, lastruntime bigint, nextruntime bigint, retrycount int"


def test_schedule_due(spark):
    s = spark.createDataFrame([(23, 1, 123, 150, 0), (24, 2, 123, 151, 0), (25, 3, 123, 152, 0), (26, 4, 123, 153, 0)], SCHED)
    assert sorted(r[0] for r in H.schedule_due(s, 152).collect()) == [23, 24, 25]


def test_schedule_retry_sequence(spark):
    s = spark.createDataFrame([(1, 1, 1, 123, 0)], SCHED)
    fail = spark.createDataFrame([(1, 1, 444, 555)], "dataflowid bigint, stepid bigint, retrytime bigint, scheduledtime bigint")
    s0 = H.schedule_retry_update(s, fail, allowed=0).first()
    assert (s0["nextruntime"], s0["retrycount"]) == (555, 0)
    seen = []
    cur = s
    for _ in range(3):
        cur = spark.createDataFrame(H.schedule_retry_update(cur, fail, allowed=2).collect(), SCHED)
        r = cur.first()
        seen.append((r["nextruntime"], r["retrycount"]))
    assert seen == [(444, 1), (444, 2), (555, 0)]
    other = spark.createDataFrame([(2, 2, 1, 999, 1)], SCHED)
    assert rows(H.schedule_retry_update(other, fail, 2), "nextruntime", "retrycount") == [(999, 1)]


def test_queue_waiting_and_events(spark):
    q = spark.createDataFrame([(1, 1, 1, "data"), (2, 1, 1, "data"), (3, 2, 1, "data")],
                              "id bigint, dataflowid bigint, stepid bigint, eventdata string")
    assert H.queue_waiting(q).count() == 2
    assert [H.queue_events(q, f).count() for f in (1, 2, 99)] == [2, 1, 0]


def test_queue_purge_all_or_nothing(spark):
    q = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "a")], "id bigint, dataflowid bigint, name string")
    new = spark.createDataFrame([(1, "a"), (2, "a")], "dataflowid bigint, new_name string")
    assert sorted(r["id"] for r in H.queue_purge(q, "name", new).collect()) == [3]


RUNS = "id bigint, dataflowid bigint, userid bigint, status string, timestarted double, timefinished double, name string"


def test_last_runs_health_and_numbers(spark):
    runs = spark.createDataFrame([
        (1, 10, 5, "finished", 100.0, 110.0, "1"), (2, 10, 5, "aborted", 200.0, 230.5, "2"),
        (3, 11, 5, "finished", 300.0, 0.0, "3"), (4, 10, 5, "finished", 150.0, 160.0, "10")], RUNS)
    flows = spark.createDataFrame([(10, "f", 5, True), (11, "g", 5, True), (12, "h", 5, True), (13, "x", 5, False)],
                                  "id bigint, name string, userid bigint, enabled boolean")
    last = {r["dataflowid"]: (r["last_start"], r["last_duration"], r["running"]) for r in H.last_run(runs, now=400.0).collect()}
    assert last == {10: (200.0, 30.5, False), 11: (300.0, 100.0, True)}
    health = {r["dataflowid"]: r["health"] for r in H.health(flows, runs).collect()}
    assert health == {10: "OK", 11: "OK", 12: "NO_RUNS"}
    assert {r[0]: r[1] for r in H.next_run_number(runs).collect()} == {10: 4, 11: 2}
    last2 = H.last_n_runs(runs, 2).where("dataflowid = 10").orderBy("seq")
    assert [r["id"] for r in last2.collect()] == [2, 4]
    assert [r["duration"] for r in H.run_duration(runs).orderBy("id").collect()][:2] == [10.0, 30.5]


def test_lineage(spark):
    steps = spark.createDataFrame([(1, 7, "reader", "reader"), (2, 7, "writer", "writer"), (3, 7, "lost", "writer")],
                                  "id bigint, dataflowid bigint, alias string, type string")
    edges = spark.createDataFrame([(2, 1, 0)], "stepid bigint, dependson bigint, position int")
    assert rows(H.lineage_edges(edges, steps), "source", "dest") == [("reader", "writer")]
    assert rows(H.lineage_detached(steps, edges), "alias") == [("lost",)]
    limits = spark.createDataFrame([("reader", 0, 0, 1, 1), ("writer", 1, 1, 0, 0)],
                                   "type string, min_in int, max_in int, min_out int, max_out int")
    assert rows(H.lineage_degree_check(steps, edges, limits), "id", "kind") == [(3, "in_low")]


def test_subjects_and_versions(spark):
    flows = spark.createDataFrame([(1, 5), (2, 6)], "id bigint, userid bigint")
    steps = spark.createDataFrame([(10, 1), (11, 2)], "id bigint, dataflowid bigint")
    runs = spark.createDataFrame([(20, 1, 6), (21, 2, 5), (22, 2, 6)], "id bigint, dataflowid bigint, userid bigint")
    edges = spark.createDataFrame([(11, 10), (11, 11)], "stepid bigint, dependson bigint")
    out = H.subject_erasure({"flows": (flows, "id", ["userid"], {}), "steps": (steps, "id", [], {"dataflowid": "flows"}),
                             "runs": (runs, "id", ["userid"], {"dataflowid": "flows"}),
                             "edges": (edges, None, [], {"stepid": "steps", "dependson": "steps"})}, 5)
    assert rows(out["flows"], "id") == [(2,)] and rows(out["steps"], "id") == [(11,)]
    # a run of the user in somebody else's flow goes too
    assert rows(out["runs"], "id") == [(22,)] and rows(out["edges"]) == [(11, 11)]
    assert sorted(r[0] for r in H.subject_list([(flows, "userid")]).collect()) == [5, 6]
    exp = H.subject_export({"flows": (flows, ["userid"], "id")}, 6).first()
    assert exp["source"] == "flows" and exp["key"] == 2
    versions = spark.createDataFrame([(1, "h")], "dataflowid bigint, confighash string")
    cands = spark.createDataFrame([(1, "a: 1"), (1, "a: 1"), (2, "b")], "dataflowid bigint, config string")
    assert H.version_dedupe(versions, cands).count() == 2


def test_listeners(spark):
    steps = spark.createDataFrame([(1, 1, "trigger", '{"eventname": "x"}'), (2, 2, "trigger", '{"eventname": "x"}'),
                                   (3, 1, "trigger", '{"eventname": "y"}')],
                                  "id bigint, dataflowid bigint, type string, config string")
    flows = spark.createDataFrame([(1, True), (2, False)], "id bigint, enabled boolean")
    assert rows(H.queue_listeners(steps, flows, "x", "trigger"), "id") == [(1,)]


def test_health_summary_messages(spark):
    hs = "dataflowid bigint, last_run_id bigint, last_status string, health string"
    none = spark.createDataFrame([], hs)
    assert H.health_summary(none).first()["summary"] == "no flows enabled"
    noruns = spark.createDataFrame([(1, None, None, "NO_RUNS")], hs)
    assert H.health_summary(noruns).first()["summary"] == "no runs yet"
    bad = spark.createDataFrame([(1, 5, "aborted", "ERROR"), (2, 6, "finished", "OK")], hs)
    r = H.health_summary(bad).first()
    assert (r["status"], r["summary"]) == ("ERROR", "last run aborted")


def test_last_run_without_finish_is_running(spark):
    runs = spark.createDataFrame([(1, 7, 100.0, None)], "id bigint, dataflowid bigint, timestarted double, timefinished double")
    r = H.last_run(runs, now=130).first()
    assert r["running"] is True and r["last_duration"] == 30.0
