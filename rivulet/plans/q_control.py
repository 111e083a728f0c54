"""Registered queries: row control, state and per-record policies (C-*, U-*)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rivulet.operators.control import (
    find_first, find_first_in_array, iteration_number, keyed_update, observe_counts, take_until, violations,
)
from rivulet.operators.transform import last_values
from rivulet.operators.udf import map_records, with_error_policy
from rivulet.plans.registry import query, table
from rivulet.session import scratch_path
from rivulet.state import StateTable


@query("quality_gate", """
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
WHERE NOT coalesce(NOT (o_totalprice > 450000 AND o_orderstatus = 'O'), false)""")
def q_quality_gate(spark, sf_dir):
    """C-1: rows that would abort the flow (condition not exactly false)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return violations(o, "o_totalprice > 450000 AND o_orderstatus = 'O'")


@query("take_until", """
SELECT event_id, event_type, value FROM events
WHERE event_id < coalesce((SELECT min(event_id) FROM events WHERE value > 300), 9223372036854775807)""")
def q_take_until(spark, sf_dir):
    """C-2: records in flow order up to (not including) the first aborting one."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return take_until(ev, "value > 300", "event_id")


@query("find_first", """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
  FROM conversations WHERE role = 'assistant') WHERE rn = 1""")
def q_find_first(spark, sf_dir):
    """C-3: per conversation the first assistant turn."""
    c = table(spark, sf_dir, "conversations")
    found = find_first(c, "role = 'assistant'", "turn", group_by="conv_id")
    return found.select("found.*")


@query("find_first_in_array", """
SELECT l_orderkey AS orderkey,
       (list_filter(list(l_linenumber ORDER BY l_linenumber), lambda x: x >= 3))[1] AS first_line_from_3
FROM lineitem GROUP BY l_orderkey""")
def q_find_first_in_array(spark, sf_dir):
    """C-3: first element of each order's (bounded) line array meeting a condition."""
    li = table(spark, sf_dir, "lineitem")
    arr = li.groupBy(F.col("l_orderkey").alias("orderkey")).agg(
        F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    return arr.select("orderkey", find_first_in_array("lines", lambda x: x >= 3).alias("first_line_from_3"))


@query("last_value_state", """
SELECT 'last_event' AS name, CAST(arg_max(event_id, ts) AS VARCHAR) AS value FROM events
UNION ALL SELECT 'last_ts', strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') FROM events""")
def q_last_value_state(spark, sf_dir):
    """C-4: the last value under flow order is saved to a state table for the next run."""
    ev = table(spark, sf_dir, "events")
    st = StateTable(spark, scratch_path(spark, "state"))
    last = last_values(ev, {"last_event": F.col("event_id"),
                            "last_ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")}, "ts").first()
    st.save({"last_event": last["last_event"], "last_ts": last["last_ts"]})
    # values are stored JSON-encoded; show them as plain text
    return st.as_frame().select("name", F.regexp_replace(F.col("value"), '^"|"$', "").alias("value"))


@query("multi_state", """
SELECT CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total, max(ts) AS latest,
       arg_max(event_type, event_id) AS last_type FROM events""")
def q_multi_state(spark, sf_dir):
    """C-5: several variables from one pass."""
    ev = table(spark, sf_dir, "events")
    return last_values(ev, {"last_type": F.col("event_type")}, "event_id",
                       extra=[F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"),
                              F.max("ts").alias("latest")])


@query("restart_guard", "SELECT event_id, value FROM events WHERE false")
def q_restart_guard(spark, sf_dir):
    """C-6: a second run over the same batch delivers nothing (mark compared before running)."""
    from rivulet.sources.sql import incremental_read
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    st = StateTable(spark, scratch_path(spark, "guard"))
    first = incremental_read(ev, "event_id", st)
    first.df.write.format("noop").mode("overwrite").save()
    first.commit()
    return incremental_read(ev, "event_id", st).df


@query("iteration_number", """
SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS iteration FROM events""")
def q_iteration_number(spark, sf_dir):
    """C-7: 0-based position of each record in flow order, without a single-partition window."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    return iteration_number(ev, ["ts", "event_id"]).select("event_id", "iteration")


def _inverse_k(rec):
    props = json.loads(rec["props"])
    return 1000.0 / int(props["k"])


@query("skip_bad_records", """
SELECT event_id, 1000.0 / CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events
WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) <> 0""")
def q_skip_bad_records(spark, sf_dir):
    """C-8: a per-record Python function; records it fails on are skipped (and kept aside)."""
    ev = table(spark, sf_dir, "events").select("event_id", "props")
    ok, _ = with_error_policy(ev, _inverse_k, "double", "skiprecord", keep=["event_id"])
    return ok


@query("skip_bad_records_errors", """
SELECT event_id, 'ZeroDivisionError: float division by zero' AS error FROM events
WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 0""")
def q_skip_bad_records_errors(spark, sf_dir):
    """C-8: the error side of the same policy."""
    ev = table(spark, sf_dir, "events").select("event_id", "props")
    _, errors = with_error_policy(ev, _inverse_k, "double", "skiprecord", keep=["event_id"])
    return errors


@query("run_metrics", """
SELECT CAST(count(*) AS BIGINT) AS rows_in,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       CAST(count(*) FILTER (WHERE value > 10) AS BIGINT) AS rows_out FROM events""")
def q_run_metrics(spark, sf_dir):
    """C-9: step counters gathered while the flow runs, without an extra pass."""
    ev = table(spark, sf_dir, "events")
    observed, obs = observe_counts(ev, "reader", {"errors": "event_type = 'error'"})
    out = observed.where("value > 10")
    n_out = out.count()
    m = obs.get
    return spark.createDataFrame([(m["rows"], m["errors"], n_out)], "rows_in bigint, errors bigint, rows_out bigint")


@query("keyed_update", """
WITH latest AS (
  SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS c_mktsegment,
         arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS c_acctbal
  FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, c.c_name, c.c_nationkey, coalesce(l.c_acctbal, c.c_acctbal) AS c_acctbal,
       coalesce(l.c_mktsegment, c.c_mktsegment) AS c_mktsegment
FROM customer c LEFT JOIN latest l ON c.c_custkey = l.o_custkey""")
def q_keyed_update(spark, sf_dir):
    """C-10: customers updated from their latest order; unknown keys are not inserted."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"),
        F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey")
    return keyed_update(c, o, "c_custkey", ["c_mktsegment", "c_acctbal"], order_by=["o_orderdate", "o_orderkey"])


def _tag_record(rec):
    if rec["event_type"] == "error":
        return False
    if rec["event_type"] == "view":
        return None
    return {**rec, "event_type": rec["event_type"].upper()}


@query("map_rows", """
SELECT event_id, CASE WHEN event_type = 'view' THEN event_type ELSE upper(event_type) END AS event_type, value
FROM events WHERE event_type <> 'error'""")
def q_map_rows(spark, sf_dir):
    """U-2: a per-record function: False drops, None keeps, a dict replaces."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return map_records(ev, _tag_record, "event_id bigint, event_type string, value double")
