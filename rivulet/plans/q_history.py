"""Registered queries: run history, queue, schedule, lineage, data subjects (H-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import history as H
from rivulet.plans.registry import query
from rivulet.plans.standins import duck_cte, standins

W = duck_cte()
NOW = 1706745600  # fixed reference time (2024-02-01T00:00:00Z) so results are repeatable
DUE_AT = 5000
SUBJECT = 3


@query("hist_runs_user", W + """
SELECT r.id, r.dataflowid, r.status, u.firstname, TRY_CAST(r.name AS DOUBLE) AS name_num
FROM runs r LEFT JOIN users u ON r.userid = u.id""")
def q_hist_runs_user(spark, sf_dir):
    """H-1/H-3: runs with their user; run names ordered as numbers."""
    t = standins(spark, sf_dir)
    return H.runs_with_user(t["runs"], t["users"]).select("id", "dataflowid", "status", "firstname", "name_num")


@query("hist_flow_stepcount", W + """
SELECT f.id, f.name, f.enabled, u.firstname AS user_firstname, CAST(coalesce(s.n, 0) AS BIGINT) AS stepcount
FROM flows f LEFT JOIN (SELECT dataflowid, count(*) AS n FROM steps GROUP BY dataflowid) s ON f.id = s.dataflowid
LEFT JOIN users u ON f.userid = u.id""")
def q_hist_flow_stepcount(spark, sf_dir):
    """H-2: flows with user and step count."""
    t = standins(spark, sf_dir)
    return H.flows_with_stepcount(t["flows"], t["users"], t["steps"]).select(
        "id", "name", "enabled", "user_firstname", "stepcount")


@query("hist_last_n", W + """
SELECT id, dataflowid, CAST(4 - rn AS INTEGER) AS seq FROM (
  SELECT id, dataflowid, row_number() OVER (PARTITION BY dataflowid ORDER BY id DESC) AS rn FROM runs) WHERE rn <= 3""")
def q_hist_last_n(spark, sf_dir):
    """H-4: the three latest runs per flow, oldest first."""
    t = standins(spark, sf_dir)
    return H.last_n_runs(t["runs"], 3).select("id", "dataflowid", "seq")


@query("hist_last_run", W + f"""
SELECT dataflowid, s AS last_start, CASE WHEN f < s THEN {NOW} - s ELSE f - s END AS last_duration, f < s AS running
FROM (SELECT dataflowid, arg_max(timestarted, (timestarted, id)) AS s, arg_max(timefinished, (timestarted, id)) AS f
      FROM runs GROUP BY dataflowid)""")
def q_hist_last_run(spark, sf_dir):
    """H-5: last start and duration per flow; a running flow counts up to 'now'."""
    t = standins(spark, sf_dir)
    return H.last_run(t["runs"], now=float(NOW))


@query("hist_duration", W + "SELECT id, round(timefinished - timestarted, 3) AS duration FROM runs")
def q_hist_duration(spark, sf_dir):
    """H-6: run duration, 3 decimals."""
    t = standins(spark, sf_dir)
    return H.run_duration(t["runs"]).select("id", "duration")


@query("hist_health", W + """
SELECT f.id AS dataflowid, l.id AS last_run_id, l.status AS last_status,
       CASE WHEN l.id IS NULL THEN 'NO_RUNS' WHEN l.status = 'aborted' THEN 'ERROR' ELSE 'OK' END AS health
FROM flows f LEFT JOIN (SELECT dataflowid, max(id) AS id, arg_max(status, id) AS status FROM runs GROUP BY dataflowid) l
ON f.id = l.dataflowid WHERE f.enabled""")
def q_hist_health(spark, sf_dir):
    """H-7: health of enabled flows from their last run."""
    t = standins(spark, sf_dir)
    return H.health(t["flows"], t["runs"])


@query("hist_health_summary", W + """
, h AS (
  SELECT f.id, CASE WHEN l.id IS NULL THEN 'NO_RUNS' WHEN l.status = 'aborted' THEN 'ERROR' ELSE 'OK' END AS health
  FROM flows f LEFT JOIN (SELECT dataflowid, max(id) AS id, arg_max(status, id) AS status FROM runs GROUP BY dataflowid) l
  ON f.id = l.dataflowid WHERE f.enabled)
SELECT CASE WHEN sum(CASE WHEN health = 'ERROR' THEN 1 ELSE 0 END) > 0 THEN 'ERROR' ELSE 'OK' END AS status,
       CASE WHEN count(*) = 0 THEN 'no flows enabled'
            WHEN sum(CASE WHEN health <> 'NO_RUNS' THEN 1 ELSE 0 END) = 0 THEN 'no runs yet'
            WHEN sum(CASE WHEN health = 'ERROR' THEN 1 ELSE 0 END) > 0 THEN 'last run aborted'
            ELSE 'completed successfully' END AS summary,
       CAST(count(*) AS BIGINT) AS enabled_flows,
       CAST(coalesce(sum(CASE WHEN health = 'ERROR' THEN 1 ELSE 0 END), 0) AS BIGINT) AS errors
FROM h""")
def q_hist_health_summary(spark, sf_dir):
    """H-7: the overall health verdict with its summary message."""
    t = standins(spark, sf_dir)
    return H.health_summary(H.health(t["flows"], t["runs"]))


@query("hist_run_number", W + "SELECT dataflowid, CAST(count(*) + 1 AS BIGINT) AS next_run FROM runs GROUP BY dataflowid")
def q_hist_run_number(spark, sf_dir):
    """H-8: next run number per flow."""
    return H.next_run_number(standins(spark, sf_dir)["runs"])


@query("queue_waiting", W + "SELECT DISTINCT dataflowid FROM queue")
def q_queue_waiting(spark, sf_dir):
    """H-9: flows with queued events."""
    return H.queue_waiting(standins(spark, sf_dir)["queue"])


@query("queue_events", W + """
SELECT * FROM queue WHERE dataflowid = (SELECT dataflowid FROM queue GROUP BY dataflowid
                                        ORDER BY count(*) DESC, dataflowid LIMIT 1)""")
def q_queue_events(spark, sf_dir):
    """H-10: the queued events of one flow (the busiest one, found from the data)."""
    q = standins(spark, sf_dir)["queue"]
    busiest = (q.groupBy("dataflowid").agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.col("n").desc(), "dataflowid").limit(1).select("dataflowid").scalar())
    return H.queue_events(q, busiest)


@query("schedule_due", W + f"""
SELECT dataflowid, min(nextruntime) AS nextruntime FROM schedule WHERE nextruntime <= {DUE_AT} GROUP BY dataflowid""")
def q_schedule_due(spark, sf_dir):
    """H-11: flows due at a reference time."""
    return H.schedule_due(standins(spark, sf_dir)["schedule"], DUE_AT)


@query("schedule_due_union", W + f"""
SELECT dataflowid FROM schedule WHERE nextruntime <= {DUE_AT} UNION SELECT dataflowid FROM queue""")
def q_schedule_due_union(spark, sf_dir):
    """H-12: due by schedule or waiting in the queue."""
    t = standins(spark, sf_dir)
    return H.schedule_due_union(t["schedule"], t["queue"], DUE_AT)


@query("queue_listeners", W + """
SELECT s.* FROM steps s WHERE s.type = 'trigger' AND json_extract_string(s.config, '$.eventname') = 'purchase'
AND s.dataflowid IN (SELECT id FROM flows WHERE enabled)""")
def q_queue_listeners(spark, sf_dir):
    """H-13: trigger steps listening to an event name in enabled flows."""
    t = standins(spark, sf_dir)
    return H.queue_listeners(t["steps"], t["flows"], "purchase", "trigger")


@query("lineage_edges", W + """
SELECT s.dataflowid, s.alias AS source, d.alias AS dest, e.position, e.stepid, e.dependson
FROM edges e JOIN steps s ON e.dependson = s.id LEFT JOIN steps d ON e.stepid = d.id""")
def q_lineage_edges(spark, sf_dir):
    """H-14: edges as (source alias, destination alias, position)."""
    t = standins(spark, sf_dir)
    return H.lineage_edges(t["edges"], t["steps"])


@query("lineage_detached", W + """
SELECT * FROM steps WHERE id NOT IN (SELECT stepid FROM edges UNION SELECT dependson FROM edges)""")
def q_lineage_detached(spark, sf_dir):
    """H-15: steps linked to nothing."""
    t = standins(spark, sf_dir)
    return H.lineage_detached(t["steps"], t["edges"])


@query("lineage_degree_check", W + """
SELECT id, type, in_degree, out_degree, kind FROM (
  SELECT s.id, s.type, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree,
         l.min_in, l.max_in, l.min_out, l.max_out
  FROM steps s LEFT JOIN (SELECT stepid, count(*) AS n FROM edges GROUP BY stepid) i ON s.id = i.stepid
  LEFT JOIN (SELECT dependson, count(*) AS n FROM edges GROUP BY dependson) o ON s.id = o.dependson
  LEFT JOIN limits l ON s.type = l.type) x,
  (VALUES ('in_low'), ('in_high'), ('out_low'), ('out_high')) k(kind)
WHERE (kind = 'in_low' AND in_degree < min_in) OR (kind = 'in_high' AND in_degree > max_in)
   OR (kind = 'out_low' AND out_degree < min_out) OR (kind = 'out_high' AND out_degree > max_out)""")
def q_lineage_degree_check(spark, sf_dir):
    """H-16: steps whose in/out degree breaks the limits of their type."""
    t = standins(spark, sf_dir)
    return H.lineage_degree_check(t["steps"], t["edges"], t["limits"])


def _subject_tables(spark, sf_dir):
    t = standins(spark, sf_dir)
    return {"flows": (t["flows"], ["userid", "usermodified"], "id"), "steps": (t["steps"], ["userid", "usermodified"], "id"),
            "runs": (t["runs"], ["userid"], "id")}


@query("subject_export", W + f"""
SELECT 'flows' AS source, id AS key, CAST(to_json({{'id': id, 'name': name, 'userid': userid, 'enabled': enabled,
        'usermodified': usermodified}}) AS VARCHAR) AS fields FROM flows WHERE userid = {SUBJECT} OR usermodified = {SUBJECT}
UNION ALL
SELECT 'steps', id, CAST(to_json({{'id': id, 'dataflowid': dataflowid, 'alias': alias, 'type': type, 'name': name, 'config': config,
        'userid': userid, 'usermodified': usermodified}}) AS VARCHAR) FROM steps WHERE userid = {SUBJECT} OR usermodified = {SUBJECT}
UNION ALL
SELECT 'runs', id, CAST(to_json({{'id': id, 'dataflowid': dataflowid, 'userid': userid, 'status': status,
        'timestarted': CAST(timestarted AS DECIMAL(20, 3)), 'timefinished': CAST(timefinished AS DECIMAL(20, 3)), 'name': name}}) AS VARCHAR) FROM runs WHERE userid = {SUBJECT}""")
def q_subject_export(spark, sf_dir):
    """H-17: every field of every row a user owns or changed last, across flows, steps and runs."""
    tables = _subject_tables(spark, sf_dir)
    runs, owners, key = tables["runs"]
    times = {c: F.col(c).cast("decimal(20,3)") for c in ("timestarted", "timefinished")}  # plain digits in the JSON text
    return H.subject_export({**tables, "runs": (runs.withColumns(times), owners, key)}, SUBJECT)


@query("subject_erasure", W + f""",
gf AS (SELECT id FROM flows WHERE userid = {SUBJECT} OR usermodified = {SUBJECT}),
gs AS (SELECT id FROM steps WHERE userid = {SUBJECT} OR usermodified = {SUBJECT} OR dataflowid IN (SELECT id FROM gf))
SELECT 'flows' AS tbl, id AS key FROM flows WHERE id NOT IN (SELECT id FROM gf)
UNION ALL SELECT 'steps', id FROM steps WHERE id NOT IN (SELECT id FROM gs)
UNION ALL SELECT 'runs', id FROM runs WHERE userid <> {SUBJECT} AND dataflowid NOT IN (SELECT id FROM gf)
UNION ALL SELECT 'edges', stepid FROM edges WHERE stepid NOT IN (SELECT id FROM gs) AND dependson NOT IN (SELECT id FROM gs)""")
def q_subject_erasure(spark, sf_dir):
    """H-18: the rows that remain after a user's own rows and all that hang on them are removed."""
    t, s = standins(spark, sf_dir), _subject_tables(spark, sf_dir)
    out = H.subject_erasure({
        "flows": (t["flows"], "id", s["flows"][1], {}),
        "steps": (t["steps"], "id", s["steps"][1], {"dataflowid": "flows"}),
        "runs": (t["runs"], None, s["runs"][1], {"dataflowid": "flows"}),
        "edges": (t["edges"], None, [], {"stepid": "steps", "dependson": "steps"})}, SUBJECT)
    keys = {"flows": "id", "steps": "id", "runs": "id", "edges": "stepid"}
    parts = [out[n].select(F.lit(n).alias("tbl"), F.col(k).cast("bigint").alias("key")) for n, k in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("flow_list", W + """
SELECT id, name, enabled, CAST((SELECT count(*) FROM steps s WHERE s.dataflowid = f.id) AS BIGINT) AS stepcount,
       row_number() OVER (ORDER BY enabled DESC, name, id) AS position FROM flows f""")
def q_flow_list(spark, sf_dir):
    """H-2: the list of flows, enabled ones first, with their position."""
    t = standins(spark, sf_dir)
    return H.flow_list(t["flows"], t["users"], t["steps"]).select("id", "name", "enabled", "stepcount", "position")


@query("subject_list", W + """
SELECT userid FROM flows WHERE userid IS NOT NULL UNION SELECT userid FROM runs WHERE userid IS NOT NULL""")
def q_subject_list(spark, sf_dir):
    """H-19: all user ids seen in any table."""
    t = standins(spark, sf_dir)
    return H.subject_list([(t["flows"], "userid"), (t["runs"], "userid")])


@query("version_dedupe", W + """
SELECT DISTINCT c.dataflowid, c.config, sha1(c.config) AS confighash FROM steps c
WHERE NOT EXISTS (SELECT 1 FROM steps v WHERE v.type = 'transform'
                  AND v.dataflowid = c.dataflowid AND sha1(v.config) = sha1(c.config))""")
def q_version_dedupe(spark, sf_dir):
    """H-20: store a config version only when (flow, sha1(config)) is new."""
    t = standins(spark, sf_dir)
    stored = (t["steps"].where(F.col("type") == "transform")
              .select("dataflowid", F.sha1("config").alias("confighash")))
    return H.version_dedupe(stored, t["steps"].select("dataflowid", "config"))


@query("queue_purge", W + """
SELECT * FROM queue WHERE dataflowid NOT IN (
  SELECT q.dataflowid FROM queue q JOIN (SELECT id AS dataflowid, 'purchase' AS new_name FROM flows WHERE NOT enabled) n
  ON q.dataflowid = n.dataflowid WHERE q.eventname <> n.new_name)""")
def q_queue_purge(spark, sf_dir):
    """H-21: when a disabled flow's trigger now listens to 'purchase', its queue is dropped if any event differs."""
    t = standins(spark, sf_dir)
    new_names = t["flows"].where(~F.col("enabled")).select(F.col("id").alias("dataflowid"),
                                                          F.lit("purchase").alias("new_name"))
    return H.queue_purge(t["queue"], "eventname", new_names)


@query("schedule_retry_update", W + """
SELECT s.dataflowid, s.stepid, s.lastruntime,
       CASE WHEN f.dataflowid IS NULL THEN s.nextruntime WHEN s.retrycount >= 1 THEN f.scheduledtime ELSE f.retrytime END AS nextruntime,
       CAST(CASE WHEN f.dataflowid IS NULL THEN s.retrycount WHEN s.retrycount >= 1 THEN 0 ELSE s.retrycount + 1 END AS INTEGER) AS retrycount
FROM schedule s LEFT JOIN failures f ON s.dataflowid = f.dataflowid AND s.stepid = f.stepid""")
def q_schedule_retry_update(spark, sf_dir):
    """H-22: retry bookkeeping after failed runs, one retry allowed."""
    t = standins(spark, sf_dir)
    return H.schedule_retry_update(t["schedule"], t["failures"], allowed=1)


@query("alias_from_name", W + """
SELECT id, name, regexp_replace(lower(name), '[^a-zA-Z0-9_-]+', '_', 'g') AS alias FROM steps""")
def q_alias_from_name(spark, sf_dir):
    """V-3: a step alias derived from its name."""
    from rivulet.operators.validate import alias_column
    steps = standins(spark, sf_dir)["steps"]
    return steps.select("id", "name", alias_column(F.col("name")).alias("alias"))
