"""Run-history, queue, schedule, lineage and data-subject queries (H-1 … H-22).

Written against the table shapes of a job-history store:

* ``flows(id, name, userid, enabled)``
* ``runs(id, dataflowid, userid, status, timestarted, timefinished, name)``
* ``steps(id, dataflowid, alias, type, name, config)``
* ``edges(stepid, dependson, position)``
* ``queue(id, dataflowid, stepid, eventdata)``
* ``schedule(dataflowid, stepid, lastruntime, nextruntime, retrycount)``
* ``users(id, …)``

Per-flow "latest" questions use partial aggregates (``max_by``) or a
row-number filter that Spark turns into a map-side group limit, so a flow
with a third of all runs never lands whole in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = [
    "runs_with_user", "flows_with_stepcount", "last_n_runs", "last_run", "run_duration",
    "health", "health_summary", "next_run_number", "queue_waiting", "queue_events", "schedule_due",
    "schedule_due_union", "queue_listeners", "lineage_edges", "lineage_detached",
    "lineage_degree_check", "subject_export", "subject_erasure", "subject_list",
    "version_dedupe", "queue_purge", "schedule_retry_update",
]


def runs_with_user(runs: DataFrame, users: DataFrame, flow_id=None, user_cols=None) -> DataFrame:
    """H-1/H-3: runs (optionally of one flow) with their user; ``name_num`` orders names as numbers."""
    r = runs if flow_id is None else runs.where(F.col("dataflowid") == F.lit(flow_id))
    ucols = user_cols or [c for c in users.columns if c != "id"]
    u = users.select(F.col("id").alias("_uid"), *ucols)
    return (r.join(u, r["userid"] == u["_uid"], "left").drop("_uid")
             .withColumn("name_num", F.col("name").try_cast("double")))


def flows_with_stepcount(flows: DataFrame, users: DataFrame, steps: DataFrame) -> DataFrame:
    """H-2: flows with their user and step count (0 without steps)."""
    counts = steps.groupBy(F.col("dataflowid").alias("_fid")).agg(F.count(F.lit(1)).alias("stepcount"))
    u = users.select(F.col("id").alias("_uid"), *[F.col(c).alias(f"user_{c}") for c in users.columns if c != "id"])
    return (flows.join(counts, flows["id"] == counts["_fid"], "left")
                 .join(u, flows["userid"] == u["_uid"], "left")
                 .withColumn("stepcount", F.coalesce("stepcount", F.lit(0)).cast("bigint"))
                 .drop("_fid", "_uid"))


def flow_list(flows: DataFrame, users: DataFrame, steps: DataFrame) -> DataFrame:
    """H-2 in list order: enabled flows first, then by name and id; ``position`` carries the order."""
    from rivulet.operators.ordering import with_row_index
    return with_row_index(flows_with_stepcount(flows, users, steps), [F.col("enabled").desc(), F.col("name").asc(), F.col("id").asc()],
                          "position")


def last_n_runs(runs: DataFrame, n: int, per: str = "dataflowid", order: str = "id") -> DataFrame:
    """H-4: the ``n`` latest runs per flow, numbered 1 = oldest of them.

    ``row_number() <= n`` lets Spark apply the limit per group on the map side
    before the shuffle.
    """
    w = Window.partitionBy(per).orderBy(F.col(order).desc())
    latest = runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return latest.withColumn("seq", (F.lit(n) - F.col("_rn") + 1).cast("int")).drop("_rn")


def last_run(runs: DataFrame, now=None) -> DataFrame:
    """H-5: per flow, start and duration of the run that started last.

    A finish before the start, or none, means still running: duration = ``now - start``.
    """
    pick = runs.groupBy("dataflowid").agg(
        F.max_by(F.struct("timestarted", "timefinished"), F.struct("timestarted", "id")).alias("_l"))
    start, finish = F.col("_l.timestarted"), F.col("_l.timefinished")
    nowc = F.lit(now) if now is not None else F.unix_timestamp()
    running = F.coalesce(finish < start, F.lit(True))
    return pick.select("dataflowid", start.alias("last_start"),
                       F.when(running, nowc - start).otherwise(finish - start).alias("last_duration"),
                       running.alias("running"))


def run_duration(runs: DataFrame) -> DataFrame:
    """H-6: run duration in seconds, 3 decimals."""
    return runs.withColumn("duration", F.round(F.col("timefinished") - F.col("timestarted"), 3))


def health(flows: DataFrame, runs: DataFrame, aborted: str = "aborted") -> DataFrame:
    """H-7: per enabled flow its last run state and OK/ERROR/NO_RUNS; one summary row per flow.

    The overall verdict is ``ERROR`` if any row is ERROR (``bool_or`` over this result).
    """
    last = runs.groupBy("dataflowid").agg(
        F.max_by(F.struct("id", "name", "status"), F.col("id")).alias("_l"))
    en = flows.where(F.col("enabled"))
    j = en.join(last, en["id"] == last["dataflowid"], "left")
    status = (F.when(F.col("_l").isNull(), F.lit("NO_RUNS"))
               .when(F.col("_l.status") == F.lit(aborted), F.lit("ERROR")).otherwise(F.lit("OK")))
    return j.select(en["id"].alias("dataflowid"), F.col("_l.id").alias("last_run_id"),
                    F.col("_l.status").alias("last_status"), status.alias("health"))


def health_summary(health_rows: DataFrame) -> DataFrame:
    """H-7 overall verdict in one row: ``status`` and ``summary``.

    ERROR if any enabled flow's last run aborted; otherwise a message for no
    enabled flows, no runs at all, or all completed.
    """
    agg = health_rows.agg(
        F.count(F.lit(1)).alias("enabled_flows"),
        F.sum(F.when(F.col("health") == "ERROR", 1).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("health") != "NO_RUNS", 1).otherwise(0)).alias("with_runs"))
    status = F.when(F.col("errors") > 0, F.lit("ERROR")).otherwise(F.lit("OK"))
    summary = (F.when(F.col("enabled_flows") == 0, F.lit("no flows enabled"))
                .when(F.col("with_runs") == 0, F.lit("no runs yet"))
                .when(F.col("errors") > 0, F.lit("last run aborted"))
                .otherwise(F.lit("completed successfully")))
    return agg.select(status.alias("status"), summary.alias("summary"),
                      F.col("enabled_flows").cast("bigint").alias("enabled_flows"),
                      F.coalesce(F.col("errors"), F.lit(0)).cast("bigint").alias("errors"))


def next_run_number(runs: DataFrame) -> DataFrame:
    """H-8: next run number per flow = runs so far + 1."""
    return runs.groupBy("dataflowid").agg((F.count(F.lit(1)) + 1).cast("bigint").alias("next_run"))


def queue_waiting(queue: DataFrame) -> DataFrame:
    """H-9: distinct flows with queued events."""
    return queue.select("dataflowid").distinct()


def queue_events(queue: DataFrame, flow_id) -> DataFrame:
    """H-10: queued events of one flow (an id or a scalar Column)."""
    fid = flow_id if isinstance(flow_id, Column) else F.lit(flow_id)
    return queue.where(F.col("dataflowid") == fid)


def schedule_due(schedule: DataFrame, t) -> DataFrame:
    """H-11: flows due at ``t`` (``nextruntime <= t``), one row per flow (earliest time)."""
    return (schedule.where(F.col("nextruntime") <= F.lit(t))
                    .groupBy("dataflowid").agg(F.min("nextruntime").alias("nextruntime")))


def schedule_due_union(schedule: DataFrame, queue: DataFrame, t) -> DataFrame:
    """H-12: flows to run now: due by schedule or waiting in the queue."""
    return (schedule_due(schedule, t).select("dataflowid")
            .union(queue_waiting(queue)).distinct())


def queue_listeners(steps: DataFrame, flows: DataFrame, event_name: str,
                    step_type: str, key: str = "$.eventname") -> DataFrame:
    """H-13: trigger steps of ``step_type`` listening to ``event_name`` in enabled flows."""
    s = steps.where((F.col("type") == F.lit(step_type))
                    & (F.get_json_object(F.col("config"), key) == F.lit(event_name)))
    en = flows.where(F.col("enabled")).select(F.col("id").alias("_fid"))
    return s.join(en, s["dataflowid"] == en["_fid"], "left_semi")


def lineage_edges(edges: DataFrame, steps: DataFrame, flow_id=None) -> DataFrame:
    """H-14: edges as (source alias, destination alias, position)."""
    st = steps if flow_id is None else steps.where(F.col("dataflowid") == F.lit(flow_id))
    src = st.select(F.col("id").alias("_sid"), F.col("alias").alias("source"), F.col("dataflowid"))
    dst = steps.select(F.col("id").alias("_did"), F.col("alias").alias("dest"))
    e = edges.join(src, edges["dependson"] == src["_sid"], "inner")
    return (e.join(dst, e["stepid"] == dst["_did"], "left")
             .select("dataflowid", "source", "dest", "position", "stepid", "dependson"))


def lineage_detached(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """H-15: steps that appear in no edge."""
    # both ends of every edge from one scan of the edges
    linked = edges.select(F.explode(F.array("stepid", "dependson")).alias("_id")).distinct()
    return steps.join(linked, steps["id"] == linked["_id"], "left_anti")


def lineage_degree_check(steps: DataFrame, edges: DataFrame, limits: DataFrame) -> DataFrame:
    """H-16: steps whose in/out degree is outside the limits of their type.

    ``limits(type, min_in, max_in, min_out, max_out)``; the result has one row
    per violation with ``kind`` in {in_low, in_high, out_low, out_high}.
    """
    # in- and out-degree in one aggregation over one scan of the edges
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("stepid").alias("_s"), F.lit(1).alias("_in"), F.lit(0).alias("_out")),
        F.struct(F.col("dependson").alias("_s"), F.lit(0).alias("_in"), F.lit(1).alias("_out")))).alias("_e"))
    deg = ends.groupBy(F.col("_e._s").alias("_d")).agg(F.sum("_e._in").alias("in_degree"),
                                                       F.sum("_e._out").alias("out_degree"))
    s = (steps.join(deg, steps["id"] == deg["_d"], "left")
              .join(limits, "type", "left")
              .withColumn("in_degree", F.coalesce("in_degree", F.lit(0)).cast("bigint"))
              .withColumn("out_degree", F.coalesce("out_degree", F.lit(0)).cast("bigint")))
    kinds = F.array_compact(F.array(
        F.when(F.col("in_degree") < F.col("min_in"), F.lit("in_low")),
        F.when(F.col("in_degree") > F.col("max_in"), F.lit("in_high")),
        F.when(F.col("out_degree") < F.col("min_out"), F.lit("out_low")),
        F.when(F.col("out_degree") > F.col("max_out"), F.lit("out_high"))))
    return (s.select("id", "type", "in_degree", "out_degree", F.explode(kinds).alias("kind")))


def subject_export(tables: dict[str, tuple[DataFrame, list[str], str]], user_id) -> DataFrame:
    """H-17: every row owned or changed by a user, as ``(source, key, fields)``.

    ``tables`` maps a name to ``(frame, user columns, key column)``; fields
    is the row as JSON text.
    """
    parts = []
    for name, (df, ucols, key) in tables.items():
        owned = reduce(lambda a, b: a | b, [F.col(c) == F.lit(user_id) for c in ucols])
        parts.append(df.where(owned).select(F.lit(name).alias("source"), F.col(key).cast("bigint").alias("key"),
                                            F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("fields")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def subject_erasure(tables: dict[str, tuple[DataFrame, str | None, list[str], dict[str, str]]], user_id) -> dict[str, DataFrame]:
    """H-18: remove a user's rows from every table and, over any number of levels, the rows that point to removed ones.

    ``tables`` maps a name to ``(frame, key column, owner columns, {foreign key
    column: parent table})``, parents before children.  A row goes if an owner
    column names the user or a foreign key points to a row that goes, so a
    user's own rows go wherever they stand.  Keys stay distributed, never
    collected; a table's removed keys are joined once per foreign key.
    """
    out, gone = {}, {}
    for name, (df, key, owners, parents) in tables.items():
        goes = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == F.lit(user_id), F.lit(False)) for c in owners], F.lit(False))
        marked = df.withColumn("_goes", goes)
        for i, (fk, parent) in enumerate(parents.items()):
            keys = gone[parent].select(F.col("_gone").alias(f"_gone{i}"), F.lit(True).alias(f"_hit{i}"))
            marked = marked.join(keys, marked[fk] == keys[f"_gone{i}"], "left") \
                .withColumn("_goes", F.col("_goes") | F.coalesce(F.col(f"_hit{i}"), F.lit(False))).drop(f"_gone{i}", f"_hit{i}")
        out[name] = marked.where(~F.col("_goes")).select(*df.columns)
        if key:
            gone[name] = marked.where("_goes").select(F.col(key).alias("_gone")).distinct()
    return out


def subject_list(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """H-19: every user id seen in any of the given (frame, user column) pairs."""
    parts = [df.select(F.col(c).cast("bigint").alias("userid")) for df, c in tables]
    return reduce(lambda a, b: a.union(b), parts).where(F.col("userid").isNotNull()).distinct()


def version_dedupe(versions: DataFrame, candidates: DataFrame) -> DataFrame:
    """H-20: new version rows: candidates whose (flow, sha1(config)) is not stored yet.

    ``versions(dataflowid, confighash, …)``, ``candidates(dataflowid, config)``.
    Returns rows to append with ``confighash`` filled in (deduplicated).
    """
    c = candidates.withColumn("confighash", F.sha1(F.col("config")))
    c = c.dropDuplicates(["dataflowid", "confighash"])
    return c.join(versions.select("dataflowid", "confighash"), ["dataflowid", "confighash"], "left_anti")


def queue_purge(queue: DataFrame, name_col: str, new_names: DataFrame) -> DataFrame:
    """H-21: queue after a trigger's event name changed.

    ``new_names(dataflowid, new_name)``: if any queued event of a flow has a
    different name, *all* of that flow's events go.  Flows to purge are
    found with a distinct (partially aggregated), then removed by an anti-join.
    """
    q = queue.join(new_names, "dataflowid", "inner")
    purge = q.where(F.col(name_col) != F.col("new_name")).select("dataflowid").distinct()
    return queue.join(purge, "dataflowid", "left_anti").select(*queue.columns)


def schedule_retry_update(schedule: DataFrame, failures: DataFrame, allowed: int) -> DataFrame:
    """H-22: schedule after failed runs.

    ``failures(dataflowid, stepid, retrytime, scheduledtime)``.  When
    ``retrycount >= allowed`` the count resets to 0 and the regular time is
    used, else the count goes up by one and the retry time is used.  Rows
    without a failure are unchanged.  Of several failures of one step the one
    with the latest retry time counts.
    """
    f = failures.groupBy("dataflowid", "stepid").agg(F.max(F.struct("retrytime", "scheduledtime")).alias("_f")) \
        .select("dataflowid", "stepid", "_f.*", F.lit(True).alias("_f"))
    j = schedule.join(f, ["dataflowid", "stepid"], "left")
    failed = F.coalesce(F.col("_f"), F.lit(False))
    exhausted = F.col("retrycount") >= F.lit(allowed)
    new_count = F.when(~failed, F.col("retrycount")).when(exhausted, F.lit(0)).otherwise(F.col("retrycount") + 1)
    new_next = (F.when(~failed, F.col("nextruntime")).when(exhausted, F.col("scheduledtime"))
                 .otherwise(F.col("retrytime")))
    return j.select(*[F.col(c) for c in schedule.columns if c not in ("retrycount", "nextruntime")],
                    new_next.cast(schedule.schema["nextruntime"].dataType).alias("nextruntime"),
                    new_count.cast(schedule.schema["retrycount"].dataType).alias("retrycount"))
