"""Registered queries: the event queue through Structured Streaming (T-*).

Each query copies ``events`` into a queue folder on shared storage, runs a
streaming job over it with ``availableNow`` and a checkpoint, and returns
what the sink holds.  The oracle is the batch form of the same question.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.plans.registry import query, table
from rivulet.plans.standins import duck_cte, standins
from rivulet.session import scratch_path
from rivulet.streaming.queue import POLICIES, capture, compact_log, drain, last_value_per_key, read_latest, run_available_now, upsert_log


def _queue_folder(spark, sf_dir):
    """Copy of ``events`` as the queue's landing folder; returns (path, schema)."""
    ev = table(spark, sf_dir, "events")
    path = scratch_path(spark, "queue")
    ev.write.parquet(path)
    return path, ev.schema


@query("stream_capture", duck_cte() + """
SELECT s.dataflowid, s.id AS stepid, e.event_type AS eventname, e.props AS eventdata, e.event_id, e.ts, e.value
FROM events e JOIN steps s ON s.type = 'trigger' AND s.dataflowid = e.user_id
 AND json_extract_string(s.config, '$.eventname') = e.event_type
WHERE s.dataflowid IN (SELECT id FROM flows WHERE enabled)""")
def q_stream_capture(spark, sf_dir):
    """T-1: each event is queued once for every listening trigger of its flow (enabled flows only)."""
    path, schema = _queue_folder(spark, sf_dir)
    t = standins(spark, sf_dir)
    enabled = t["flows"].where("enabled").select(F.col("id").alias("dataflowid"))
    listeners = (t["steps"].where(F.col("type") == "trigger")
                 .join(enabled, "dataflowid", "left_semi")
                 .select("dataflowid", F.col("id").alias("stepid"),
                         F.get_json_object("config", "$.eventname").alias("eventname")))
    stream = spark.readStream.schema(schema).parquet(path)
    sink = scratch_path(spark, "captured")
    drain(capture(stream, listeners, flow_col="user_id"), sink, scratch_path(spark, "ckpt_capture"))
    return spark.read.parquet(sink).drop("batch")


@query("stream_drain", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_stream_drain(spark, sf_dir):
    """T-2: the queue drained once through a checkpointed, idempotent micro-batch sink."""
    path, schema = _queue_folder(spark, sf_dir)
    sink = scratch_path(spark, "drained")
    drain(spark.readStream.schema(schema).parquet(path), sink, scratch_path(spark, "ckpt_drain"))
    return spark.read.parquet(sink).drop("batch")


@query("stream_redrain", """
SELECT 'first' AS run, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT event_id) AS BIGINT) AS events FROM events
UNION ALL SELECT 'second', 0, 0""")
def q_stream_redrain(spark, sf_dir):
    """T-2/T-5: the first run drains every event once, a second with the same checkpoint finds nothing new."""
    path, schema = _queue_folder(spark, sf_dir)
    ckpt = scratch_path(spark, "ckpt_redrain")
    parts = []
    for run in ("first", "second"):
        sink = scratch_path(spark, f"redrain_{run}")
        drain(spark.readStream.schema(schema).parquet(path), sink, ckpt)
        # an empty sink folder has no files to infer from
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{sink}/batch=-1")
        parts.append(spark.read.schema(schema).parquet(sink).agg(
            F.lit(run).alias("run"), F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events")))
    return parts[0].unionByName(parts[1])


@query("stream_policies", "SELECT p AS policy, CAST(count(*) AS BIGINT) AS n FROM events, (VALUES ('adhoc'), ('adhocqueued'), ('immediately')) t(p) GROUP BY 1")
def q_stream_policies(spark, sf_dir):
    """T-3: each policy delivers every queued event; 'immediately' keeps running until it is stopped."""
    path, schema = _queue_folder(spark, sf_dir)
    parts = []
    for policy in POLICIES:
        sink = scratch_path(spark, f"policy_{policy}")

        def write_batch(df, batch_id, sink=sink):
            df.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

        q = run_available_now(spark.readStream.schema(schema).parquet(path), scratch_path(spark, "ckpt_policy"), write_batch, policy=policy)
        if policy == "immediately":
            q.processAllAvailable()
            q.stop()
        parts.append(spark.read.schema(schema).parquet(sink).agg(F.lit(policy).alias("policy"), F.count(F.lit(1)).alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stream_dry_run", "SELECT CAST(count(*) AS BIGINT) AS n FROM events")
def q_stream_dry_run(spark, sf_dir):
    """T-4: a dry run processes the queue but keeps no offsets; a real run afterwards still sees every event."""
    path, schema = _queue_folder(spark, sf_dir)
    ckpt = scratch_path(spark, "ckpt_dry")
    drain(spark.readStream.schema(schema).parquet(path), scratch_path(spark, "dry_sink"), ckpt, dry_run=True)
    sink = scratch_path(spark, "after_dry")
    drain(spark.readStream.schema(schema).parquet(path), sink, ckpt)
    return spark.read.parquet(sink).agg(F.count(F.lit(1)).alias("n"))


@query("stream_last_value", """
SELECT user_id, CAST(count(*) AS BIGINT) AS events, arg_max(value, (ts, event_id)) AS last_value
FROM events GROUP BY user_id""")
def q_stream_last_value(spark, sf_dir):
    """T-6: running count and last value per user, kept as streaming state.

    Update mode: each micro-batch emits only the users that changed into an
    upsert log; the current table is the latest row per user.
    """
    path, schema = _queue_folder(spark, sf_dir)
    stream = spark.readStream.schema(schema).parquet(path)
    sink = scratch_path(spark, "last_value")
    run_available_now(last_value_per_key(stream, "user_id", "value", ["ts", "event_id"]),
                      scratch_path(spark, "ckpt_last"), upsert_log(sink, "user_id"), output_mode="update")
    compact_log(spark, sink, "user_id")
    return read_latest(spark, sink, "user_id")


_QUEUE = "event_id bigint, event_type string, user_id bigint, value double"


def _queue_in_two_runs(spark, sf_dir, each, upto=("half", "all")):
    """Events put into a queue table, and ``each(run)`` called when a first and then a second part is there."""
    e = table(spark, sf_dir, "events").selectExpr("CAST(event_id AS bigint) AS event_id", "event_type", "CAST(user_id AS bigint) AS user_id", "CAST(value AS double) AS value")
    half = e.agg((F.max("event_id") / 2).cast("bigint").alias("h")).first()["h"]
    path = scratch_path(spark, "queue")
    for run, part in ((1, e.where(F.col("event_id") <= half)), (2, e.where(F.col("event_id") > half))):
        part.write.mode("append").parquet(path)
        each(run, path)
    return half


@query("stream_queue_source", """
SELECT event_id, event_type, CASE WHEN event_id <= (SELECT max(event_id) // 2 FROM events) THEN 1 ELSE 2 END AS run FROM events
""")
def q_stream_queue_source(spark, sf_dir):
    """S-15, T-5: a queue read by id offsets over a dry run and two runs on one checkpoint."""
    from rivulet.streaming.source import queue_stream
    sink, checkpoint = scratch_path(spark, "queue_sink"), scratch_path(spark, "queue_ckpt")

    def run_once(run, path):
        stream = queue_stream(spark, path, _QUEUE, "event_id").withColumn("run", F.lit(run))
        if run == 1:
            drain(stream, sink, checkpoint, dry_run=True)
        drain(stream, f"{sink}/run={run}", checkpoint)

    _queue_in_two_runs(spark, sf_dir, run_once)
    parts = [spark.read.schema(_QUEUE + ", run int").parquet(f"{sink}/run={r}") for r in (1, 2)]
    return parts[0].unionByName(parts[1]).select("event_id", "event_type", "run")


@query("stream_iteration", """
SELECT event_id, event_type, row_number() OVER w - 1 AS iteration, CAST(lag(user_id) OVER w AS VARCHAR) AS previous
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)
""")
def q_stream_iteration(spark, sf_dir):
    """C-7, T-6: each record's number within its event name and the value before it, kept in state over two runs."""
    from rivulet.streaming.source import numbered, queue_stream
    sink, checkpoint = scratch_path(spark, "iteration_sink"), scratch_path(spark, "iteration_ckpt")

    def run_once(run, path):
        stream = numbered(queue_stream(spark, path, _QUEUE, "event_id"), "event_type", "event_id", "user_id")
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append") \
            .trigger(availableNow=True).start().awaitTermination()

    _queue_in_two_runs(spark, sf_dir, run_once)
    return spark.read.parquet(sink).select("event_id", "event_type", "iteration", "previous")
