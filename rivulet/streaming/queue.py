"""Queued events as a Structured Streaming source.

* ``capture`` fans each event out to every listener of its name (T-1).
* ``drain`` consumes what is queued once, with a checkpoint, so a second run
  sees only new events (T-2, T-4, T-5).  Unlike deleting rows before
  processing, a failed batch is retried from the checkpoint: at-least-once,
  and exactly-once with the idempotent batch writer used here.
* ``last_value_per_key`` keeps a running count and last value per key (T-6).

Execution policies (T-3): ``immediately`` = continuous micro-batches,
``adhoc``/``adhocqueued`` = one ``availableNow`` run started now / by the
scheduler.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Execution policies of an event trigger.
POLICIES = ("immediately", "adhoc", "adhocqueued")


def capture(events: DataFrame, listeners: DataFrame, name_col: str = "event_type",
            payload_col: str = "props", flow_col: str | None = None, salt_buckets: int = 0) -> DataFrame:
    """One queue row per (event, listening step) (T-1).

    ``listeners(dataflowid, stepid, eventname)``; with ``flow_col`` an event
    only reaches listeners of its own flow.  Works on a batch or a streaming
    ``events`` frame (stream-static join).  AQE does not run inside
    micro-batches, so when one event name carries most of the traffic and the
    listener table is too large to broadcast, ``salt_buckets`` spreads each
    key over that many tasks (``joins.salted_join``).
    """
    if events.isStreaming:
        # the static side is computed once, not in every micro-batch
        from rivulet.session import materialize
        listeners = materialize(listeners, "listeners")
    if salt_buckets:
        from rivulet.operators.joins import salted_join
        keys = [name_col] + ([flow_col] if flow_col else [])
        lst = listeners.select(F.col("eventname").alias(name_col),
                               *([F.col("dataflowid").alias(flow_col)] if flow_col else []),
                               F.col("dataflowid").alias("_lflow"), "stepid")
        joined = salted_join(events, lst, keys, "inner", salt_buckets)
        return joined.select(F.col("_lflow").alias("dataflowid"), "stepid", F.col(name_col).alias("eventname"),
                             F.col(payload_col).alias("eventdata"),
                             *[F.col(c) for c in events.columns if c not in (name_col, payload_col, flow_col)])
    cond = [events[name_col] == listeners["eventname"]]
    if flow_col:
        cond.append(events[flow_col] == listeners["dataflowid"])
    return events.join(listeners, cond, "inner").select(
        listeners["dataflowid"], listeners["stepid"], events[name_col].alias("eventname"),
        F.col(payload_col).alias("eventdata"), *[events[c] for c in events.columns
                                                 if c not in (name_col, payload_col, flow_col)])


def run_available_now(stream_df: DataFrame, checkpoint: str, batch_fn: Callable[[DataFrame, int], None],
                      output_mode: str = "append", policy: str = "adhoc",
                      timeout_s: float | None = None):
    """Run a streaming frame through ``batch_fn`` until the queue is empty.

    ``policy='immediately'`` returns the running query (micro-batches as
    events arrive); the other policies process what is there and stop.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    w = stream_df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(batch_fn)
    if policy == "immediately":
        return w.trigger(processingTime="0 seconds").start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
    if q.exception() is not None:
        raise q.exception()
    return q


def drain(stream_df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
          transform: Callable[[DataFrame], DataFrame] | None = None, dry_run: bool = False,
          timeout_s: float | None = None):
    """Consume every queued event once and append it (transformed) to ``sink_path``.

    Each micro-batch is written to its own ``batch=<id>`` folder with
    overwrite, so a retried batch replaces its earlier attempt (idempotent).
    A dry run processes the events into the ``noop`` sink and does not keep
    the checkpoint, so the queue stays as it was.
    """
    def write_batch(df: DataFrame, batch_id: int) -> None:
        out = transform(df) if transform else df
        if dry_run:
            out.write.format("noop").mode("overwrite").save()
        else:
            out.write.mode("overwrite").format(fmt).save(f"{sink_path}/batch={batch_id}")

    if dry_run:
        # process what is queued without committing offsets anywhere lasting
        import uuid
        checkpoint = f"{checkpoint.rstrip('/')}-dryrun-{uuid.uuid4().hex[:8]}"
    return run_available_now(stream_df, checkpoint, write_batch, timeout_s=timeout_s)


def upsert_log(path: str, key: str | list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer for ``update`` output mode.

    Each micro-batch (only the keys that changed) is appended under
    ``batch=<id>`` with overwrite of that one folder, so a retried batch
    replaces itself.  ``read_latest`` gives the current value per key.  The
    sink grows with changes, not with re-emitting every key each batch as
    ``complete`` mode would.
    """
    def write_batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write_batch


def _snapshots(path: str) -> str:
    return f"{path.rstrip('/')}_snapshots"


def _newest_snapshot(spark, path: str) -> int | None:
    """Last batch that a snapshot covers, from the folder names."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(_snapshots(path))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath().getName() for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] \
        if fs.exists(folder) else []
    return max((int(n.removeprefix("upto=")) for n in done if n.startswith("upto=")), default=None)


def _log_with_snapshot(spark, path: str) -> DataFrame:
    log = spark.read.parquet(path)
    upto = _newest_snapshot(spark, path)
    if upto is None:
        return log
    # a snapshot's rows carry the batch they came from, so later batches win over them
    return log.where(F.col("batch") > upto).unionByName(spark.read.parquet(f"{_snapshots(path)}/upto={upto}"))


def read_latest(spark, path: str, key: str | list[str]) -> DataFrame:
    """Latest row per key from an ``upsert_log`` folder (partial aggregate by key).

    Reads the newest snapshot and the batches after it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    log = _log_with_snapshot(spark, path)
    cols = [c for c in log.columns if c not in keys and c != "batch"]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch")).alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols])


def compact_log(spark, path: str, key: str | list[str]) -> int:
    """Write a snapshot with the latest row per key of an ``upsert_log`` folder; readers use it from then on.

    The log's batches up to the returned one, and older snapshots, are no
    longer read and may be deleted when no reader is running.
    """
    keys = [key] if isinstance(key, str) else list(key)
    log = _log_with_snapshot(spark, path)
    upto = log.agg(F.max("batch").alias("b")).first()["b"]
    cols = [c for c in log.columns if c not in keys]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch")).alias("_v"))
    latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols]).write.mode("overwrite").parquet(f"{_snapshots(path)}/upto={upto}")
    return upto


def last_value_per_key(events: DataFrame, key: str, value: str, order_cols: list[str]) -> DataFrame:
    """Running count and last value per key, by ``order_cols`` (T-6).

    Works on a stream (output mode ``update``/``complete``) and on a batch.
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("events"),
                                   F.max_by(F.col(value), order).alias("last_value"))
