"""Session defaults and the shared scratch folder.

On a cluster the shared folder is whatever the deployment put in
``spark.checkpoint.dir``; only when that is unset (tests, a laptop) do we
create one of our own.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on; a cluster may add to them but should keep these.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state on executor disk with checkpoints, not in the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "rivulet", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    apply_session_defaults(spark)
    return spark


def apply_session_defaults(spark: SparkSession) -> None:
    """Runtime SQL settings that can be changed on an existing session."""
    for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
              "spark.sql.session.timeZone", "spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set(k, DEFAULT_CONF[k])


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only where the session has none and runs in
    one process (``local*``: tests, a laptop).  Anywhere else every executor
    would write to its own disk, so a missing setting raises.
    """
    try:
        d = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # not readable as a SQL conf in some deployments
        d = None
    if d:
        return d
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        return d
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir is not set: {sc.master} needs a folder that all executors share")
    d = tempfile.mkdtemp(prefix="rivulet-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/rivulet-scratch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path in the innermost open ``scratch_scope``, else in the application's folder."""
    return f"{_SCOPES[-1] if _SCOPES else scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_SCOPES: list[str] = []


def drop_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder of ours on whatever file system it lies."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True))


def drop_scratch(spark: SparkSession) -> bool:
    """Delete every intermediate table of this application; call it when no frame of the session is needed any more."""
    return drop_path(spark, scratch_root(spark))


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Own the intermediate tables made inside the block; they are deleted when it ends.

    Frames built inside must have been written or collected by then.
    """
    path = scratch_path(spark, "scope")
    _SCOPES.append(path)
    try:
        yield path
    finally:
        _SCOPES.remove(path)
        drop_path(spark, path)


def materialize(df, name: str, fmt: str = "parquet"):
    """Write ``df`` to a fresh folder under the shared folder and read it back.

    Cuts the lineage (later stages and retries after a lost executor start
    from the written files, not from the sources) and lets several consumers
    share one computation.  Unlike ``localCheckpoint`` the data survives the
    loss of the executors that computed it.  The table belongs to the
    innermost ``scratch_scope`` or, without one, to the application
    (``drop_scratch``).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.format(fmt).save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for code that must touch the local disk (tests only)."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20,
               max_split_bytes: int = 256 << 20) -> dict:
    """Session settings sized for an input of ``input_bytes`` on ``cores`` task slots.

    * scans: splits of at most ``max_split_bytes`` (Parquet still splits at
      row groups);
    * shuffles: an initial partition count that keeps each shuffle partition
      near ``target_partition_bytes`` of input (so sorts and hash tables fit
      in executor memory and spill stays small), never fewer than 2 waves of
      tasks, which AQE then coalesces towards the advisory size;
    * skewed partitions above 4x the median (and 1 GiB) are split by AQE.
    """
    initial = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(max_split_bytes),
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        # broadcast only what the optimizer measures below 64 MiB
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }


def apply_scale_conf(spark: SparkSession, input_bytes: int, cores: int | None = None, **kw) -> dict:
    """Set ``scale_conf`` on a running session (runtime SQL settings only)."""
    conf = scale_conf(input_bytes, cores or spark.sparkContext.defaultParallelism, **kw)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
