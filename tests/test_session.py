"""Session helpers: shared folder, materialize, scale settings."""

from rivulet.session import apply_scale_conf, materialize, scratch_path, shared_dir


def test_scratch_paths_are_unique_and_shared(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(shared_dir(spark).rstrip("/"))


def test_materialize_cuts_lineage(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS twice")
    m = materialize(df, "test_mat")
    assert m.count() == 100 and sorted(m.columns) == ["id", "twice"]
    assert m.inputFiles()  # reads the written files, not the original plan


def test_apply_scale_conf_sets_runtime_conf(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        conf = apply_scale_conf(spark, 10 * 2**30, cores=8)
        assert spark.conf.get("spark.sql.shuffle.partitions") == conf["spark.sql.shuffle.partitions"] == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                  "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold",
                  "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
                  "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"):
            spark.conf.unset(k)


def test_scratch_has_an_owner(spark):
    import os
    from rivulet.session import materialize, scratch_root, scratch_scope
    with scratch_scope(spark) as path:
        assert materialize(spark.range(3), "x").count() == 3
        folder = path.removeprefix("file:")
        assert os.path.isdir(folder) and path.startswith(scratch_root(spark))
    assert not os.path.exists(folder)


def test_no_machine_local_scratch_on_a_cluster():
    import pytest
    from types import SimpleNamespace
    from rivulet.session import shared_dir

    def session(master, conf):
        sc = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(conf=conf, sparkContext=sc)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master, {}))
        assert shared_dir(session(master, {"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"
    assert "rivulet-ckpt-" in shared_dir(session("local[2]", {}))
