"""As-of join against a brute-force answer, with a hot key and matches carried across buckets."""

import random

from pyspark.sql import functions as F

from rivulet.operators.joins import asof_join


import pytest


@pytest.mark.parametrize("width", [37, None])
def test_asof_matches_brute_force(spark, width):
    rnd = random.Random(11)
    left = [(i, 0 if i % 3 else rnd.randint(1, 4), rnd.randint(0, 1000)) for i in range(300)]
    right = [(100 + j, 0 if j % 2 else rnd.randint(1, 4), rnd.randint(0, 1000)) for j in range(120)]
    ldf = spark.createDataFrame(left, "id bigint, k bigint, t bigint")
    rdf = spark.createDataFrame(right, "id bigint, k bigint, t bigint")
    got = {r["id"]: r["r_id"] for r in
           asof_join(ldf, rdf, ["k"], F.col("t"), F.col("t"), ["id"], bucket_width=width, right_tiebreak="id",
                     num_partitions=7).collect()}
    want = {}
    for lid, lk, lt in left:
        cands = [(rt, rid) for rid, rk, rt in right if rk == lk and rt <= lt]
        want[lid] = max(cands)[1] if cands else None
    assert got == want


def test_salted_join_equals_plain_join(spark):
    from rivulet.operators.joins import salted_join
    big = spark.createDataFrame([(i, 0 if i % 3 == 0 else i % 7) for i in range(600)], "id bigint, k bigint")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k bigint, v string")
    plain = sorted(tuple(r) for r in big.join(small, ["k"], "left").select("id", "k", "v").collect())
    for hot in (None, spark.createDataFrame([(0,)], "k bigint")):
        salted = salted_join(big, small, ["k"], "left", salt_buckets=8, hot_keys=hot)
        assert sorted(tuple(r) for r in salted.select("id", "k", "v").collect()) == plain


def test_hot_keys(spark):
    from rivulet.operators.joins import hot_keys
    df = spark.createDataFrame([(0,)] * 50 + [(k,) for k in range(1, 11)], "k bigint")
    assert [r["k"] for r in hot_keys(df, ["k"], rows_per_task=20).collect()] == [0]


def test_asof_single_hot_key_spread_over_partitions(spark):
    rnd = random.Random(3)
    left = [(i, 1, rnd.randint(0, 5000)) for i in range(400)]
    right = [(1000 + j, 1, rnd.randint(0, 5000)) for j in range(200)]
    ldf = spark.createDataFrame(left, "id bigint, k bigint, t bigint")
    rdf = spark.createDataFrame(right, "id bigint, k bigint, t bigint")
    out = asof_join(ldf, rdf, ["k"], F.col("t"), F.col("t"), ["id"], right_tiebreak="id", num_partitions=9)
    got = {r["id"]: r["r_id"] for r in out.collect()}
    want = {}
    for lid, _, lt in left:
        cands = [(rt, rid) for rid, _, rt in right if rt <= lt]
        want[lid] = max(cands)[1] if cands else None
    assert got == want


def test_asof_nulls_match_nothing(spark):
    left = spark.createDataFrame([(1, 1, 10), (2, None, 10), (3, 1, None)], "id bigint, k bigint, t bigint")
    right = spark.createDataFrame([(7, 1, 5), (8, None, 5), (9, 1, None)], "id bigint, k bigint, t bigint")
    for width in (4, None):
        out = asof_join(left, right, ["k"], F.col("t"), F.col("t"), ["id"], bucket_width=width, right_tiebreak="id", num_partitions=3)
        assert {r["id"]: r["r_id"] for r in out.collect()} == {1: 7, 2: None, 3: None}


def test_salted_join_spreads_equal_rows_and_allows_maps(spark):
    from rivulet.operators.joins import salted_join
    big = spark.createDataFrame([(0, {"a": 1})] * 400, "k bigint, m map<string,int>")
    small = spark.createDataFrame([(0, "x")], "k bigint, v string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = salted_join(big, small, ["k"], salt_buckets=16)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 400 and max(sizes) <= 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
