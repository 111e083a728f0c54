"""Range lookups against plain comparison of all pairs, with ties, hot values, NULLs and repeated records."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators.rangelookup import lookup_between, running_positions


def data(spark, n=300, m=400):
    rnd = random.Random(7)
    pick = lambda top: rnd.choice([None, 5, 5, 5, rnd.randint(0, top)])
    recs = [(rnd.choice([1, 1, 2, None]), pick(20), pick(20)) for _ in range(n)]
    recs += recs[:5]
    rows = [(rnd.choice([1, 1, 2, 3, None]), pick(20), i) for i in range(m)]
    rows += [(2, 100 + i, 1000 + i) for i in range(30)]
    recs += [(2, 100 + i, 100 + i) for i in range(0, 40, 3)]
    return (spark.createDataFrame(recs, "k int, lo bigint, hi bigint").repartition(5),
            spark.createDataFrame(rows, "tk int, v int, id bigint").repartition(4), recs, rows)


def brute(recs, rows, low, high, il, ih, keyed):
    out = []
    for k, lo, hi in recs:
        hits = [i for tk, v, i in rows if v is not None and (not keyed or (k is not None and tk == k))
                and (not low or (lo is not None and (v >= lo if il else v > lo)))
                and (not high or (hi is not None and (v <= hi if ih else v < hi)))]
        out.append((k, lo, hi, len(hits), hits[0] if len(hits) == 1 else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("low,high,il,ih,keyed", [
    (True, True, True, True, False), (True, True, False, True, True), (True, True, True, False, True),
    (True, True, False, False, True), (True, False, True, True, False), (False, True, True, False, True)])
def test_against_all_pairs(spark, low, high, il, ih, keyed):
    r, t, recs, rows = data(spark)
    out = lookup_between(r, t, "v", "lo" if low else None, "hi" if high else None, il, ih, on={"k": "tk"} if keyed else None,
                         data_cols=["id"], num_partitions=6)
    got = sorted(((x["k"], x["lo"], x["hi"], x["count"], x["data"] and x["data"]["id"]) for x in out.collect()), key=repr)
    assert got == brute(recs, rows, low, high, il, ih, keyed)


def test_no_pairs_in_the_plan_and_even_tasks(spark):
    """No nested loop, and a value that all rows share is cut into ranges."""
    r = spark.range(4000).selectExpr("id", "5 AS lo", "5 AS hi")
    t = spark.range(4000).selectExpr("5 AS v", "id")
    out = lookup_between(r, t, "v", "lo", "hi", data_cols=["id"], num_partitions=8)
    assert {x["count"] for x in out.select("count").collect()} == {4000}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    events = t.selectExpr("v", "id", "1 AS one")
    ranges = events.repartitionByRange(8, "v", "id").rdd.glom().map(len).collect()
    assert max(ranges) < 3 * sorted(ranges)[len(ranges) // 2]
    pos = running_positions(events, ["v", "id"], "one", "p", 8)
    assert sorted(x["p"] for x in pos.collect()) == list(range(1, 4001))


def test_empty_tables_and_wrong_use(spark):
    r = spark.createDataFrame([(1, 2)], "lo int, hi int")
    t = spark.createDataFrame([], "v int, id int")
    assert [tuple(x) for x in lookup_between(r, t, "v", "lo", "hi").collect()] == [(1, 2, 0, None)]
    assert lookup_between(r.limit(0), spark.createDataFrame([(1, 1)], "v int, id int"), "v", "lo", "hi").count() == 0
    with pytest.raises(ValueError):
        lookup_between(r, t, "v")
    with pytest.raises(ValueError):
        lookup_between(r, t, "v", "lo", count_col="hi")


def test_records_without_an_only_match_are_spread(spark):
    from rivulet.operators.rangelookup import _only_match
    got = spark.range(0, 4000, 1, 4).select(_only_match(F.col("id") % 5, F.col("id"), F.monotonically_increasing_id()).alias("k"), "id").collect()
    assert len({r["k"] for r in got}) == 4000 and all(r["k"] == r["id"] + 1 if r["id"] % 5 == 1 else r["k"] < 0 for r in got)


def test_ranges_follow_the_rows(spark, monkeypatch):
    from rivulet.operators import rangelookup
    from rivulet import session
    monkeypatch.setattr(rangelookup, "RANGE_ROWS", 100)
    kept = []
    monkeypatch.setattr(session, "materialize", lambda df, name, make=session.materialize: kept.append((name, make(df, name))) or kept[-1][1])
    pos = running_positions(spark.range(4000).selectExpr("id % 3 AS v", "id", "1 AS one"), ["v", "id"], "one", "p")
    assert sorted(x["p"] for x in pos.collect()) == list(range(1, 4001))
    sizes = [x["count"] for name, df in kept for x in df.groupBy("_rp_range").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 300
