"""Plan shape checks: pushdown, pruning, partial aggregation and map-side limits
that keep hot keys and large inputs out of single tasks."""

import contextlib
import io
import random

import __spark_entry__ as E
from rivulet.operators import history as H
from rivulet.operators.control import find_first
from rivulet.operators.sqlstep import lookup
from tests.conftest import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_flagship_is_one_scan_with_pushed_filter(spark):
    p = plan(E.entry(spark))
    import re
    assert len(re.findall(r"^\(\d+\) Scan parquet", p, re.M)) == 1 and "Union" not in p
    assert "GreaterThan(value,10.0)" in p


def test_projection_reaches_the_scan(spark):
    p = plan(E.queries()["sql_params"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in p
    assert "EqualTo(o_orderstatus,O)" in p


def _skewed_runs(spark, n=3000):
    rnd = random.Random(5)
    # flow 0 holds a third of all runs
    rows = [(i, 0 if i % 3 == 0 else rnd.randint(1, 50), 1, "finished", float(i), float(i + 1), str(i)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, dataflowid bigint, userid bigint, status string, "
                                       "timestarted double, timefinished double, name string")


def test_hot_key_is_aggregated_before_the_shuffle(spark):
    runs = _skewed_runs(spark)
    p = plan(H.last_run(runs, now=0.0))
    assert "partial_max_by" in p
    p2 = plan(H.last_n_runs(runs, 3))
    tree = p2.split("\n\n")[0]
    # one group limit above the shuffle and one below it (applied map-side, before the data moves)
    assert tree.count("WindowGroupLimit") == 2 and tree.rfind("WindowGroupLimit") > tree.find("Exchange")
    got = {r["id"] for r in H.last_n_runs(runs, 3).where("dataflowid = 0").collect()}
    assert got == {2991, 2994, 2997}


def test_find_first_and_lookup_partial(spark):
    runs = _skewed_runs(spark)
    assert "partial_min_by" in plan(find_first(runs, "status = 'finished'", "id", "dataflowid"))
    recs = spark.range(60).withColumnRenamed("id", "flow")
    p = plan(lookup(recs, runs, {"flow": "dataflowid"}, data_cols=["id"]))
    assert "partial_count" in p and "partial_first" in p  # any_value runs as first()
    hot = {r["flow"]: r["count"] for r in lookup(recs, runs, {"flow": "dataflowid"}, data_cols=["id"]).collect()}
    assert hot[0] == 1000 and hot[55] == 0
