"""Registered queries: switch, merge and tee (R-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators.routing import branch_counts, label_cases, merge, switch, tee, unmatched, write_switch
from rivulet.session import scratch_path
from rivulet.plans.registry import query, table

ROUTE_CASES = {
    "high": "value >= 200",
    "mid": "value >= 50",
    "low": "value < 50",
}


@query("switch_route", """
SELECT event_id, value, CASE WHEN value >= 200 THEN 'high' WHEN value >= 50 THEN 'mid'
                             WHEN value < 50 THEN 'low' END AS branch FROM events""")
def q_switch_route(spark, sf_dir):
    """R-1: each row goes to the first case that holds."""
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    return label_cases(ev, ROUTE_CASES)


@query("switch_first_match", """
SELECT 'a' AS branch, CAST(count(*) AS BIGINT) AS n FROM events
UNION ALL SELECT 'b', CAST(0 AS BIGINT)""")
def q_switch_first_match(spark, sf_dir):
    """R-1: two cases that are both always true: everything goes to the first."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    return branch_counts(ev, {"a": F.lit(1), "b": F.lit(1)})


@query("switch_mod", """
SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS branch, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1""")
def q_switch_mod(spark, sf_dir):
    """R-1: non-boolean cases by truthiness: ``user_id % 2 == 0`` / ``user_id % 2`` (1 is true)."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    lab = label_cases(ev, {"even": "user_id % 2 = 0", "odd": "user_id % 2"})
    return lab.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@query("switch_default", """
SELECT event_id, event_type, CASE WHEN event_type = 'purchase' THEN 'sale'
                                  WHEN event_type = 'signup' THEN 'growth' ELSE 'default' END AS branch
FROM events""")
def q_switch_default(spark, sf_dir):
    """R-2: a last case ``1`` catches everything else."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    return label_cases(ev, {"sale": "event_type = 'purchase'", "growth": "event_type = 'signup'", "default": 1})


@query("switch_unmatched", """
SELECT event_id, event_type, value FROM events
WHERE NOT (event_type = 'purchase') AND NOT (value > 300)""")
def q_switch_unmatched(spark, sf_dir):
    """R-3: rows no case accepts reach no branch; they are returned for counting."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return unmatched(ev, {"sale": "event_type = 'purchase'", "big": "value > 300"})


@query("merge_branches", """
SELECT event_id, event_type, value, NULL::DOUBLE AS bonus FROM events WHERE event_type = 'view'
UNION ALL
SELECT event_id, event_type, value, value * 0.1 AS bonus FROM events WHERE event_type = 'purchase'
UNION ALL
SELECT event_id, event_type, value, NULL::DOUBLE AS bonus FROM events WHERE event_type NOT IN ('view', 'purchase')""")
def q_merge_branches(spark, sf_dir):
    """R-5: branches merged back by column name; a column only one branch has is NULL elsewhere."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    b = switch(ev, {"view": "event_type = 'view'", "buy": "event_type = 'purchase'", "rest": 1})
    b["buy"] = b["buy"].withColumn("bonus", F.col("value") * 0.1)
    return merge(b["view"], b["buy"], b["rest"])


@query("tee", """
SELECT 'count' AS sink, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders
UNION ALL
SELECT 'open', CAST(count(*) AS BIGINT), round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'O'""")
def q_tee(spark, sf_dir):
    """R-6: one input feeding two sinks, computed once (persisted while the sinks run)."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice")

    def all_rows(df):
        return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).first()

    def open_rows(df):
        return df.where(F.col("o_orderstatus") == "O").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).first()

    r1, r2 = tee(o, [all_rows, open_rows])
    return spark.createDataFrame([("count", r1["n"], r1["total"]), ("open", r2["n"], r2["total"])],
                                 "sink string, n bigint, total double")


@query("switch_partitioned_write", """
SELECT CASE WHEN value >= 200 THEN 'high' WHEN value >= 50 THEN 'mid' WHEN value < 50 THEN 'low' END AS branch,
       CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def q_switch_partitioned_write(spark, sf_dir):
    """R-1: every branch written to its own folder by one job; read back per branch."""
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    path = scratch_path(spark, "branches")
    write_switch(ev, ROUTE_CASES, path)
    return spark.read.parquet(path).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))
