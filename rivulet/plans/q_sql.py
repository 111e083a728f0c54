"""Registered queries: SQL reader / SQL steps (S-7 … S-10, Q-1 … Q-4).

Pass-through SQL is written once with ``{table}`` placeholders: Spark binds
them to the frames, the DuckDB twin is the same text without braces.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rivulet.operators.joins import asof_join
from rivulet.operators.sqlstep import dml_delete, dml_insert, dml_update, lookup, sql_once
from rivulet.plans.registry import TABLES, query, table
from rivulet.session import scratch_path
from rivulet.sources.sql import incremental_read, sql_read
from rivulet.state import StateTable


def _frames(spark, sf_dir, text):
    names = set(re.findall(r"\{(\w+)\}", text))
    return {n: table(spark, sf_dir, n) for n in names if n in TABLES}


def _duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def passthrough(name: str, text: str, args: dict | None = None, duck_text: str | None = None):
    """Register a SQL-reader query over the driver tables."""
    def run(spark, sf_dir):
        return sql_read(spark, text, _frames(spark, sf_dir, text), args)
    run.__name__ = f"q_{name}"
    run.__doc__ = f"Q-4 pass-through SQL: {name}"
    query(name, duck_text if duck_text is not None else _duck(text))(run)


# ---- S-7 … S-9: SQL reader, bound parameters, optional fragments ----

passthrough("sql_read", """
SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'F'""")

passthrough("sql_params", """
SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :minprice""",
            args={"status": "O", "minprice": 100000},
            duck_text="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")

passthrough("sql_optional_fragment", """
SELECT o_orderkey, o_custkey, o_orderpriority FROM {orders} WHERE o_orderstatus = :status
[[ AND o_custkey > :mincust ]] [[ AND o_orderpriority = :prio ]]""",
            args={"status": "P", "mincust": 500, "prio": None},
            duck_text="SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_custkey > 500")


# ---- S-10: incremental reads over two runs ----

def _two_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    src = scratch_path(spark, "inc_src")
    o.write.parquet(src)
    st = StateTable(spark, scratch_path(spark, "inc_state"))
    run1 = incremental_read(spark.read.parquet(src), "o_orderkey", st)
    out1 = scratch_path(spark, "inc_out1")
    run1.observed().write.parquet(out1)
    run1.commit()
    # new rows arrive: this period's finished orders, with fresh keys above the old ones
    top = o.select(F.max("o_orderkey")).scalar()
    arrivals = o.where(F.col("o_orderstatus") == "F").withColumn("o_orderkey", F.col("o_orderkey") + top + 1)
    arrivals.write.mode("append").parquet(src)
    run2 = incremental_read(spark.read.parquet(src), "o_orderkey", st)
    return out1, run2


@query("incremental_batch_1", "SELECT * FROM orders")
def q_incremental_batch_1(spark, sf_dir):
    """S-10: first run with no mark reads everything; the mark becomes the last key."""
    out1, _ = _two_runs(spark, sf_dir)
    return spark.read.parquet(out1)


@query("incremental_batch_2", """
SELECT o_orderkey + (SELECT max(o_orderkey) + 1 FROM orders) AS o_orderkey, o_custkey, o_orderstatus,
       o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'F'""")
def q_incremental_batch_2(spark, sf_dir):
    """S-10: the second run reads only rows that arrived after the saved mark."""
    _, run2 = _two_runs(spark, sf_dir)
    return run2.df


# ---- Q-1 … Q-3: SQL steps ----

@query("lookup_count_data", """
WITH m AS (SELECT o_custkey, count(*) AS n, any_value(o_orderkey) AS k, any_value(o_totalprice) AS p
           FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey)
SELECT c.c_custkey, c.c_name, coalesce(m.n, 0) AS count,
       CASE WHEN m.n = 1 THEN m.k END AS data_orderkey, CASE WHEN m.n = 1 THEN m.p END AS data_totalprice
FROM customer c LEFT JOIN m ON c.c_custkey = m.o_custkey""")
def q_lookup_count_data(spark, sf_dir):
    """Q-1: per customer the number of matching orders and the order when exactly one matches."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").where(
        (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"))
    out = lookup(c, o, {"c_custkey": "o_custkey"}, data_cols=["o_orderkey", "o_totalprice"])
    return out.select("c_custkey", "c_name", "count", F.col("data.o_orderkey").alias("data_orderkey"),
                      F.col("data.o_totalprice").alias("data_totalprice"))


@query("sql_once", """
SELECT CAST(count(*) AS BIGINT) AS count, max(top) AS data_top FROM (SELECT max(o_totalprice) AS top FROM orders)""")
def q_sql_once(spark, sf_dir):
    """Q-2: a query run once; its single row becomes the step's data."""
    text = "SELECT max(o_totalprice) AS top FROM {orders}"
    one = sql_once(spark, text, _frames(spark, sf_dir, text))
    return one.select("count", F.col("data.top").alias("data_top"))


@query("dml_insert", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL
SELECT s_suppkey + 1000000000, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def q_dml_insert(spark, sf_dir):
    """Q-3 INSERT: a new snapshot with the rows added."""
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1000000000).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    return dml_insert(c, s)


@query("dml_delete", """
SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_dml_delete(spark, sf_dir):
    """Q-3 DELETE: a new snapshot without the matching rows (anti-join)."""
    o = table(spark, sf_dir, "orders")
    keys = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("o_custkey"))
    return dml_delete(o, keys, "o_custkey")


@query("dml_update", """
SELECT c.c_custkey, c.c_name, c.c_nationkey, coalesce(s.s_acctbal, c.c_acctbal) AS c_acctbal, c.c_mktsegment
FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey""")
def q_dml_update(spark, sf_dir):
    """Q-3 UPDATE: given fields replaced for matching keys only."""
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"),
                                                F.col("s_acctbal").alias("c_acctbal"))
    return dml_update(c, s, "c_custkey", ["c_acctbal"])


# ---- Q-4: pass-through classes ----

passthrough("join_inner", """
SELECT o.o_orderkey, c.c_name, n.n_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey""")

passthrough("join_left", """
SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o
ON o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'P'""")

passthrough("join_full", """
SELECT coalesce(a.k, b.k) AS nationkey, a.nc, b.ns FROM
 (SELECT c_nationkey AS k, count(*) AS nc FROM {customer} WHERE c_acctbal > 9000 GROUP BY c_nationkey) a
FULL OUTER JOIN
 (SELECT s_nationkey AS k, count(*) AS ns FROM {supplier} WHERE s_acctbal > 5000 GROUP BY s_nationkey) b
ON a.k = b.k""")

passthrough("join_semi", """
SELECT c_custkey, c_name FROM {customer} c
WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)""")

passthrough("join_anti", """
SELECT c_custkey, c_name FROM {customer} c
WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""")

passthrough("join_range", """
SELECT l.l_orderkey, l.l_linenumber, o.o_orderdate, l.l_shipdate FROM {lineitem} l JOIN {orders} o
ON l.l_orderkey = o.o_orderkey AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL '60' DAY""")


@query("join_asof", """
SELECT p.event_id, p.user_id, p.ts, v.event_id AS r_event_id, v.ts AS r_ts
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') v
ON p.user_id = v.user_id AND p.ts >= v.ts""")
def q_join_asof(spark, sf_dir):
    """Q-4 as-of: each purchase with the same user's latest view at or before it."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    buys = ev.where(F.col("event_type") == "purchase").drop("event_type")
    views = ev.where(F.col("event_type") == "view").drop("event_type")
    return asof_join(buys, views, ["user_id"], micros, micros, ["event_id", "ts"],
                     bucket_width=86_400_000_000, right_tiebreak="event_id")


passthrough("agg_group", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price, round(avg(l_discount), 6) AS avg_disc,
       count(*) AS count_order
FROM {lineitem} GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""")

passthrough("agg_distinct", """
SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) AS orders
FROM {orders} GROUP BY o_orderstatus""")

passthrough("agg_rollup", """
SELECT c_mktsegment, c_nationkey, CAST(grouping(c_mktsegment) AS INT) AS g_seg, count(*) AS n,
       round(sum(c_acctbal), 2) AS bal
FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)""")

passthrough("agg_cube", """
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g_flag,
       CAST(grouping(l_linestatus) AS INT) AS g_status, count(*) AS n
FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)""")

passthrough("agg_grouping_sets", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")

passthrough("win_rank", """
SELECT l_orderkey, l_linenumber,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS BIGINT) AS rn,
       CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS BIGINT) AS rnk,
       CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS BIGINT) AS drnk
FROM {lineitem}""")

passthrough("win_lag", """
SELECT o_orderkey, o_custkey,
       lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_total,
       lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next2
FROM {orders}""")

passthrough("win_frame", """
SELECT o_orderkey, o_custkey,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                     ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run3,
       first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_key,
       CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n_cust
FROM {orders}""")

passthrough("topk", """
SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")

passthrough("set_union", """
SELECT c_nationkey AS nationkey FROM {customer} WHERE c_acctbal > 9900
UNION SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 9000""")

passthrough("set_intersect", """
SELECT c_nationkey AS nationkey FROM {customer} WHERE c_mktsegment = 'BUILDING'
INTERSECT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000""")

passthrough("set_except", """
SELECT o_custkey AS custkey FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0""")

passthrough("subquery_scalar", """
SELECT o_orderkey, o_totalprice FROM {orders}
WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM {orders})""")

passthrough("subquery_exists", """
SELECT c_custkey, c_nationkey FROM {customer}
WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)""")

passthrough("cte", """
WITH big AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey),
     seg AS (SELECT c_custkey, c_mktsegment FROM {customer})
SELECT s.c_mktsegment, count(*) AS customers, round(sum(b.total), 2) AS total
FROM big b JOIN seg s ON b.o_custkey = s.c_custkey GROUP BY s.c_mktsegment""")


@query("join_salted", """
SELECT e.event_id, e.user_id, c.c_name, c.c_mktsegment FROM events e JOIN customer c ON e.user_id = c.c_custkey""")
def q_join_salted(spark, sf_dir):
    """Q-4 with skew handling: the busiest users' events are salted over 8 tasks,
    only those users' customer rows are replicated."""
    from rivulet.operators.joins import hot_keys, salted_join
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    # users with more events than one task should get (found from the data)
    hot = hot_keys(ev, ["user_id"], rows_per_task=20)
    return salted_join(ev, cust, ["user_id"], "inner", salt_buckets=8, hot_keys=hot)


@query("join_asof_range", """
SELECT p.event_id, p.user_id, p.ts, v.event_id AS r_event_id, v.ts AS r_ts
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') v
ON p.user_id = v.user_id AND p.ts >= v.ts""")
def q_join_asof_range(spark, sf_dir):
    """Q-4 as-of with buckets taken from the range-partitioned (user, time) order:
    balanced by construction, whatever the skew of users or time."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    buys = ev.where(F.col("event_type") == "purchase").drop("event_type")
    views = ev.where(F.col("event_type") == "view").drop("event_type")
    return asof_join(buys, views, ["user_id"], micros, micros, ["event_id", "ts"], right_tiebreak="event_id")
