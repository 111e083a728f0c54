"""Job-history tables derived from the driver tables.

The driver data has no run history, so flows, runs, steps, edges, schedule
and queue rows are derived deterministically from ``customer``, ``events``,
``orders`` and ``nation``.  The same SQL text builds them in Spark and (as a
CTE) in DuckDB, so every history query grows with the source tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from rivulet.plans.registry import table

# name -> SQL with {table} placeholders; {EPOCH} is the dialect's epoch-seconds of ts.
STANDINS = {
    "users": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS firstname FROM {nation}",
    "flows": """SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS userid,
                       c_acctbal > 0 AS enabled, CAST((c_nationkey + 3) % 25 AS BIGINT) AS usermodified FROM {customer}""",
    "runs": """SELECT event_id AS id, user_id AS dataflowid, user_id AS userid,
                      CASE event_type WHEN 'error' THEN 'aborted' WHEN 'view' THEN 'processing'
                                      ELSE 'finished' END AS status,
                      CAST({EPOCH} AS DOUBLE) AS timestarted,
                      CASE WHEN event_type = 'view' THEN CAST(0 AS DOUBLE) ELSE {EPOCH} + value END AS timefinished,
                      CAST(event_id AS STRING) AS name FROM {events}""",
    "steps": """SELECT o_orderkey AS id, o_custkey AS dataflowid, 'step_' || CAST(o_orderkey AS STRING) AS alias,
                       CASE o_orderstatus WHEN 'O' THEN 'trigger' WHEN 'F' THEN 'transform'
                                          ELSE 'writer' END AS type,
                       o_orderpriority AS name,
                       '{"eventname": "' || CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'purchase'
                            WHEN '2' THEN 'click' WHEN '3' THEN 'view' WHEN '4' THEN 'signup' ELSE 'error' END
                       || '"}' AS config, CAST(o_custkey % 25 AS BIGINT) AS userid,
                       CAST(o_orderkey % 25 AS BIGINT) AS usermodified FROM {orders}""",
    "edges": """SELECT id AS stepid, id - 1 AS dependson, CAST(0 AS INT) AS position FROM {steps}
                WHERE type <> 'trigger' AND id > 0""",
    "schedule": """SELECT c_custkey AS dataflowid, c_custkey AS stepid, CAST(0 AS BIGINT) AS lastruntime,
                          CAST(floor(c_acctbal) AS BIGINT) AS nextruntime,
                          CAST(floor(c_nationkey / 10) AS INT) AS retrycount FROM {customer}""",
    "queue": """SELECT event_id AS id, user_id AS dataflowid, CAST(0 AS BIGINT) AS stepid, props AS eventdata,
                       event_type AS eventname FROM {events}""",
    "failures": """SELECT dataflowid, stepid, nextruntime + 60 AS retrytime, nextruntime + 3600 AS scheduledtime
                   FROM {schedule} WHERE dataflowid IN (SELECT dataflowid FROM {runs} WHERE status = 'aborted')""",
    "limits": """SELECT * FROM (VALUES ('trigger', 0, 0, 1, 1), ('transform', 1, 1, 0, 1),
                                       ('writer', 1, 1, 0, 0)) AS t(type, min_in, max_in, min_out, max_out)""",
}

SPARK_EPOCH = "unix_seconds(CAST(ts AS TIMESTAMP))"
DUCK_EPOCH = "(epoch_us(ts) // 1000000)"
_PH = re.compile(r"\{(\w+)\}")


def _fill(text: str, epoch: str) -> str:
    return text.replace("{EPOCH}", epoch)


def duck_cte() -> str:
    """``WITH`` clause defining every stand-in table for DuckDB."""
    parts = []
    for name, text in STANDINS.items():
        body = _PH.sub(lambda m: m.group(1), _fill(text, DUCK_EPOCH))
        parts.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n"


def standins(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The stand-in tables as lazy Spark frames."""
    out: dict[str, DataFrame] = {}
    for name, text in STANDINS.items():
        refs = set(_PH.findall(text)) - {"EPOCH"}
        frames = {r: out[r] if r in out else table(spark, sf_dir, r) for r in refs}
        sql = _fill(text, SPARK_EPOCH).replace('{"eventname": "', '{{"eventname": "').replace('"}', '"}}')
        out[name] = spark.sql(sql, **frames)
    return out
