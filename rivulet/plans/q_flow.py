"""The flagship flow: read events → alter → filter → switch → merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.routing import label_cases, switch_merge
from rivulet.operators.transform import alter, filter_rows
from rivulet.plans.registry import query, table

# Cases of the flagship switch, first match wins.
FLAG_CASES = {
    "buy": "event_type = 'purchase'",
    "browse": "event_type IN ('click', 'view')",
    "other": "1",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    shaped = alter(events, {
        "value_x2": "${{ round(value * 2, 2) }}",
        "tag": "${{ event_type }}:${{ user_id }}",
    })
    kept = filter_rows(shaped, "value > 10")
    # switch → per-branch alter → merge, planned as one pass over one scan
    return switch_merge(kept, FLAG_CASES, {
        "buy": {"bonus": "${{ value / 10 }}"},
        "browse": {"tag": "browse:${{ user_id }}"},
    })


query("flow_events", """
SELECT event_id, user_id, event_type, value, round(value * 2, 2) AS value_x2,
       CASE WHEN event_type IN ('click', 'view') THEN 'browse:' || CAST(user_id AS VARCHAR)
            ELSE event_type || ':' || CAST(user_id AS VARCHAR) END AS tag,
       CASE WHEN event_type = 'purchase' THEN 'buy'
            WHEN event_type IN ('click', 'view') THEN 'browse' ELSE 'other' END AS branch,
       CASE WHEN event_type = 'purchase' THEN value / 10 END AS bonus
FROM events WHERE value > 10
""")(flagship)


@query("flow_branch_counts", """
SELECT CASE WHEN event_type = 'purchase' THEN 'buy'
            WHEN event_type IN ('click', 'view') THEN 'browse' ELSE 'other' END AS branch,
       count(*) AS n, round(sum(value), 2) AS total
FROM events WHERE value > 10 GROUP BY 1
""")
def flow_branch_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    labelled = label_cases(filter_rows(events, "value > 10"), FLAG_CASES)
    return labelled.groupBy("branch").agg(F.count(F.lit(1)).alias("n"),
                                          F.round(F.sum("value"), 2).alias("total"))
