"""Event-queue reader (S-15): queued rows with their JSON payload decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_event_queue(queue: DataFrame, payload_col: str = "eventdata", schema: str | None = None,
                     flow_id=None, flow_col: str = "dataflowid") -> DataFrame:
    """Rows ``{id, dataflowid, stepid, eventdata}`` with the payload parsed.

    With a ``schema`` the payload becomes a struct; without one it becomes a
    ``variant`` (``parse_json``), which keeps any shape.  ``flow_id`` keeps one
    flow's events (pushed down to the scan).
    """
    df = queue if flow_id is None else queue.where(F.col(flow_col) == F.lit(flow_id))
    decoded = F.from_json(F.col(payload_col), schema) if schema else F.parse_json(F.col(payload_col))
    return df.withColumn(payload_col, decoded)
