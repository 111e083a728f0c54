"""Walks over edges: what can be reached, and in how many steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["reachable"]


def reachable(edges: DataFrame, start: DataFrame, src: str = "src", dst: str = "dst", node: str = "node",
              max_rounds: int = 1000) -> DataFrame:
    """``node`` and ``depth``: every node that ``start`` (``node``) reaches, and the fewest steps to it.

    The table counterpart of a recursive query, for graphs of any size and with
    cycles: each round joins the newest nodes to the edges, drops what was seen,
    and is written to the shared folder, so a lost executor costs one round.
    Copies and NULLs in ``start`` and ``edges`` add nothing.  ``max_rounds`` is a
    guard: a walk that has not ended by then raises.
    """
    from rivulet.session import materialize

    links = edges.select(F.col(f"`{src}`").alias("_from"), F.col(f"`{dst}`").alias("_to"))
    newest = materialize(start.select(F.col(f"`{node}`").alias("_n")).where(F.col("_n").isNotNull()).distinct(), "reach-0")
    rounds = [newest.withColumn("_d", F.lit(0))]
    for depth in range(1, max_rounds + 1):
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.unionByName(r)
        # a node of many edges is a partial aggregate before the shuffle of new nodes
        found = newest.join(links, F.col("_n") == F.col("_from")).select(F.col("_to").alias("_n")).where(F.col("_n").isNotNull()).distinct()
        newest = materialize(found.join(seen.select("_n"), "_n", "left_anti"), f"reach-{depth}")
        if newest.isEmpty():
            return seen.select(F.col("_n").alias(node), F.col("_d").cast("bigint").alias("depth"))
        rounds.append(newest.withColumn("_d", F.lit(depth)))
    raise RuntimeError(f"the walk did not end in {max_rounds} rounds")
