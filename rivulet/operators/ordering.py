"""Ordered operators that must not pull a whole table into one task.

A window with ``ORDER BY`` and no ``PARTITION BY`` moves every row to a
single partition.  ``with_row_index`` gives the same 1-based (or 0-based)
position with a range-partitioned sort, a per-partition row count (one row
per partition) and a broadcast of those offsets, whose size is bounded by the
number of shuffle partitions, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.coerce import as_column

_LOW_BITS = (1 << 33) - 1


def _order_cols(order_by) -> list[Column]:
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    return [as_column(c) if not isinstance(c, str) else F.col(c) for c in order_by]


def _shuffle_partitions(df: DataFrame) -> int:
    value = str(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return int(value) if value.isdigit() else 200


def order_key(order_by) -> Column:
    """Key for ``max_by``/``min_by``: the column itself when there is one (a
    primitive key keeps the aggregate hash-based), else a struct, which
    compares field by field."""
    cols = _order_cols(order_by)
    return cols[0] if len(cols) == 1 else F.struct(*cols)


def with_row_index(df: DataFrame, order_by, name: str = "row_index", start: int = 1,
                   num_partitions: int | None = None) -> DataFrame:
    """Add the global position of each row under ``order_by``.

    ``order_by`` must be a total order (end it with a unique key) so the
    numbering is the same on every recomputation, for example after an
    executor is lost.  The range partitioning has an explicit partition
    count (default: ``spark.sql.shuffle.partitions``), which AQE never
    coalesces.  Each row's partition and position are tagged as data and
    written once to the shared folder (``session.materialize``): Spark seeds
    the range partitioner's sampling per execution, so two branches that
    re-ran the sort (the counts and the rows, pruned differently) could see
    different boundaries.  Runs one job now; the result is then lazy.
    """
    from rivulet.session import materialize

    cols = _order_cols(order_by)
    n = num_partitions or _shuffle_partitions(df)
    tagged = materialize(
        df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
          .withColumn("_ri_pid", F.spark_partition_id())
          .withColumn("_ri_mid", F.monotonically_increasing_id()),
        "row_index")
    counts = tagged.groupBy("_ri_pid").agg(F.count(F.lit(1)).alias("_ri_n"))
    w = Window.orderBy("_ri_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_ri_pid", F.coalesce(F.sum("_ri_n").over(w), F.lit(0)).alias("_ri_off"))
    # offsets has one row per shuffle partition: a size bound independent of the data.
    out = tagged.join(F.broadcast(offsets), "_ri_pid")
    pos = F.col("_ri_off") + F.col("_ri_mid").bitwiseAND(F.lit(_LOW_BITS)) + F.lit(start)
    return out.withColumn(name, pos.cast("bigint")).drop("_ri_pid", "_ri_mid", "_ri_off")


def offset_limit(df: DataFrame, order_by, offset: int = 0, limit: int | None = None,
                 index_name: str = "row_index") -> DataFrame:
    """Rows ``offset+1 … offset+limit`` under ``order_by`` with their position.

    ``limit`` of 0 or None means all remaining rows.
    """
    out = with_row_index(df, order_by, index_name, start=1)
    cond = F.col(index_name) > F.lit(offset)
    if limit:
        cond = cond & (F.col(index_name) <= F.lit(offset + limit))
    return out.where(cond)
