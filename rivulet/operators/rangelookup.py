"""Lookups by a range of values, without comparing pairs (Q-1 with an inequality).

How many table rows lie between two bounds is a difference of two positions in
the table's order, and the only match of a record, if there is one, is the row
at the next position.  So records and table are put into one order by value,
once, and no pair is made: the work does not grow with the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.coerce import as_column
from rivulet.operators.ordering import _shuffle_partitions

__all__ = ["lookup_between", "running_positions"]

# places of an event among those of one key: before all values, at a value, after all values
_BEFORE, _AT, _AFTER = 0, 1, 2

# rows that one range of the order holds, about
RANGE_ROWS = 250_000


def running_positions(events: DataFrame, order_by: list[str], counted: str, name: str, num_partitions: int | None = None) -> DataFrame:
    """``events`` with the number of rows up to each one for which ``counted`` is 1.

    The order is cut into ranges of about equal size; ``order_by`` should end
    in a column that tells equal values apart, so that a value which a third of
    all rows share is cut, too.  Their number follows the rows, so that a task
    sorts and buffers no more of a larger table.  Each row's range is written
    as data, the ranges' sums (one row each) are added up and joined back.
    """
    from rivulet.session import materialize

    n = num_partitions or max(_shuffle_partitions(events), -(-events.count() // RANGE_ROWS))
    tagged = materialize(events.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
                         .withColumn("_rp_range", F.spark_partition_id()).withColumn("_rp_at", F.monotonically_increasing_id()), "positions")
    earlier = Window.orderBy("_rp_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy(F.col("_rp_range").alias("_rp_r")).agg(F.sum(counted).alias("_rp_n")) \
        .select("_rp_r", F.coalesce(F.sum("_rp_n").over(earlier), F.lit(0)).alias("_rp_off"))
    here = Window.partitionBy("_rp_range").orderBy("_rp_at").rowsBetween(Window.unboundedPreceding, 0)
    # offsets has one row per range, whatever the data
    return tagged.repartition(n, "_rp_range").withColumn("_rp_sum", F.sum(counted).over(here)).join(F.broadcast(offsets), F.col("_rp_range") == F.col("_rp_r")) \
        .withColumn(name, (F.col("_rp_sum") + F.col("_rp_off")).cast("bigint")) \
        .drop("_rp_range", "_rp_at", "_rp_r", "_rp_n", "_rp_sum", "_rp_off")


def _only_match(n: Column, position: Column, row: Column) -> Column:
    """Position of a record's only match; else a number of its own below all positions, so that these records don't meet in one task."""
    return F.when(n == 1, position + 1).otherwise(-1 - row)


def lookup_between(records: DataFrame, table: DataFrame, value: Column | str, low: Column | str | None = None,
                   high: Column | str | None = None, include_low: bool = True, include_high: bool = True,
                   on: dict[str, str] | str | None = None, data_cols: list[str] | None = None,
                   count_col: str = "count", data_col: str = "data", num_partitions: int | None = None) -> DataFrame:
    """Records unchanged plus the number of table rows whose ``value`` is between their bounds, and the match if it is the only one.

    ``value`` is an expression over the table, ``low`` and ``high`` are
    expressions over the records; a bound that is not given is open.  ``on``
    adds equalities (record column to table column).  A NULL bound, value or
    key matches nothing, as in SQL; bounds in the wrong order match nothing.
    Records that repeat each come back.  Runs three jobs now (records numbered,
    order written); the result is then lazy.
    """
    from rivulet.session import materialize

    clash = {count_col, data_col} & set(records.columns)
    if clash:
        raise ValueError(f"records have columns {sorted(clash)}; choose another count_col or data_col")
    if low is None and high is None:
        raise ValueError("at least one bound")
    pairs = {} if on is None else {on: on} if isinstance(on, str) else dict(on)
    cols = data_cols or list(table.columns)
    keys = [f"_lb_k{i}" for i in range(len(pairs))]
    numbered = materialize(records.withColumn("_lb_row", F.monotonically_increasing_id()), "lookup")
    payload = F.struct(*[F.col(f"`{c}`") for c in cols])
    rows = table.select(*[F.col(f"`{t}`").alias(k) for k, t in zip(keys, pairs.values())], as_column(value).alias("_lb_v"), payload.alias("_lb_d")) \
        .where(F.col("_lb_v").isNotNull())
    bounds = numbered.select("_lb_row", *[F.col(f"`{r}`").alias(k) for k, r in zip(keys, pairs)],
                             *[as_column(b).alias(n) for b, n in ((low, "_lb_low"), (high, "_lb_high")) if b is not None])
    for k in keys:
        rows, bounds = rows.where(F.col(k).isNotNull()), bounds.where(F.col(k).isNotNull())
    for b, n in ((low, "_lb_low"), (high, "_lb_high")):
        if b is not None:
            bounds = bounds.where(F.col(n).isNotNull())

    def bound(given, name: str, place: int, side: int):
        at, v = (F.lit(place), F.lit(None)) if given is None else (F.lit(_AT), F.col(name))
        return F.struct(at.alias("place"), v.cast(kind).alias("v"), F.lit(side).alias("side"))

    # one type for values and bounds, by the rules of a comparison
    typed = rows.select(F.col("_lb_v").alias("v"))
    for b, n in ((low, "_lb_low"), (high, "_lb_high")):
        if b is not None:
            typed = typed.union(bounds.select(F.col(n)))
    kind = typed.schema[0].dataType
    # of equal values: what comes before them, the rows, what comes after them
    ends = F.array(bound(low, "_lb_low", _BEFORE, 0 if include_low else 2), bound(high, "_lb_high", _AFTER, 2 if include_high else 0))
    asked = bounds.select("_lb_row", *keys, F.posexplode(ends).alias("_lb_end", "_lb_b")) \
        .select(*keys, "_lb_b.place", F.col("_lb_b.v").alias("_lb_v"), "_lb_b.side", F.col("_lb_row").alias("_lb_tie"), "_lb_end")
    there = rows.select(*keys, F.lit(_AT).alias("place"), F.col("_lb_v").cast(kind).alias("_lb_v"), F.lit(1).alias("side"),
                        F.monotonically_increasing_id().alias("_lb_tie"), "_lb_d")
    events = asked.withColumn("_lb_d", F.lit(None).cast(rows.schema["_lb_d"].dataType)).withColumn("_lb_one", F.lit(0)) \
        .unionByName(there.withColumn("_lb_end", F.lit(None).cast("int")).withColumn("_lb_one", F.lit(1)))
    placed = materialize(running_positions(events, [*keys, "place", "_lb_v", "side", "_lb_tie"], "_lb_one", "_lb_pos", num_partitions), "placed")
    counted = placed.where("_lb_one = 0").groupBy(F.col("_lb_tie").alias("_lb_row")).agg(
        F.max(F.when(F.col("_lb_end") == 0, F.col("_lb_pos"))).alias("_lb_from"), F.max(F.when(F.col("_lb_end") == 1, F.col("_lb_pos"))).alias("_lb_to")) \
        .select(F.col("_lb_row").alias("_lb_r"), "_lb_from", F.greatest(F.col("_lb_to") - F.col("_lb_from"), F.lit(0)).alias("_lb_n"))
    counted = counted.withColumn("_lb_at", _only_match(F.col("_lb_n"), F.col("_lb_from"), F.col("_lb_r")))
    single = placed.where("_lb_one = 1").select(F.col("_lb_pos").alias("_lb_p"), "_lb_d")
    found = counted.join(single, F.col("_lb_at") == F.col("_lb_p"), "left").select("_lb_r", "_lb_n", "_lb_d")
    return numbered.join(found, F.col("_lb_row") == F.col("_lb_r"), "left").select(
        *[F.col(f"`{c}`") for c in records.columns], F.coalesce("_lb_n", F.lit(0)).cast("bigint").alias(count_col), F.col("_lb_d").alias(data_col))
