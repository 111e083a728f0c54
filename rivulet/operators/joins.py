"""Joins Spark has no single operator for: as-of (backward) join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.coerce import as_column

__all__ = ["asof_join", "salted_join", "hot_keys"]


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time, right_time,
              right_cols: list[str], bucket_width: int | None = None, prefix: str = "r_",
              right_tiebreak: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """For each left row, the last right row with the same ``by`` keys and
    ``right_time <= left_time`` (NULLs when none).

    A NULL key or time matches nothing: such right rows are left out, such left
    rows come back with NULLs.  Times are numeric (e.g. epoch seconds/micros).  The work is split into
    buckets so that no key, however hot, is ordered in a single task:

    * ``bucket_width`` given: buckets are fixed time ranges (same unit);
    * ``bucket_width=None``: buckets are the range partitions of the sorted
      (keys, time) order, which Spark's range partitioner balances, so even a
      single (key, time range) holding a third of all rows is spread over
      many tasks.  Each row's bucket is written once to the shared folder
      (one job at call time) so every branch sees the same buckets.

    1. left and right rows of the same (keys, bucket) are merged in one
       window pass: the running last right row is the in-bucket match;
    2. for left rows without an in-bucket match, the last right row of an
       earlier bucket comes from a bucket-level table (one row per key and
       bucket, built with partial aggregates), again by a running window,
       then an equi-join on (keys, bucket).
    """
    lt, rt = as_column(left_time), as_column(right_time)
    lcols = left.columns
    usable = lambda t: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by], t.isNotNull())
    unmatched = left.where(~usable(lt))
    left, right = left.where(usable(lt)), right.where(usable(rt))
    rec_r = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in right_cols])
    tb = F.col(right_tiebreak) if right_tiebreak else F.lit(0)
    L = left.select(*by, lt.alias("_t"), F.struct(*[F.col(f"`{c}`") for c in lcols]).alias("_l"))
    R = right.select(*by, rt.alias("_t"), tb.alias("_tb"), rec_r.alias("_r"))
    rtype = R.schema["_r"].dataType
    ltype = L.schema["_l"].dataType

    u = (L.select(*by, "_t", F.lit(1).alias("_side"), F.lit(0).cast(R.schema["_tb"].dataType).alias("_tb"), "_l",
                  F.lit(None).cast(rtype).alias("_r"))
         .unionByName(R.select(*by, "_t", F.lit(0).alias("_side"), "_tb",
                               F.lit(None).cast(ltype).alias("_l"), "_r")))
    if bucket_width:
        u = u.withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_width)))
    else:
        from rivulet.operators.ordering import _shuffle_partitions
        n = num_partitions or _shuffle_partitions(left)
        # the bucket is written as data once: the range partitioner samples afresh in every
        # execution, so the branches below must not each re-run the range shuffle
        from rivulet.session import materialize
        u = materialize(u.repartitionByRange(n, *by, "_t", "_side", "_tb")
                         .withColumn("_b", F.spark_partition_id().cast("bigint")), "asof_buckets")

    w = (Window.partitionBy(*by, "_b").orderBy("_t", "_side", "_tb")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inb = (u.withColumn("_m", F.last("_r", ignorenulls=True).over(w))
             .where(F.col("_side") == 1).select(*by, "_b", "_l", "_m"))

    per_bucket = (u.where(F.col("_side") == 0).groupBy(*by, "_b")
                   .agg(F.max_by("_r", F.struct("_t", "_tb")).alias("_rb")))
    # carry candidates for every left (keys, bucket); taken from the input, not from the
    # window above, so the in-bucket pass is computed once
    need = u.where(F.col("_side") == 1).select(*by, "_b").distinct()
    ub = (need.select(*by, "_b", F.lit(0).alias("_side"), F.lit(None).cast(rtype).alias("_rb"))
          .unionByName(per_bucket.select(*by, "_b", F.lit(1).alias("_side"), "_rb")))
    wb = (Window.partitionBy(*by).orderBy("_b", "_side")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = (ub.withColumn("_c", F.last("_rb", ignorenulls=True).over(wb))
               .where(F.col("_side") == 0).select(*by, "_b", "_c"))

    out = inb.join(carry, [*by, "_b"], "left")
    match = F.coalesce(F.col("_m"), F.col("_c"))
    matched = out.select(*[F.col(f"_l.`{c}`").alias(c) for c in lcols],
                         *[match.getField(f"{prefix}{c}").alias(f"{prefix}{c}") for c in right_cols])
    return matched.unionByName(unmatched.select(*[F.col(f"`{c}`") for c in lcols]), allowMissingColumns=True)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                salt_buckets: int = 16, hot_keys: DataFrame | None = None) -> DataFrame:
    """Equi-join that spreads hot keys of ``big`` over ``salt_buckets`` tasks.

    Rows of ``big`` get a salt in ``[0, salt_buckets)`` from a hash of their
    values and of the partition they lie in when the join begins.  A task that
    is run again, with its rows in any order, gives them the same salts, and
    equal rows are spread as far as they lie in different partitions.  Columns
    of any type are allowed (maps are not hashed); each row of ``small`` is replicated once per salt.  Only
    keys in ``hot_keys`` (a frame of the ``on`` columns) are salted when it is
    given, so the replication is limited to the hot keys.  ``big`` is marked
    by a join that keeps its rows where they are as long as ``hot_keys`` is
    small enough to broadcast, which its size decides at run time.  Use it
    where AQE's skew split does not apply (streaming micro-batches, outer
    sides AQE cannot split); ``how`` is ``inner`` or ``left`` (``big`` on the
    left).
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports how='inner' or 'left'")
    taken = {"_salt", "_hot"} & {*big.columns, *small.columns}
    if taken:
        raise ValueError(f"column names reserved for the join: {sorted(taken)}")
    hashed = [F.col(f"`{f.name}`") for f in big.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    big = big.withColumn("_salt", F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), F.lit(salt_buckets)).cast("int"))
    salt = F.col("_salt")
    if hot_keys is not None:
        hot = hot_keys.select(*on).distinct().withColumn("_hot", F.lit(True))
        big = big.join(hot, on, "left")
        salt = F.when(F.col("_hot"), salt).otherwise(F.lit(0))
        small_hot = small.join(hot, on, "left")
        reps = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salt_buckets - 1))).otherwise(F.array(F.lit(0)))
        small_s = small_hot.withColumn("_salt", F.explode(reps)).drop("_hot")
        big_s = big.withColumn("_salt", salt).drop("_hot")
    else:
        big_s = big
        small_s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    return big_s.join(small_s, [*on, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, on: list[str], rows_per_task: int = 1_000_000) -> DataFrame:
    """Keys with more rows than one task should get.

    At most ``rows / rows_per_task`` keys, whatever the distribution; one
    partial aggregate per key, lazy.  The result feeds ``salted_join``.
    """
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > F.lit(rows_per_task)).select(*on)
