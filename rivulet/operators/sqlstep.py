"""SQL as a step (Q-1 … Q-3): per-record lookups become one join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.sources.sql import sql_read

__all__ = ["lookup", "sql_once", "dml_insert", "dml_delete", "dml_update"]


def lookup(records: DataFrame, table: DataFrame, on: dict[str, str] | str,
           data_cols: list[str] | None = None, count_col: str = "count",
           data_col: str = "data", where: str | None = None) -> DataFrame:
    """Records unchanged plus the number of matching rows and the match (Q-1).

    ``data`` is set only when exactly one row matches, else NULL; ``count`` is
    0 without a match.  Instead of one query per record, the lookup table is
    aggregated per key (partial aggregation before the shuffle, so a hot key
    adds one row per partition) and left-joined once; the optimizer picks
    broadcast or sort-merge from the real sizes.

    ``where`` is any further condition over ``r.column`` (the record) and
    ``t.column`` (the table), such as a range.  Matching pairs are then found by
    the join on ``on`` and counted per record, by a partial aggregate.
    """
    clash = {count_col, data_col} & set(records.columns)
    if clash:
        raise ValueError(f"records have columns {sorted(clash)}; choose another count_col or data_col")
    pairs = {on: on} if isinstance(on, str) else dict(on)
    rkeys = list(pairs.values())
    cols = data_cols or [c for c in table.columns]
    # ``data`` is only kept when a key has exactly one row, so each column can be
    # aggregated on its own (no struct buffer): fixed-width columns then stay in a
    # hash aggregate instead of a sort-based one
    data = F.struct(*[F.col(f"_lk_v{j}").alias(c) for j, c in enumerate(cols)])
    if where is None:
        agg = (table.groupBy(*[F.col(f"`{r}`").alias(f"_lk_{i}") for i, r in enumerate(rkeys)])
                    .agg(F.count(F.lit(1)).alias("_lk_n"),
                         *[F.any_value(F.col(f"`{c}`")).alias(f"_lk_v{j}") for j, c in enumerate(cols)])
                    .withColumn("_lk_d", data))
        cond = [records[f"`{lk}`"] == agg[f"_lk_{i}"] for i, lk in enumerate(pairs)]
        joined = records.join(agg, cond, "left")
        n = F.coalesce(F.col("_lk_n"), F.lit(0)).cast("bigint")
        return joined.select(*[records[f"`{c}`"] for c in records.columns], n.alias(count_col),
                             F.when(n == 1, F.col("_lk_d")).alias(data_col))
    # a record's number is written once, so the pairs and the records agree on it
    from rivulet.session import materialize
    numbered = materialize(records.withColumn("_lk_row", F.monotonically_increasing_id()), "lookup")
    r, t = numbered.alias("r"), table.alias("t")
    cond = F.expr(where)
    for lk, rk in pairs.items():
        cond = cond & (F.col(f"r.`{lk}`") == F.col(f"t.`{rk}`"))
    hits = (r.join(t, cond).groupBy(F.col("r._lk_row").alias("_lk_row"))
             .agg(F.count(F.lit(1)).alias("_lk_n"),
                  *[F.any_value(F.col(f"t.`{c}`")).alias(f"_lk_v{j}") for j, c in enumerate(cols)]))
    n = F.coalesce(F.col("_lk_n"), F.lit(0)).cast("bigint")
    return numbered.join(hits, "_lk_row", "left").select(
        *[F.col(f"`{c}`") for c in records.columns], n.alias(count_col), F.when(n == 1, data).alias(data_col))


def sql_once(spark: SparkSession, text: str, tables: dict | None = None, args: dict | None = None,
             count_col: str = "count", data_col: str = "data") -> DataFrame:
    """Run a query once (Q-2): a one-row frame ``(count, data)``.

    ``data`` holds the row when exactly one row came back.
    """
    df = sql_read(spark, text, tables, args)
    rec = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    n = F.count(F.lit(1))
    return df.agg(n.alias(count_col), F.when(n == 1, F.any_value(rec)).alias(data_col))


def dml_insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT as a new snapshot: the target plus the rows (by column name)."""
    return target.unionByName(rows.select(*[c for c in target.columns if c in rows.columns]),
                              allowMissingColumns=True)


def dml_delete(target: DataFrame, keys: DataFrame, on: list[str] | str) -> DataFrame:
    """DELETE as a new snapshot: target rows without a match in ``keys``."""
    on = [on] if isinstance(on, str) else list(on)
    return target.join(keys.select(*on).distinct(), on, "left_anti").select(*target.columns)


def dml_update(target: DataFrame, updates: DataFrame, key: str, fields: list[str], order_by=None) -> DataFrame:
    """UPDATE as a new snapshot: the last update of a key sets all its fields, also to NULL; any column may be set."""
    from rivulet.operators.control import keyed_update
    return keyed_update(target, updates, key, fields, order_by, null_keeps=False, protected=())
