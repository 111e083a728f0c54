"""Row control, assertions, find, last-value state and keyed updates (C-1 … C-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rivulet.functions.coerce import as_column
from rivulet.operators.ordering import with_row_index

__all__ = [
    "GateError", "violations", "gate", "gate_inline", "take_until", "find_first",
    "find_first_in_array", "iteration_number", "observe_counts", "keyed_update",
    "PROTECTED_FIELDS",
]


class GateError(RuntimeError):
    """A data-quality gate found a violating row."""


def violations(df: DataFrame, condition) -> DataFrame:
    """Rows for which the abort condition holds (C-1).

    Only a condition that is exactly false lets a row through; NULL counts as
    a violation, like any non-false value.
    """
    c = as_column(condition)
    return df.where(F.coalesce(c != F.lit(False), F.lit(True)))


def gate(df: DataFrame, condition=None, message: str = "flow aborted") -> DataFrame:
    """Raise ``GateError`` before any sink if a row violates ``condition``.

    With no condition the gate always aborts.  The check reads at most one
    violating row (``limit(1)``), then the untouched input is returned.
    """
    if condition is None:
        raise GateError(message)
    if violations(df, condition).limit(1).count() > 0:
        raise GateError(message)
    return df


def gate_inline(df: DataFrame, condition, message: str = "flow aborted") -> DataFrame:
    """Same gate in the same pass as the sink: a violating row fails the job."""
    c = as_column(condition)
    bad = F.coalesce(c != F.lit(False), F.lit(True))
    return df.where(F.when(bad, F.raise_error(F.lit(message))).otherwise(F.lit(True)))


def take_until(df: DataFrame, condition, order_col: str) -> DataFrame:
    """Rows strictly before the first row (by ``order_col``) meeting ``condition`` (C-2).

    The first stop key is a scalar aggregate (partial + final), so no global
    window is needed; no stop row ⇒ every row.
    """
    first_stop = df.where(as_column(condition)).select(F.min(order_col)).scalar()
    return df.where(first_stop.isNull() | (F.col(order_col) < first_stop))


def find_first(df: DataFrame, condition, order_by, group_by=None, alias: str = "found") -> DataFrame:
    """First row (by ``order_by``) meeting ``condition``, per group if given (C-3).

    ``min_by`` is aggregated partially on each partition before the shuffle,
    so a hot group costs one row per partition.  No match ⇒ no row for the
    group (use a left join to get a NULL struct).
    """
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_by])
    rec = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    hits = df.where(as_column(condition))
    if group_by:
        groups = [group_by] if isinstance(group_by, str) else list(group_by)
        return hits.groupBy(*groups).agg(F.min_by(rec, key).alias(alias))
    return hits.agg(F.min_by(rec, key).alias(alias))


def find_first_in_array(arr, predicate) -> Column:
    """First element of an array column for which ``predicate(x)`` holds, else NULL."""
    return F.try_element_at(F.filter(as_column(arr), predicate), F.lit(1))


def iteration_number(df: DataFrame, order_by, name: str = "iteration") -> DataFrame:
    """0-based position of each record in flow order (C-7)."""
    return with_row_index(df, order_by, name, start=0)


def observe_counts(df: DataFrame, name: str, errors: dict | None = None) -> tuple[DataFrame, Observation]:
    """Row and error counters gathered during the real run, no extra pass (C-9).

    ``errors`` maps a counter name to a condition; read ``obs.get`` after an
    action on the returned frame.
    """
    obs = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    for k, cond in (errors or {}).items():
        metrics.append(F.sum(F.when(as_column(cond), 1).otherwise(0)).alias(k))
    return df.observe(obs, *metrics), obs


# Fields the user update never changes.
PROTECTED_FIELDS = ("password", "auth")


def keyed_update(target: DataFrame, updates: DataFrame, key: str, fields: list[str],
                 order_by=None, null_keeps: bool = True, protected: tuple[str, ...] = PROTECTED_FIELDS) -> DataFrame:
    """New snapshot of ``target`` with ``fields`` replaced from ``updates`` (C-10).

    Only the given fields change and only for keys present in ``target``
    (unknown keys are not inserted).  With ``null_keeps`` a NULL counts as "not
    given": each field takes its last given value under ``order_by``.  Without
    it the last update wins whole, NULLs included.  Fields in ``protected`` are
    refused.
    """
    bad = [f for f in fields if f in protected]
    if bad:
        raise ValueError(f"protected fields cannot be updated: {bad}")
    if order_by is not None:
        from rivulet.operators.ordering import order_key
        okey = order_key(order_by)
        pick = {f: F.max_by(F.col(f), F.when(F.col(f).isNotNull(), okey) if null_keeps else okey) for f in fields}
        latest = updates.groupBy(key).agg(F.lit(True).alias("_hit"), *[c.alias(f"_new_{f}") for f, c in pick.items()])
    else:
        # no order given: one arbitrary update per key (never duplicates target rows)
        pick = updates.groupBy(key).agg(F.any_value(F.struct(*[F.col(f) for f in fields])).alias("_u"))
        latest = pick.select(key, F.lit(True).alias("_hit"), *[F.col(f"_u.{f}").alias(f"_new_{f}") for f in fields])
    joined = target.join(latest, key, "left")

    def value(c):
        if null_keeps:
            return F.coalesce(F.col(f"_new_{c}"), F.col(c))
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))

    return joined.select(*[value(c).cast(target.schema[c].dataType).alias(c) if c in fields else F.col(c)
                           for c in target.columns])
