"""Routing of rows to branches and merging of branches (R-1 … R-6).

A switch is one label column (first true case wins), computed once; branches
are filters on that label over the same plan, or one ``partitionBy(label)``
write.  Nothing runs one job per branch over an unshared source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.coerce import as_column, truthy_in

__all__ = ["label_cases", "switch", "switch_merge", "write_switch", "branch_counts", "unmatched", "merge", "tee"]

# Fixed value: a switch has at least two cases.
MIN_BRANCHES = 2
# name of the label while branches are told apart; an input column may have any other name
_LABEL = "__switch_label"


def _case_predicate(df: DataFrame, cond):
    c = as_column(cond)
    dtype = df.select(c.alias("_c")).schema["_c"].dataType
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    return truthy_in(df, c)


def label_cases(df: DataFrame, cases: dict, label_col: str = "branch") -> DataFrame:
    """Add ``label_col`` = label of the first case that holds, NULL if none.

    ``cases`` is an ordered ``{label: condition}``; a condition may be a
    Column, a Spark SQL string or a literal (``1`` = always, for a default).
    """
    if len(cases) < MIN_BRANCHES:
        raise ValueError(f"a switch needs at least {MIN_BRANCHES} cases, got {len(cases)}")
    if label_col in df.columns:
        raise ValueError(f"the input has a column {label_col!r}; choose another label_col")
    expr = None
    for label, cond in cases.items():
        pred = _case_predicate(df, cond)
        expr = F.when(pred, F.lit(label)) if expr is None else expr.when(pred, F.lit(label))
    return df.withColumn(label_col, expr)


def switch(df: DataFrame, cases: dict, label_col: str = "branch",
           keep_label: bool = False) -> dict[str, DataFrame]:
    """Branches of a switch: ``{label: rows routed there}``.

    The labelled frame is shared by all branches; persist it (or write once
    with ``partitionBy(label_col)``) when every branch goes to its own sink.
    """
    name = label_col if keep_label else _LABEL
    labelled = label_cases(df, cases, name)
    out = {}
    for label in cases:
        b = labelled.where(F.col(name) == F.lit(label))
        out[label] = b if keep_label else b.drop(name)
    return out


def switch_merge(df: DataFrame, cases: dict, branch_exprs: dict | None = None,
                 label_col: str = "branch") -> DataFrame:
    """Switch, per-branch alter, merge — in one pass over the input.

    Same rows and columns as ``merge(*[alter(b, branch_exprs[l]) for l, b in
    switch(df, cases).items()])`` (unmatched rows dropped; a column only some
    branches set is NULL elsewhere; an overwritten column keeps its value in
    the other branches), but computed as one projection over one scan
    instead of a union that reads the source once per branch.
    """
    from rivulet.functions.coerce import template

    branch_exprs = branch_exprs or {}
    unknown = set(branch_exprs) - set(cases)
    if unknown:
        raise ValueError(f"branch expressions for unknown labels: {sorted(unknown)}")
    labelled = label_cases(df, cases, label_col).where(F.col(label_col).isNotNull())
    targets: list[str] = []
    for exprs in branch_exprs.values():
        targets += [c for c in exprs if c not in targets]
    out = {}
    for col in targets:
        expr = None
        for label, exprs in branch_exprs.items():
            if col in exprs:
                hit = F.col(label_col) == F.lit(label)
                v = template(exprs[col])
                expr = F.when(hit, v) if expr is None else expr.when(hit, v)
        base = F.col(f"`{col}`") if col in df.columns else F.lit(None)
        out[col] = expr.otherwise(base)
    return labelled.withColumns(out) if out else labelled


def write_switch(df: DataFrame, cases: dict, path: str, fmt: str = "parquet",
                 label_col: str = "branch", mode: str = "errorifexists", dry_run: bool = False) -> str | None:
    """Every branch to its own folder ``<path>/<label_col>=<label>`` in one job.

    One scan and one write, instead of one job per branch over the source;
    unmatched rows are not written.
    """
    from rivulet.sinks.writers import write
    labelled = label_cases(df, cases, label_col).where(F.col(label_col).isNotNull())
    return write(labelled, path, fmt, mode, dry_run, partition_by=label_col)


def branch_counts(df: DataFrame, cases: dict, label_col: str = "branch",
                  include_unmatched: bool = False, unmatched_label: str = "(unmatched)") -> DataFrame:
    """Rows per branch, zero for empty branches, in one pass: ``(branch, n)``.

    The counts are one global aggregate (partial per partition); with
    ``include_unmatched`` a row for the records no case accepted is added, so
    the counts always sum to the input size.
    """
    labelled = label_cases(df, cases, _LABEL)
    labels = list(cases) + ([None] if include_unmatched else [])
    aggs = [F.count_if(F.col(_LABEL).isNull() if l is None else (F.col(_LABEL) == F.lit(l))).alias(f"_n{i}")
            for i, l in enumerate(labels)]
    names = [unmatched_label if l is None else l for l in labels]
    stack = ", ".join(f"'{n.replace(chr(39), chr(39) * 2)}', _n{i}" for i, n in enumerate(names))
    return labelled.agg(*aggs).selectExpr(f"stack({len(names)}, {stack}) AS ({label_col}, n)")


def unmatched(df: DataFrame, cases: dict) -> DataFrame:
    """Rows no case accepted (they reach no branch)."""
    return label_cases(df, cases, _LABEL).where(F.col(_LABEL).isNull()).drop(_LABEL)


def merge(*branches: DataFrame) -> DataFrame:
    """Multiset union of any number of branches by column name; missing columns become NULL."""
    if not branches:
        raise ValueError("merge takes at least one input")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def tee(df: DataFrame, sinks: list, shared: bool = True) -> list:
    """Send every row to each sink callable; returns the sinks' results.

    The input is computed once and written to the scratch folder, from which
    the sinks read (a lost executor loses nothing).  With ``shared=False`` each
    sink reads the source itself, with its own pruning: cheaper for a plain
    scan, and right only if computing the input twice gives the same rows.
    """
    from rivulet.session import materialize
    frame = materialize(df, "tee") if shared else df
    return [sink(frame) for sink in sinks]
