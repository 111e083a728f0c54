"""Per-record Python functions (U-1, U-2, C-8), Arrow-batched.

The built-in operators cover the data work; these wrap a user function for
what SQL cannot say.  The function runs once per record inside
``mapInArrow`` tasks, never on the driver.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import rivulet

# Functions from this package travel to the Python workers by value, so
# executors need no installed copy of it (only pyarrow, which PySpark itself
# needs for Arrow batches).
cloudpickle.register_pickle_by_value(rivulet)

__all__ = ["map_records", "with_error_policy", "apply_step"]


def apply_step(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A third-party step is any ``DataFrame -> DataFrame`` function (U-1)."""
    return df.transform(fn)


def map_records(df: DataFrame, fn: Callable[[dict], object], schema) -> DataFrame:
    """Apply ``fn(record) -> record | False | None`` to every row (U-2).

    ``False`` drops the record, ``None`` keeps it unchanged, a dict replaces
    it (missing fields become NULL).  ``schema`` is the output schema.
    """
    out_schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = [f.name for f in out_schema.fields]

    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # plain Python values: integers of any size stay exact, NULL is None
        for batch in batches:
            rows = []
            for rec in batch.to_pylist():
                res = fn(rec)
                if res is False:
                    continue
                res = rec if res is None else res
                rows.append({n: res.get(n) for n in names})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, out_schema)


def with_error_policy(df: DataFrame, fn: Callable[[dict], object], value_type: str,
                      policy: str = "skiprecord", keep: list[str] | None = None, shared: bool = True):
    """Run ``fn(record)`` per row with a failure policy (C-8).

    Returns ``(ok, errors)``: ``ok`` has ``keep`` columns plus ``value``;
    ``errors`` has ``keep`` plus the error text.  ``policy='abortflow'``
    raises on the first failing record (the task fails, so the job fails
    before any sink commits).  The tagged result is written once
    (``shared``), so the function runs once per record and a record is on one
    side only, even if the function gives another answer the next time;
    ``shared=False``, or a policy that has no error side, leaves both lazy, each
    running the function itself.
    """
    if policy not in ("skiprecord", "abortflow"):
        raise ValueError("policy must be 'skiprecord' or 'abortflow'")
    keep = keep or []
    vtype = T._parse_datatype_string(value_type)
    fields = [df.schema[c] for c in keep]
    schema = T.StructType(fields + [T.StructField("ok", T.BooleanType()),
                                    T.StructField("value", vtype), T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rec in batch.to_pylist():
                base = {k: rec[k] for k in keep}
                try:
                    out.append({**base, "ok": True, "value": fn(rec), "error": None})
                except Exception as e:  # the policy decides what a failure does
                    if policy == "abortflow":
                        raise
                    msg = "".join(traceback.format_exception_only(type(e), e)).strip()
                    out.append({**base, "ok": False, "value": None, "error": msg})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    tagged = df.mapInArrow(run, schema)
    if shared and policy == "skiprecord":
        from rivulet.session import materialize
        tagged = materialize(tagged, "error_policy")
    ok = tagged.where("ok").select(*keep, "value")
    errors = tagged.where("not ok").select(*keep, "error")
    return ok, errors
