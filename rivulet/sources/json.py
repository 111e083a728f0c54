"""JSON reader and nested-array extraction (S-3 … S-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.coerce import as_column, natural_key
from rivulet.operators.ordering import with_row_index


# Text form of timestamps in JSON/CSV, microseconds kept.
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def read_json(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    """Read JSON; a malformed document raises (``FAILFAST``).

    ``multi_line=True`` reads files that each hold one document (for example
    a root array of records); one file is then one task, so for large data use
    JSON lines (the default).
    """
    r = (spark.read.option("mode", "FAILFAST").option("multiLine", str(multi_line).lower())
         .option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT + "XXX"))
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def extract_array(df: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """One row per element of the array at dotted ``path`` (S-4).

    Struct elements are spread into columns.  A path that does not exist
    fails at analysis time, before any job.
    """
    elem = F.explode(F.col(path)).alias("_elem")
    out = df.select(*(keep or []), elem)
    etype = out.schema["_elem"].dataType
    if isinstance(etype, T.StructType):
        return out.select(*(keep or []), "_elem.*")
    return out.withColumnRenamed("_elem", "value")


def object_values(df: DataFrame, json_col, keep: list[str] | None = None,
                  value_type: str = "string") -> DataFrame:
    """One row per property of a JSON object text (S-5): ``pos, key, value``.

    ``pos`` is the 0-based position in the document.
    """
    m = F.from_json(as_column(json_col).cast("string"), f"map<string,{value_type}>")
    return df.select(*(keep or []), F.posexplode(m).alias("pos", "key", "value"))


def natural_sort(df: DataFrame, key, tiebreak, order: str = "asc",
                 index_name: str = "sort_rank", case_insensitive: bool = True) -> DataFrame:
    """Natural, case-insensitive order of ``key`` with its 1-based rank (S-6).

    ``order='desc'`` reverses; any other value sorts ascending.  ``tiebreak``
    (a unique column) keeps the rank stable.
    """
    nk = natural_key(key, case_insensitive)
    nk = nk.desc() if str(order).lower() == "desc" else nk.asc()
    tb = [tiebreak] if isinstance(tiebreak, (str, Column)) else list(tiebreak)
    return with_row_index(df, [nk, *[F.col(t) if isinstance(t, str) else t for t in tb]], index_name)
