"""Record transforms (P-1 … P-13)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.coerce import (
    as_column, java_groups, named_groups, template, translate_regex, truthy_in,
)

__all__ = [
    "alter", "filter_rows", "regex_extract", "noop", "capture", "step_vars",
    "last_values", "content_hash", "hash_files", "render_messages", "render_log", "HASH_ALGORITHMS", "LOG_LEVELS",
]


def alter(df: DataFrame, expressions: dict) -> DataFrame:
    """Add or overwrite fields (P-1, P-2).

    Every expression reads the *input* record: ``withColumns`` evaluates all
    of them against the same input, so overwriting ``a`` does not change what
    another expression sees as ``a``.  New fields go last, overwritten ones
    keep their position.  Values: Column, literal text, ``${{ expr }}`` or a
    template mixing both (see ``template``).
    """
    if not expressions:
        raise ValueError("alter needs at least one expression")
    return df.withColumns({k: template(v) for k, v in expressions.items()})


def filter_rows(df: DataFrame, condition, on_null: str = "drop") -> DataFrame:
    """Keep rows whose condition is true (P-4 … P-6).

    Non-boolean conditions use the loose truthiness (``'0'``, ``''``, 0 and
    empty arrays are false).  ``on_null='drop'`` is SQL semantics; ``'keep'``
    lets rows with a NULL condition pass, as the original did when an
    expression failed.
    """
    if on_null not in ("drop", "keep"):
        raise ValueError("on_null must be 'drop' or 'keep'")
    cond = as_column(condition)
    dtype = df.select(cond.alias("_c")).schema["_c"].dataType
    if isinstance(dtype, T.BooleanType):
        # 'drop' is plain SQL (NULL fails the filter) and stays pushable to the scan
        pred = cond if on_null == "drop" else F.coalesce(cond, F.lit(True))
    else:
        raw = truthy_in(df, cond)
        pred = F.when(cond.isNull(), F.lit(on_null == "keep")).otherwise(raw)
    return df.where(pred)


def regex_extract(df: DataFrame, field, pattern: str, alias: str = "regex") -> DataFrame:
    """First match of ``pattern`` in ``field`` (P-7, P-8).

    Without named groups one column ``alias`` holds the whole match, NULL on
    no match.  With named groups one column per name is added (NULL on no
    match); the schema follows from the pattern alone.
    """
    java = translate_regex(pattern)
    src = as_column(field).cast("string")
    groups = named_groups(java)
    if not groups:
        return df.withColumn(alias, F.regexp_substr(src, F.lit(java)))
    java = java_groups(java)
    hit = src.rlike(java)
    return df.withColumns({
        name: F.when(hit, F.regexp_extract(src, java, idx)) for name, idx in groups.items()
    })


def noop(df: DataFrame) -> DataFrame:
    return df


def capture(df: DataFrame, alias: str) -> DataFrame:
    """Keep the record as it entered step ``alias`` in column ``_<alias>`` (P-12).

    Later steps refer to ``_<alias>.field``; unused captures are pruned by
    Spark's optimizer.  Drop the column before writing.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.withColumn(f"_{alias}", F.struct(*cols))


def step_vars(df: DataFrame, variables: dict) -> DataFrame:
    """Named expressions over the current record, as columns (P-13).

    Variables are defined in order, so a variable may use the ones before it;
    Spark's optimizer collapses the projections into one.
    """
    for k, v in variables.items():
        df = df.withColumn(k, template(v))
    return df


def last_values(df: DataFrame, variables: dict, order_by, extra: list | None = None) -> DataFrame:
    """Value of each variable for the last record under ``order_by`` (P-13, C-4, C-5).

    One aggregate pass with partial aggregation; the result is one row.
    """
    from rivulet.operators.ordering import order_key
    key = order_key(order_by)
    return df.agg(*[F.max_by(template(v), key).alias(k) for k, v in variables.items()], *(extra or []))


# Digests Spark computes itself (lower-case hex output).
HASH_ALGORITHMS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512", "crc32")


def _library_digest(algorithm: str):
    """A digest that Spark lacks, by name: what hashlib knows, adler32 and the XXH family (seed 0)."""
    import hashlib
    import zlib
    if algorithm == "adler32":
        return lambda b: f"{zlib.adler32(b):08x}"
    if algorithm.replace("xxhash64", "xxh64") in ("xxh32", "xxh64", "xxh3_64", "xxh3_128"):
        import xxhash
        make = getattr(xxhash, algorithm.replace("xxhash64", "xxh64"))
        return lambda b: make(b).hexdigest()
    name = algorithm.replace("-", "_") if algorithm.replace("-", "_") in hashlib.algorithms_available else algorithm
    if name not in hashlib.algorithms_available or name.startswith("shake"):
        raise ValueError(f"unknown hash algorithm {algorithm!r}")
    return lambda b: hashlib.new(name, b).hexdigest()


def _digest(c: Column, algorithm: str) -> Column:
    a = algorithm.lower()
    if a == "md5":
        return F.md5(c)
    if a == "sha1":
        return F.sha1(c)
    if a in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(c, int(a[3:]))
    if a == "crc32":
        return F.lower(F.lpad(F.hex(F.crc32(c)), 8, "0"))
    digest = _library_digest(a)  # an unknown name raises here, before anything runs

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else digest(v))

    return run(c.cast("binary"))


def content_hash(df: DataFrame, content, algorithm: str = "sha256", alias: str = "hash") -> DataFrame:
    """Digest of a text or binary column (P-11); unknown algorithm raises before running."""
    return df.withColumn(alias, _digest(as_column(content), algorithm))


def hash_files(spark: SparkSession, paths, algorithm: str = "sha256", alias: str = "hash") -> DataFrame:
    """``path``, ``length`` and the digest of each file's bytes (P-11 by path); executors read the files."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", "length", _digest(F.col("content"), algorithm).alias(alias))



def render_messages(df: DataFrame, to, subject, message, name=None) -> tuple[DataFrame, DataFrame]:
    """Project records to an outbox ``(to, name, subject, message)`` (P-10).

    Returns ``(outbox, invalid)``: rows with an empty required field go to
    ``invalid`` with the list of missing fields; delivery is not done here.
    """
    cols = {"to": template(to), "subject": template(subject), "message": template(message)}
    if name is not None:
        cols["name"] = template(name)
    rendered = df.select(*[v.alias(k) for k, v in cols.items()])
    missing = F.array_compact(F.array(*[
        F.when(F.coalesce(F.trim(F.col(k)), F.lit("")) == "", F.lit(k)) for k in ("to", "subject", "message")
    ]))
    tagged = rendered.withColumn("missing", missing)
    ok = tagged.where(F.size("missing") == 0).drop("missing")
    bad = tagged.where(F.size("missing") > 0)
    return ok, bad


# Log levels a log step accepts.
LOG_LEVELS = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")


def render_log(df: DataFrame, message, level: str = "info") -> DataFrame:
    """Log lines as data ``(level, message)`` (P-10); an empty message gives no row."""
    if level not in LOG_LEVELS:
        raise ValueError(f"level must be one of {LOG_LEVELS}")
    out = df.select(F.lit(level).alias("level"), template(message).alias("message"))
    return out.where(F.coalesce(F.col("message"), F.lit("")) != "")
