"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.session import materialize

# white space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id is never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    value = str(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return int(value) if value.isdigit() else 200


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, made longer until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def told_apart(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells all its rows apart.

    That is the id where no id is null or repeated (one count over the ids
    finds out).  Otherwise the rows are numbered and written once, so that the
    numbers stay the same when a lost executor's work is done again.
    """
    unclear = docs.groupBy(F.col(id_col).alias("_id")).count().where("_id IS NULL OR count > 1")
    if unclear.isEmpty():
        return docs, id_col
    key = free_name(docs, "_row_key")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def first_of_each(members: DataFrame, group: str) -> DataFrame:
    """``group`` and ``_stays``: the ``_key`` of its row with the smallest ``_id`` (null last), ties by ``_key``."""
    return members.groupBy(group).agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_key"))["_key"].alias("_stays"))


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs.

    Spark removes them once the driver's JVM has collected the frames that
    made them; between two large steps that is asked for here, so that the
    disk holds one step's shuffle at a time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def batches_of(columns, limit_bytes: int):
    """Split the rows of one Arrow batch into runs of about ``limit_bytes`` of text.

    ``columns`` is a list of equally long lists, the last one of ``bytes``.
    A longer text makes a run of its own.
    """
    start = size = 0
    texts = columns[-1]
    for i, t in enumerate(texts):
        if size and size + len(t) > limit_bytes:
            yield [c[start:i] for c in columns]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield [c[start:] for c in columns]
