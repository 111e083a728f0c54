"""Updates and deletes that rewrite only the files they touch (C-10, Q-3).

A table is a folder of Parquet files and a manifest: for each version the list
of its files with their row count and the range of the key.  A change finds the
files that hold a changed key (first by their key ranges, then by reading the
key column alone), writes their rows anew and adds a version that names the new
files and all others as they were.  Readers see a version whole; older versions
stay readable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.coerce import as_column

__all__ = ["create_table", "read_table", "table_files", "update_table", "delete_from_table"]


def _versions(spark: SparkSession, path: str) -> int:
    from rivulet.sources.entries import list_entries
    done = list_entries(spark, f"{path}/manifest", recursive=True, spread_levels=0).where("path LIKE '%/_SUCCESS'")
    return done.agg(F.max(F.regexp_extract("path", r"/v=(\d+)/", 1).cast("int")).alias("v")).first()["v"] or 0


def _described(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """``file``, ``rows``, ``lo`` and ``hi`` (of the key) of the Parquet files below a folder."""
    return spark.read.option("recursiveFileLookup", "true").parquet(folder).groupBy(F.col("_metadata.file_path").alias("file")) \
        .agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("lo"), F.max(key).alias("hi"))


def _commit(spark: SparkSession, path: str, version: int, files: DataFrame) -> int:
    # the version counts once its _SUCCESS is there
    files.select("file", "rows", "lo", "hi").coalesce(1).write.parquet(f"{path}/manifest/v={version}")
    return version


def create_table(df: DataFrame, path: str, key: str, split_by: Column | str | None = None) -> int:
    """Write ``df`` as the first version; with ``split_by`` rows of one value share files and no others do."""
    spark = df.sparkSession
    if _versions(spark, path):
        raise ValueError(f"a table is there: {path}")
    folder = f"{path}/data/v=1"
    if split_by is None:
        df.write.parquet(folder)
    else:
        parted = df.withColumn("_ft_part", as_column(split_by))
        parted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_ft_part").write.partitionBy("_ft_part").parquet(folder)
    return _commit(spark, path, 1, _described(spark, folder, key))


def table_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The manifest of a version (default: the newest)."""
    v = version or _versions(spark, path)
    if not v:
        raise ValueError(f"no table: {path}")
    return spark.read.parquet(f"{path}/manifest/v={v}")


def _load(spark: SparkSession, files: DataFrame, schema) -> DataFrame:
    # one name per file comes to the driver, as in any file listing that Spark plans a scan from
    names = [r["file"] for r in files.select("file").collect()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version."""
    files = table_files(spark, path, version)
    return _load(spark, files, _schema(spark, path))


def _schema(spark: SparkSession, path: str):
    one = table_files(spark, path, 1).select("file").first()
    found = spark.read.parquet(one["file"] if one else f"{path}/data/v=1").schema
    return found


def _rewrite(spark: SparkSession, path: str, key: str, keys: DataFrame, change) -> int:
    """A new version in which ``change`` has been applied to the rows of the files that hold one of ``keys``."""
    from rivulet.session import materialize

    version = _versions(spark, path)
    files = materialize(table_files(spark, path, version), "manifest")
    schema = _schema(spark, path)
    wanted = materialize(keys.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull()).distinct(), "keys")
    ends = wanted.agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).first()
    if ends["lo"] is None:
        return version
    kind = schema[key].dataType
    near = files.where((F.col("hi") >= F.lit(ends["lo"]).cast(kind)) & (F.col("lo") <= F.lit(ends["hi"]).cast(kind)))
    # the key column only
    held = _load(spark, near, schema).select(F.col(key).alias("_k"), F.col("_metadata.file_path").alias("file")) if not near.isEmpty() else None
    touched = None if held is None else materialize(held.join(wanted, "_k", "left_semi").select("file").distinct(), "touched")
    if touched is None or touched.isEmpty():
        return version
    folder = f"{path}/data/v={version + 1}"
    change(_load(spark, touched, schema)).select(*schema.fieldNames()).write.mode("overwrite").parquet(folder)
    kept = files.join(touched, "file", "left_anti")
    return _commit(spark, path, version + 1, kept.unionByName(_described(spark, folder, key)))


def update_table(spark: SparkSession, path: str, updates: DataFrame, key: str, fields: list[str], order_by=None) -> int:
    """Set ``fields`` of the rows whose key is in ``updates`` (of several updates of a key the last by ``order_by``); returns the version.

    Keys that no row has change nothing; without any row to change there is no
    new version.  NULL keys match nothing.  One writer at a time.
    """
    from rivulet.operators.sqlstep import dml_update
    return _rewrite(spark, path, key, updates, lambda rows: dml_update(rows, updates, key, fields, order_by))


def delete_from_table(spark: SparkSession, path: str, keys: DataFrame, key: str) -> int:
    """Delete the rows whose key is in ``keys``; returns the version."""
    from rivulet.operators.sqlstep import dml_delete
    return _rewrite(spark, path, key, keys, lambda rows: dml_delete(rows, keys, key))
