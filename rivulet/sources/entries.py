"""Directories and files as rows, empty ones included (S-11, S-13).

Spark's own listing gives files that hold bytes and nothing else.  Here folders
are listed by tasks, level by level: the first levels spread over tasks, so a
tree is walked by as many tasks as it has folders there, and nothing is listed
on the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["list_entries", "list_glob", "entry_count", "entry_counts", "open_store"]

_ENTRIES = "path string, is_dir boolean, length bigint, modified timestamp"


def open_store(uri: str):
    """(Arrow file system, path in it, what goes before such a path) of a Hadoop-style URI or a plain path."""
    from pyarrow import fs
    if "://" in uri and not uri.startswith("file:"):
        store, path = fs.FileSystem.from_uri(uri)
        return store, path, uri[:uri.index(path)] if path and path in uri else uri.split("://")[0] + "://"
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(uri), "file:"


def _listed(deep: bool):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path, before = open_store(uri)
                if store.get_file_info(path).type != fs.FileType.Directory:
                    continue
                found = store.get_file_info(fs.FileSelector(path, recursive=deep))
                yield pa.RecordBatch.from_pydict(
                    {"path": [before + f.path for f in found], "is_dir": [f.type == fs.FileType.Directory for f in found],
                     "length": [f.size for f in found], "modified": [f.mtime for f in found]},
                    schema=pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]))
    return run


def list_entries(spark: SparkSession, directory, recursive: bool = True, spread_levels: int = 2) -> DataFrame:
    """``path``, ``is_dir``, ``length`` (files) and ``modified`` of all that is below ``directory`` (one or several).

    The upper ``spread_levels`` levels are listed one job each, what lies below
    by one task for each folder there.  A directory that does not exist has no entries.
    """
    from rivulet.session import materialize

    roots = [directory] if isinstance(directory, str) else list(directory)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = materialize(spark.createDataFrame([(r,) for r in roots], "path string").mapInArrow(_listed(False), _ENTRIES), "entries")
    level = out
    for k in range(spread_levels + 1 if recursive else 0):
        folders = level.where("is_dir").select("path").repartition(n, "path")
        level = folders.mapInArrow(_listed(k == spread_levels), _ENTRIES)
        level = materialize(level, "entries")
        out = out.unionByName(level)
    return out


def list_glob(spark: SparkSession, source) -> DataFrame:
    """The files (``path``, ``length``, ``modified``) of paths and globs; a folder stands for all files below it.

    ``*`` and ``?`` match within one part of a path.  Names that begin with
    ``_`` or ``.`` are left out, as by Spark's readers.
    """
    from rivulet.functions.coerce import glob_to_regex

    out = None
    for s in [source] if isinstance(source, str) else list(source):
        whole = s.rstrip("/")
        parts = whole.split("/")
        fixed = next((i for i, p in enumerate(parts) if any(ch in p for ch in "*?[")), len(parts))
        root = "/".join(parts[:fixed])
        _, path, before = open_store(root or "/")
        if fixed == len(parts):
            # the path itself is a file, or a folder
            above, name = root.rpartition("/")[0] or "/", parts[-1]
            found = list_entries(spark, root).where("NOT is_dir").unionByName(
                list_entries(spark, above, recursive=False).where(~F.col("is_dir") & (F.element_at(F.split("path", "/"), -1) == name)))
        else:
            rest = glob_to_regex("/".join(parts[fixed:])).replace(".*", "[^/]*")[1:-1]
            pattern = "^" + glob_to_regex(before + path.rstrip("/"))[1:-1] + "/" + rest + "(/.*)?$"
            found = list_entries(spark, root, recursive=True).where(~F.col("is_dir") & F.col("path").rlike(pattern))
        found = found.where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))
        out = found if out is None else out.unionByName(found)
    return out.drop("is_dir").distinct()


def entry_count(spark: SparkSession, directory: str) -> int:
    """Number of entries directly in ``directory``, files and folders, empty ones too (0 when it does not exist)."""
    return list_entries(spark, directory, recursive=False).count()


def entry_counts(entries: DataFrame) -> DataFrame:
    """For every folder of a listing and above its entries: ``directory``, ``files``, ``folders``; empty folders have 0 of both."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    inside = entries.select(parent.alias("directory"), F.col("is_dir").cast("int").alias("d"))
    own = entries.where("is_dir").select(F.col("path").alias("directory"), F.lit(None).cast("int").alias("d"))
    return inside.unionByName(own).groupBy("directory").agg(
        F.coalesce(F.sum(1 - F.col("d")), F.lit(0)).cast("bigint").alias("files"), F.coalesce(F.sum("d"), F.lit(0)).cast("bigint").alias("folders"))
