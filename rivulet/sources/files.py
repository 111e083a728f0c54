"""File listings and list constraints (S-11 … S-14, V-4, V-5).

Listing uses the ``binaryFile`` source with only metadata columns selected,
so file contents are never read; paths are Hadoop FS URIs, which covers local
disks, object stores and remote file systems alike.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions.coerce import as_column, glob_to_regex, natural_key
from rivulet.operators.ordering import with_row_index

LISTING_SCHEMA = "path string, length bigint, modificationTime timestamp"

# Accepted return-value and sort modes of a listing.
RETURN_VALUES = ("basename", "relativepath", "absolutepath")
SORTS = ("alpha", "alpha_reverse", "natural")


def list_files(spark: SparkSession, directory: str, pattern: str = "*",
               recursive: bool = False) -> DataFrame:
    """One row per file below ``directory`` matching the glob ``pattern`` on the file name.

    A directory without matches, or that does not exist, gives no rows; one
    that cannot be read raises.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern and pattern != "*":
        reader = reader.option("pathGlobFilter", pattern)
    try:
        df = reader.load(directory).select("path", "length", "modificationTime")
        df.schema  # analysis resolves the path now
        return df
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTING_SCHEMA)


def basename(c) -> Column:
    return F.regexp_extract(as_column(c), r"([^/]*)/*$", 1)


def dirname(c) -> Column:
    return F.regexp_extract(as_column(c), r"^(.*)/[^/]*$", 1)


def list_constraints(df: DataFrame, path_col: str = "path", returnvalue: str = "relativepath",
                     sort: str = "alpha", offset: int = 0, limit: int | None = None,
                     include_dirs: bool = False, base: str = "", pattern: str | None = None,
                     is_dir_col: str | None = None, out_col: str = "value",
                     index_name: str = "position") -> DataFrame:
    """Filter, map, sort and slice a column of paths (S-12).

    Order of work: drop ``.``/``..``; drop directories unless
    ``include_dirs`` (needs ``is_dir_col``); glob ``pattern`` on the whole
    path (``*`` also matches ``/``); map to ``returnvalue``; sort the mapped
    values; keep ``offset+1 … offset+limit`` (``limit`` 0/None = all).  The
    position column carries the order.
    """
    if returnvalue not in RETURN_VALUES:
        raise ValueError(f"returnvalue must be one of {RETURN_VALUES}")
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    p = F.col(path_col)
    name = basename(p)
    out = df.where(~name.isin(".", ".."))
    if not include_dirs and is_dir_col:
        out = out.where(~F.coalesce(F.col(is_dir_col), F.lit(False)))
    if pattern:
        out = out.where(p.rlike(glob_to_regex(pattern)))
    if returnvalue == "basename":
        value = basename(p)
    elif returnvalue == "relativepath" and base:
        value = F.replace(p, F.lit(base.rstrip("/") + "/"), F.lit(""))
    else:
        value = p
    out = out.withColumn(out_col, value)
    v = F.col(out_col)
    if sort == "alpha":
        order = [v.asc(), p.asc()]
    elif sort == "alpha_reverse":
        order = [v.desc(), p.desc()]
    else:
        order = [natural_key(v, case_insensitive=False).asc(), p.asc()]
    if limit:
        # ordered top-k; only the rows asked for are numbered
        few = out.orderBy(*order).limit(offset + limit)
        ranked = few.withColumn(index_name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    else:
        ranked = with_row_index(out, order, index_name)
    return ranked.where(F.col(index_name) > F.lit(offset))


def file_count(spark: SparkSession, directory: str) -> int:
    """Number of entries directly in ``directory``: files plus sub-directories
    that hold files (0 when it does not exist).

    Spark's listing sees leaf files only, so an empty sub-directory is not
    counted.  The count is a distributed ``count(distinct first segment)``.
    """
    listing = list_files(spark, directory, recursive=True)
    base = directory.rstrip("/").split("://")[-1].lstrip("/")
    # first path segment below the directory, whatever URI prefix the listing uses
    rel = F.regexp_extract(F.col("path"), rf"{_re_escape(base)}/([^/]+)", 1)
    return listing.select(rel.alias("entry")).where(F.col("entry") != "").distinct().count()


def _re_escape(text: str) -> str:
    import re
    return re.escape(text)


def file_count_by_dir(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """File count per parent directory of a listing (the set-at-a-time form)."""
    return listing.groupBy(dirname(F.col(path_col)).alias("directory")).agg(
        F.count(F.lit(1)).alias("files"))


def paths_exist(wanted: DataFrame, listing: DataFrame, wanted_col: str = "path",
                path_col: str = "path") -> DataFrame:
    """``wanted`` plus ``exists``: true when the path is a listed file or a directory above one.

    Directories are derived as every parent prefix of listed files.  Both sides
    are shuffled on the path; nothing is broadcast, the listing may be large.
    """
    parts = F.split(F.col(path_col), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = listing.select(F.explode(prefixes).alias("_known")).distinct()
    w = wanted.withColumn("_norm", F.regexp_replace(F.col(wanted_col), "/+$", ""))
    return (w.join(known, w["_norm"] == known["_known"], "left")
             .withColumn("exists", F.col("_known").isNotNull())
             .drop("_norm", "_known"))


def path_scheme(c) -> Column:
    """Scheme of a path: text before ``://``, else ``file`` (V-5)."""
    s = F.regexp_extract(as_column(c), r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    return F.when(s == "", F.lit("file")).otherwise(s)


def path_permitted(c, permitted_dirs: list[str]) -> Column:
    """True when a path is relative, has a scheme, or starts with a permitted directory (V-4)."""
    p = as_column(c)
    ok = (~p.startswith("/")) | p.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    for d in permitted_dirs:
        ok = ok | p.startswith(d)
    return ok
