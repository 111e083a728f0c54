"""Writers.  Each returns the path written (or None on a dry run)."""

from __future__ import annotations

import gzip

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def write(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists",
          dry_run: bool = False, compression: str | None = None, partition_by=None,
          **options) -> str | None:
    """Write ``df`` in ``fmt``, the name of any writer the session knows (U-3); ``mode='append'`` adds files (K-3).

    ``dry_run`` runs the whole plan into the ``noop`` sink (K-4).
    ``compression='gzip'`` compresses text formats (K-7); reading ``.gz``
    back is transparent.
    """
    if not fmt or not path:
        raise ValueError("an output format and path are required")
    if dry_run:
        df.write.format("noop").mode("overwrite").save()
        return None
    w = df.write.mode(mode).format(fmt)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    for k, v in options.items():
        w = w.option(k, v)
    try:
        w.save(path)
    except (AnalysisException, Py4JJavaError) as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e):
            raise ValueError(f"unknown output format {fmt!r}") from e
        raise
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", dry_run: bool = False,
               compression: str | None = None) -> str | None:
    """JSON lines, one object per record (K-1).  Absent fields stay absent."""
    from rivulet.sources.json import TS_FORMAT
    return write(df, path, "json", mode, dry_run, compression, ignoreNullFields="true",
                 timestampNTZFormat=TS_FORMAT, timestampFormat=TS_FORMAT + "XXX")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", dry_run: bool = False,
              compression: str | None = None, header: bool = True, delimiter: str = ",",
              null_value: str = "") -> str | None:
    """CSV with a header line per file, ``"`` quoting (K-2).

    Blanks, quotes, delimiters and line ends inside a field are kept, as is an
    empty text (written ``""``).  NULL is written as ``null_value``: give the
    reader the same one to tell it from an empty text.
    """
    return write(df, path, "csv", mode, dry_run, compression, header=str(header).lower(),
                 sep=delimiter, quote='"', escape='"', nullValue=null_value, emptyValue='""',
                 ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")


def debug_json(df: DataFrame, alias: str = "json") -> DataFrame:
    """Each record as one JSON text (K-5); the records pass on unchanged otherwise."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(alias))


def write_json_array(df: DataFrame, path: str, order_by: str, pretty: bool = False, mode: str = "errorifexists") -> str:
    """The frame as one JSON array over part files (K-1): their texts, in name order, are the array.

    Rows are in order of ``order_by``, NULL first; repeats stand in any order.
    They are numbered without gathering them anywhere (``with_row_index``); the
    first number opens the array and the last one closes it, so it can be of any
    size.  An empty frame writes ``[]``.
    """
    from rivulet.operators.ordering import with_row_index

    numbered = with_row_index(df, F.col(f"`{order_by}`"), "_wja_at")
    last = numbered.agg(F.max("_wja_at").alias("n")).first()["n"]
    if not last:
        df.sparkSession.range(1).select(F.lit("[]").alias("value")).write.mode(mode).text(path)
        return path
    rec = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": str(pretty).lower()})
    at = F.col("_wja_at")
    line = F.concat(F.when(at == 1, F.lit("[")).otherwise(F.lit(",")), rec, F.when(at == last, F.lit("]")).otherwise(F.lit("")))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered.repartitionByRange(n, at).sortWithinPartitions(at).select(line.alias("value")).write.mode(mode).text(path)
    return path


# a chunk of a table: a hundred rows are buffered before Parquet looks at their size
TABLE_CHUNK_BYTES = 1 << 20


def _changed(change):
    """mapInArrow body over (path, chunk, content): one row held at a time."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for path, chunk, content in zip(*batch.columns):
                yield pa.RecordBatch.from_pydict({"path": [path.as_py()], "chunk": [chunk.as_py()], "content": [change(content.as_py())]})
    return run


def _per_file(spark: SparkSession, source, target: str, suffix: str, change, mode: str, chunk_bytes: int) -> DataFrame:
    """Each source file, changed as bytes chunk by chunk, to rows under ``target``; no task holds a whole large file.

    Bytes go through Spark's writer for binary data only by way of a table, so
    the result is a table of (path, chunk, content) next to its manifest: file
    names stay data, and any store that Spark writes will do.  ``chunk`` is the
    offset in the source; a file's contents in its order are the file.  A file
    of one chunk is read by Spark, a larger one in ranges by many tasks.
    """
    from rivulet.sinks.files import read_ranges

    files = spark.read.format("binaryFile").load(source)
    name = F.concat(F.element_at(F.split("file", "/"), -1), F.lit(suffix)).alias("path")
    small = files.where(F.col("length") <= chunk_bytes).withColumnRenamed("path", "file").select(name, F.lit(0).cast("bigint").alias("chunk"), "content")
    large = read_ranges(files.where(F.col("length") > chunk_bytes).select(F.col("path").alias("file"), "length"), chunk_bytes, change)
    if change is not None:
        small = small.mapInArrow(_changed(change), small.schema)
    small.unionByName(large.select(name, F.col("at").alias("chunk"), "content")).write.mode(mode).parquet(target)
    return spark.read.parquet(target)


def _gzip(content: bytes) -> bytes:
    return gzip.compress(content, mtime=0)


def copy_files(spark: SparkSession, source, target: str, mode: str = "errorifexists", chunk_bytes: int = TABLE_CHUNK_BYTES) -> DataFrame:
    """Byte-true copy of files (glob allowed) as a table ``(path, chunk, content)`` at ``target`` (K-8)."""
    return _per_file(spark, source, target, "", None, mode, chunk_bytes)


def gzip_files(spark: SparkSession, source, target: str, mode: str = "errorifexists", chunk_bytes: int = TABLE_CHUNK_BYTES) -> DataFrame:
    """Each chunk of each file as a gzip member (K-7 ``compress``), table ``(path, chunk, content)`` at ``target``; a file's members in order are a gzip file."""
    return _per_file(spark, source, target, ".gz", _gzip, mode, chunk_bytes)


def gunzip_table(packed: DataFrame) -> DataFrame:
    """The files of a table ``(path, chunk, content)`` unpacked again, byte for byte and chunk by chunk (K-7 ``decompress``)."""
    rows = packed.select(F.regexp_replace("path", r"\.gz$", "").alias("path"), "chunk", "content")
    return rows.mapInArrow(_changed(gzip.decompress), rows.schema)


def copy_dataset(spark: SparkSession, source: str, target: str, fmt: str = "parquet",
                 mode: str = "errorifexists", dry_run: bool = False) -> str | None:
    """Copy a data set (glob allowed in ``source``) between any Hadoop FS URIs (K-8).

    A path without matches is a no-op; a source that cannot be read raises.  A
    target ending in ``/`` is a folder: the source's last path segment (without
    glob characters) is appended.
    """
    if target.endswith("/"):
        segments = [p for p in source.rstrip("/").split("/") if p and not any(ch in p for ch in "*?[")]
        target = target + (segments[-1] if segments else "copy")
    try:
        df = spark.read.format(fmt).load(source)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return write(df, target, fmt, mode, dry_run)


def _drop_first_lines(keep_file):
    """mapInPandas body: drop each file's first line, in partition order."""
    def run(batches):
        seen: set = set()
        for pdf in batches:
            blk0 = pdf[pdf["_blk"] == 0]
            fresh = blk0[~blk0["file"].duplicated() & ~blk0["file"].isin(seen)]
            if keep_file is not None:
                fresh = fresh[fresh["file"] != keep_file]
            seen.update(blk0["file"].unique())
            yield pdf.drop(index=fresh.index)[["file", "line", "_blk", "line_no"]]
    return run


def concat_skip_headers(spark: SparkSession, sources, target: str | None = None,
                        chop_first_line: bool = True, target_exists: bool = False,
                        mode: str = "errorifexists", dry_run: bool = False):
    """Concatenate text files, dropping the header line of all but the first (K-6).

    With ``chop_first_line`` the first file (of the given list; of the files of
    one path the first by name) keeps its header unless the target already
    exists (``target_exists``), in which case every file loses its first line.
    A file's first line lies in its first split, which one partition reads in
    order, so it is dropped there: one scan, no shuffle.

    Returns ``(file, line, file_no, block, line_no)``: file number in the given
    order, split and position within it, which order the lines as they stood.
    With ``target`` the lines are written in that order (a range sort).
    """
    from rivulet.operators.ordering import with_row_index

    paths = [sources] if isinstance(sources, str) else list(sources)
    # each given path by itself, so that its number does not hang on its name; names only, no content is read
    listing = None
    for i, p in enumerate(paths):
        one = spark.read.format("binaryFile").load(p).select(F.lit(i).alias("path_no"), F.col("path").alias("file"))
        listing = one if listing is None else listing.unionByName(one)
    first = listing.orderBy("path_no", "file").first()
    files = with_row_index(listing, ["path_no", "file"], "file_no", start=0)
    out = None
    for i, p in enumerate(paths):
        lines = (spark.read.text(p)
                 .select(F.col("value").alias("line"),
                         F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_block_start").alias("_blk"),
                         F.monotonically_increasing_id().alias("line_no")))
        if chop_first_line:
            keep = first["file"] if first is not None and not target_exists and first["path_no"] == i else None
            lines = lines.mapInPandas(_drop_first_lines(keep), "file string, line string, _blk long, line_no long")
        lines = lines.withColumn("path_no", F.lit(i))
        out = lines if out is None else out.unionByName(lines)
    out = out.withColumnRenamed("_blk", "block").join(files, ["path_no", "file"], "left").select("file", "line", "file_no", "block", "line_no")
    if target is not None:
        write(out.orderBy("file_no", "block", "line_no").select("line"), target, "text", mode, dry_run)
    return out
