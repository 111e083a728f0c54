"""Files of given names and bytes: copies, gzip and any rows of chunks, on any store that both Spark and Arrow reach (K-7, K-8).

A file is rows of (``path``, ``chunk``, ``content``), so no file has to fit
into one value.  Chunks are read, packed and made by many tasks; one task
writes a file, chunk after chunk, and holds one chunk.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from rivulet.sources.entries import list_glob, open_store

__all__ = ["read_chunks", "write_files", "copy_files_bytes", "gzip_files_bytes", "gunzip_files_bytes", "file_digests", "FilesWritten"]

CHUNK_BYTES = 8 << 20
_CHUNKS = "path string, chunk bigint, content binary"


def _store(uri: str):
    return open_store(uri)[:2]


@dataclass
class FilesWritten(WriterCommitMessage):
    files: int
    bytes: int


class _FilesWriter(DataSourceArrowWriter):
    """Writes each path's chunks, which come one after another, to a file of its own below the target.

    An attempt writes under a name of its own and moves the finished file to
    its place, so a task that is run again replaces the file by the same bytes
    and leaves no second one.
    """

    def __init__(self, target: str):
        self.target = target

    def write(self, batches):
        store, root = _store(self.target)
        path = out = temporary = None
        files = size = 0

        def close():
            nonlocal files
            out.close()
            final = f"{root}/{path}"
            store.create_dir(final.rpartition("/")[0], recursive=True)
            store.move(temporary, final)
            files += 1

        store.create_dir(f"{root}/_temporary", recursive=True)
        for batch in batches:
            names = batch.schema.names
            for name, content in zip(batch.column(names.index("path")).to_pylist(), batch.column(names.index("content"))):
                if name != path:
                    if out is not None:
                        close()
                    if not name or name.startswith(("/", "_temporary/")) or ".." in name.split("/"):
                        raise ValueError(f"not a file name below the target: {name!r}")
                    if name.endswith("/"):
                        store.create_dir(f"{root}/{name.rstrip('/')}", recursive=True)
                        path = out = None
                        continue
                    path, temporary = name, f"{root}/_temporary/{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary, compression=None)
                data = content.as_buffer()
                if data is not None:
                    out.write(data)
                    size += data.size
        if out is not None:
            close()
        return FilesWritten(files, size)

    def commit(self, messages):
        store, root = _store(self.target)
        store.create_dir(root, recursive=True)
        store.open_output_stream(f"{root}/_SUCCESS").close()
        self._clean(store, root)

    def abort(self, messages):
        self._clean(*_store(self.target))

    @staticmethod
    def _clean(store, root):
        from pyarrow import fs
        if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary")


class NamedFiles(DataSource):
    """``df.write.format("rivulet_files")``: rows (path, chunk, content) sorted by path and chunk in each partition."""

    @classmethod
    def name(cls):
        return "rivulet_files"

    def schema(self):
        return _CHUNKS

    def writer(self, schema, overwrite):
        return _FilesWriter(self.options["path"])


def write_files(chunks: DataFrame, target: str) -> str:
    """Write rows (``path`` below ``target``, ``chunk``, ``content``) as files; a path's chunks in order of ``chunk``.

    A path that ends in ``/`` makes a folder.  A file that is there already is replaced.  A NULL content adds nothing.
    Rows with a NULL path raise.  After a failed job the files that were
    finished stay; ``_SUCCESS`` tells that all are there.
    """
    spark = chunks.sparkSession
    spark.dataSource.register(NamedFiles)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.select("path", F.col("chunk").cast("bigint").alias("chunk"), F.col("content").cast("binary").alias("content"))
    rows.repartition(n, "path").sortWithinPartitions("path", "chunk").write.format("rivulet_files").mode("append").save(target)
    return target


def _listing(spark: SparkSession, source) -> DataFrame:
    """Names and sizes, empty files too; no content is read."""
    return list_glob(spark, source).select(F.col("path").alias("file"), "length")


def _ranges(change):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for file, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = _store(file)
                with store.open_input_file(path) as f:
                    data = f.read_at(n, at)
                if len(data) != n:
                    raise OSError(f"{file} became shorter while it was read")
                yield pa.RecordBatch.from_pydict({"file": [file], "at": [at], "content": [change(data) if change else data]})
    return run


def read_ranges(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, change=None) -> DataFrame:
    """``file``, ``at`` and ``content`` of every byte range of ``files`` (``file``, ``length``); ``change`` is applied to a range's bytes as it is read."""
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk_bytes).cast("bigint"))).alias("at")
    ranges = files.select("file", "length", at).select("file", "at", F.least(F.col("length") - F.col("at"), F.lit(chunk_bytes)).alias("n"))
    return ranges.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "at") \
        .mapInArrow(_ranges(change), "file string, at bigint, content binary")


def read_chunks(spark: SparkSession, source, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``file``, ``at`` (offset) and ``content`` of every byte range of the files below ``source`` (paths or globs).

    A file of any size is read by many tasks.  An empty file has one empty range.
    """
    return read_ranges(_listing(spark, source), chunk_bytes)


def _named(file):
    return F.element_at(F.split(file, "/"), -1)


def copy_files_bytes(spark: SparkSession, source, target: str, chunk_bytes: int = CHUNK_BYTES) -> str:
    """Copy files byte for byte under their own names (K-8); two sources of one name raise."""
    names = _listing(spark, source).groupBy(_named(F.col("file")).alias("n")).count().where("count > 1")
    if not names.isEmpty():
        raise ValueError(f"two files have one name: {names.first()['n']!r}")
    return write_files(read_chunks(spark, source, chunk_bytes).select(_named(F.col("file")).alias("path"), F.col("at").alias("chunk"), "content"), target)


def _pack(batches):
    import pyarrow as pa
    for batch in batches:
        for path, at, content in zip(*(c.to_pylist() for c in batch.columns)):
            yield pa.RecordBatch.from_pydict({"path": [path], "chunk": [at], "content": [gzip.compress(content, mtime=0)]})


def gzip_files_bytes(spark: SparkSession, source, target: str, chunk_bytes: int = CHUNK_BYTES) -> str:
    """Each file as ``name.gz`` (K-7): every chunk is a gzip member, packed by a task of its own; members one after another are a gzip file."""
    chunks = read_chunks(spark, source, chunk_bytes).select(F.concat(_named(F.col("file")), F.lit(".gz")).alias("path"), F.col("at").alias("chunk"), "content")
    return write_files(chunks.mapInArrow(_pack, _CHUNKS), target)


def _unpack(step: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = _store(file)
                name, at, member = path.rpartition("/")[2], 0, None
                name = name[:-3] if name.endswith(".gz") else name
                with store.open_input_stream(path, compression=None) as f:
                    left = b""
                    while True:
                        data = left or f.read(step)
                        if not data:
                            break
                        member = member or zlib.decompressobj(wbits=31)
                        out = member.decompress(data, step)
                        left = member.unconsumed_tail or member.unused_data
                        if member.eof:
                            member = None
                        if out:
                            yield pa.RecordBatch.from_pydict({"path": [name], "chunk": [at], "content": [out]})
                            at += 1
                if member is not None:
                    raise EOFError(f"{file} ends inside a gzip member")
                if not at:
                    yield pa.RecordBatch.from_pydict({"path": [name], "chunk": [0], "content": [b""]})
    return run


def gunzip_files_bytes(spark: SparkSession, source, target: str, chunk_bytes: int = CHUNK_BYTES) -> str:
    """Unpack gzip files (K-7), each by one task that holds one chunk; a damaged or cut file raises."""
    files = _listing(spark, source).select("file").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return write_files(files.mapInArrow(_unpack(chunk_bytes), _CHUNKS), target)


def _digest(batches):
    import pyarrow as pa
    for batch in batches:
        for file in batch.column(0).to_pylist():
            store, path = _store(file)
            digest, size = hashlib.sha256(), 0
            with store.open_input_stream(path, compression=None) as f:
                while data := f.read(CHUNK_BYTES):
                    digest.update(data)
                    size += len(data)
            yield pa.RecordBatch.from_pydict({"file": [file], "bytes": [size], "sha256": [digest.hexdigest()]})


def file_digests(spark: SparkSession, source) -> DataFrame:
    """``file``, ``bytes`` and ``sha256`` of the files as they are on disk; one chunk is held at a time."""
    files = _listing(spark, source).select("file").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return files.mapInArrow(_digest, "file string, bytes bigint, sha256 string")
