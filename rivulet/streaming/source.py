"""A queue table as a streaming source with offsets of its own, and numbers and last values kept in stream state (S-15, T-5, T-6, C-7).

The queue is a folder of Parquet files with a growing, unique id per row (as an
auto-increment key is).  Offsets are ids, so a query goes on behind the last id
it has committed, whatever files the rows lie in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from rivulet.sources.entries import open_store

__all__ = ["queue_stream", "numbered", "register_queue"]


class _IdRange(InputPartition):
    def __init__(self, files, low, high):
        self.files, self.low, self.high = files, low, high


def _dataset(path: str):
    import pyarrow.dataset as ds
    store, root, _ = open_store(path)
    return store, root, ds


class _QueueReader(DataSourceStreamReader):
    """Offsets ``{"id": n}``: rows with an id up to n have been given out."""

    def __init__(self, schema: T.StructType, options: dict):
        self.path, self.id_col = options["path"], options.get("idcolumn", "id")
        self.names = schema.fieldNames()
        self.start, self.rows = int(options.get("startafter", "-1")), int(options.get("rowsperpartition", "100000"))

    def _files(self) -> list[tuple[str, int, int]]:
        """Each file with its smallest and largest id, from the Parquet footers; no rows are read."""
        import pyarrow.parquet as pq
        from pyarrow import fs
        store, root, _ = _dataset(self.path)
        out = []
        for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = f.path.rpartition("/")[2]
            if f.type != fs.FileType.File or not f.size or name.startswith(("_", ".")) or "/_temporary/" in f.path:
                continue
            meta = pq.ParquetFile(f.path, filesystem=store).metadata
            at = next(i for i in range(len(meta.schema)) if meta.schema.column(i).path == self.id_col)
            stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups) if meta.row_group(g).num_rows]
            if stats:
                out.append((f.path, min(s.min for s in stats), max(s.max for s in stats)))
        return out

    def initialOffset(self) -> dict:
        return {"id": self.start}

    def latestOffset(self) -> dict:
        return {"id": max((hi for *_, hi in self._files()), default=self.start)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["id"], end["id"]
        files = [f for f in self._files() if f[2] > low and f[1] <= high]
        out = []
        # ranges of ids, each with the files that can hold some: a large file is read by many tasks
        while low < high and files:
            top = min(high, low + self.rows)
            inside = [p for p, lo, hi in files if hi > low and lo <= top]
            if inside:
                out.append(_IdRange(inside, low, top))
                low = top
            else:  # nothing up to the next file's first id
                low = max(top, min(lo for _, lo, hi in files if hi > low) - 1)
        return out or [_IdRange([], low, low)]

    def read(self, partition: _IdRange) -> Iterator:
        import pyarrow.dataset as ds
        if not partition.files:
            return
        store, _, _ = _dataset(self.path)
        at = ds.field(self.id_col)
        data = ds.dataset(partition.files, filesystem=store, format="parquet")
        yield from data.to_batches(columns=self.names, filter=(at > partition.low) & (at <= partition.high))

    def commit(self, end: dict) -> None:
        """Rows up to ``end`` are done with; the queue itself is purged by its owner (``history.queue_purge``)."""


class QueueSource(DataSource):
    """``spark.readStream.format("rivulet_queue")`` over ``path``; options ``idColumn``, ``startAfter``, ``rowsPerPartition``."""

    @classmethod
    def name(cls):
        return "rivulet_queue"

    def schema(self):
        raise ValueError("give the queue's schema")

    def streamReader(self, schema):
        return _QueueReader(schema, {k.lower(): v for k, v in self.options.items()})


def register_queue(spark: SparkSession) -> None:
    spark.dataSource.register(QueueSource)


def queue_stream(spark: SparkSession, path: str, schema, id_col: str = "id", start_after: int = -1, rows_per_partition: int = 100_000) -> DataFrame:
    """Rows of the queue at ``path`` with an id above what the query's checkpoint has, from ``start_after`` on.

    Ids must grow: a row with a smaller id than one that was read before is
    not seen.  A table that is not there yet is an empty queue.
    """
    register_queue(spark)
    return spark.readStream.format("rivulet_queue").schema(schema).option("idColumn", id_col).option("startAfter", str(start_after)) \
        .option("rowsPerPartition", str(rows_per_partition)).load(path)


def _numbering(key_type: T.DataType, order_col: str, value_col: str):
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Numbering(StatefulProcessor):
        """A key's count and last value; rows of one micro-batch are numbered in order of ``order_col``."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("seen", "n bigint, last string")

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
            n, last = self.state.get() if self.state.exists() else (0, None)
            pdf = pd.concat(list(rows)).sort_values(order_col, kind="stable")
            values = pdf[value_col].astype(object)
            before = [last, *values.iloc[:-1]]
            pdf = pdf.assign(iteration=range(n, n + len(pdf)), previous=[None if v is None or pd.isna(v) else str(v) for v in before])
            end = values.iloc[-1]
            self.state.update((n + len(pdf), None if end is None or pd.isna(end) else str(end)))
            yield pdf

        def close(self) -> None:
            pass

    return Numbering()


def numbered(stream: DataFrame, key: str, order_col: str, value_col: str) -> DataFrame:
    """Each record of a stream with its number within its ``key`` (``iteration``, from 0) and the value before it (``previous``, as text).

    Counts and last values are kept in the stream's state (RocksDB), so numbers
    go on over micro-batches and over runs on one checkpoint.  The rows of one
    key in one micro-batch are sorted in its task; the source's options bound a
    micro-batch.  A NULL key is a key like any other.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("iteration", T.LongType()), T.StructField("previous", T.StringType())])
    return stream.groupBy(key).transformWithStateInPandas(
        _numbering(stream.schema[key].dataType, order_col, value_col), outputStructType=schema, outputMode="Append", timeMode="None")
