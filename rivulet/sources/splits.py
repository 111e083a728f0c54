"""Large files whose records span lines: CSV with line ends in quotes, one JSON array.

Where a record begins depends on all that stands before it, so Spark's own
readers give such a file to one task.  Here it is read in splits like any text:

1. Every split is cut into pieces at a separator.  What a split does to the
   reader's state is the same whatever stands before it, but for one bit (inside
   quotes or not), so both cases are run and one row per split is kept.
2. The rows of a file are composed in order: each split learns the state in
   which it begins, and which split the record that is open there began in.
3. Splits are read again and give the records that lie inside them.  Parts of
   records that cross splits, at most two for each split, are joined.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["CsvState", "JsonArrayState", "records_in_splits", "read_csv_in_splits", "read_json_array"]


class CsvState:
    """Quotes of delimited text, pieces being lines: a quote opens a field only where the field begins."""
    separator, base = b"\n", 0

    def __init__(self, delimiter: str = ",", quote: str = '"'):
        d, q = re.escape(delimiter.encode()), re.escape(quote.encode())
        inside = b"[^" + q + b"]*+(?:" + q + q + b"[^" + q + b"]*+)*+"
        field = b"(?:" + q + inside + q + b"(?:(?!" + d + b").)*+|(?!" + q + b")(?:(?!" + d + b").)*+)"
        self.quote = quote.encode()
        # whole fields, then one whose quotes stay open
        self.opens = re.compile(b"(?:" + field + d + b")*+" + q + inside + rb"\Z", re.S)

    def step(self, piece: bytes, inside: int, depth: int) -> tuple[int, int]:
        if self.quote not in piece:
            return inside, depth
        return int(self.opens.match(self.quote + piece if inside else piece) is not None), depth


class JsonArrayState:
    """Strings and brackets of one array, pieces ending at commas (a comma never ends an escape)."""
    separator, base = b",", 1
    marks = re.compile(rb'\\.|["\[\]{}]', re.S)

    def step(self, piece: bytes, inside: int, depth: int) -> tuple[int, int]:
        for m in self.marks.finditer(piece):
            c = m.group()
            if c == b'"':
                inside = 1 - inside
            elif not inside and len(c) == 1:
                depth += 1 if c in b"[{" else -1
        return inside, depth


def _splits(batches):
    """The pieces of each split together: (file, block, pieces one after another)."""
    from itertools import chain, groupby

    rows = chain.from_iterable(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(0).to_pylist(),
                                   *(c.to_pylist() for c in b.columns[3:])) for b in batches)
    return groupby(rows, key=lambda r: (r[0], r[1]))


def _effects(machine):
    """One row per split: for both states it may begin in, the state after it and the lowest depth at which a piece begins outside quotes."""
    def run(batches):
        import pyarrow as pa
        for (file, block), rows in _splits(batches):
            state, lowest, n = [(0, 0), (1, 0)], [None, None], 0
            for row in rows:
                n += 1
                for s, (inside, depth) in enumerate(state):
                    if not inside:
                        lowest[s] = depth if lowest[s] is None else min(lowest[s], depth)
                    state[s] = machine.step(row[2], inside, depth)
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "pieces": [n],
                                              **{f"{k}{s}": [v] for s in (0, 1) for k, v in (("inside", state[s][0]), ("depth", state[s][1]),
                                                                                            ("low", lowest[s]))}},
                                             schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("pieces", pa.int64()),
                                                               *[(f"{k}{s}", pa.int64()) for s in (0, 1) for k in ("inside", "depth", "low")]]))
    return run


def _composed(base: int):
    """The splits of one file (one row each): of those that begin inside a record, the state there and the split in which that record began."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        inside, depth, owner, out = 0, 0, None, []
        for r in pdf.sort_values("block").to_dict("records"):
            if owner is not None and (inside, depth) != (0, base):
                out.append((r["file"], r["block"], inside, depth, owner))
            low = r[f"low{inside}"]
            # the file's first piece begins a record, and so do pieces outside quotes at the base depth
            begins = owner is None or (not pd.isna(low) and depth + low <= base)
            inside, depth = int(r[f"inside{inside}"]), depth + int(r[f"depth{inside}"])
            if begins:
                owner = r["block"]
        return pd.DataFrame(out, columns=["file", "block", "inside", "depth", "owner"])
    return run


_RECORD = T.StructType([T.StructField("file", T.StringType()), T.StructField("owner", T.LongType()), T.StructField("block", T.LongType()),
                        T.StructField("at", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("closed", T.BooleanType())])


def _records(machine, fragments: bool):
    """Whole records of each split, or its fragments, with the split that owns them and their number in this one.

    A split's first pieces up to the first begin of a record, and its last
    record (which may go on in the next split), are fragments.  ``closed``:
    the text ends at depth 0.
    """
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("text", pa.binary()), ("closed", pa.bool_())])
        held: list[tuple] = []
        out = lambda: pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held))), schema=schema)
        for (file, block), rows in _splits(batches):
            pieces, at, owner, head, inside, depth = None, 0, block, False, 0, 0
            for _, _, piece, *state in rows:
                if pieces is None:
                    pieces = []
                    if state[0] is not None:
                        (inside, depth, owner), head = state, True
                    else:
                        depth = machine.base if block else 0
                elif (inside, depth) == (0, machine.base):
                    if head == fragments:
                        held.append((file, owner, block, at, machine.separator.join(pieces), False))
                    at, pieces, head, owner = at + 1, [], False, block
                pieces.append(piece)
                inside, depth = machine.step(piece, inside, depth)
                if len(held) >= 1000:
                    yield out()
                    held.clear()
            if pieces and fragments:
                held.append((file, owner, block, at, machine.separator.join(pieces), (inside, depth) == (0, 0)))
        if held:
            yield out()
    return run


def records_in_splits(spark: SparkSession, path, machine) -> DataFrame:
    """``file``, ``block`` and ``at`` (the record's place: start of its split, number in it), ``text`` (bytes) and ``closed`` of every record.

    The text of a record is without the separator that follows it.  Files are
    read three times as text; only one row per split and the records that cross
    splits are shuffled or held.  What is broadcast is one row for each split
    that begins inside a record (some 100 bytes for a split of 128 MB).  A
    compressed file is one split.
    """
    from rivulet.session import materialize

    raw = spark.read.option("lineSep", machine.separator.decode()).text(path) \
        .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    effects = raw.mapInArrow(_effects(machine), "file string, block bigint, pieces bigint, inside0 bigint, depth0 bigint, low0 bigint, "
                                                "inside1 bigint, depth1 bigint, low1 bigint")
    states = materialize(effects.groupBy("file").applyInPandas(
        _composed(machine.base), "file string, block bigint, inside int, depth bigint, owner bigint"), "splits")
    known = F.broadcast(states.withColumnsRenamed({"file": "_f", "block": "_b"}))  # which keeps the order of lines
    told = raw.join(known, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")), "left") \
        .select("value", "file", "block", "inside", "depth", "owner")
    whole = told.mapInArrow(_records(machine, False), _RECORD).select("file", "block", "at", "text", "closed")
    parts = materialize(told.mapInArrow(_records(machine, True), _RECORD), "fragments")
    # a record begins in the last fragment of its own split and goes on in the first ones of later splits
    first, rest = F.element_at("p", 1), F.slice(F.col("p.text"), F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))
    joined = parts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "at", "text", "closed"))).alias("p")) \
        .select("file", F.col("owner").alias("block"), first["at"].alias("at"),
                F.concat(first["text"], F.aggregate(rest, F.lit(b""), lambda a, b: F.concat(a, F.lit(machine.separator), b))).alias("text"),
                F.element_at("p", -1)["closed"].alias("closed"))
    return whole.unionByName(joined)


def read_csv_in_splits(spark: SparkSession, path, headers: list[str] | str | None = None, overwrite_headers: bool = False,
                       continue_on_error: bool = False, delimiter: str = ",", null_value: str | None = None):
    """``read_csv`` for line ends in quotes, with many tasks a file (its rules for headers, fields and malformed rows hold).

    Line ends are LF or CRLF; those inside quotes are kept as they are.  Every
    file begins with its header unless ``headers`` are given without
    ``overwrite_headers``.  A file without any byte has no records; if no file
    has a header, nothing names the columns and the result has none.
    """
    import csv
    import io

    if isinstance(headers, str):
        headers = [h.strip() for h in headers.split(",") if h.strip()]
    records = records_in_splits(spark, path, CsvState(delimiter)) \
        .select("file", "block", "at", F.regexp_replace(F.col("text").cast("string"), r"\r\z", "").alias("text"))
    is_first = (F.col("block") == 0) & (F.col("at") == 0)
    if headers:
        names = list(headers)
    else:
        top = records.where(is_first).orderBy("file").limit(1).collect()
        names = next(csv.reader(io.StringIO(top[0]["text"], newline=""), delimiter=delimiter)) if top and top[0]["text"] else []
    if not headers or overwrite_headers:
        records = records.where(~is_first)
    if not names:
        empty = spark.createDataFrame([], T.StructType([]))
        return (empty, spark.createDataFrame([], "raw string")) if continue_on_error else empty
    # parsed under plain names, as headers may repeat or hold anything
    schema = ", ".join([*[f"_c{i} string" for i in range(len(names))], "_bad string"])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1"}
    parsed = records.where(F.col("text") != "").select("text", F.from_csv("text", schema, options).alias("r"))

    def field(i: int, n: str):
        c = F.coalesce(F.col(f"r._c{i}"), F.lit(""))
        return (c if null_value is None else F.when(c != null_value, c)).alias(n)

    fields, bad = [field(i, n) for i, n in enumerate(names)], F.col("r._bad")
    if continue_on_error:
        return parsed.where(bad.isNull()).select(*fields), parsed.where(bad.isNotNull()).select(*fields, F.col("text").alias("raw"))
    failed = F.raise_error(F.concat(F.lit("malformed CSV row: "), F.col("text"))).cast("boolean")
    return parsed.where(F.when(bad.isNotNull(), failed).otherwise(F.lit(True))).select(*fields)


def read_json_array(spark: SparkSession, path, schema=None, with_position: bool = False) -> DataFrame:
    """The elements of the array that is the whole of each file, with many tasks a file.

    ``schema`` (DDL or type of one element) parses them, and an element that
    does not parse raises; without it the element's JSON text comes back in
    ``value``.  ``with_position`` adds ``file``, ``block`` and ``at``, which
    order the elements as they stand in the file.  A file that is not an array
    raises; an empty array or a file without any byte has no elements.
    """
    records = records_in_splits(spark, path, JsonArrayState())
    is_first = (F.col("block") == 0) & (F.col("at") == 0)
    text = F.col("text").cast("string")
    no_array = F.raise_error(F.concat(F.lit("not a JSON array: "), F.substring(text, 1, 80)))
    text = F.when(~is_first, text).when(text.rlike(r"^\s*\["), F.regexp_replace(text, r"^\s*\[", "")).when(text.rlike(r"^\s*\z"), F.lit("")) \
        .otherwise(no_array)
    value = F.trim(F.when(F.col("closed"), F.regexp_replace(text, r"\]\s*\z", "")).otherwise(text), F.lit(" \t\r\n"))
    out = records.select("file", "block", "at", value.alias("value")).where(F.col("value") != "")
    place = ["file", "block", "at"] if with_position else []
    if schema is None:
        return out.select(*place, "value")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) and " " in schema.strip() else schema
    return out.select(*place, F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select(*place, "r.*")
