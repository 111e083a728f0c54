"""CSV reader (S-1, S-2): every field is a string."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _strict(corrupt: Column) -> Column:
    """True, or an error for a row that did not parse."""
    failed = F.raise_error(F.concat(F.lit("malformed CSV row: "), corrupt)).cast("boolean")
    return F.when(corrupt.isNotNull(), failed).otherwise(F.lit(True))


def read_csv(spark: SparkSession, path: str, headers: list[str] | str | None = None,
             overwrite_headers: bool = False, continue_on_error: bool = False,
             delimiter: str = ",", null_value: str | None = None, multi_line: bool = False,
             row_numbers: bool = False, shared: bool = False):
    """Read delimited text as string columns.

    * ``headers`` empty: the first line of the file names the columns (names
      that repeat get their position appended: ``a,a`` is ``a0,a1``).
    * ``headers`` given: those names; the first line is data …
    * … unless ``overwrite_headers``: then the first line is dropped.

    An empty field, quoted or not, is ``''``; only a field equal to
    ``null_value`` is NULL.  Blanks around a field are kept.  ``multi_line``
    allows line ends inside quotes (a file is then read by one task;
    ``splits.read_csv_in_splits`` reads it by many).

    A row whose field count differs from the header raises, also when a query
    needs few columns or none.  With ``continue_on_error`` the reader returns
    ``(good, bad)``: ``bad`` holds the raw line in ``raw`` next to the parsed
    fields, and with ``row_numbers`` the row's number in its ``file`` (1 is the
    first record after the header).  Both are lazy and read the source for
    themselves; ``shared`` parses once into the scratch folder for both.  Blank
    lines are skipped.  A missing path raises.
    """
    if isinstance(headers, str):
        headers = [h.strip() for h in headers.split(",") if h.strip()]
    opts = {"sep": delimiter, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false", "multiLine": str(multi_line).lower(),
            "columnPruning": "false"}  # a parser that skips fields does not see a wrong number of them
    if headers:
        names = list(headers)
        opts["header"] = "true" if overwrite_headers else "false"
    else:
        names = spark.read.options(**opts).option("header", "true").csv(path).columns
        opts["header"] = "true"
    if not names:
        # no byte in any file: no records, and nothing that names a column
        none = spark.createDataFrame([], T.StructType([]))
        return (none, spark.createDataFrame([], "raw string, file string, row_number bigint" if row_numbers else "raw string")) if continue_on_error else none
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in [*names, CORRUPT]])
    raw = (spark.read.options(**opts).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path))
    if row_numbers:
        raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_id"))

    def field(n: str) -> Column:
        c = F.coalesce(F.col(f"`{n}`"), F.lit(""))
        return (c if null_value is None else F.when(c != null_value, c)).alias(n)

    fields = [field(n) for n in names]
    # the source refuses to read the raw record alone, so no bytes of the first field go with it
    raw_line = F.concat(F.col(CORRUPT), F.substring(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")), 1, 0))
    if not continue_on_error:
        return raw.where(_strict(raw_line)).select(*fields)
    if shared:
        from rivulet.session import materialize
        raw = materialize(raw, "csv_parsed")
    good = raw.where(raw_line.isNull()).select(*fields)
    bad = raw.where(raw_line.isNotNull())
    if not row_numbers:
        return good, bad.select(*fields, raw_line.alias("raw"))
    # rows before each split of a file: one row per split
    splits = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.col(f"`{names[0]}`").isNull()).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    number = (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("bigint")
    return good, bad.join(splits, ["file", "_block"]).select(*fields, raw_line.alias("raw"), "file", number.alias("row_number"))
