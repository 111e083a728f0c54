"""Registered queries: readers (S-*) and path checks (V-4, V-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.plans.registry import query, table
from rivulet.session import scratch_path
from rivulet.sinks.writers import write_csv, write_json
from rivulet.sources.csv import read_csv
from rivulet.sources.files import list_constraints, path_permitted, path_scheme
from rivulet.sources.json import extract_array, natural_sort, object_values, read_json
from rivulet.sources.queue import read_event_queue

EVENTS_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def orders_as_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        "o_orderstatus",
        F.format_string("%.2f", "o_totalprice").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority")


ORDERS_TEXT_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, printf('%.2f', o_totalprice) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""


@query("read_csv", ORDERS_TEXT_SQL)
def q_read_csv(spark, sf_dir):
    """S-1: orders written as CSV with a header, read back: every field a string."""
    path = scratch_path(spark, "read_csv")
    write_csv(orders_as_text(spark, sf_dir), path)
    return read_csv(spark, path)


def _orders_lines_with_bad(spark, sf_dir, path):
    o = table(spark, sf_dir, "orders")
    line = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    # rows of status P carry one field too many
    line = F.when(F.col("o_orderstatus") == "P", F.concat(line, F.lit(",x"))).otherwise(line)
    o.select(line.alias("value")).write.text(path)


CSV_HEADERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query("csv_bad_rows", """
SELECT concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority, 'x') AS raw,
       CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, o_orderpriority
FROM orders WHERE o_orderstatus = 'P'""")
def q_csv_bad_rows(spark, sf_dir):
    """S-2: rows whose field count differs from the header, kept aside with their raw line."""
    path = scratch_path(spark, "csv_bad")
    _orders_lines_with_bad(spark, sf_dir, path)
    _, bad = read_csv(spark, path, headers=CSV_HEADERS, continue_on_error=True)
    return bad


@query("csv_good_rows", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'""")
def q_csv_good_rows(spark, sf_dir):
    """S-2: with continue-on-error the well-formed rows flow on."""
    path = scratch_path(spark, "csv_good")
    _orders_lines_with_bad(spark, sf_dir, path)
    good, _ = read_csv(spark, path, headers=CSV_HEADERS, continue_on_error=True)
    return good


@query("read_json", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_read_json(spark, sf_dir):
    """S-3: events written as JSON lines and read back with a declared schema."""
    path = scratch_path(spark, "read_json")
    write_json(table(spark, sf_dir, "events"), path)
    return read_json(spark, path, schema=EVENTS_DDL)


ORDER_DOC_DDL = ("orderkey bigint, data struct<list: struct<items: array<struct<"
                 "line: bigint, part: bigint, qty: double>>>>")


@query("json_extract_array", """
SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_quantity AS qty
FROM lineitem""")
def q_json_extract_array(spark, sf_dir):
    """S-4: one JSON document per order with its lines nested at data.list.items; extract the array."""
    li = table(spark, sf_dir, "lineitem")
    # an order has a bounded number of lines, so each collected array is small
    docs = li.groupBy(F.col("l_orderkey").alias("orderkey")).agg(
        F.collect_list(F.struct(F.col("l_linenumber").cast("bigint").alias("line"),
                                F.col("l_partkey").alias("part"),
                                F.col("l_quantity").alias("qty"))).alias("items"))
    text = docs.select(F.to_json(F.struct("orderkey", F.struct(F.struct("items").alias("list")).alias("data")))
                       .alias("value"))
    path = scratch_path(spark, "order_docs")
    text.write.text(path)
    return extract_array(read_json(spark, path, schema=ORDER_DOC_DDL), "data.list.items", keep=["orderkey"])


@query("json_object_values", """
SELECT e.event_id, CAST(row_number() OVER (PARTITION BY e.event_id ORDER BY j.id) - 1 AS INTEGER) AS pos,
       j.key AS key,
       CASE WHEN j.type = 'VARCHAR' THEN j.value ->> '$' ELSE CAST(j.value AS VARCHAR) END AS value
FROM events e, json_each(e.props) j""")
def q_json_object_values(spark, sf_dir):
    """S-5: one row per property of each JSON object, in document order."""
    return object_values(table(spark, sf_dir, "events"), "props", keep=["event_id"])


NATKEY_SQL = """list_transform(regexp_extract_all({s}, '(\\d+|\\D+)'),
    lambda p: CASE WHEN regexp_matches(p, '^[0-9]')
              THEN lpad(CAST(length(CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END) AS VARCHAR), 10, '0')
                   || CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END
              ELSE p END)"""


@query("natural_sort", f"""
SELECT page_id, url, row_number() OVER (ORDER BY {NATKEY_SQL.format(s='lower(url)')}, page_id) AS sort_rank
FROM pages""")
def q_natural_sort(spark, sf_dir):
    """S-6: natural, case-insensitive sort of URLs with the rank of each row."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return natural_sort(pages, "url", tiebreak="page_id")


@query("natural_sort_desc", f"""
SELECT page_id, url, row_number() OVER (ORDER BY {NATKEY_SQL.format(s='lower(url)')} DESC, page_id) AS sort_rank
FROM pages""")
def q_natural_sort_desc(spark, sf_dir):
    """S-6: the same sort with order 'desc'."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return natural_sort(pages, "url", tiebreak="page_id", order="desc")


@query("path_list_constraints", f"""
SELECT * FROM (
  SELECT url, value, row_number() OVER (ORDER BY {NATKEY_SQL.format(s='value')}, url) AS position
  FROM (SELECT url, regexp_extract(url, '([^/]*)/*$', 1) AS value FROM pages
        WHERE regexp_matches(url, '^.*/en/.*$'))
) WHERE position > 2""")
def q_path_list_constraints(spark, sf_dir):
    """S-12: glob '*/en/*', basename, natural sort, skip the first two."""
    pages = table(spark, sf_dir, "pages").select("url")
    return list_constraints(pages, "url", returnvalue="basename", sort="natural", offset=2,
                            pattern="*/en/*")


@query("path_list_alpha_reverse", """
SELECT * FROM (
  SELECT url, value, row_number() OVER (ORDER BY value DESC, url DESC) AS position
  FROM (SELECT url, replace(url, 'https://m.ththth.example.net/', '') AS value FROM pages
        WHERE regexp_matches(url, '^https://.*$'))
) WHERE position > 0 AND position <= 100""")
def q_path_list_alpha_reverse(spark, sf_dir):
    """S-12: relative paths below a base, reverse alphabetical, first 100 (limit is the operator's feature)."""
    pages = table(spark, sf_dir, "pages").select("url")
    return list_constraints(pages, "url", returnvalue="relativepath", sort="alpha_reverse", offset=0,
                            limit=100, pattern="https://*", base="https://m.ththth.example.net")


@query("path_scheme", """
SELECT page_id, CASE WHEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1) = '' THEN 'file'
                     ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1) END AS scheme
FROM (SELECT page_id, CASE WHEN url LIKE 'http://%' THEN regexp_replace(url, '^http://[^/]+', '') ELSE url END AS url
      FROM pages)""")
def q_path_scheme(spark, sf_dir):
    """V-5: scheme of a path, 'file' when it has none."""
    p = table(spark, sf_dir, "pages")
    path = F.when(F.col("url").startswith("http://"), F.regexp_replace("url", "^http://[^/]+", "")).otherwise(F.col("url"))
    return p.select("page_id", path_scheme(path).alias("scheme"))


@query("path_permitted", """
SELECT page_id, path, (NOT starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z][A-Za-z0-9+.\\-]*://')
                       OR starts_with(path, '/en/')) AS permitted
FROM (SELECT page_id, CASE WHEN url LIKE 'http://%' THEN regexp_replace(url, '^http://[^/]+', '') ELSE url END AS path
      FROM pages)""")
def q_path_permitted(spark, sf_dir):
    """V-4: relative paths, paths with a scheme, and paths under a permitted directory pass."""
    p = table(spark, sf_dir, "pages")
    path = F.when(F.col("url").startswith("http://"), F.regexp_replace("url", "^http://[^/]+", "")).otherwise(F.col("url"))
    q = p.select("page_id", path.alias("path"))
    return q.withColumn("permitted", path_permitted(F.col("path"), ["/en/"]))


@query("event_queue_read", """
SELECT event_id AS id, user_id AS dataflowid, event_id % 4 AS stepid, event_type AS eventname,
       CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def q_event_queue_read(spark, sf_dir):
    """S-15: queued events with their JSON payload decoded."""
    q = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("dataflowid"), (F.col("event_id") % 4).alias("stepid"),
        F.col("event_type").alias("eventname"), F.col("props").alias("eventdata"))
    decoded = read_event_queue(q, schema="k bigint")
    return decoded.select("id", "dataflowid", "stepid", "eventname", F.col("eventdata.k").alias("k"))


def _pages_by_lang(spark, sf_dir, rows_per_file=0):
    """``pages`` written partitioned by language: one folder per language, files of ``rows_per_file`` (0: one file)."""
    p = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"))
    base = scratch_path(spark, "pages_by_lang")
    p.repartition("lang").write.option("maxRecordsPerFile", rows_per_file).partitionBy("lang").parquet(base)
    return base


LANG_DIRS_SQL = """(SELECT DISTINCT 'lang=' || regexp_extract(url, '/([a-z]{2})/', 1) AS directory FROM pages)"""
LANG_FILES_SQL = """SELECT 'lang=' || regexp_extract(url, '/([a-z][a-z])/', 1) AS directory, CAST(ceil(count(*) / 7.0) AS BIGINT) AS files{more}
FROM pages GROUP BY 1"""


@query("file_listing", LANG_FILES_SQL.format(more=", true AS named, true AS filled, true AS timed"))
def q_file_listing(spark, sf_dir):
    """S-11: the data files below a folder (metadata only): how many, their names, lengths and times, by folder."""
    from rivulet.sources.files import basename, dirname, list_files
    base = _pages_by_lang(spark, sf_dir, 7)
    listing = list_files(spark, base, "*.parquet", recursive=True)
    return listing.groupBy(basename(dirname("path")).alias("directory")).agg(
        F.count_distinct("path").alias("files"), F.bool_and(basename("path").rlike(r"^part-.*\.parquet$")).alias("named"),
        F.bool_and(F.col("length") > 0).alias("filled"),
        F.bool_and(F.col("modificationTime") > F.lit("2020-01-01").cast("timestamp")).alias("timed"))


@query("file_count_by_dir", LANG_FILES_SQL.format(more=""))
def q_file_count_by_dir(spark, sf_dir):
    """S-13: number of files per folder."""
    from rivulet.sources.files import basename, file_count_by_dir, list_files
    base = _pages_by_lang(spark, sf_dir, 7)
    counts = file_count_by_dir(list_files(spark, base, "*.parquet", recursive=True))
    return counts.select(basename("directory").alias("directory"), "files")


@query("file_count", f"SELECT CAST(count(*) AS BIGINT) AS entries FROM {LANG_DIRS_SQL}")
def q_file_count(spark, sf_dir):
    """S-13: number of entries directly in a folder."""
    from rivulet.sources.files import file_count
    return spark.createDataFrame([(file_count(spark, _pages_by_lang(spark, sf_dir)),)], "entries bigint")


@query("paths_exist", f"""
SELECT directory, true AS exists FROM {LANG_DIRS_SQL}
UNION ALL
SELECT replace(directory, 'lang=', 'missing='), false FROM {LANG_DIRS_SQL}""")
def q_paths_exist(spark, sf_dir):
    """S-14: which wanted paths exist (directories count); wanted paths come from the data."""
    from rivulet.sources.files import list_files, paths_exist
    base = _pages_by_lang(spark, sf_dir)
    listing = list_files(spark, base, "*.parquet", recursive=True)
    # the folder's URI as the file system spells it (one row)
    root = listing.select(F.regexp_extract("path", r"^(.*)/lang=[^/]*/[^/]*$", 1).alias("root")).first()["root"]
    langs = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang")).distinct()
    wanted = (langs.select(F.concat(F.lit("lang="), "lang").alias("directory"))
              .union(langs.select(F.concat(F.lit("missing="), "lang").alias("directory"))))
    wanted = wanted.withColumn("path", F.concat(F.lit(root + "/"), "directory"))
    return paths_exist(wanted, listing).select("directory", "exists")
