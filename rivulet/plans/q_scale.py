"""Queries over steps that must not meet in one task: range lookups, files and arrays cut into splits, byte-true files, bounded batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators.filetable import create_table, delete_from_table, read_table, table_files, update_table
from rivulet.operators.graph import reachable
from rivulet.operators.ordering import with_row_index
from rivulet.operators.rangelookup import lookup_between
from rivulet.plans.registry import query, table
from rivulet.session import scratch_path
from rivulet.sinks.files import copy_files_bytes, file_digests, gunzip_files_bytes, gzip_files_bytes, write_files
from rivulet.sinks.writers import concat_skip_headers, write_json_array
from rivulet.sources.csv import read_csv
from rivulet.sources.entries import entry_counts, list_entries
from rivulet.sources.splits import read_csv_in_splits, read_json_array
from rivulet.sources.sql import incremental_keyset, incremental_read, sql_read
from rivulet.state import StateTable


@query("lookup_inequality", """
SELECT p_partkey, count(o_orderkey) AS n_orders, CASE WHEN count(o_orderkey) = 1 THEN any_value(o_orderkey) END AS hit
FROM part LEFT JOIN orders ON o_totalprice >= p_retailprice * 100 AND o_totalprice < p_retailprice * 100 + 30 GROUP BY p_partkey
""")
def q_lookup_inequality(spark, sf_dir):
    """Q-1: a lookup with no equality at all, orders in a price band of each part."""
    out = lookup_between(table(spark, sf_dir, "part"), table(spark, sf_dir, "orders"), "o_totalprice", "p_retailprice * 100",
                         "p_retailprice * 100 + 30", include_high=False, data_cols=["o_orderkey"], count_col="n_orders", data_col="hit")
    return out.select("p_partkey", "n_orders", F.col("hit.o_orderkey").alias("hit"))


@query("lookup_inequality_open", """
SELECT s_suppkey, (SELECT count(*) FROM orders WHERE o_totalprice > s_acctbal * 40) AS n_above,
  (SELECT count(*) FROM customer WHERE c_acctbal <= s_acctbal) AS n_below FROM supplier
""")
def q_lookup_inequality_open(spark, sf_dir):
    """Q-1: one open end; the number of matches grows with the table, the work does not."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    above = lookup_between(s, table(spark, sf_dir, "orders"), "o_totalprice", "s_acctbal * 40", include_low=False,
                           data_cols=["o_orderkey"], count_col="n_above", data_col="d1")
    both = lookup_between(above, table(spark, sf_dir, "customer"), "c_acctbal", high="s_acctbal", data_cols=["c_custkey"],
                          count_col="n_below", data_col="d2")
    return both.select("s_suppkey", "n_above", "n_below")


@query("lookup_inequality_keyed", """
SELECT o_orderkey, count(event_id) AS n_events, CASE WHEN count(event_id) = 1 THEN any_value(event_id) END AS hit
FROM orders LEFT JOIN events ON (CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END) = (CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END)
  AND value > (o_orderkey % 100) / 2.0 AND value <= (o_orderkey % 100) / 2.0 + 1 GROUP BY o_orderkey
""")
def q_lookup_inequality_keyed(spark, sf_dir):
    """Q-1: a range besides a key that a third of both tables share."""
    hot = lambda c: F.when(F.col(c) % 3 == 0, F.lit(0)).otherwise(F.col(c)).cast("bigint").alias("k")
    o = table(spark, sf_dir, "orders").select("o_orderkey", hot("o_custkey"))
    e = table(spark, sf_dir, "events").select("event_id", "value", hot("user_id"))
    out = lookup_between(o, e, "value", "(o_orderkey % 100) / 2D", "(o_orderkey % 100) / 2D + 1", include_low=False, on="k",
                         data_cols=["event_id"], count_col="n_events", data_col="hit")
    return out.select("o_orderkey", "n_events", F.col("hit.event_id").alias("hit"))


# ten documents a file: the number of files grows with the table
_FILES = "SELECT printf('%08d.txt', doc_id // 10) AS name, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, " \
         "sha256(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY 1"


def _document_files(spark, sf_dir, name):
    d = table(spark, sf_dir, "documents")
    path = F.format_string("%08d.txt", F.floor(F.col("doc_id") / 10).cast("bigint"))
    return write_files(d.select(path.alias("path"), F.col("doc_id").alias("chunk"), F.coalesce("text", F.lit("")).cast("binary").alias("content")),
                       scratch_path(spark, name))


def _digests(spark, path):
    return file_digests(spark, path).select(F.element_at(F.split("file", "/"), -1).alias("name"), "bytes", "sha256")


@query("copy_files_bytes", _FILES)
def q_copy_files_bytes(spark, sf_dir):
    """K-8: files made of all documents, copied in chunks; one row per file on disk."""
    source, target = _document_files(spark, sf_dir, "files"), scratch_path(spark, "copies")
    return _digests(spark, f"{copy_files_bytes(spark, f'{source}/*.txt', target, 4096)}/*.txt")


@query("gzip_files_bytes", f"SELECT *, true AS packed FROM ({_FILES})")
def q_gzip_files_bytes(spark, sf_dir):
    """K-7: the same files packed chunk by chunk and unpacked again; ``packed``: the file between is smaller, but for short ones."""
    source, packed, target = _document_files(spark, sf_dir, "files"), scratch_path(spark, "packed"), scratch_path(spark, "unpacked")
    gzip_files_bytes(spark, f"{source}/*.txt", packed, 65536)
    back = _digests(spark, f"{gunzip_files_bytes(spark, f'{packed}/*.gz', target, 4096)}/*.txt")
    sizes = _digests(spark, f"{packed}/*.gz").select(F.regexp_replace("name", r"\.gz$", "").alias("name"), F.col("bytes").alias("small"))
    return back.join(sizes, "name").select("name", "bytes", "sha256", ((F.col("small") < F.col("bytes")) | (F.col("bytes") < 500)).alias("packed"))


def _quoted(c):
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '""'), F.lit('"'))


@query("csv_multiline_split", "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes, sha256(coalesce(text, '')) AS sha256, coalesce(source, '') AS source FROM documents")
def q_csv_multiline_split(spark, sf_dir):
    """S-1: texts with line ends, commas and quotes in CSV files that are read in splits."""
    d = table(spark, sf_dir, "documents")
    file = F.format_string("%06d.csv", F.floor(F.col("doc_id") / 2000).cast("bigint")).alias("path")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), _quoted(F.col("text")), _quoted(F.col("source")))
    rows = d.select(file, F.col("doc_id").alias("chunk"), F.concat(line, F.lit("\n")).cast("binary").alias("content"))
    heads = d.select(file).distinct().select("path", F.lit(-1).cast("bigint").alias("chunk"), F.lit("doc_id,text,source\n").cast("binary").alias("content"))
    path = write_files(rows.unionByName(heads), scratch_path(spark, "multiline"))
    out = read_csv_in_splits(spark, f"{path}/*.csv")
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length("text").cast("bigint").alias("bytes"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "source")


@query("json_array_split", "SELECT doc_id, sha256(text) AS sha256, lang, strlen(text)::BIGINT AS bytes FROM documents")
def q_json_array_split(spark, sf_dir):
    """S-3: files that are one array each, read in splits; texts hold brackets, quotes and commas."""
    d = table(spark, sf_dir, "documents")
    file = F.format_string("%06d.json", F.floor(F.col("doc_id") / 2000).cast("bigint")).alias("path")
    first = d.groupBy(file).agg(F.min("doc_id").alias("_lo"))
    item = F.to_json(F.struct("doc_id", "text", "lang"))
    items = d.withColumn("path", file).join(first, "path").select(
        "path", F.col("doc_id").alias("chunk"), F.concat(F.when(F.col("doc_id") == F.col("_lo"), F.lit("[")).otherwise(F.lit(",\n")), item).cast("binary").alias("content"))
    ends = first.select("path", F.lit((1 << 63) - 1).alias("chunk"), F.lit("]\n").cast("binary").alias("content"))
    path = write_files(items.unionByName(ends), scratch_path(spark, "arrays"))
    out = read_json_array(spark, f"{path}/*.json", "doc_id bigint, text string, lang string")
    return out.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "lang", F.octet_length("text").cast("bigint").alias("bytes"))


@query("file_entries", """
WITH d AS (SELECT 'n' || s_nationkey AS a, 's' || s_suppkey AS b, s_suppkey % 3 = 0 AS f FROM supplier)
SELECT a || '/' || b AS directory, CAST(f AS BIGINT) AS files, CAST(0 AS BIGINT) AS folders FROM d
UNION ALL SELECT a, CAST(0 AS BIGINT), count(*) FROM d GROUP BY a
""")
def q_file_entries(spark, sf_dir):
    """S-11, S-13: entries of every folder, most of them empty."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("n"), F.col("s_nationkey"), F.lit("/s"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, "/a.txt").otherwise("/"))
    root = write_files(s.select(name.alias("path"), F.lit(0).alias("chunk"), F.col("s_name").cast("binary").alias("content")), scratch_path(spark, "tree"))
    base = root.split("://")[-1].removeprefix("file:").rstrip("/")
    out = entry_counts(list_entries(spark, root).where("path NOT LIKE '%/_SUCCESS' AND path NOT LIKE '%/_temporary'"))
    return out.withColumn("directory", F.regexp_replace("directory", f"^.*{base}/?", "")).where("directory != ''")


@query("incremental_keyset", """
SELECT o_orderkey, day, (row_number() OVER (ORDER BY day, o_orderkey) - 1) // (SELECT count(*) // 5 + 1 FROM orders) + 1 AS run FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN DATE '1995-06-17' ELSE CAST(o_orderdate AS DATE) END AS day FROM orders)
""")
def q_incremental_keyset(spark, sf_dir):
    """S-10: a third of all rows share one counter, and no batch is larger than its limit."""
    day = F.when(F.col("o_orderkey") % 3 == 0, F.lit("1995-06-17").cast("date")).otherwise(F.col("o_orderdate").cast("date"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"))
    state, sink = StateTable(spark, scratch_path(spark, "keyset")), scratch_path(spark, "keyset_sink")
    limit = o.count() // 5 + 1
    for run in range(1, 7):
        batch = incremental_keyset(o, "day", "o_orderkey", state, limit)
        batch.df.withColumn("run", F.lit(run).cast("bigint")).write.mode("append").parquet(sink)
        batch.commit()
    return spark.read.parquet(sink)


@query("incremental_nulls", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS c, CASE WHEN o_orderkey % 5 = 0 OR o_custkey <= (SELECT max(o_custkey) // 2 FROM orders) THEN 1 ELSE 2 END AS run FROM orders
""")
def q_incremental_nulls(spark, sf_dir):
    """S-10: rows without a counter are read by the first run and by it alone."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("c"))
    half = table(spark, sf_dir, "orders").agg((F.max("o_custkey") / 2).cast("bigint").alias("h")).first()["h"]
    state, sink = StateTable(spark, scratch_path(spark, "nulls")), scratch_path(spark, "nulls_sink")
    for run, seen in ((1, o.where(F.col("c").isNull() | (F.col("c") <= half))), (2, o)):
        batch = incremental_read(seen, "c", state)
        batch.observed().withColumn("run", F.lit(run)).write.mode("append").parquet(sink)
        batch.commit()
    return spark.read.parquet(sink)


@query("json_array_repeats", "SELECT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS k, c_custkey, c_name FROM customer")
def q_json_array_repeats(spark, sf_dir):
    """K-1: an array of all customers by a column with repeats and NULLs; every row is read back."""
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("k"), "c_custkey", "c_name")
    path = scratch_path(spark, "array")
    write_json_array(c, path, "k")
    lines = spark.read.text(path)
    # one bracket opens and one closes, or nothing comes back
    whole = lines.agg((F.count_if(F.col("value").startswith("[")) == 1).alias("o"), (F.count_if(F.col("value").endswith("]")) == 1).alias("c")).first()
    rec = F.from_json(F.regexp_replace("value", r"^[\[,]|\]$", ""), c.schema)
    return lines.where(F.lit(bool(whole["o"] and whole["c"]))).select(rec.alias("r")).select("r.*")


@query("concat_same_names", """
SELECT line, row_number() OVER (ORDER BY part, kind, c_custkey) AS position FROM (
  SELECT 0 AS part, 0 AS kind, 0 AS c_custkey, 'key,z' AS line
  UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END, 1, c_custkey, concat_ws(',', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'z' ELSE 'a' END) FROM customer)
""")
def q_concat_same_names(spark, sf_dir):
    """K-6: two files of one name, the first given (z) keeps its header although the other (a) sorts before it."""
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "z").otherwise("a").alias("d"), "c_custkey")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "d")
    rows = c.select("d", F.col("c_custkey").alias("chunk"), line.alias("l"))
    heads = c.select("d").distinct().select("d", F.lit(-1).cast("bigint").alias("chunk"), F.concat(F.lit("key,"), "d").alias("l"))
    root = write_files(rows.unionByName(heads).select(F.concat("d", F.lit("/part.csv")).alias("path"), "chunk",
                                                      F.concat("l", F.lit("\n")).cast("binary").alias("content")), scratch_path(spark, "same"))
    out = concat_skip_headers(spark, [f"{root}/z/part.csv", f"{root}/a/part.csv"])
    return with_row_index(out, ["file_no", "block", "line_no"], "position").select("line", "position")


@query("csv_empty_file", "SELECT r_regionkey, CAST(0 AS BIGINT) AS records FROM region")
def q_csv_empty_file(spark, sf_dir):
    """S-1: a file without any byte has no records, whether headers are given or not; one file for each region."""
    r = table(spark, sf_dir, "region")
    name = F.concat(F.lit("r"), F.col("r_regionkey"), F.lit(".csv"))
    root = write_files(r.select(name.alias("path"), F.lit(0).alias("chunk"), F.lit(None).cast("binary").alias("content")), scratch_path(spark, "empty"))
    n = read_csv(spark, f"{root}/*.csv").count() + read_csv(spark, f"{root}/*.csv", headers="a,b").count() + read_csv_in_splits(spark, f"{root}/*.csv").count()
    return r.select("r_regionkey", F.lit(n).cast("bigint").alias("records"))


@query("cte_recursive", """
WITH RECURSIVE up(node, parent, depth) AS (
  SELECT c_custkey, c_custkey // 10, CAST(0 AS BIGINT) FROM customer WHERE c_custkey < 10
  UNION ALL SELECT c.c_custkey, c.c_custkey // 10, u.depth + 1 FROM customer c JOIN up u ON c.c_custkey // 10 = u.node WHERE c.c_custkey >= 10)
SELECT node, parent, depth FROM up
""")
def q_cte_recursive(spark, sf_dir):
    """Q-4: a recursive query as written, each customer below the one of its leading digits."""
    return sql_read(spark, """
        WITH RECURSIVE up(node, parent, depth) AS (
          SELECT c_custkey, c_custkey DIV 10, CAST(0 AS BIGINT) FROM {customer} WHERE c_custkey < 10
          UNION ALL SELECT c.c_custkey, c.c_custkey DIV 10, u.depth + 1 FROM {customer} c JOIN up u ON c.c_custkey DIV 10 = u.node WHERE c.c_custkey >= 10)
        SELECT node, parent, depth FROM up""", {"customer": table(spark, sf_dir, "customer")})


@query("graph_reach", """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) + 1 AS dst FROM orders),
w(node, depth) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 12)
SELECT node, min(depth) AS depth FROM w GROUP BY node
""")
def q_graph_reach(spark, sf_dir):
    """Q-4: the same over a graph with cycles, by rounds of joins, each written."""
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "customer").count()
    edges = o.select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % n + 1).alias("dst"))
    return reachable(edges, spark.range(1).select(F.lit(1).cast("bigint").alias("node")))


@query("dml_update_files", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7000 < 20 THEN -1.0 ELSE o_totalprice END AS o_totalprice,
  o_orderkey // 500 NOT IN (SELECT o_orderkey // 500 FROM orders WHERE o_orderkey % 7000 < 20 OR o_orderkey % 9000 = 4500) AS same_file
FROM orders WHERE o_orderkey % 9000 <> 4500
""")
def q_dml_update_files(spark, sf_dir):
    """C-10, Q-3: an update and a delete over files of 500 keys; ``same_file``: the row's file has the name it had before."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path = scratch_path(spark, "filetable")
    create_table(o, path, "o_orderkey", "o_orderkey DIV 500")
    update_table(spark, path, o.where("o_orderkey % 7000 < 20").select("o_orderkey", F.lit(-1.0).alias("o_totalprice")), "o_orderkey", ["o_totalprice"])
    delete_from_table(spark, path, o.where("o_orderkey % 9000 = 4500"), "o_orderkey")
    first = table_files(spark, path, 1).select(F.col("file").alias("_f"))
    rows = read_table(spark, path).select("o_orderkey", "o_totalprice", F.col("_metadata.file_path").alias("file"))
    return rows.join(first, F.col("file") == F.col("_f"), "left").select("o_orderkey", "o_totalprice", F.col("_f").isNotNull().alias("same_file"))
