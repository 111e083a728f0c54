"""Registered queries over hard values: ties, NULLs, odd text, skew, several runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.functions import vocab as V
from rivulet.functions.coerce import intval, natural_key
from rivulet.operators.joins import asof_join, hot_keys, salted_join
from rivulet.operators.sqlstep import dml_update, lookup
from rivulet.operators.transform import content_hash, regex_extract
from rivulet.operators.udf import apply_step, map_records
from rivulet.operators.validate import require
from rivulet.plans.registry import query, table
from rivulet.session import scratch_path
from rivulet.sinks.files import read_chunks
from rivulet.sinks.writers import TABLE_CHUNK_BYTES, concat_skip_headers, copy_files, gunzip_table, gzip_files, write, write_csv, write_json_array
from rivulet.sources.csv import read_csv
from rivulet.sources.sql import incremental_read
from rivulet.state import StateTable


@query("incremental_limit_ties", """
SELECT o_orderkey, day, CASE WHEN rnk <= cut THEN 1 ELSE 2 END AS run FROM (
  SELECT o_orderkey, o_orderdate AS day, dense_rank() OVER (ORDER BY o_orderdate) AS rnk FROM orders) a,
 (SELECT dense_rank AS cut FROM (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderdate) AS dense_rank,
         row_number() OVER (ORDER BY o_orderdate) AS n FROM orders) WHERE n = 50) b""")
def q_incremental_limit_ties(spark, sf_dir):
    """S-10: a batch of 50 by a counter with many ties, then the rest; every row is read exactly once."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("day"))
    st = StateTable(spark, scratch_path(spark, "ties"))
    first = incremental_read(o, "day", st, limit=50)
    path = scratch_path(spark, "ties_sink")
    first.observed().withColumn("run", F.lit(1)).write.parquet(path)
    first.commit()
    incremental_read(o, "day", st).df.withColumn("run", F.lit(2)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("csv_strict_pruned", """
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) > 0 AS raised
FROM orders GROUP BY 1""")
def q_csv_strict_pruned(spark, sf_dir):
    """S-2: files of one status each, every row of status P a field too long: counting raises there and only there."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    line = F.concat_ws(",", "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", F.lit("x")))
    path = scratch_path(spark, "strict")
    o.select(line.alias("value"), "o_orderstatus").write.partitionBy("o_orderstatus").text(path)
    out = []
    for row in o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per status
        df = read_csv(spark, f"{path}/o_orderstatus={row['o_orderstatus']}", headers="a,b")
        try:
            raised = df.count() != row["n"]
        except Exception as e:
            raised = "malformed CSV row" in str(e)
        out.append((row["o_orderstatus"], row["n"], raised))
    return spark.createDataFrame(out, "o_orderstatus string, n bigint, raised boolean")


TEXTS = "SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations"


@query("csv_roundtrip_text", f"""
SELECT id, CASE WHEN length(text) % 7 = 0 THEN NULL WHEN length(text) % 7 = 1 THEN '' ELSE ' "' || text || chr(10) || ', ' END AS text
FROM ({TEXTS})""")
def q_csv_roundtrip_text(spark, sf_dir):
    """S-1/K-2: whole texts with blanks, quotes, line ends, empty texts and NULLs come back from CSV unchanged."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    c = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text")
    n = F.length("text") % 7
    both = d.unionByName(c).withColumn("text", F.when(n == 0, F.lit(None)).when(n == 1, F.lit("")).otherwise(
        F.concat(F.lit(' "'), "text", F.lit("\n, "))))
    path = scratch_path(spark, "csv_text")
    write_csv(both, path, null_value="\\N")
    return read_csv(spark, path, null_value="\\N", multi_line=True)


@query("csv_error_rownumber", """
SELECT o_orderpriority AS part, concat_ws(',', o_orderkey, o_custkey, 'x') AS raw, row_number FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS row_number FROM orders)
WHERE o_orderstatus = 'P'""")
def q_csv_error_rownumber(spark, sf_dir):
    """S-2: a malformed row is reported with its number in the sorted files of its priority, which are ranges of the key."""
    o = table(spark, sf_dir, "orders")
    line = F.concat_ws(",", "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", F.lit("x")))
    path = scratch_path(spark, "csv_rows")
    o.select(line.alias("value"), F.col("o_orderpriority").alias("part"), "o_orderkey").repartitionByRange("part", "o_orderkey") \
        .sortWithinPartitions("part", "o_orderkey").select("value", "part").write.partitionBy("part").text(path)
    _, bad = read_csv(spark, path, headers="a,b", continue_on_error=True, row_numbers=True)
    part = F.replace(F.regexp_extract("file", "/part=([^/]*)/", 1), F.lit("%20"), F.lit(" "))
    # rows in the files before: one row per file
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(part).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return bad.join(files, "file").select(part.alias("part"), "raw", (F.col("row_number") + F.col("before")).alias("row_number"))


@query("natural_sort_long", """
SELECT page_id, CAST(CASE page_id % 3 WHEN 0 THEN 1001 WHEN 1 THEN 501 ELSE 12 END AS BIGINT) AS digits,
       row_number() OVER (ORDER BY CASE page_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END, page_id) AS sort_rank FROM pages""")
def q_natural_sort_long(spark, sf_dir):
    """S-6: runs of 12, 501 and 1001 digits in the order of their values."""
    from rivulet.operators.ordering import with_row_index
    n = F.when(F.col("page_id") % 3 == 0, 1001).when(F.col("page_id") % 3 == 1, 501).otherwise(12)
    p = table(spark, sf_dir, "pages").select("page_id", n.cast("bigint").alias("digits"),
                                             F.concat(F.lit("file"), F.repeat(F.lit("7"), n)).alias("name"))
    return with_row_index(p, [natural_key(F.col("name")), F.col("page_id")], "sort_rank").select("page_id", "digits", "sort_rank")


def _echo(rec):
    return None


@query("map_rows_bigint_null", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 9007199254740993 + event_id END AS big FROM events""")
def q_map_rows_bigint_null(spark, sf_dir):
    """U-2: integers beyond 2^53 next to NULLs pass a record function unchanged."""
    ev = table(spark, sf_dir, "events").select("event_id", F.when(
        F.col("event_id") % 3 != 0, F.lit(9007199254740993) + F.col("event_id")).alias("big"))
    return map_records(ev, _echo, "event_id bigint, big bigint")


@query("join_asof_nulls", """
WITH b AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id,
                  CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id,
             CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts FROM events WHERE event_type = 'view')
SELECT b.event_id, v.event_id AS r_event_id FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts >= v.ts""")
def q_join_asof_nulls(spark, sf_dir):
    """Q-4: NULL keys and NULL times match nothing in an as-of join."""
    ev = table(spark, sf_dir, "events")

    def side(kind, key, time):
        return ev.where(F.col("event_type") == kind).select(
            "event_id", F.when(F.col("event_id") % key != 0, F.col("user_id")).alias("user_id"),
            F.when(F.col("event_id") % time != 0, F.col("ts")).alias("ts"))

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return asof_join(side("purchase", 11, 13), side("view", 5, 7), ["user_id"], micros, micros, ["event_id"],
                     right_tiebreak="event_id").select("event_id", "r_event_id")


@query("join_salted_hot", """
SELECT e.event_id, c.c_name FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS k FROM events) e
JOIN customer c ON e.k = c.c_custkey""")
def q_join_salted_hot(spark, sf_dir):
    """Q-4: a key that holds over a third of the rows, found by its row count and spread over tasks."""
    ev = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")).alias("k"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return salted_join(ev, cust, ["k"], "inner", 8, hot_keys(ev, ["k"], rows_per_task=200)).select("event_id", "c_name")


@query("dml_update_null", """
SELECT c.c_custkey, CASE WHEN s.s_suppkey IS NULL THEN c.c_acctbal WHEN s.s_suppkey % 2 = 0 THEN NULL ELSE s.s_acctbal END AS c_acctbal,
       CASE WHEN s.s_suppkey IS NULL THEN c.c_name ELSE 'reset' END AS password
FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey""")
def q_dml_update_null(spark, sf_dir):
    """Q-3: UPDATE sets NULL, and any column by name."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_name").alias("password"))
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 2 != 0, F.col("s_acctbal")).alias("c_acctbal"),
        F.lit("reset").alias("password"))
    return dml_update(c, s, "c_custkey", ["c_acctbal", "password"])


@query("lookup_range", """
SELECT o.o_orderkey, CAST(count(e.event_id) AS BIGINT) AS n_events,
       CASE WHEN count(e.event_id) = 1 THEN any_value(e.event_id) END AS only_event
FROM orders o LEFT JOIN events e ON e.user_id = o.o_custkey AND e.value > o.o_totalprice / 2000 AND e.event_type <> 'error'
GROUP BY o.o_orderkey""")
def q_lookup_range(spark, sf_dir):
    """Q-1: a lookup whose condition is a range besides the key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    out = lookup(o, e, {"o_custkey": "user_id"}, ["event_id"], count_col="n_events", data_col="hit",
                 where="t.value > r.o_totalprice / 2000 AND t.event_type <> 'error'")
    return out.select("o_orderkey", "n_events", F.col("hit.event_id").alias("only_event"))


@query("write_json_array", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def q_write_json_array(spark, sf_dir):
    """K-1: one JSON array of all customers over part files, read back one text per line; the result lists those of its SQL."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = scratch_path(spark, "array")
    write_json_array(c, path, "c_custkey")
    rec = F.regexp_replace("value", r"^[\[,]|\]$", "")
    return spark.read.text(path).select(F.from_json(rec, "c_custkey bigint, c_name string, c_acctbal double").alias("r")).select("r.*") \
        .where("c_custkey % 2 = 0")


def _text_files(spark, sf_dir, name):
    """Texts with both kinds of line ends and no end of the last line, in a few files."""
    d = table(spark, sf_dir, "documents").select(F.concat("text", F.lit("\r\nlast line")).alias("value"))
    path = scratch_path(spark, name)
    d.repartition(3).write.option("lineSep", "\r\n").text(path)
    return path


def _digests(files):
    """One row per chunk of each file."""
    return files.select("path", "chunk", F.length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha"))


def _chunks(spark, files):
    return read_chunks(spark, files, TABLE_CHUNK_BYTES).select(F.element_at(F.split("file", "/"), -1).alias("path"), F.col("at").alias("chunk"), "content")


@query("gzip_bytes", "SELECT CAST(3 AS BIGINT) AS files, true AS same_bytes, true AS smaller FROM (SELECT count(*) FROM documents)")
def q_gzip_bytes(spark, sf_dir):
    """K-7: files packed and unpacked come back byte for byte."""
    src, dst = _text_files(spark, sf_dir, "gz_src"), scratch_path(spark, "gz_dst")
    files = _digests(_chunks(spark, f"{src}/part-*"))
    packed = gzip_files(spark, f"{src}/part-*", dst)
    back = _digests(gunzip_table(packed)).select("path", "chunk", F.col("sha").alias("sha2"))
    size = packed.select(F.regexp_replace("path", r"\.gz$", "").alias("path"), "chunk", F.length("content").alias("packed"))
    both = files.join(back, ["path", "chunk"], "full").join(size, ["path", "chunk"], "full").groupBy("path").agg(
        F.bool_and(F.col("sha").eqNullSafe(F.col("sha2"))).alias("same"), (F.sum("packed") < F.sum("bytes")).alias("smaller"))
    return both.agg(F.count(F.lit(1)).alias("files"), F.bool_and("same").alias("same_bytes"), F.bool_and("smaller").alias("smaller"))


@query("copy_bytes", "SELECT CAST(3 AS BIGINT) AS files, true AS same_bytes FROM (SELECT count(*) FROM documents)")
def q_copy_bytes(spark, sf_dir):
    """K-8: a byte-true copy of files chosen by a glob."""
    src, dst = _text_files(spark, sf_dir, "copy_src"), scratch_path(spark, "copy_dst")
    a = _digests(_chunks(spark, f"{src}/part-*"))
    b = _digests(copy_files(spark, f"{src}/part-*", dst)).select("path", "chunk", F.col("sha").alias("sha2"))
    both = a.join(b, ["path", "chunk"], "full").groupBy("path").agg(F.bool_and(F.col("sha").eqNullSafe(F.col("sha2"))).alias("same"))
    return both.agg(F.count(F.lit(1)).alias("files"), F.bool_and("same").alias("same_bytes"))


@query("concat_in_order", """
SELECT line, row_number() OVER (ORDER BY part, kind, o_orderkey) AS position FROM (
  SELECT 0 AS part, 0 AS kind, 0 AS o_orderkey, 'key,status' AS line
  UNION ALL SELECT CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, 1, o_orderkey, concat_ws(',', o_orderkey, o_orderstatus) FROM orders)""")
def q_concat_in_order(spark, sf_dir):
    """K-6: files in the order given (P, F, O), the first one's header kept, lines as they stood."""
    from rivulet.operators.ordering import with_row_index
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    base = scratch_path(spark, "concat")
    paths = []
    for s in ("P", "F", "O"):
        paths.append(f"{base}/{s}")
        write_csv(o.where(F.col("status") == s).repartitionByRange("key").sortWithinPartitions("key"), paths[-1])
    lines = concat_skip_headers(spark, paths)
    return with_row_index(lines, ["file_no", "block", "line_no"], "position").select("line", "position")


@query("fn_arith_text", """
SELECT event_id, CAST(1.5 + user_id AS DOUBLE) AS a, CAST(user_id - 0.25 AS DOUBLE) AS b, 1e308 * 10.0 * 0 IS NULL AS c, CAST(NULL AS BIGINT) AS d,
       CAST(7 % 4 AS BIGINT) AS m, CAST(-7 % 4 AS BIGINT) AS n FROM events""".replace("1e308 * 10.0 * 0 IS NULL", "false"))
def q_fn_arith_text(spark, sf_dir):
    """F-1/F-2: fractions given as text, a sum beyond bigint (NULL), remainders of the whole parts."""
    ev = table(spark, sf_dir, "events")
    big = F.lit(9223372036854775807)
    return ev.select("event_id", V.add(F.lit("1.5"), "user_id").alias("a"), V.sub("user_id", F.lit("0.25")).alias("b"),
                     V.add(F.lit("x"), "user_id").isNotNull().alias("c"), V.add(big, F.lit(1), "bigint").alias("d"),
                     V.mod(F.lit("7.9"), F.lit("4")).alias("m"), V.mod(F.lit("-7.9"), F.lit(4)).alias("n"))


@query("fn_date_letters", """
SELECT event_id, CAST(isodow(ts) AS VARCHAR) || ' ' || CAST(dayofweek(ts) AS VARCHAR) AS days, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS secs,
       strftime(ts, '%-d') || CASE WHEN day(ts) IN (11, 12, 13) THEN 'th' WHEN day(ts) % 10 = 1 THEN 'st' WHEN day(ts) % 10 = 2 THEN 'nd'
                                   WHEN day(ts) % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
       CAST(day(last_day(ts)) AS VARCHAR) AS month_days, CAST(dayofyear(ts) - 1 AS VARCHAR) AS year_day FROM events""")
def q_fn_date_letters(spark, sf_dir):
    """F-19: the letters N, w, U, j, S, t, z."""
    ev = table(spark, sf_dir, "events")
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    return ev.select("event_id", V.date_text(secs, "N w").alias("days"), V.date_text(secs, "U").alias("secs"),
                     V.date_text(secs, "jS").alias("ordinal"), V.date_text(secs, "t").alias("month_days"), V.date_text(secs, "z").alias("year_day"))


@query("fn_strtotime_text", """
SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS long_text, CAST(epoch(o_orderdate) AS BIGINT) AS short_text,
       CAST(epoch(o_orderdate) AS BIGINT) AS dotted, CAST(epoch(o_orderdate) AS BIGINT) AS plain FROM orders""")
def q_fn_strtotime_text(spark, sf_dir):
    """F-21: dates written out."""
    o = table(spark, sf_dir, "orders")
    as_text = lambda f: F.date_format("o_orderdate", f)
    return o.select("o_orderkey", V.strtotime(as_text("d MMMM yyyy")).alias("long_text"), V.strtotime(as_text("MMM d, yyyy")).alias("short_text"),
                    V.strtotime(as_text("dd.MM.yyyy")).alias("dotted"), V.strtotime(as_text("yyyyMMdd")).alias("plain"))


@query("fn_intval_limits", """
SELECT c_custkey, 9223372036854775807 AS high, -9223372036854775807 - 1 AS low, CAST(c_custkey AS BIGINT) AS plain FROM customer""")
def q_fn_intval_limits(spark, sf_dir):
    """F-23: more digits than a bigint holds give its limits."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", intval(F.concat(F.lit("99999999999999999999"), F.col("c_custkey").cast("string"))).alias("high"),
                    intval(F.concat(F.lit(" -9999999999999999999"), F.col("c_custkey").cast("string"))).alias("low"),
                    intval(F.concat(F.col("c_custkey").cast("string"), F.lit("abc"))).alias("plain"))


@query("fn_values", """
SELECT event_id, event_type AS passed, event_type IS NULL AS is_null, 2 AS n_vars, CAST(user_id AS VARCHAR) AS var,
       user_id IS NOT DISTINCT FROM event_id AS same, true AS now_known,
       CASE WHEN user_id % 2 <> 0 THEN 'odd' ELSE 'even' END AS parity FROM events""")
def q_fn_values(spark, sf_dir):
    """F-5, F-10, F-12, F-14, F-18, F-20: identity, a number as a condition, a struct through fromJSON, a variable by path, time(), NULL fields of an object."""
    ev = table(spark, sf_dir, "events").withColumn("s", F.struct("event_type", F.lit(None).cast("string").alias("none"))) \
        .withColumn("vars", F.struct(F.struct(F.col("user_id").cast("string").alias("id")).alias("user")))
    passed = V.from_json_or_pass("s", "event_type string", ev)
    return ev.select("event_id", passed["event_type"].alias("passed"), F.col("event_type").isNull().alias("is_null"),
                     F.size(V.object_vars("s")).alias("n_vars"), V.get_var("user.id", "vars").alias("var"),
                     V.identical("user_id", "event_id").alias("same"), (V.run_time() > 1_600_000_000).alias("now_known"),
                     V.ternary((F.col("user_id") % 2).cast("string"), F.lit("odd"), F.lit("even"), ev).alias("parity"))


@query("regex_named_odd", """
SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/:]+)', 1) AS the_scheme, regexp_extract(url, '^([a-z]+)://([^/:]+)', 2) AS the_host_1 FROM pages""")
def q_regex_named_odd(spark, sf_dir):
    """P-8: group names with underscores, in two spellings."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return regex_extract(p, "url", "~^(?<the_scheme>[a-z]+)://(?'the_host_1'[^/:]+)~").drop("url")


@query("content_hash_more", """
SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, length(text) > 0 AS some FROM documents""")
def q_content_hash_more(spark, sf_dir):
    """P-11: digests Spark has and ones it lacks; the latter are checked by their length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    for a in ("md5", "sha256", "sha3_256", "adler32", "xxh64"):
        d = content_hash(d, "text", a, alias=a)
    return d.select("doc_id", "md5", "sha256", ((F.length("sha3_256") == 64) & (F.length("adler32") == 8) & (F.length("xxh64") == 16)
                                                & (F.length("text") > 0)).alias("some"))


@query("step_by_name", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def q_step_by_name(spark, sf_dir):
    """U-1, U-3, V-1: a step given as a function, a writer given by name, its settings checked first."""
    config = {"format": "orc", "step": lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))}
    require(config, "format", "step")
    path = scratch_path(spark, "by_name")
    write(apply_step(table(spark, sf_dir, "events"), config["step"]), path, config["format"])
    return spark.read.format("orc").load(path)
