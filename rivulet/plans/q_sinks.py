"""Registered queries: writers (K-*) checked by reading back what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.plans.registry import query, table
from rivulet.session import scratch_path
from rivulet.sinks.writers import concat_skip_headers, copy_dataset, debug_json, write, write_csv, write_json
from rivulet.sources.csv import read_csv
from rivulet.sources.json import read_json
from rivulet.plans.q_sources import EVENTS_DDL


@query("write_json", """
SELECT event_id, ts, user_id, event_type, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value, props
FROM events""")
def q_write_json(spark, sf_dir):
    """K-1: JSON lines; a NULL field is left out of its record and reads back as NULL."""
    ev = table(spark, sf_dir, "events").withColumn(
        "value", F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("value")))
    path = scratch_path(spark, "write_json")
    write_json(ev, path)
    return read_json(spark, path, schema=EVENTS_DDL)


@query("write_csv", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
       printf('%.2f', p_retailprice) AS p_retailprice FROM part""")
def q_write_csv(spark, sf_dir):
    """K-2: CSV with header and quoting; read back as strings."""
    p = table(spark, sf_dir, "part")
    out = p.select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", "p_brand", "p_type",
                   F.col("p_size").cast("string").alias("p_size"),
                   F.format_string("%.2f", "p_retailprice").alias("p_retailprice"))
    path = scratch_path(spark, "write_csv")
    write_csv(out, path)
    return read_csv(spark, path)


@query("write_append", """
SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders
WHERE o_orderstatus = 'F'""")
def q_write_append(spark, sf_dir):
    """K-3: a second run in append mode adds its rows next to the first run's files."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    path = scratch_path(spark, "append")
    write(o, path, "parquet")
    write(o.where(F.col("o_orderstatus") == "F"), path, "parquet", mode="append")
    return spark.read.parquet(path)


@query("write_dry_run", "SELECT count(*) AS written_paths FROM orders WHERE false")
def q_write_dry_run(spark, sf_dir):
    """K-4: a dry run executes the plan into the noop sink and leaves no output."""
    from pyspark.errors import AnalysisException
    path = scratch_path(spark, "dry")
    write(table(spark, sf_dir, "orders"), path, "parquet", dry_run=True)
    try:
        n = spark.read.parquet(path).count()
    except AnalysisException:
        n = 0
    return spark.range(1).select(F.lit(n).cast("bigint").alias("written_paths"))


@query("debug_json", """
SELECT CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey,
                'c_mktsegment': c_mktsegment}) AS VARCHAR) AS json FROM customer""")
def q_debug_json(spark, sf_dir):
    """K-5: every record as one JSON text."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return debug_json(c)


LI_DDL = "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"


@query("gzip_roundtrip", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem""")
def q_gzip_roundtrip(spark, sf_dir):
    """K-7: gzip-compressed JSON lines read back unchanged."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                  "l_extendedprice", "l_returnflag")
    path = scratch_path(spark, "gz")
    write_json(li, path, compression="gzip")
    return read_json(spark, path, schema=LI_DDL)


@query("copy_dataset", "SELECT * FROM orders")
def q_copy_dataset(spark, sf_dir):
    """K-8: copy a data set selected by a glob to another location."""
    src = scratch_path(spark, "copy_src")
    dst = scratch_path(spark, "copy_dst")
    table(spark, sf_dir, "orders").write.parquet(src)
    copy_dataset(spark, f"{src}/*.parquet", dst)
    return spark.read.parquet(dst)


@query("concat_skip_headers", """
SELECT 'o_orderkey,o_custkey,o_orderstatus,o_orderpriority' AS line
UNION ALL
SELECT concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority) AS line FROM orders""")
def q_concat_skip_headers(spark, sf_dir):
    """K-6: CSV files with a header each, concatenated with only the first header kept."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    src = scratch_path(spark, "concat_src")
    write_csv(o.repartition(4, "o_orderstatus"), src)
    return concat_skip_headers(spark, src).select("line")
