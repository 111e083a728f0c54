"""Registered queries: the expression vocabulary (F-1 … F-23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import vocab as V
from rivulet.functions.coerce import intval
from rivulet.plans.registry import query, table

PRI = """CASE WHEN starts_with(o_orderpriority, '5') THEN 'x' ELSE substr(o_orderpriority, 1, 1) END"""


def _pri(o):
    return o.withColumn("pri", F.when(F.col("o_orderpriority").startswith("5"), F.lit("x"))
                        .otherwise(F.substring("o_orderpriority", 1, 1)))


@query("fn_arith", f"""
SELECT o_orderkey, TRY_CAST(pri AS DOUBLE) + o_custkey AS a_add, TRY_CAST(pri AS DOUBLE) - o_custkey AS a_sub,
       TRY_CAST(pri AS DOUBLE) * o_custkey AS a_mul, CAST(pri AS VARCHAR) AS pri,
       TRY_CAST(o_custkey AS DOUBLE) / nullif(TRY_CAST(pri AS DOUBLE), 0) AS a_div
FROM (SELECT o_orderkey, o_custkey, {PRI} AS pri FROM orders)""")
def q_fn_arith(spark, sf_dir):
    """F-1: + - * / on text and numbers; text that is not a number gives NULL."""
    o = _pri(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    return o.select("o_orderkey", "pri", V.add("pri", "o_custkey").alias("a_add"),
                    V.sub("pri", "o_custkey").alias("a_sub"), V.mul("pri", "o_custkey").alias("a_mul"),
                    V.div("o_custkey", "pri").alias("a_div"))


@query("fn_mod", """
SELECT event_id, user_id % 7 AS m1, (CAST(round(value * 100) AS BIGINT) - 15000) % 7 AS m2 FROM events""")
def q_fn_mod(spark, sf_dir):
    """F-2: integer remainder; the sign follows the dividend."""
    ev = table(spark, sf_dir, "events")
    shifted = F.round(F.col("value") * 100).cast("bigint") - 15000
    return ev.select("event_id", V.mod("user_id", F.lit(7)).alias("m1"), V.mod(shifted, F.lit(7)).alias("m2"))


@query("fn_bits", """
SELECT o_orderkey, o_orderkey & 255 AS b_and, o_orderkey | 1024 AS b_or, xor(o_orderkey, o_custkey) AS b_xor,
       power(CAST(o_custkey AS DOUBLE), 2) AS p2 FROM orders""")
def q_fn_bits(spark, sf_dir):
    """F-3: power and bitwise and / or / xor."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_orderkey").bitwiseAND(255).alias("b_and"),
                    F.col("o_orderkey").bitwiseOR(1024).alias("b_or"),
                    F.col("o_orderkey").bitwiseXOR(F.col("o_custkey")).alias("b_xor"),
                    F.pow(F.col("o_custkey").cast("double"), 2).alias("p2"))


@query("fn_bool", """
SELECT event_id, (event_type = 'click' AND value > 100) AS b_and, (event_type = 'click' OR value > 100) AS b_or,
       NOT (event_type = 'click') AS b_not FROM events""")
def q_fn_bool(spark, sf_dir):
    """F-6: and, or, not."""
    ev = table(spark, sf_dir, "events")
    click, big = F.col("event_type") == "click", F.col("value") > 100
    return ev.select("event_id", (click & big).alias("b_and"), (click | big).alias("b_or"), (~click).alias("b_not"))


@query("fn_concat", """
SELECT event_id, event_type || '~' || CAST(user_id AS VARCHAR) || '~' || CAST(value AS VARCHAR) AS joined
FROM events""")
def q_fn_concat(spark, sf_dir):
    """F-7: ``~`` concatenation of text and numbers."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", V.concat_text("event_type", F.lit("~"), "user_id", F.lit("~"), "value").alias("joined"))


@query("fn_in", """
SELECT event_id, event_type IN ('click', 'view') AS is_browse, event_type NOT IN ('error') AS not_error,
       value BETWEEN 10 AND 20 AS in_range, list_contains(range(1, 6), user_id) AS small_user FROM events""")
def q_fn_in(spark, sf_dir):
    """F-8: in, not in, and the a..b range."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.col("event_type").isin("click", "view").alias("is_browse"),
                     (~F.col("event_type").isin("error")).alias("not_error"),
                     F.col("value").between(10, 20).alias("in_range"),
                     F.array_contains(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint")),
                                      F.col("user_id")).alias("small_user"))


@query("fn_matches", """
SELECT doc_id, regexp_matches(source, 'src1[0-9]') AS m FROM documents""")
def q_fn_matches(spark, sf_dir):
    """F-9: ``matches`` as a regular-expression search."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", V.matches("source", "src1[0-9]").alias("m"))


@query("fn_ternary", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size FROM orders""")
def q_fn_ternary(spark, sf_dir):
    """F-10: ``c ? a : b``."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", V.ternary(F.col("o_totalprice") > 200000, F.lit("big"), F.lit("small")).alias("size"))


@query("fn_path", """
SELECT vec_id, embedding[1] AS first, embedding[-1] AS last, embedding[100000] AS missing FROM embeddings""")
def q_fn_path(spark, sf_dir):
    """F-11: ``a[0]``, negative index, and a missing index (NULL, never an error)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", V.path_get("embedding", 0).alias("first"), V.path_get("embedding", -1).alias("last"),
                    V.path_get("embedding", 99999).alias("missing"))


@query("fn_from_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS missing FROM events""")
def q_fn_from_json(spark, sf_dir):
    """F-12: ``fromJSON`` then field access; an absent field is NULL."""
    ev = table(spark, sf_dir, "events")
    s = V.from_json_or_pass("props", "k bigint, other struct<x: string>")
    return ev.select("event_id", s.getField("k").alias("k"), V.path_get(s, "other", "x").alias("missing"))


@query("fn_isset", """
SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS has_k, false AS has_z FROM events""")
def q_fn_isset(spark, sf_dir):
    """F-13: ``isset``."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", V.isset(F.get_json_object("props", "$.k")).alias("has_k"),
                     V.isset(F.get_json_object("props", "$.z")).alias("has_z"))


@query("fn_count", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings""")
def q_fn_count(spark, sf_dir):
    """F-15: ``count`` of an array."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", V.count_of("embedding").alias("n"))


@query("fn_count_keys", """
SELECT event_id, CAST(json_array_length(json_keys(props)) AS INTEGER) AS n FROM events""")
def q_fn_count_keys(spark, sf_dir):
    """F-15: ``count`` of an object's keys."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", V.count_of(F.from_json("props", "map<string,string>"), "map").alias("n"))


@query("fn_duration", """
SELECT event_id, CASE WHEN s = 0 THEN '0 secs' ELSE concat_ws(' ',
   CASE WHEN s // 3600 > 0 THEN CAST(s // 3600 AS VARCHAR) || CASE WHEN s // 3600 = 1 THEN ' hour' ELSE ' hours' END END,
   CASE WHEN (s % 3600) // 60 > 0 THEN CAST((s % 3600) // 60 AS VARCHAR) || CASE WHEN (s % 3600) // 60 = 1 THEN ' min' ELSE ' mins' END END,
   CASE WHEN s % 60 > 0 THEN CAST(s % 60 AS VARCHAR) || CASE WHEN s % 60 = 1 THEN ' sec' ELSE ' secs' END END) END AS took
FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS s FROM events)""")
def q_fn_duration(spark, sf_dir):
    """F-16: seconds as readable text."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", V.duration_text(F.floor(F.col("value") * 100).cast("bigint")).alias("took"))


@query("fn_round", """
SELECT event_id, round(value, 1) AS r1, round(value) AS r0, round(-value, 1) AS rn FROM events""")
def q_fn_round(spark, sf_dir):
    """F-17: round half away from zero."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", V.round_half_up("value", 1).alias("r1"), V.round_half_up("value").alias("r0"),
                     V.round_half_up(-F.col("value"), 1).alias("rn"))


@query("fn_date", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS d1, strftime(ts, '%a, %d %b %Y') AS d2 FROM events""")
def q_fn_date(spark, sf_dir):
    """F-19: ``date(fmt, ts)`` with PHP format letters over epoch seconds."""
    ev = table(spark, sf_dir, "events")
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    return ev.select("event_id", V.date_text(secs, "Y-m-d H:i").alias("d1"), V.date_text(secs, "D, d M Y").alias("d2"))


@query("fn_object_vars", """
SELECT event_id, event_type AS v_type, CAST(user_id AS VARCHAR) AS v_user, 2 AS n FROM events""")
def q_fn_object_vars(spark, sf_dir):
    """F-20: an object's fields as a map."""
    ev = table(spark, sf_dir, "events")
    m = V.object_vars(F.struct("event_type", "user_id"))
    return ev.select("event_id", m["event_type"].alias("v_type"), m["user_id"].alias("v_user"),
                     F.size(m).alias("n"))


@query("fn_strtotime", """
SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS t, NULL::BIGINT AS rel FROM orders""")
def q_fn_strtotime(spark, sf_dir):
    """F-21: absolute date text to epoch seconds; relative phrases are not supported (NULL)."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", V.strtotime(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("t"),
                    V.strtotime(F.lit("next monday")).alias("rel"))


@query("fn_lower", "SELECT c_custkey, lower(c_name) AS name FROM customer")
def q_fn_lower(spark, sf_dir):
    """F-22: ``strtolower``."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("name"))


@query("fn_intval", """
SELECT page_id, coalesce(TRY_CAST(regexp_extract(trim(regexp_extract(url, '[^/]*$')), '^[+-]?[0-9]+') AS BIGINT), 0)
       AS n FROM pages""")
def q_fn_intval(spark, sf_dir):
    """F-23: leading integer of a text, else 0."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", intval(F.regexp_extract("url", "[^/]*$", 0)).alias("n"))


@query("fn_json_path", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS has_k,
       json_extract(props, '$.k.deeper') IS NOT NULL AS has_deeper, CAST(json_array_length(json_keys(props)) AS INTEGER) AS n
FROM events""")
def q_fn_json_path(spark, sf_dir):
    """F-11/F-13/F-15 over JSON of unknown shape (variant): path value, isset, count."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", V.json_get("props", "$.k", "bigint").alias("k"),
                     V.json_isset("props", "$.k").alias("has_k"), V.json_isset("props", "$.k.deeper").alias("has_deeper"),
                     V.json_count("props").alias("n"))
