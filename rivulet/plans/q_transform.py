"""Registered queries: record transforms (P-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions.coerce import num
from rivulet.operators.transform import (
    alter, capture, content_hash, filter_rows, last_values, regex_extract, render_messages, step_vars,
)
from rivulet.plans.registry import query, table


@query("alter", """
SELECT event_id, 'o' AS event_type, CAST(user_id AS BIGINT) AS user_id, value,
       event_type || ' ' || CAST(user_id AS VARCHAR) AS c,
       CAST(user_id + event_id AS BIGINT) AS d
FROM events""")
def q_alter(spark, sf_dir):
    """P-1: overwrite one field and add two; every expression sees the input record."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    return alter(ev, {
        "event_type": "o",
        "c": "${{ event_type }} ${{ user_id }}",
        "d": "${{ user_id + event_id }}",
    })


@query("template_string", """
SELECT o_orderkey, 'order ' || CAST(o_orderkey AS VARCHAR) || ' of ' || CAST(o_custkey AS VARCHAR)
       || ' is ' || o_orderstatus AS label, o_totalprice * 2 AS doubled, 'fixed' AS kind
FROM orders""")
def q_template_string(spark, sf_dir):
    """P-2: literal, whole-value expression (typed) and mixed template (text)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    out = alter(o, {
        "label": "order ${{ o_orderkey }} of ${{ o_custkey }} is ${{ o_orderstatus }}",
        "doubled": "${{ o_totalprice * 2 }}",
        "kind": "fixed",
    })
    return out.select("o_orderkey", "label", "doubled", "kind")


def _orders_pri(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    # the leading digit of the priority as text, 'x' for the lowest class
    pri = F.when(F.col("o_orderpriority").startswith("5"), F.lit("x")).otherwise(
        F.substring("o_orderpriority", 1, 1))
    return o.withColumn("pri", pri)


PRI_SQL = """(SELECT o_orderkey, o_orderstatus, o_orderpriority,
   CASE WHEN starts_with(o_orderpriority, '5') THEN 'x' ELSE substr(o_orderpriority, 1, 1) END AS pri
 FROM orders)"""


@query("filter_eq_num", f"SELECT * FROM {PRI_SQL} WHERE TRY_CAST(pri AS DOUBLE) = 1")
def q_filter_eq_num(spark, sf_dir):
    """P-4: text field compared as a number; non-numbers ('x') never match."""
    return filter_rows(_orders_pri(spark, sf_dir), num("pri") == 1)


@query("filter_eq_str", f"SELECT * FROM {PRI_SQL} WHERE pri = '2'")
def q_filter_eq_str(spark, sf_dir):
    """P-4: text equality."""
    return filter_rows(_orders_pri(spark, sf_dir), "pri = '2'")


@query("filter_ge_str", f"SELECT * FROM {PRI_SQL} WHERE o_orderpriority >= '3-MEDIUM'")
def q_filter_ge_str(spark, sf_dir):
    """P-4: lexicographic comparison of text."""
    return filter_rows(_orders_pri(spark, sf_dir), "o_orderpriority >= '3-MEDIUM'")


@query("filter_truthy", """
SELECT event_id, k FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
WHERE k IS NOT NULL AND k <> '' AND k <> '0'""")
def q_filter_truthy(spark, sf_dir):
    """P-5: a text condition: '', '0' and NULL are false."""
    ev = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return filter_rows(ev, F.col("k"))


NULLCOND_SQL = """(SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


@query("filter_null_keep", f"SELECT * FROM {NULLCOND_SQL} WHERE coalesce(value / nullif(k, 0) > 5, true)")
def q_filter_null_keep(spark, sf_dir):
    """P-6: a NULL condition lets the row pass (on_null='keep')."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return filter_rows(ev, F.try_divide(F.col("value"), F.nullif(F.col("k"), F.lit(0))) > 5, on_null="keep")


@query("filter_null_drop", f"SELECT * FROM {NULLCOND_SQL} WHERE value / nullif(k, 0) > 5")
def q_filter_null_drop(spark, sf_dir):
    """P-6: SQL semantics: a NULL condition drops the row (on_null='drop')."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return filter_rows(ev, F.try_divide(F.col("value"), F.nullif(F.col("k"), F.lit(0))) > 5, on_null="drop")


@query("regex_first", """
SELECT page_id, url, nullif(regexp_extract(url, '[0-9]+'), '') AS regex FROM pages""")
def q_regex_first(spark, sf_dir):
    """P-7: first match of a pattern (in delimiters) or NULL."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return regex_extract(p, "url", "/[0-9]+/", alias="regex")


@query("regex_named", """
SELECT p_partkey, p_brand,
       CASE WHEN regexp_matches(p_brand, 'brand#([0-9]+)', 'i') THEN regexp_extract(p_brand, 'brand#([0-9]+)', 1, 'i') END AS num
FROM part""")
def q_regex_named(spark, sf_dir):
    """P-8: named group, case-insensitive flag: one column per name."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return regex_extract(p, "p_brand", "/brand#(?P<num>[0-9]+)/i")


@query("regex_named_multi", """
SELECT page_id,
  CASE WHEN regexp_matches(url, '^(https?)://([^/]+)/([a-z]{2})/') THEN regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/', 1) END AS scheme,
  CASE WHEN regexp_matches(url, '^(https?)://([^/]+)/([a-z]{2})/') THEN regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/', 2) END AS host,
  CASE WHEN regexp_matches(url, '^(https?)://([^/]+)/([a-z]{2})/') THEN regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/', 3) END AS lang
FROM pages""")
def q_regex_named_multi(spark, sf_dir):
    """P-8: several named groups at once; NULLs when the pattern does not match."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return regex_extract(p, "url", "#^(?<scheme>https?)://(?<host>[^/]+)/(?<lang>[a-z]{2})/#").drop("url")


@query("content_hash", """
SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents""")
def q_content_hash(spark, sf_dir):
    """P-11: digests of whole document texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = content_hash(d, "text", "md5", "md5")
    d = content_hash(d, "text", "sha1", "sha1")
    return content_hash(d, "text", "sha256", "sha256").drop("text")


@query("render_messages", """
SELECT CASE WHEN c_acctbal >= 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' ELSE '' END AS "to",
       'Segment ' || c_mktsegment AS subject,
       'Dear ' || c_name || ', your balance is ' || printf('%.2f', c_acctbal) AS message
FROM customer WHERE c_acctbal >= 0""")
def q_render_messages(spark, sf_dir):
    """P-10: outbox rows; customers with a negative balance have no address and are held back."""
    c = table(spark, sf_dir, "customer").withColumn(
        "addr", F.when(F.col("c_acctbal") >= 0,
                       F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")))
        .otherwise(F.lit("")))
    c = c.withColumn("bal", F.format_string("%.2f", "c_acctbal"))
    ok, _ = render_messages(c, to=F.col("addr"), subject="Segment ${{ c_mktsegment }}",
                            message="Dear ${{ c_name }}, your balance is ${{ bal }}")
    return ok


@query("render_messages_invalid", """
SELECT '' AS "to", 'Segment ' || c_mktsegment AS subject,
       'Dear ' || c_name || ', your balance is ' || printf('%.2f', c_acctbal) AS message,
       'to' AS missing
FROM customer WHERE c_acctbal < 0""")
def q_render_messages_invalid(spark, sf_dir):
    """P-10: the held-back rows with the list of empty required fields."""
    c = table(spark, sf_dir, "customer").withColumn(
        "addr", F.when(F.col("c_acctbal") >= 0,
                       F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")))
        .otherwise(F.lit("")))
    c = c.withColumn("bal", F.format_string("%.2f", "c_acctbal"))
    _, bad = render_messages(c, to=F.col("addr"), subject="Segment ${{ c_mktsegment }}",
                             message="Dear ${{ c_name }}, your balance is ${{ bal }}")
    return bad.withColumn("missing", F.array_join("missing", ","))


@query("cross_step_ref", """
SELECT event_id, 'seen' AS event_type, round(value * 10, 2) AS value, event_type AS original_type,
       value AS original_value FROM events""")
def q_cross_step_ref(spark, sf_dir):
    """P-12: a later step reads the record as it entered an earlier step."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    ev = capture(ev, "reader")
    ev = alter(ev, {"event_type": "seen", "value": "${{ round(value * 10, 2) }}"})
    ev = alter(ev, {"original_type": "${{ _reader.event_type }}", "original_value": "${{ _reader.value }}"})
    return ev.drop("_reader")


@query("step_vars", """
SELECT event_id, user_id, value, event_type || '#' || CAST(event_id AS VARCHAR) AS label,
       value > 100 AS big FROM events""")
def q_step_vars(spark, sf_dir):
    """P-13: step variables as columns next to the record."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    return step_vars(ev, {"label": "${{ event_type }}#${{ event_id }}", "big": "${{ value > 100 }}"}).drop("event_type")


@query("step_vars_last", """
SELECT arg_max(event_type || '#' || CAST(event_id AS VARCHAR), event_id) AS label,
       arg_max(value, event_id) AS last_value, CAST(count(*) AS BIGINT) AS iterations FROM events""")
def q_step_vars_last(spark, sf_dir):
    """P-13/C-9: after the run a variable holds the last record's value."""
    ev = table(spark, sf_dir, "events")
    return last_values(ev, {"label": "${{ event_type }}#${{ event_id }}", "last_value": "${{ value }}"},
                       "event_id", extra=[F.count(F.lit(1)).alias("iterations")])


@query("noop", "SELECT event_id, user_id, event_type, value FROM events")
def q_noop(spark, sf_dir):
    """P-9: the no-op step passes records through unchanged."""
    from rivulet.operators.transform import noop
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").transform(noop)


@query("render_log", """
SELECT 'warning' AS level, 'order ' || CAST(o_orderkey AS VARCHAR) || ' is urgent' AS message
FROM orders WHERE o_orderpriority = '1-URGENT'""")
def q_render_log(spark, sf_dir):
    """P-10: log lines as rows; records whose message renders empty give none."""
    from rivulet.operators.transform import render_log
    o = table(spark, sf_dir, "orders")
    msg = F.when(F.col("o_orderpriority") == "1-URGENT",
                 F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" is urgent"))).otherwise(F.lit(""))
    return render_log(o, msg, "warning")
