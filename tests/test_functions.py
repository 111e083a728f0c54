"""Coercion helpers and the expression vocabulary."""

import re

import pytest
from pyspark.sql import functions as F

from rivulet.functions import vocab as V
from rivulet.functions.coerce import glob_to_regex, intval, named_groups, translate_regex, truthy
from rivulet.operators.validate import alias_from_name, require, valid_alias
from tests.conftest import rows


@pytest.mark.parametrize("glob, path, ok", [
    ("*.csv", "output/x.csv", True), ("*.csv", "x.txt", False), ("2019-*.csv", "2019-1.csv", True),
    ("file?.txt", "file1.txt", True), ("[ab].txt", "c.txt", False), ("[!ab].txt", "c.txt", True),
])
def test_glob(glob, path, ok):
    assert bool(re.match(glob_to_regex(glob), path)) == ok


def test_regex_translation():
    assert translate_regex("/abc/i") == "(?i)abc"
    assert translate_regex("#a(?P<x>b)#") == "a(?<x>b)"
    assert named_groups("(a)(?<x>b)(?:c)(?<y>d)") == {"x": 2, "y": 3}
    with pytest.raises(ValueError):
        translate_regex("/a/q")


def test_scalar_vocab(spark):
    df = spark.createDataFrame([(" 42abc", "5", "9", 3725)], "s string, a string, b string, secs bigint")
    out = df.select(intval("s").alias("i"), V.add("a", "b").alias("sum"), V.mod(F.lit(-7), F.lit(3)).alias("m"),
                    V.duration_text("secs").alias("d"), V.round_half_up(F.lit(2.5)).alias("r"),
                    V.round_half_up(F.lit(-2.5)).alias("rn"), V.strtotime(F.lit("2024-01-02 00:00:00")).alias("t"),
                    V.date_text(F.lit(0), "Y-m-d H:i:s").alias("dt"), V.count_of(F.array(F.lit(1), F.lit(2))).alias("c"))
    assert rows(out) == [(42, 14, -1, "1 hour 2 mins 5 secs", 3.0, -3.0, 1704153600, "1970-01-01 00:00:00", 2)]
    assert rows(df.select(intval(F.lit("x")))) == [(0,)]


def test_truthy_types(spark):
    df = spark.createDataFrame([(0, "0", [], True)], "n bigint, s string, a array<int>, b boolean")
    from pyspark.sql import types as T
    out = df.select(truthy("n", T.LongType()), truthy("s"), truthy("a", T.ArrayType(T.IntegerType())),
                    truthy("b", T.BooleanType()))
    assert rows(out) == [(False, False, False, True)]


def test_path_access_is_null_safe(spark):
    df = spark.createDataFrame([({"b": None, "d": {"e": "f"}}, [1, 2])], "a struct<b:string,d:struct<e:string>>, xs array<int>")
    out = df.select(V.path_get("a", "d", "e"), V.path_get("xs", 5), V.isset(F.col("a.b")))
    assert rows(out) == [("f", None, False)]


def test_alias_rules():
    assert alias_from_name("Has Space!") == "has_space_"
    assert valid_alias("kebab-name") and not valid_alias("has.dot")
    with pytest.raises(ValueError):
        require({"a": ""}, "a", "b")


EXAMPLE = '{"a": {"b": null, "c": null, "d": {"e": "f"}}}'


@pytest.mark.parametrize("fn, path, data, expected", [
    ("count", "$.a", '{"a": [3, 2, 1]}', 3),
    ("count", "$.a.b", '{"a": {"b": [1, 2]}}', 2),
    ("isset", "$.a", '{"a": [3, 2, 1]}', True),
    ("isset", "$.a[0]", '{"a": [3, 2, 1]}', True),
    ("isset", "$.a[4].id", '{"a": [3, 2, 1, 2, {"id": 1}]}', True),
    ("isset", "$.a[4].somefield", '{"a": [3, 2, 1, 2, {"id": 1}]}', False),
    ("isset", "$.a.d.e", EXAMPLE, True),
    ("isset", "$.a.e", EXAMPLE, False),
    ("isset", "$.a.d.f", EXAMPLE, False),
    ("isset", "$.a.something", '{"a": [3, 2, 1]}', False),
    ("isset", "$.a.b", EXAMPLE, False),
])
def test_parser_function_table(spark, fn, path, data, expected):
    df = spark.createDataFrame([(data,)], "j string")
    col = V.json_count("j", path) if fn == "count" else V.json_isset("j", path)
    assert df.select(col).first()[0] == expected


def test_from_json_shapes(spark):
    df = spark.createDataFrame([("[3, 2, 1]", EXAMPLE)], "arr string, obj string")
    out = df.select(V.from_json_or_pass("arr", "array<bigint>").alias("a"),
                    V.json_get("obj", "$.a.d.e", "string").alias("e")).first()
    assert out["a"] == [3, 2, 1] and out["e"] == "f"


def test_identical_and_run_time(spark):
    df = spark.createDataFrame([(1, 1), (None, None), (1, None)], "a bigint, b bigint")
    assert [r[0] for r in df.select(V.identical("a", "b")).collect()] == [True, True, False]
    t = df.select(V.run_time().alias("t")).distinct().collect()
    assert len(t) == 1 and t[0]["t"] > 1_600_000_000


def test_scale_conf_for_100tb():
    from rivulet.session import scale_conf
    conf = scale_conf(100 * 2**40, cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_conf(10 << 20, cores=8)["spark.sql.shuffle.partitions"]) == 16


def test_strtotime_tries_a_format_only_on_texts_of_its_shape(spark):
    from rivulet.functions.vocab import DATE_FORMATS, date_shape
    at = ["2024-01-02 03:04:05", "1999-12-31 23:59:59", "2024-05-06 00:00:00", "2023-09-30 12:00:00", "0044-06-15 01:02:03"]
    at += ["-0044-06-15 01:02:03", "+12345-06-15 01:02:03"]
    made = spark.createDataFrame([(t,) for t in at], "t string").select(F.explode(F.array(*[
        F.date_format(F.col("t").cast("timestamp"), f) for f in DATE_FORMATS])).alias("s"))
    texts = {r["s"] for r in made.collect() if r["s"]}
    texts |= {t.upper() for t in texts} | {t.lower() for t in texts} | {f"Mon, {t}" for t in texts} | {f" {t} " for t in texts}
    texts |= {"31 Feb 2024", "001 Jan 2024", "1 Sept 2024", "1  Jan 2024", "-1 Jan 2024", "1 Jan 2024 03:04:05 Europe/Berlin", "1 Jan 2024 03:04:05 z",
              "1 Jan 2024 03:04:05 GMT+2", "20240102t030405", "1.1.2024", "01.01.24", "01-01-2024\n", "", "x", "next monday", "@12", "20241301", "May 5 2024"}
    s = F.regexp_replace(F.trim("s"), r"^[A-Za-z]{3,9},\s*", "")
    every = F.coalesce(F.when(s.rlike(r"^@-?\d+$"), F.timestamp_seconds(F.substring(s, 2, 30).try_cast("bigint"))),
                       F.when(s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd"))), F.when(~s.rlike(r"^\d{8}$"), F.try_to_timestamp(s)),
                       *[F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS])
    got = spark.createDataFrame([(t,) for t in sorted(texts)], "s string").select("s", V.strtotime("s").alias("a"), F.unix_timestamp(every).alias("b")).collect()
    assert [(r["s"], r["a"]) for r in got] == [(r["s"], r["b"]) for r in got] and sum(r["a"] is not None for r in got) > 200
    for text in ("2 January 2024", "Jan 2, 2024", "02.01.2024", "01/02/2024", "2 May 2024 03:04"):
        assert 1 <= sum(re.search(date_shape(f).replace(r"\p{L}", "[^\\W\\d_]"), text) is not None for f in DATE_FORMATS) <= 2
