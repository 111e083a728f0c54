"""Record transforms on small inline rows."""

import pytest
from pyspark.sql import functions as F

from rivulet.functions import vocab as V
from rivulet.operators.transform import (
    alter, capture, content_hash, filter_rows, last_values, regex_extract, render_messages,
)
from tests.conftest import rows

PAIRS = [("12", "3"), ("2.5", "4"), ("zero", "7"), ("-6", "6")]


def test_alter_reads_input_record(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string").withColumn("_i", F.monotonically_increasing_id())
    out = alter(df, {"a": "new", "c": "${{ b }}/${{ a }}", "d": V.add("a", "b")}).orderBy("_i")
    assert out.columns == ["a", "b", "_i", "c", "d"]
    assert rows(out, "a", "b", "c", "d") == [
        ("new", "3", "3/12", 15.0), ("new", "4", "4/2.5", 6.5), ("new", "7", "7/zero", None), ("new", "6", "6/-6", 0.0)]


def test_template_whole_value_keeps_type(spark):
    df = spark.createDataFrame([(2, 3)], "x bigint, y bigint")
    out = alter(df, {"s": "${{ x * y }}", "t": "v=${{ x * y }}", "u": "lit"})
    assert dict(out.dtypes)["s"] == "bigint"
    assert rows(out, "s", "t", "u") == [(6, "v=6", "lit")]


def test_unresolved_expression_is_null(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert rows(alter(df, {"z": "${{ x }}-${{ y }}"}), "z") == [(None,)]


@pytest.mark.parametrize("cond, expected", [
    (lambda: V.num("a") < 3, [("2.5", "4"), ("-6", "6")]),
    ("b = '7'", [("zero", "7")]),
    ("a >= '2'", [("2.5", "4"), ("zero", "7")]),
])
def test_filter_rows(spark, cond, expected):
    df = spark.createDataFrame(PAIRS, "a string, b string").withColumn("_i", F.monotonically_increasing_id())
    cond = cond() if callable(cond) else cond
    assert rows(filter_rows(df, cond).orderBy("_i"), "a", "b") == expected


def test_filter_keep_plus_drop_is_input(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string")
    kept = filter_rows(df, V.num("a") > 0).count()
    dropped = filter_rows(df, ~(V.num("a") > 0)).count()
    nulls = df.where(V.num("a").isNull()).count()
    assert (kept, dropped, nulls) == (2, 1, 1)


def test_filter_truthiness(spark):
    df = spark.createDataFrame([("0",), ("",), ("x",), (None,), ("00",)], "a string")
    assert sorted(r[0] for r in filter_rows(df, F.col("a")).collect()) == ["00", "x"]


def test_filter_null_modes(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "a bigint")
    assert filter_rows(df, F.col("a") > 2, on_null="drop").count() == 1
    assert filter_rows(df, F.col("a") > 2, on_null="keep").count() == 2


def test_regex_first_match_or_null(spark):
    df = spark.createDataFrame([("hello world",), ("hello earth",), ("",)], "test string")
    assert rows(regex_extract(df, "test", "/world/"), "regex") == [("world",), (None,), (None,)]
    df2 = spark.createDataFrame([("1,2,3,4,5,6,7,8,9",)], "test string")
    assert rows(regex_extract(df2, "test", r"/4\,5\,6/"), "regex") == [("4,5,6",)]


def test_regex_named_groups(spark):
    df = spark.createDataFrame([("Brand#17",), ("nothing",)], "b string")
    out = regex_extract(df, "b", "/brand#(?P<num>\\d+)/i")
    assert "regex" not in out.columns
    assert rows(out, "num") == [("17",), (None,)]


def test_regex_rejects_pcre_only(spark):
    df = spark.createDataFrame([("x",)], "b string")
    with pytest.raises(ValueError):
        regex_extract(df, "b", r"/a\Kb/")


def test_content_hash_hello_world(spark):
    df = spark.createDataFrame([("Hello World",)], "content string")
    expected = {
        "md5": "b10a8db164e0754105b7a99be72e3fe5",
        "sha1": "0a4d55a8d778e5022fab701977c5d840bbc486d0",
        "sha256": "a591a6d40bf420404a011733cfb7b190d62c65bf0bcda32b57b277d9ad9f146e",
        "crc32": "4a17b156",
    }
    for algo, digest in expected.items():
        assert content_hash(df, "content", algo).first()["hash"] == digest
    with pytest.raises(ValueError):
        content_hash(df, "content", "nope")


def test_capture_keeps_entry_record(spark):
    df = spark.createDataFrame([(1, "a")], "k bigint, v string")
    out = alter(capture(df, "reader"), {"v": "changed"})
    out = alter(out, {"old": "${{ _reader.v }}"}).drop("_reader")
    assert rows(out) == [(1, "changed", "a")]


def test_last_values_is_last_record(spark):
    df = spark.createDataFrame([(1, 4), (2, 7), (3, 8)], "i bigint, apple bigint")
    assert last_values(df, {"last": F.col("apple")}, "i").first()["last"] == 8


def test_render_messages_validation(spark):
    df = spark.createDataFrame([("a@x", "s", "m"), ("", "s", "m")], "t string, s string, m string")
    ok, bad = render_messages(df, F.col("t"), F.col("s"), F.col("m"))
    assert ok.count() == 1
    assert rows(bad, "missing") == [(["to"],)]
