"""Readers: CSV header modes, JSON extraction and sorting, listings and list constraints."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rivulet.sources.csv import read_csv
from rivulet.sources.files import (
    file_count, file_count_by_dir, list_constraints, list_files, path_permitted, path_scheme, paths_exist,
)
from rivulet.sources.json import extract_array, natural_sort, object_values, read_json
from tests.conftest import rows

CSV = "apple,berry,cucumber\n4,5,6\n7,8,9\n"


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_csv_header_from_file(spark, tmp):
    p = _write(os.path.join(tmp, "a.csv"), CSV)
    df = read_csv(spark, p)
    assert df.columns == ["apple", "berry", "cucumber"]
    assert all(t == "string" for _, t in df.dtypes)
    assert rows(df) == [("4", "5", "6"), ("7", "8", "9")]


def test_csv_given_headers_keep_first_line(spark, tmp):
    p = _write(os.path.join(tmp, "a.csv"), CSV)
    df = read_csv(spark, p, headers="first,second,third")
    assert df.columns == ["first", "second", "third"] and df.count() == 3


def test_csv_overwrite_headers(spark, tmp):
    p = _write(os.path.join(tmp, "a.csv"), CSV)
    df = read_csv(spark, p, headers=["first", "second", "third"], overwrite_headers=True)
    assert rows(df, "first") == [("4",), ("7",)]


def test_csv_missing_file(spark, tmp):
    with pytest.raises(AnalysisException):
        read_csv(spark, os.path.join(tmp, "nope.csv")).collect()


def test_csv_field_count_mismatch(spark, tmp):
    p = _write(os.path.join(tmp, "bad.csv"), "a,b\n1,2\n3\n4,5,6\n7,8\n")
    for ask in (lambda d: d.collect(), lambda d: d.select("a").collect(), lambda d: d.count()):
        with pytest.raises(Exception, match="malformed CSV row"):
            ask(read_csv(spark, p))
    good, bad = read_csv(spark, p, continue_on_error=True)
    assert rows(good) == [("1", "2"), ("7", "8")]
    assert sorted(r["raw"] for r in bad.select("a", "raw").collect()) == ["3", "4,5,6"]


PARTS = {"report": {"shelf": {"parts": [
    {"sku": "k9", "label": {"title": "bolt 10", "tone": "grey"}},
    {"sku": "k3", "label": {"title": "bolt 9", "tone": "red"}},
    {"sku": "k7", "label": {"title": "anvil", "tone": None}},
]}}, "pages": 1}


def test_json_nested_array_and_sort(spark, tmp):
    p = _write(os.path.join(tmp, "u.json"), json.dumps(PARTS))
    parts = extract_array(read_json(spark, p, multi_line=True), "report.shelf.parts")
    assert sorted(r["sku"] for r in parts.collect()) == ["k3", "k7", "k9"]
    asc = natural_sort(parts, F.col("label.title"), tiebreak="sku")
    assert [r["sku"] for r in asc.orderBy("sort_rank").collect()] == ["k7", "k3", "k9"]
    desc = natural_sort(parts, F.col("label.title"), tiebreak="sku", order="desc")
    assert [r["sku"] for r in desc.orderBy("sort_rank").collect()] == ["k9", "k3", "k7"]


def test_json_missing_path_fails(spark, tmp):
    p = _write(os.path.join(tmp, "u.json"), json.dumps(PARTS))
    with pytest.raises(AnalysisException):
        extract_array(read_json(spark, p, multi_line=True), "report.shelf.tools")


def test_json_invalid_fails(spark, tmp):
    p = _write(os.path.join(tmp, "x.json"), "[{\"a\": 1},")
    with pytest.raises(Exception):
        read_json(spark, p, multi_line=True, schema="a bigint").collect()


def test_json_object_values_in_document_order(spark):
    df = spark.createDataFrame([('{"zeta":"one","alpha":"two","mid":"three"}',)], "j string")
    out = object_values(df, "j").orderBy("pos")
    assert [r["value"] for r in out.collect()] == ["one", "two", "three"]


def test_natural_order(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["img12", "img10", "IMG2", "img1", "img002x"])],
                               "i bigint, v string")
    out = natural_sort(df, "v", tiebreak="i").orderBy("sort_rank")
    assert [r["v"] for r in out.collect()] == ["img1", "IMG2", "img002x", "img10", "img12"]


PATHS = ["in/7", "in/12", "in/9.dat", "in/old/9.dat", "in/old/a9.dat", "in/old/a11.dat", "in/in/x.dat", "note"]

CASES = [
    ({"pattern": "*.dat"}, ["in/9.dat", "in/in/x.dat", "in/old/9.dat", "in/old/a11.dat", "in/old/a9.dat"]),
    ({"pattern": "*.dat", "returnvalue": "basename", "sort": "natural"}, ["9.dat", "9.dat", "a9.dat", "a11.dat", "x.dat"]),
    ({"pattern": "in/?*", "returnvalue": "basename", "sort": "natural", "limit": 3}, ["7", "9.dat", "9.dat"]),
    ({"pattern": "in/*", "base": "in", "sort": "alpha_reverse", "limit": 2}, ["x.dat", "old/a9.dat"]),
    ({"pattern": "in/old/a[19]*", "offset": 1, "limit": 5}, ["in/old/a9.dat"]),
    ({"sort": "alpha", "offset": 8, "limit": 3}, []),
    ({"sort": "alpha", "offset": 7, "limit": 0}, ["note"]),
    ({"sort": "natural", "returnvalue": "absolutepath", "limit": 2}, ["in/7", "in/9.dat"]),
]


@pytest.mark.parametrize("how, expected", CASES)
def test_list_constraints(spark, how, expected):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    out = list_constraints(df, "path", **how)
    assert [r["value"] for r in out.orderBy("position").collect()] == expected


def test_list_constraints_limit_has_no_full_sort(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    plan = list_constraints(df, "path", limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("n", [0, 10, 5, 2])
def test_file_listing_and_count(spark, tmp, n):
    d = os.path.join(tmp, f"d{n}")
    os.makedirs(d)
    for i in range(n):
        _write(os.path.join(d, f"f{i}.txt"), "x")
    assert file_count(spark, d) == n
    assert list_files(spark, d, "*.txt").count() == n
    assert list_files(spark, d, "*.csv").count() == 0


def test_file_count_missing_dir(spark, tmp):
    assert file_count(spark, os.path.join(tmp, "missing")) == 0


def test_paths_exist_and_dirs(spark, tmp):
    os.makedirs(os.path.join(tmp, "sub"))
    _write(os.path.join(tmp, "sub", "a.txt"), "x")
    listing = list_files(spark, tmp, recursive=True)
    base = listing.first()["path"].rsplit("/sub/", 1)[0]
    wanted = spark.createDataFrame([(f"{base}/sub/a.txt",), (f"{base}/sub",), (f"{base}/nope",)], "path string")
    got = {r["path"].rsplit("/", 1)[1]: r["exists"] for r in paths_exist(wanted, listing).collect()}
    assert got == {"a.txt": True, "sub": True, "nope": False}
    assert file_count_by_dir(listing).first()["files"] == 1


def test_path_scheme_and_permitted(spark):
    df = spark.createDataFrame([("s3://b/k",), ("/etc/x",), ("rel/x",), ("/data/ok",)], "p string")
    out = df.select(path_scheme("p").alias("s"), path_permitted(F.col("p"), ["/data/"]).alias("ok"))
    assert rows(out) == [("s3", True), ("file", False), ("file", True), ("file", True)]


def test_csv_empty_file_gives_no_records(spark, tmp):
    p = _write(os.path.join(tmp, "empty.csv"), "")
    assert read_csv(spark, p, headers=["a", "b"]).count() == 0


def test_file_count_counts_entries(spark, tmp):
    d = os.path.join(tmp, "entries")
    os.makedirs(os.path.join(d, "sub1"))
    os.makedirs(os.path.join(d, "sub2", "deeper"))
    _write(os.path.join(d, "a.txt"), "x")
    _write(os.path.join(d, "sub1", "b.txt"), "x")
    _write(os.path.join(d, "sub1", "c.txt"), "x")
    _write(os.path.join(d, "sub2", "deeper", "d.txt"), "x")
    assert file_count(spark, d) == 3
