"""Writers: JSON/CSV round trips, dry runs, append, gzip, copy and header-aware concatenation."""

import os

import pytest
from rivulet.sinks.writers import (
    concat_skip_headers, copy_dataset, copy_files, debug_json, gunzip_table, gzip_files, write, write_csv, write_json, write_json_array,
)
from rivulet.sources.csv import read_csv
from rivulet.sources.json import read_json
from tests.conftest import rows


def test_json_round_trip_and_dry_run(spark, tmp):
    df = spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "a bigint, b bigint, c bigint")
    write_json(df, f"{tmp}/out")
    assert sorted(rows(read_json(spark, f"{tmp}/out", schema="a bigint, b bigint, c bigint"))) == [(1, 2, 3), (4, 5, 6)]
    assert write_json(df, f"{tmp}/dry", dry_run=True) is None
    assert not os.path.exists(f"{tmp}/dry")


def test_json_heterogeneous_records(spark, tmp):
    df = spark.createDataFrame([(1, None, None), (None, 2, None), (None, None, 3)], "a bigint, b bigint, c bigint")
    write_json(df, f"{tmp}/h")
    lines = sorted(l.strip() for f in os.listdir(f"{tmp}/h") if f.endswith(".json")
                   for l in open(f"{tmp}/h/{f}") if l.strip())
    assert lines == ['{"a":1}', '{"b":2}', '{"c":3}']


@pytest.mark.parametrize("pretty", [False, True])
def test_json_array(spark, tmp, pretty):
    import json
    df = spark.range(0, 500, 1, 7).selectExpr("id", "concat('n', id) AS name")
    write_json_array(df, f"{tmp}/arr", "id", pretty=pretty)
    parts = sorted(f for f in os.listdir(f"{tmp}/arr") if f.startswith("part-"))
    text = "".join(open(f"{tmp}/arr/{f}").read() for f in parts)
    assert [r["id"] for r in json.loads(text)] == list(range(500)) and len(parts) > 1
    write_json_array(df.where("id < 0"), f"{tmp}/none", "id")
    assert json.loads("".join(open(f"{tmp}/none/{f}").read() for f in os.listdir(f"{tmp}/none") if f.startswith("part-"))) == []


def test_csv_round_trip(spark, tmp):
    df = spark.createDataFrame([("4", "5", "6"), ("7", "8", "9")], "apple string, berry string, cucumber string")
    write_csv(df.coalesce(1), f"{tmp}/c")
    back = read_csv(spark, f"{tmp}/c")
    assert back.columns == ["apple", "berry", "cucumber"] and sorted(rows(back)) == [("4", "5", "6"), ("7", "8", "9")]


def test_append_and_unknown_format(spark, tmp):
    df = spark.range(3)
    write(df, f"{tmp}/p", "parquet")
    write(df, f"{tmp}/p", "parquet", mode="append")
    assert spark.read.parquet(f"{tmp}/p").count() == 6
    with pytest.raises(ValueError):
        write(df, f"{tmp}/x", "xlsx")
    with pytest.raises(ValueError):
        write(df, "", "json")


def test_gzip_round_trip(spark, tmp):
    df = spark.createDataFrame([("line one",), ("line two",)], "value string")
    write(df, f"{tmp}/gz", "text", compression="gzip")
    assert any(f.endswith(".gz") for f in os.listdir(f"{tmp}/gz"))
    assert sorted(rows(spark.read.text(f"{tmp}/gz"))) == [("line one",), ("line two",)]


def test_copy_dataset_glob(spark, tmp):
    spark.range(5).write.parquet(f"{tmp}/src")
    copy_dataset(spark, f"{tmp}/src/*.parquet", f"{tmp}/dst")
    assert spark.read.parquet(f"{tmp}/dst").count() == 5
    assert copy_dataset(spark, f"{tmp}/none/*.parquet", f"{tmp}/dst2") is None


def test_concat_chop_first_line(spark, tmp):
    for name, text in (("z.txt", "head 1"), ("b.txt", "head 2\nbody 2a\nbody 2b"), ("m.txt", "\t")):
        with open(f"{tmp}/{name}", "w") as fh:
            fh.write(text)
    files = [f"{tmp}/z.txt", f"{tmp}/b.txt", f"{tmp}/m.txt"]
    order = ["file_no", "block", "line_no"]
    lines = lambda **how: [r["line"] for r in concat_skip_headers(spark, files, **how).orderBy(*order).collect()]
    assert lines(chop_first_line=False) == ["head 1", "head 2", "body 2a", "body 2b", "\t"]
    assert lines() == ["head 1", "body 2a", "body 2b"]  # the header of the first file given, not the first by name
    assert lines(target_exists=True) == ["body 2a", "body 2b"]


def test_debug_json(spark):
    df = spark.createDataFrame([(1, "x")], "a bigint, b string")
    assert debug_json(df).first()["json"] == '{"a":1,"b":"x"}'


def test_csv_reader_writer_byte_round_trip(spark, tmp):
    text = "apple,berry,cucumber\n4,5,6\n7,8,9\n"
    with open(f"{tmp}/in.csv", "w") as fh:
        fh.write(text)
    write_csv(read_csv(spark, f"{tmp}/in.csv").coalesce(1), f"{tmp}/out")
    parts = [f for f in os.listdir(f"{tmp}/out") if f.endswith(".csv")]
    assert len(parts) == 1 and open(f"{tmp}/out/{parts[0]}").read() == text


def test_gzip_files_keep_every_byte(spark, tmp):
    data = b"one\r\ntwo\nthree\x00\xff"
    with open(f"{tmp}/plain.bin", "wb") as fh:
        fh.write(data)
    packed = gzip_files(spark, f"{tmp}/plain.bin", f"{tmp}/gz")
    back = gunzip_table(packed).first()
    assert packed.first()["path"] == "plain.bin.gz" and back["path"] == "plain.bin" and bytes(back["content"]) == data


def test_large_files_are_copied_and_packed_in_chunks(spark, tmp):
    import gzip
    data = {"a.bin": os.urandom(25_000) + b"\0" * 25_000, "b c.txt": b"\xef\xbb\xbfshort\r\n"}
    os.mkdir(f"{tmp}/src")
    for name, content in data.items():
        with open(f"{tmp}/src/{name}", "wb") as fh:
            fh.write(content)

    def whole(table):
        found = sorted((r["path"], r["chunk"], bytes(r["content"])) for r in table.collect())
        assert max(len(c) for _, _, c in found) <= 4200 and len(found) == 14
        return {n: b"".join(c for p, _, c in found if p == n) for n, _, _ in found}

    assert whole(copy_files(spark, f"{tmp}/src/*", f"{tmp}/copy", chunk_bytes=4000)) == data
    packed = gzip_files(spark, f"{tmp}/src/*", f"{tmp}/gz", chunk_bytes=4000)
    assert {n: gzip.decompress(c) for n, c in whole(packed).items()} == {f"{n}.gz": c for n, c in data.items()}
    assert whole(gunzip_table(packed)) == data


def test_copy_to_folder_keeps_name(spark, tmp):
    spark.range(3).write.parquet(f"{tmp}/data/set1")
    copy_dataset(spark, f"{tmp}/data/set1", f"{tmp}/dest/")
    assert spark.read.parquet(f"{tmp}/dest/set1").count() == 3


def test_concat_many_files(spark, tmp):
    df = spark.range(0, 3000, 1, 12).selectExpr("CAST(id AS STRING) AS a", "CAST(id * 2 AS STRING) AS b")
    write_csv(df, f"{tmp}/many")
    got = [r["line"] for r in concat_skip_headers(spark, f"{tmp}/many", f"{tmp}/one").orderBy("file_no", "block", "line_no").collect()]
    assert got == ["a,b", *(f"{i},{2 * i}" for i in range(3000))]
    parts = sorted(f for f in os.listdir(f"{tmp}/one") if f.startswith("part-"))
    assert "".join(open(f"{tmp}/one/{f}").read() for f in parts).split() == got


def test_the_json_array_query_writes_every_customer(spark, monkeypatch):
    import __spark_entry__ as E
    from rivulet.plans import q_hard
    from tests.conftest import SF_SMALL
    paths = []

    def kept(session, name, make=q_hard.scratch_path):
        paths.append(make(session, name))
        return paths[-1]

    monkeypatch.setattr(q_hard, "scratch_path", kept)
    got = E.queries()["write_json_array"](spark, SF_SMALL)
    keys = [r.c_custkey for r in spark.read.parquet(f"{SF_SMALL}/customer.parquet").select("c_custkey").collect()]
    assert sorted(r.c_custkey for r in got.collect()) == sorted(k for k in keys if k % 2 == 0)
    assert spark.read.text(paths[0]).count() == len(keys)


def test_sorted_files_are_ranges_of_the_key(spark, monkeypatch):
    import glob
    from rivulet.plans import q_hard
    from tests.conftest import SF_SMALL
    paths = []

    def kept(session, name, make=q_hard.scratch_path):
        paths.append(make(session, name).removeprefix("file:"))
        return paths[-1]

    monkeypatch.setattr(q_hard, "scratch_path", kept)
    orders = sorted((tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/orders.parquet")
                     .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = sorted((r.position, r.line) for r in q_hard.q_concat_in_order(spark, SF_SMALL).collect())
        bad = sorted(tuple(r) for r in q_hard.q_csv_error_rownumber(spark, SF_SMALL).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = ["key,status"] + [f"{k},{s}" for x in "PFO" for k, _, s, _ in orders if s == x]
    assert lines == list(enumerate(want, 1))
    seen, numbered = {}, []
    for k, c, s, p in orders:
        seen[p] = seen.get(p, 0) + 1
        if s == "P":
            numbered.append((p, f"{k},{c},x", seen[p]))
    assert bad == sorted(numbered)
    assert len(glob.glob(f"{paths[0]}/O/part-*")) > 1 and len(glob.glob(f"{paths[1]}/part=*/part-*")) > len(seen)
