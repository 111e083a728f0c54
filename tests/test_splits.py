"""Files cut into splits at any place, against Python's own csv and json readers."""

import csv
import io
import json
import random

import pytest

from rivulet.sources.splits import CsvState, JsonArrayState, read_csv_in_splits, read_json_array, records_in_splits


@pytest.fixture(params=[40, 10**7])
def split(spark, request):
    """Split sizes from a few bytes on."""
    conf = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def odd_texts(seed, n):
    rnd = random.Random(seed)
    parts = ["plain", 'a "quoted" word', "line\nend", "crlf\r\nend", "", "comma, here", '"', '""', "ü\U0001f600", "x" * 60, "\n\n", "a,\"b\n", "tail\\"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4))) for _ in range(n)]


def write_csv(path, rows, newline="\n", quoting=csv.QUOTE_MINIMAL):
    buf = io.StringIO(newline="")
    csv.writer(buf, lineterminator=newline, quoting=quoting).writerows(rows)
    path.write_text(buf.getvalue(), encoding="utf-8", newline="")


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_csv_equals_python(spark, tmp_path, split, newline):
    want = []
    for f in range(3):
        texts = odd_texts(f, 25)
        rows = [[str(i), t, texts[-i - 1]] for i, t in enumerate(texts)]
        write_csv(tmp_path / f"f{f}.csv", [["id", "a text", "b"], *rows], newline, csv.QUOTE_ALL if f else csv.QUOTE_MINIMAL)
        want += map(tuple, rows)
    df = read_csv_in_splits(spark, str(tmp_path))
    assert df.columns == ["id", "a text", "b"]
    assert sorted(map(tuple, df.collect())) == sorted(want)
    if split < 100:
        raw = spark.read.option("lineSep", "\n").text(str(tmp_path))
        assert raw.rdd.getNumPartitions() > 20


def test_csv_quotes_inside_plain_fields_open_nothing(spark, tmp_path, split):
    (tmp_path / "f.csv").write_text('a,b\n5" pipe,x\n"q",6" pipe\n"two\nlines",y\n\nz,"last\n"')
    got = sorted(map(tuple, read_csv_in_splits(spark, str(tmp_path)).collect()))
    assert got == sorted([('5" pipe', "x"), ("q", '6" pipe'), ("two\nlines", "y"), ("z", "last\n")])


def test_csv_headers_and_bad_rows(spark, tmp_path, split):
    (tmp_path / "f.csv").write_text('n1,n2\n1,"x\ny"\n1,2,3\nNULL,4\n"only\none"\n')
    read = lambda **o: read_csv_in_splits(spark, str(tmp_path), **o)
    good, bad = read(continue_on_error=True, null_value="NULL")
    assert sorted(map(tuple, good.collect()), key=repr) == sorted([("1", "x\ny"), (None, "4")], key=repr)
    assert sorted(r["raw"] for r in bad.collect()) == ['"only\none"', "1,2,3"]
    good, _ = read(headers="p,q", continue_on_error=True)
    assert good.columns == ["p", "q"] and ("n1", "n2") in set(map(tuple, good.collect()))
    good, _ = read(headers="p,q", overwrite_headers=True, continue_on_error=True)
    assert ("n1", "n2") not in set(map(tuple, good.collect())) and good.count() == 2
    with pytest.raises(Exception, match="malformed CSV row"):
        read().collect()


def test_csv_same_names_and_no_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert read_csv_in_splits(spark, str(tmp_path)).count() == 0
    assert [d.count() for d in read_csv_in_splits(spark, str(tmp_path), continue_on_error=True)] == [0, 0]
    (tmp_path / "b.csv").write_text("a,a\n1,2\n")
    assert [tuple(r) for r in read_csv_in_splits(spark, str(tmp_path)).collect()] == [("1", "2")]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_equals_python(spark, tmp_path, split, indent):
    want = []
    for f in range(2):
        items = [{"i": i, "t": t, "deep": {"l": [[1, "],["], {"k": t}]}} for i, t in enumerate(odd_texts(f + 5, 20))]
        (tmp_path / f"f{f}.json").write_text(json.dumps(items, indent=indent, ensure_ascii=bool(f)) + "\n" * f, encoding="utf-8")
        want += items
    got = [json.loads(r["value"]) for r in read_json_array(spark, str(tmp_path)).collect()]
    key = lambda d: json.dumps(d, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))
    typed = read_json_array(spark, str(tmp_path), "i int, t string", with_position=True)
    assert sorted((r["i"], r["t"]) for r in typed.collect()) == sorted((d["i"], d["t"]) for d in want)
    first = typed.where("file LIKE '%f0.json'").orderBy("block", "at").collect()
    assert [r["i"] for r in first] == list(range(20))


@pytest.mark.parametrize("text,want", [("[]", []), (" [ ] \n", []), ("", []), ("[1, 2,3 ]", ["1", "2", "3"]), ('["a,b", "]", [1,[2]]]', ['"a,b"', '"]"', "[1,[2]]"]),
                                       ('[{"a":"\\\\"},{"b":"\\","}]', ['{"a":"\\\\"}', '{"b":"\\","}'])])
def test_json_small_arrays(spark, tmp_path, split, text, want):
    (tmp_path / "f.json").write_text(text)
    got = read_json_array(spark, str(tmp_path), with_position=True).orderBy("block", "at")
    assert [r["value"] for r in got.collect()] == want


def test_json_that_is_no_array(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"a": [1, 2]}')
    with pytest.raises(Exception, match="not a JSON array"):
        read_json_array(spark, str(tmp_path)).collect()
    (tmp_path / "f.json").write_text('[{"a": 1}, {"a": oops}]')
    with pytest.raises(Exception):
        read_json_array(spark, str(tmp_path), "a int").collect()


def test_states():
    c = CsvState()
    assert c.step(b'a,"b', 0, 0) == (1, 0) and c.step(b'c",d', 1, 0) == (0, 0) and c.step(b'x"y,z', 0, 0) == (0, 0)
    assert c.step(b'""', 0, 0) == (0, 0) and c.step(b'""', 1, 0) == (1, 0) and c.step(b'"a""', 0, 0) == (1, 0)
    assert c.step(b'"' + b'""' * 200000, 0, 0) == (1, 0)
    j = JsonArrayState()
    assert j.step(b'[{"a": "[', 0, 0) == (1, 2) and j.step(b'\\"', 1, 2) == (1, 2)


def test_one_row_per_split_is_all_that_is_gathered(spark, tmp_path):
    write_csv(tmp_path / "f.csv", [["a", "b"]] + [[str(i), "line\n" * 3] for i in range(200)])
    df = records_in_splits(spark, str(tmp_path), CsvState())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # fragments are written, whole records stream
    assert df.count() == 201
