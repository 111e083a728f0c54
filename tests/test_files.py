"""Files written from chunks, copied and packed: bytes on disk, retried tasks, failures."""

import gzip
import hashlib
import os
import random

import pytest

from rivulet.sinks.files import (FilesWritten, _FilesWriter, copy_files_bytes, file_digests, gunzip_files_bytes, gzip_files_bytes,
                                 read_chunks, write_files)


def bytes_of(folder):
    return {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder) if not f.startswith((".", "_"))}


@pytest.fixture()
def source(tmp_path):
    rnd = random.Random(1)
    d = tmp_path / "source"
    d.mkdir()
    for name, n in (("empty", 0), ("one", 1), ("exact", 4096), ("a b.bin", 100_003), ("zeros.bin", 20_000)):
        (d / name).write_bytes(b"\0" * n if "zeros" in name else rnd.randbytes(n))
    return str(d)


def test_copy_and_digests(spark, source, tmp_path):
    target = copy_files_bytes(spark, source, str(tmp_path / "copy"), 1024)
    assert bytes_of(target) == bytes_of(source)
    assert sorted(os.listdir(target))[0] == "_SUCCESS" and "_temporary" not in os.listdir(target)
    want = {(len(b), hashlib.sha256(b).hexdigest()) for b in bytes_of(source).values()}
    assert {(r["bytes"], r["sha256"]) for r in file_digests(spark, target).collect()} >= want
    assert read_chunks(spark, f"{source}/a*", 1000).count() == 101


def test_gzip_both_ways(spark, source, tmp_path):
    packed = gzip_files_bytes(spark, source, str(tmp_path / "packed"), 7000)
    assert {n: gzip.decompress(b) for n, b in bytes_of(packed).items()} == {f"{n}.gz": b for n, b in bytes_of(source).items()}
    assert len(bytes_of(packed)["zeros.bin.gz"]) < 300
    back = gunzip_files_bytes(spark, packed, str(tmp_path / "back"), 512)
    assert bytes_of(back) == bytes_of(source)


def test_a_cut_gzip_file_raises(spark, tmp_path):
    (tmp_path / "x.gz").write_bytes(gzip.compress(os.urandom(5000))[:-100])
    with pytest.raises(Exception, match="ends inside"):
        gunzip_files_bytes(spark, str(tmp_path / "x.gz"), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "_SUCCESS").exists()


def test_chunks_in_any_order_and_folders(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i % 7}.txt", i, f"{i},".encode()) for i in range(500)] + [("nothing", 0, None)]
    target = write_files(spark.createDataFrame(rows, "path string, chunk bigint, content binary").repartition(9), str(tmp_path / "t"))
    for p in {r[0] for r in rows[:-1]}:
        assert open(f"{target}/{p}", "rb").read() == b"".join(c for q, _, c in rows if q == p)
    assert open(f"{target}/nothing", "rb").read() == b""


@pytest.mark.parametrize("name", ["/abs", "../up", "a/../../b", "", None])
def test_names_outside_the_target_raise(spark, tmp_path, name):
    df = spark.createDataFrame([(name, 0, b"x")], "path string, chunk bigint, content binary")
    with pytest.raises(Exception):
        write_files(df, str(tmp_path / "t" / "u"))
    assert not (tmp_path / "t" / "u" / "_SUCCESS").exists() and not (tmp_path / "b").exists()


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"path": ["f", "f", "g"], "chunk": [0, 1, 0], "content": [b"ab", b"cd", b"e"]})
    writer = _FilesWriter(str(tmp_path / "t"))

    def dies():
        yield batch
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(dies())
    assert writer.write(iter([batch])) == FilesWritten(2, 5) == writer.write(iter([batch]))
    writer.commit([])
    assert sorted(os.listdir(tmp_path / "t")) == ["_SUCCESS", "f", "g"] and bytes_of(tmp_path / "t") == {"f": b"abcd", "g": b"e"}


def test_sources_of_one_name_raise(spark, tmp_path):
    for d in "ab":
        (tmp_path / d).mkdir()
        (tmp_path / d / "same").write_bytes(d.encode())
    with pytest.raises(ValueError, match="one name"):
        copy_files_bytes(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "t"))


def test_entries_of_a_tree(spark, tmp_path):
    from rivulet.sources.entries import entry_count, entry_counts, list_entries, list_glob
    for d in ("a/b/c/d/e", "empty", "a/none"):
        (tmp_path / d).mkdir(parents=True)
    for f in ("top.txt", "a/x.csv", "a/b/c/d/e/deep.csv", "a/b/zero"):
        (tmp_path / f).write_bytes(b"" if "zero" in f else b"12345")
    base = f"file:{tmp_path}"
    got = {(r["path"].removeprefix(base), r["is_dir"], r["length"]) for r in list_entries(spark, str(tmp_path)).collect()}
    want = {(f"/{p.relative_to(tmp_path)}", p.is_dir(), None if p.is_dir() else p.stat().st_size) for p in tmp_path.rglob("*")}
    assert got == want
    assert entry_count(spark, base) == 3 and entry_count(spark, str(tmp_path / "empty")) == 0 == entry_count(spark, str(tmp_path / "absent"))
    counts = {r["directory"].removeprefix(base): (r["files"], r["folders"]) for r in entry_counts(list_entries(spark, base)).collect()}
    assert counts[""] == (1, 2) and counts["/empty"] == (0, 0) and counts["/a/b"] == (1, 1) and counts["/a"] == (1, 2)
    names = lambda s: sorted(r["path"].removeprefix(base) for r in list_glob(spark, s).collect())
    assert names(f"{base}/*.txt") == ["/top.txt"] and names(f"{tmp_path}/a") == ["/a/b/c/d/e/deep.csv", "/a/b/zero", "/a/x.csv"]
    assert names(f"{tmp_path}/*/x.*") == ["/a/x.csv"] and names(str(tmp_path / "top.txt")) == ["/top.txt"] and names(f"{tmp_path}/no*") == []
