import glob
import gzip
import hashlib

import pytest

from rivulet.llm import warc as W


def pages(spark, clash=True):
    from pyspark.sql import functions as F
    long, odd = "<p>x</p>" * 200, "ü" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "y" * 600
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (9, "http://a/9", long), (3, None, "short"), (4, "http://a/4", "short"),
            (5, "http://a/5", None), (6, "http://a/6", ""), (7, "http://a b/\r\nX: 1", odd), (8, "http://a/8", odd + "\r\n"),
            (10, "http://a/10", "z" * 3_000_000), (11, "u", "a" * 999), (12, "u", "a" * 999), (13, "u", "b" * 1000), (14, "u", "b" * 1000),
            (None, "n", long), (15, "u", "\r\n\r\n"), (16, "u", "é" * 500), (17, "u", "é" * 500)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    if clash:
        df = df.withColumns({c: F.lit(0) for c in ("_id", "_url", "_html", "_key", "id", "type", "payload", "capture", "value")})
    return rows, df


def expected(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == b and j is not None]
        revisit = len(b) >= 1000 and (i is None and same or i is not None and i < max(same))
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=repr)


def digest_rows(spark, df, sf=None):
    import rivulet.llm.warc as mod
    old = mod.table
    mod.table = lambda *a: df
    try:
        return sorted(map(tuple, mod.op9_warc(spark, "").collect()), key=repr)
    finally:
        mod.table = old


def test_round_trip(spark):
    rows, df = pages(spark)
    assert digest_rows(spark, df) == expected(rows)


def test_payloads_and_transactions(spark, tmp):
    rows, df = pages(spark)
    W.write_warc(df, f"{tmp}/w")
    records = W.read_warc(spark, f"{tmp}/w")
    kinds = {r["type"]: r["count"] for r in records.groupBy("type").count().collect()}
    assert kinds["request"] == kinds["metadata"] == len(rows) and kinds["response"] + kinds["revisit"] == len(rows)
    by_page = {r[0]: (r[2] or "").encode() for r in rows}
    for c in W.assemble(records).collect():
        page = int(c.capture.page) if c.capture.page else None
        assert c.request.record_id.startswith(c.id) and b"GET " in bytes(c.request.payload)
        assert bytes(c.metadata.payload) == f"page: {c.capture.page}\r\n".encode()
        if c.capture.type == "response":
            assert bytes(c.capture.payload) == by_page[page]
        else:
            assert c.original.payload_bytes == len(by_page[page]) and c.original.payload_sha1 == hashlib.sha1(by_page[page]).hexdigest()


def test_the_files_are_warc(spark, tmp):
    _, df = pages(spark)
    W.write_warc(df, f"{tmp}/w")
    n = 0
    for f in glob.glob(f"{tmp}/w/part-*"):
        raw = gzip.open(f).read()
        assert raw.startswith(b"WARC/1.1\r\n")
        n += len(list(W.records_of(raw)))
        members = gzip.compress(raw[:len(raw) // 2]) + gzip.compress(raw[len(raw) // 2:])
        assert len(list(W.records_of(members))) == len(list(W.records_of(raw)))
        with pytest.raises(ValueError):
            list(W.records_of(raw[:-3]))
    assert n == 3 * df.count()


def test_rows_that_repeat(spark):
    df = spark.createDataFrame([(1, "u", "x" * 1200)] * 3 + [(2, "u", "x" * 1200)], "page_id bigint, url string, html string")
    got = W.archive_pages(df).select("capture.page", "capture.type").collect()
    assert sorted(map(tuple, got)) == [("1", "revisit"), ("2", "response")]


def test_every_row_comes_back_as_in_the_sql(spark):
    x, y = "x" * 1200, "y" * 1300
    rows = [(1, "u", x)] * 3 + [(2, "u", x)] * 2 + [(2, "v", x), (3, "u", "short"), (3, "u", "short"), (4, "u", y), (4, "u", y)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    df.createOrReplaceTempView("pages")
    twin = sorted(map(tuple, spark.sql(W.SQL.replace("encode(coalesce(html, ''))", "encode(coalesce(html, ''), 'utf-8')")).collect()), key=repr)
    assert len(twin) == len(rows)
    assert digest_rows(spark, df) == twin


def test_empty_table(spark):
    assert W.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
