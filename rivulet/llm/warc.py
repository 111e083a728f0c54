"""WARC archives: writing pages as transactions, reading and assembling them.

A page becomes three records that belong together: the request, the response
(or, for a payload that another record carries, a revisit) and a metadata
record.  Request and metadata name the response in WARC-Concurrent-To.

Writing uses Spark's text writer.  A record ends with two line ends, so they
are the writer's line separator, and the parts of the table are gzip
archives that any WARC reader understands.

Reading takes the archives as binary files and goes from record to record by
Content-Length, never by looking for separators inside a payload.  Assembly
joins the records of a capture to one nested row; a revisit finds its payload
by WARC-Refers-To.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import release, table
from rivulet.session import materialize, scratch_path

REVISIT_BYTES = 1000
END = "\r\n"
RECORD_END = END + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
DATE = "2024-01-01T00:00:00Z"
# payload bytes after which a record list becomes an Arrow batch
BATCH_BYTES = 8 << 20

RECORD = "id string, type string, target string, concurrent_to string, refers_to string, payload_digest string, " \
         "page string, payload binary, payload_bytes long, payload_sha1 string"


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def _record_id(*parts: Column) -> Column:
    """A urn made of the md5 of the parts; a null part counts as a mark of its own."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def _header(kind: Column, rid: Column, target: Column, content: str, length: Column, *more: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), rid, F.lit(">")),
             F.lit(f"WARC-Date: {DATE}"),
             # an address that breaks lines would break the header
             F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(target, r"[\r\n]+", " ")),
             F.lit(f"Content-Type: {content}"), *more, F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(RECORD_END))


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str,
                 revisit_bytes: int = REVISIT_BYTES, every_row: bool = False) -> DataFrame:
    """Every page with its record id and, for a revisit, the record id it refers to.

    Payloads are compared by SHA-256 and length; only these are shuffled to
    find the largest id of each payload.  With ``every_row`` equal rows are
    numbered, so that each has a record id of its own, and a row with the
    largest id is a response, however many there are.
    """
    base = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    base = base.withColumn("_sha1", F.sha1(F.col("_html").cast("binary")))
    base = base.withColumn("_rid", _record_id(F.col("_id"), F.col("_url"), F.col("_sha1")))
    if every_row:
        # only the rows that repeat are written, so that their numbers are the same to every reader
        again = materialize(base.groupBy("_rid").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_rid"), "warc-again")
        many = materialize(base.join(again, "_rid", "left_semi").withColumn("_row", F.monotonically_increasing_id()), "warc-many")
        own = F.when(F.col("_row") == F.col("_lead"), F.col("_rid")).otherwise(_record_id(F.col("_rid"), F.col("_row")))
        many = many.join(many.groupBy("_rid").agg(F.min("_row").alias("_lead")), "_rid") \
            .withColumn("_rid", own).drop("_row", "_lead")
        base = base.join(again, "_rid", "left_anti").unionByName(many)
    # a smaller payload has a key of its own, so that these rows are dealt evenly and match nothing
    large = _bytes(F.col("_html")) >= revisit_bytes
    base = base.withColumn("_key", F.when(large, F.sha2(F.col("_html").cast("binary"), 256)).otherwise(F.col("_rid")))
    # a null id is below every other; only payloads that two records share are listed
    first = base.where(large).groupBy("_key").agg(
        F.max(F.struct("_id", "_url", "_rid")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1") \
        .select("_key", F.col("_first._rid").alias("_to"), F.col("_first._id").alias("_top"))
    itself = F.col("_id").eqNullSafe(F.col("_top")) if every_row else F.col("_to") == F.col("_rid")
    return base.join(first, "_key", "left").withColumn("_to", F.when(~itself, F.col("_to"))).drop("_top")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               revisit_bytes: int = REVISIT_BYTES, every_row: bool = False) -> None:
    """Write three records per page to gzip archives under ``path``."""
    p = plan_records(pages, id_col, url_col, html_col, revisit_bytes, every_row)
    rid, url, to = F.col("_rid"), F.col("_url"), F.col("_to")
    page = F.concat(F.lit("WARC-Page-ID: "), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_sha1"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    _bytes(F.col("_html")).cast("string"), F.lit(RECORD_END))
    response = F.concat(
        _header(F.lit("response"), rid, url, "application/http; msgtype=response", _bytes(http) + _bytes(F.col("_html")), page, digest),
        http, F.col("_html"))
    revisit = F.concat(
        _header(F.lit("revisit"), rid, url, "application/http; msgtype=response", _bytes(http), page, digest,
                F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: <"), to, F.lit(">"))), http)
    with_it = F.concat(F.lit("WARC-Concurrent-To: <"), rid, F.lit(">"))
    get = F.concat(F.lit("GET "), F.regexp_replace(url, r"[\r\n ]+", "%20"), F.lit(f" HTTP/1.1{RECORD_END}"))
    request = F.concat(_header(F.lit("request"), F.concat(rid, F.lit("-q")), url, "application/http; msgtype=request",
                               _bytes(get), with_it), get)
    note = F.concat(F.lit("page: "), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(END))
    metadata = F.concat(_header(F.lit("metadata"), F.concat(rid, F.lit("-m")), url, "application/warc-fields",
                                _bytes(note), with_it), note)
    records = p.select(F.explode(F.array(request, F.when(to.isNull(), response).otherwise(revisit), metadata)).alias("value"))
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


class _Stream:
    """Reads an unzipped archive a piece at a time."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.data, self.at, self.step, self.buffer = memoryview(data), 0, step, bytearray()
        self.zip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.zip and self.zip.eof and self.zip.unused_data:  # the next gzip member
            rest, self.zip = self.zip.unused_data, zlib.decompressobj(31)
            self.buffer += self.zip.decompress(rest)
            return True
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at:self.at + self.step]
        self.at += self.step
        if self.zip and self.zip.eof:
            self.zip = zlib.decompressobj(31)
        self.buffer += self.zip.decompress(piece) if self.zip else piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (found := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                return None
        out = bytes(self.buffer[:found])
        del self.buffer[:found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            raise ValueError(f"the archive ends inside a record: {n} bytes announced, {len(self.buffer)} left")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records_of(data: bytes):
    """(headers by lower-case name, block) of each record of an archive."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")
        yield headers, block


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``; ``payload`` is null if not asked for.

    An archive is read by one task, a piece at a time; the writer makes one per
    task.
    """
    def run(batches):
        import pyarrow as pa
        types = [pa.string()] * 7 + [pa.binary(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in RECORD.split(", ")]

        def batch_of(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def bare(value):
            return value.strip("<>") if value else None

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in records_of(content.as_py()):
                    kind, payload = h["warc-type"], None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                    elif kind in ("request", "metadata"):
                        payload = block
                    rows.append((bare(h["warc-record-id"]), kind, h.get("warc-target-uri", ""), bare(h.get("warc-concurrent-to")),
                                 bare(h.get("warc-refers-to")), h.get("warc-payload-digest"), h.get("warc-page-id"),
                                 payload if with_payload else None, None if payload is None else len(payload),
                                 None if payload is None else hashlib.sha1(payload).hexdigest()))
                    size += len(block) + 500
                    if size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content") \
        .mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``id``, ``capture``, ``request``, ``metadata``, ``original``.

    ``request`` and ``metadata`` are those whose concurrent-to names the capture
    (null if there is none); ``original`` is the response a revisit refers to.
    Of records with one id, one counts, so a capture gives one row.
    """
    body = F.struct("type", "target", "payload_digest", "page", "refers_to", "payload", "payload_bytes", "payload_sha1")
    captures = records.where(F.col("type").isin("response", "revisit")).select("id", body.alias("capture")).dropDuplicates(["id"])

    def part(kind: str) -> DataFrame:
        return records.where(F.col("type") == kind).select(
            F.col("concurrent_to").alias("id"), F.struct(F.col("id").alias("record_id"), "payload").alias(kind)).dropDuplicates(["id"])

    originals = records.where("type = 'response'").select(
        F.col("id").alias("_to"), F.struct("id", "page", "payload_bytes", "payload_sha1").alias("original")).dropDuplicates(["_to"])
    return captures.join(part("request"), "id", "left").join(part("metadata"), "id", "left") \
        .withColumn("_to", F.coalesce("capture.refers_to", F.concat(F.lit("none:"), "id"))) \
        .join(originals, "_to", "left").drop("_to")  # a capture that refers to nothing has a key of its own


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  revisit_bytes: int = REVISIT_BYTES, with_payload: bool = True, every_row: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read the captures back.

    Of equal payloads of at least ``revisit_bytes`` bytes the one with the
    largest id is the response.  A null html is an empty payload, a null
    address an empty one; a null id is below all others and comes back null.
    Rows equal in id, address and html are one capture or, with ``every_row``,
    a capture each; then all rows of the largest id are responses.  Other columns of
    ``pages`` are not read.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, html_col, revisit_bytes, every_row)
    release(spark)
    return assemble(read_warc(spark, path, with_payload))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    c = archive_pages(table(spark, sf_dir, "pages"), with_payload=False, every_row=True)
    page = F.nullif(F.col("capture.page"), F.lit("")).cast("bigint")
    return c.select(
        page.alias("page_id"),
        F.coalesce("capture.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.substring_index("capture.payload_digest", ":", -1).alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.nullif(F.col("original.page"), F.lit("")).cast("bigint").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""
