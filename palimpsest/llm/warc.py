"""WARC archives with revisit resolution.

The headers of all records, without payloads, are aggregated by payload digest: of equal payloads the
record with the largest id stays a response, the others become revisits of it. Only digests that come up
again are kept; they meet the records where these are read, so that payloads are not shuffled while that
table is within `SENT_BYTES`, and in a shuffled join beyond. Payloads then go to the archives with fresh
headers; a revisit carries headers only. Archives are WARC 1.1, each record a gzip member of its own, written
by Spark's text writer: it puts a record's bytes as they are, and a task that is run again after a lost
executor commits its file once. The writer wants something between records: an empty gzip member.

Reading takes whole files, whose size the writer bounds, unpacks them piece by piece, finds records by their
Content-Length, checks each digest, and joins revisits back to the responses that they refer to.

Defined results
    null payload     is written as the empty payload
    equal payloads   have equal SHA-1 digest, length and XXH64 hash
    small payloads   of fewer than `min_bytes` bytes are responses each
    binary payload   is written byte by byte; a payload of another type as its text in UTF-8
    long payloads    records of more than `file_bytes` / `file_records` bytes go to files of fewer records, so
                     that no file holds more than about `file_bytes`, or one record
    null url         is written as the URI `urn:page:ID`; line ends in a url are percent-encoded
    repeated ids     each row is a record; rows that repeat the response's id and payload are responses too
    null id          is smaller than all; it is written as `urn:page` and read back as null
    ids              are URL-encoded
    date             of every record is `date`, a fixed day unless it is given: pages have no date of their own
    empty table      is one archive without records, or none
    extra columns    are not written
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table

MIN_BYTES = 0
FILE_RECORDS = 500
FILE_BYTES = 64 << 20
#: Bytes of repeated digests, with the records that they refer to, that are sent to tasks at most; beyond that Spark shuffles.
SENT_BYTES = 32 << 20
#: Bytes that are unpacked at a time, and payload bytes of an Arrow batch that is read.
PIECE = 1 << 20
#: The format's names, line ends and revisit profile, and the Base32 alphabet.
VERSION = "WARC/1.1"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32(hexed: Column) -> Column:
    """The Base32 form of a digest of 40 hex digits: 8 groups of 20 bits, four letters each."""
    letters = []
    for g in range(8):
        number = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        for k in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(number, k).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _payload(pages: DataFrame, payload_col: str) -> Column:
    payload = F.col(payload_col) if pages.schema[payload_col].dataType == T.BinaryType() else F.col(payload_col).cast("string").cast("binary")
    return F.coalesce(payload, F.lit(b""))


def _rows(pages: DataFrame, id_col: str, payload_col: str, url_col: str) -> DataFrame:
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), _payload(pages, payload_col).alias("payload"))
    return rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), F.xxhash64("payload").alias("hash"))


def resolved(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = MIN_BYTES, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(id, url, payload, digest, bytes, refers_to, refers_url): refers_to is null for responses.

    Only headers are aggregated, and partially in each task first. What joins the records is a written table
    of digests that come up again: sent to the tasks if it is small, else joined by digest, where Spark splits
    a payload that is very frequent.
    """
    key = ["sha1", "bytes", "hash"]
    rows = _rows(pages, id_col, payload_col, url_col)
    heads = rows.where(F.col("bytes") >= min_bytes).select("id", "url", *key)
    heads = heads.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.struct("id", "url")).alias("first"))
    again = Scratch(pages.sparkSession, "revisits").write(heads.where("n > 1").drop("n"), "again")
    size = again.agg(F.sum(F.lit(128) + F.coalesce(F.octet_length("first.url"), F.lit(0)) + F.coalesce(F.octet_length(F.col("first.id").cast("string")), F.lit(0)))).first()[0]
    rows = rows.join(F.broadcast(again) if (size or 0) <= sent_bytes else again, key, "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    return rows.select(
        "id", "url", "payload", base32(F.col("sha1")).alias("digest"), "bytes", F.when(revisit, F.col("first.id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_url")
    )


def _record_uri(id_: Column) -> Column:
    return F.concat(F.lit("<"), _name(id_), F.lit(">"))


def _name(id_: Column) -> Column:
    return F.coalesce(F.concat(F.lit("urn:page:"), F.url_encode(id_.cast("string"))), F.lit("urn:page"))


def _target(url: Column, id_: Column) -> Column:
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(url, _name(id_))


def _lines(*lines: Column) -> Column:
    """Header lines, without those that are null, and the empty line after them."""
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def record_bytes(date: str = DATE) -> Column:
    """The record of a row of `resolved`, with the two line ends after it."""
    again = F.col("refers_to").isNotNull()
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string")))
    size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("bytes"))
    only = lambda value: F.when(again, value)
    head = _lines(
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _record_uri(F.col("id"))),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), _target(F.col("url"), F.col("id"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        only(F.concat(F.lit("WARC-Refers-To: "), _record_uri(F.col("refers_to")))),
        only(F.concat(F.lit("WARC-Refers-To-Target-URI: "), _target(F.col("refers_url"), F.col("refers_to")))),
        only(F.concat(F.lit("WARC-Refers-To-Date: "), F.lit(date))),
        only(F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    )
    payload = F.when(again, F.lit(b"")).otherwise(F.col("payload"))
    return F.concat(F.concat(head, http).cast("binary"), payload, F.lit((CRLF + CRLF).encode()))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(r.as_buffer(), mtime=0) for r in batch.column(0)], pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, *, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES, date: str = DATE, compression: str = "gzip", **options) -> None:
    """Writes the deduplicated archives of `pages` under `path`: folders by size of the records, files of at most `file_records` records and about `file_bytes` bytes.

    Each record is a gzip member; with compression "none" records are plain.
    """
    records = resolved(pages, **options)
    largest = pages.agg(F.max(F.octet_length(_payload(pages, options.get("payload_col", "html"))))).first()[0] or 0
    bytes_ = F.when(F.col("refers_to").isNull(), F.col("bytes")).otherwise(F.lit(0))
    least, count = -1, file_records
    while least < largest:
        most = largest if count == 1 else file_bytes // count  # bytes of one record in this folder
        part = records.where((bytes_ > least) & (bytes_ <= most)) if least >= 0 or most < largest else records
        part = part.select(record_bytes(date).alias("value"))
        if compression == "none":
            lines = part.select(F.substring("value", F.lit(1), F.octet_length("value") - 4).cast("string"))
            between = {"lineSep": CRLF + CRLF}
        else:
            lines = part.mapInArrow(_members, "value binary").select(F.col("value").cast("string"))
            between = {"lineSep": gzip.compress(b"", mtime=0).decode("latin-1"), "encoding": "ISO-8859-1"}
        lines.write.options(maxRecordsPerFile=count, compression="none", **between).text(f"{path}/records-{count}")
        least, count = max(least, most), max(1, count // 8)


def unpacked(data: bytes) -> Iterator[bytes]:
    """An archive's bytes, a piece at a time: gzip members one after the other, or plain."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member, rest = zlib.decompressobj(31), memoryview(data)
        at = 0
        while not member.eof:
            if not (given := member.unconsumed_tail):
                given = rest[at : at + PIECE]
                at += len(given)
                if not given:
                    raise ValueError("an archive ends within a gzip member")
            if piece := member.decompress(given, PIECE):
                yield piece
        data = rest[at - len(member.unused_data) :]


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive that is given in pieces."""
    held, head, need = bytearray(), None, 0
    for piece in pieces:
        held += piece
        at = 0
        while True:
            if head is None:
                if (to := held.find(b"\r\n\r\n", at)) < 0:
                    break
                first, *lines = held[at:to].decode().split(CRLF)
                if first != VERSION:
                    raise ValueError(f"no record at {first[:40]!r}")
                head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
                at, need = to + 4, int(head["content-length"])
            if len(held) < at + need + 4:
                break
            if held[at + need : at + need + 4] != b"\r\n\r\n":
                raise ValueError(f"record {head['warc-record-id']} does not end at its length")
            yield head, bytes(held[at : at + need])
            at, head = at + need + 4, None
        del held[:at]
    if held or head is not None:
        raise ValueError("an archive ends within a record")


def _page(uri: str | None) -> str | None:
    return unquote_plus(uri[len("<urn:page:") : -1]) if uri and uri != "<urn:page>" else None


def _records(with_payload: bool):
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                for head, block in parse(unpacked(content.as_py())):
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    payload = None
                    if head["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"the payload of {head['warc-record-id']} does not have its digest")
                    size = None if payload is None else len(payload)
                    out.append((_page(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], digest, size, _page(head.get("warc-refers-to")), payload if with_payload else None))
                    held += (size or 0) if with_payload else 0
                    if held >= PIECE:
                        yield batch_of(out)
                        out, held = [], 0
                yield batch_of(out)

    return scan


_NAMES = ["page", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]


def read_records(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """(page, url, record_type, payload_digest, payload_bytes, refers_to, payload) of each record; a revisit has no bytes of its own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_records(with_payload), "page string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary")


def revisits_resolved(records: DataFrame) -> DataFrame:
    """`records` in which a revisit has the payload_bytes of the response that it refers to."""
    found = records.where("record_type = 'response'").groupBy("page", "payload_digest").agg(F.max("payload_bytes").alias("its_bytes")).alias("o")
    here = records.alias("r")
    joined = here.join(found, (F.col("r.refers_to") == F.col("o.page")) & (F.col("r.payload_digest") == F.col("o.payload_digest")), "left")
    return joined.select(*[F.col(f"r.{c}") for c in records.columns if c != "payload_bytes"], F.coalesce("r.payload_bytes", "o.its_bytes").alias("payload_bytes"))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_archives(pages, path)
    records = scratch.write(read_records(spark, path).drop("payload"), "records")
    kind = pages.schema["page_id"].dataType
    return revisits_resolved(records).select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


#: Every record with the response that it revisits, if any. Base32 is spelt out: eight groups of four letters.
OP6_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
    SELECT page_id, h, octet_length(encode(h)) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS m FROM p
), g AS (
    SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(x, 5 * k + 1, 5))::INTEGER) AS groups FROM d
)
SELECT page_id, n AS payload_bytes,
    list_aggregate(list_transform(groups, lambda v: concat(
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1),
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1))), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> m THEN m END AS refers_to
FROM g
"""
