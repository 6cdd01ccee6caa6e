"""WARC files and a derivative builder.

``write_warc`` stores records as WARC/1.1 files, each record a gzip member of its own, so one can be read alone. Members are
made in tasks and written by Spark's text writer, whose line separator is the zero byte that ends each member, so files are
plain concatenations that any gzip reader unpacks. A file holds at most RECORDS_PER_FILE records of one partition. ``read_warc`` reads such files, or any
WARC files, plain, gzip as a whole or gzip by record, unpacking one record at a time; a file's packed bytes are one row, so
files are to be smaller than 2 GB.

``derivatives`` makes two records of each response: a metadata record with what the capture says of itself (status,
headers, title, links, digests) and a conversion record with the plain text. Both carry WARC-Refers-To with the response's
identifier, its target and date, and WARC-Concurrent-To with each other's identifier; the response's own headers are
kept in the metadata's body. Identifiers are name-based, so a repeated run makes the same records.

Defined results: a null page is an empty payload; a null address is left out of the header block; repeated rows make
records with equal identifiers; header names are compared without regard to case and returned as the standard writes them;
a record without a valid Content-Length, cut off, or in a broken member, is left out, and reading goes on at the next one; a
response without an identifier gets one made of its headers and body; an empty table makes no records; other columns of the
pages are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import itertools
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_path, table, uncollected

END = "\r\n"
RECORDS_PER_FILE = 4000
LEVEL = 2  # of compression: files some 3 % larger than at 4

UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
TAG = re.compile(r"<[^>]*>")
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", re.I)


def digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def plain_text(page: str) -> str:
    """Text of a page, a line per block, without empty lines."""
    text = TAG.sub("", BREAK.sub("\n", UNSEEN.sub("\n", page)))
    return "\n".join(filter(None, map(_single_spaced, entities.unescape(text).split("\n"))))


def _single_spaced(line: str) -> str:
    """White space as single spaces, none at the ends. Of white space only the space itself is printable."""
    return line.strip(" ") if line.isprintable() and "  " not in line else " ".join(line.split())


def response_records(pages: DataFrame, date: str, url: str = "url", html: str = "html", ident: str = "page_id") -> DataFrame:
    """Column record: pages as response records, made by column functions. The page's number is a source header."""
    body = F.coalesce(F.col(html), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}X-Source-Id: "), F.coalesce(F.col(ident).cast("string"), F.lit("null")), F.lit(f"{END}Content-Length: "), F.octet_length(body).cast("string"), F.lit(END * 2), body)
    name = F.sha2(F.concat_ws("|", F.col(ident).cast("string"), F.col(url), F.lit(date), F.col(html)), 256)
    guid = F.concat_ws("-", *(F.substring(name, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    sha = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    fields: list[tuple[str, Column]] = [
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), guid, F.lit(">"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.regexp_replace(url, "[\\r\\n]+", " ")),
        ("WARC-Payload-Digest", sha(body)), ("WARC-Block-Digest", sha(F.col("__http"))), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length("__http").cast("string")),
    ]
    head = F.concat(F.lit(f"WARC/1.1{END}"), *(F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), value, F.lit(END))).otherwise("") for key, value in fields))
    return pages.withColumn("__http", http).select(F.concat(head, F.lit(END), "__http").alias("record"))


# Field names of the WARC standard.
FIELDS = (
    "WARC-Type WARC-Record-ID WARC-Date WARC-Target-URI WARC-Payload-Digest WARC-Block-Digest WARC-Refers-To WARC-Refers-To-Target-URI WARC-Refers-To-Date WARC-Concurrent-To WARC-Truncated WARC-Warcinfo-ID WARC-Filename WARC-Profile"
    " WARC-Identified-Payload-Type WARC-Segment-Number WARC-Segment-Origin-ID WARC-Segment-Total-Length WARC-IP-Address Content-Type Content-Length"
).split()
_standard = {name.lower(): name for name in FIELDS}


def _member(data: bytes) -> bytes:
    """A gzip member, or two where the first does not end in a zero byte, without its last byte, which is zero.

    The last byte of a member is the highest of its length modulo 2^32, so it is zero below 16 MB; behind longer records stands
    an empty member.
    """
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    member = packer.compress(data) + packer.flush()
    return member[:-1] if member[-1] == 0 else member + _member(b"")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as gzip members without their last byte."""
    for batch in batches:
        for at in range(0, len(batch), 200):
            made = [_member((value.as_py() + END * 2).encode()) for value in batch.column(0).slice(at, 200)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])


def _write(members: DataFrame, path: str) -> None:
    """Files of concatenated members: the zero byte that ends each of them is the text writer's line separator."""
    members.select(F.col("member").cast("string")).write.options(lineSep="\0", maxRecordsPerFile=RECORDS_PER_FILE).text(path)


def write_warc(records: DataFrame, path: str, record: str = "record") -> None:
    _write(records.select(record).where(F.col(record).isNotNull()).mapInArrow(_packed, "member binary"), path)


def _unpacked(data: bytes, step: int = 1 << 13) -> Iterator[bytes | None]:
    """The bytes of a file in pieces, unpacked if it is made of gzip members; None where some are lost.

    After a member that is broken, cut off or followed by other bytes, reading goes on at the next place that looks like a
    member's start.
    """
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        for i in range(0, len(data), step):
            yield bytes(view[i : i + step])
        return
    while 0 <= at < len(data):
        start, member = at, zlib.decompressobj(31)
        try:
            while not member.eof and at < len(data):
                piece = view[at : at + step]
                at += len(piece)
                yield member.decompress(piece)
            at -= len(member.unused_data)
            broken = not member.eof
        except zlib.error:
            broken = True
        if broken:
            yield None
            at = data.find(b"\x1f\x8b\x08", start + 1)


class _Gap(Exception):
    """Bytes are missing here."""


def parse_warc(pieces: Iterable[bytes | None]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each whole record. Only the record at hand is held; where bytes are missing it is given up."""
    source, held = iter(pieces), bytearray()

    def grown() -> bool:
        piece = next((p for p in source if p != b""), b"")
        if piece is None:
            raise _Gap
        held.extend(piece)
        return bool(piece)

    while True:
        try:
            found = _next_record(held, grown)
        except _Gap:
            held.clear()
            continue
        if found is None:
            return
        if found:
            yield found


def _next_record(held: bytearray, grown: Callable[[], bool]) -> tuple[dict[str, str], bytes] | tuple[()] | None:
    """The next record, taken off what is held; empty if it has no length, None at the end."""
    while len(held) < 5 and grown():
        pass
    while not held.startswith(b"WARC/"):  # only at the start of a line
        if (start := held.find(b"\nWARC/")) >= 0:
            del held[: start + 1]
            continue
        del held[: max(0, len(held) - 5)]
        if not grown():
            return None
    seen = 0
    while (stop := held.find(b"\r\n\r\n", seen)) < 0:
        seen = max(0, len(held) - 3)
        if not grown():
            return None
    headers: dict[str, str] = {}
    for line in held[:stop].decode("utf-8", "replace").split(END)[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers.setdefault(_standard.get(name.strip().lower(), name.strip()), value.strip())
    size = headers.get("Content-Length", "")
    if not (size.isascii() and size.isdigit()):
        del held[: stop + 4]
        return ()
    end = stop + 4 + int(size)
    while len(held) < end and grown():
        pass
    if len(held) < end:
        return None
    body = bytes(held[stop + 4 : end])
    del held[:end]
    return headers, body


_KINDS = [pa.map_(pa.string(), pa.string()), pa.binary()]


def _batch(some: list[tuple[dict, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([list(h.items()) for h, _ in some], _KINDS[0]), pa.array([b for _, b in some], _KINDS[1])], names=["headers", "body"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files to headers and bodies, a few megabytes at a time."""
    for batch in batches:
        for content in batch.column(0):
            some: list[tuple[dict, bytes]] = []
            held = 0
            for found in parse_warc(_unpacked(content.as_py())):
                some.append(found)
                held += len(found[1])
                if len(some) == 500 or held > 4 << 20:
                    yield _batch(some)
                    some, held = [], 0
            if some:
                yield _batch(some)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """headers (map) and body (binary) of each record. A file is one task's work; write_warc bounds its records."""
    return _files(spark, path).mapInArrow(_parsed, "headers map<string,string>, body binary")


def _record(kind: str, ident: str, headers: dict[str, str], source: str, other: str, mime: str, body: bytes) -> str:
    fields = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": headers.get("WARC-Date"), "WARC-Target-URI": headers.get("WARC-Target-URI"), "WARC-Refers-To": source}
    fields |= {"WARC-Concurrent-To": other, "WARC-Block-Digest": digest(body), "Content-Type": mime, "Content-Length": str(len(body))}
    return f"WARC/1.1{END}" + "".join(f"{k}: {v}{END}" for k, v in fields.items() if v is not None) + END + body.decode()


def derive(headers: dict[str, str], body: bytes) -> tuple[str, str]:
    """The metadata record and the conversion record of a response."""
    head, _, payload = body.partition(b"\r\n\r\n")
    page = payload.decode("utf-8", "replace")
    source = headers.get("WARC-Record-ID") or record_id("response", *(f"{k}: {v}" for k, v in headers.items()), digest(body))
    ids = {kind: record_id(kind, source) for kind in ("metadata", "conversion")}
    title = TITLE.search(page)
    status, *http = head.decode("utf-8", "replace").split(END)
    facts = [("status", status), *(("http-" + k.lower(), v) for k, v in ((k, v.strip()) for k, _, v in (x.partition(":") for x in http) if v)), *(("source-" + k.lower(), v) for k, v in headers.items())]
    facts += [("payload-sha1", digest(payload)), ("title", " ".join(entities.unescape(title[1]).split()) if title else "")]
    facts += [("outlink", entities.unescape(link)) for link in LINK.findall(UNSEEN.sub("", page))]
    fields = "".join(f"{k}: {v}{END}" for k, v in facts).encode()
    return (
        _record("metadata", ids["metadata"], headers, source, ids["conversion"], "application/warc-fields", fields),
        _record("conversion", ids["conversion"], headers, source, ids["metadata"], "text/plain; charset=utf-8", plain_text(page).encode()),
    )


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        responses = ((dict(headers), body) for headers, body in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True))
        made = [record for headers, body in responses if headers.get("WARC-Type") == "response" for record in derive(headers, body)]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["record"])


def derivatives(responses: DataFrame) -> DataFrame:
    """Column record: two records of each response of read_warc()."""
    return responses.select("headers", "body").mapInArrow(_derived, "record string")


def derive_files(spark: SparkSession, source: str, path: str) -> None:
    """WARC files of derivatives of the files at source: read, derived and packed record by record by one worker a task."""
    _write(_files(spark, source).mapInArrow(_rederived, "member binary"), path)


def _rederived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files to the members of their responses' derivatives."""
    for content in (value for batch in batches for value in batch.column(0)):
        found = (record for headers, body in parse_warc(_unpacked(content.as_py())) if headers.get("WARC-Type") == "response" for record in derive(headers, body))
        while True:
            with uncollected():
                made = [_member((record + END * 2).encode()) for record in itertools.islice(found, 200)]
            if not made:
                break
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per response: its number and address, the linked records' identifiers, and digests of the files' bodies."""
    source, out = new_path(spark, "warc"), new_path(spark, "warc-derived")
    write_warc(response_records(table(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z"), source)
    derive_files(spark, source, out)
    h, body = F.col("headers"), F.col("body").cast("string")
    is_meta = h["WARC-Type"] == "metadata"
    pick = lambda kind, c: F.max(F.when(h["WARC-Type"] == kind, c))
    fact = lambda name: F.regexp_extract(body, rf"(?m)^{name}: ([^\r\n]*)", 1)
    rows = read_warc(spark, out).groupBy(h["WARC-Refers-To"].alias("refers_to")).agg(
        pick("metadata", fact("http-x-source-id")).alias("__id"),
        F.max(h["WARC-Target-URI"]).alias("url"),
        pick("metadata", h["WARC-Record-ID"]).alias("metadata_id"),
        pick("conversion", h["WARC-Record-ID"]).alias("conversion_id"),
        F.bool_and(F.when(is_meta, fact("source-warc-record-id") == h["WARC-Refers-To"]).otherwise(True)).alias("linked"),
        pick("metadata", fact("source-warc-payload-digest")).alias("payload_digest"),
        F.count_if(is_meta).alias("n_metadata"),
        F.sum(F.when(is_meta, F.regexp_count(body, F.lit("(?m)^outlink: ")))).cast("long").alias("n_links"),
        pick("conversion", F.sha2(F.col("body"), 256)).alias("text_sha256"),
        pick("conversion", F.octet_length("body").cast("long")).alias("text_bytes"),
    )
    return rows.select(F.expr("try_cast(__id AS bigint)").alias("page_id"), "url", "refers_to", "metadata_id", "conversion_id", "linked", "payload_digest", "n_metadata", "n_links", "text_sha256", "text_bytes")
