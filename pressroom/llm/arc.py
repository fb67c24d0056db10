"""Legacy ARC archives read and converted to WARC.

An ARC file begins with a version block whose body names the version and the
fields of the URL-record lines that follow. Version 1 lines have five fields
(URL, IP, date, content type, length), version 2 lines ten (… result code,
checksum, location, offset, filename, length). The declared length alone says
where a record ends; nothing in a payload can be mistaken for a header.

The converter synthesises what WARC asks for and ARC lacks: a record id (a
name-based UUID of URL, date and place), an ISO timestamp, the record type, and
payload digests; the converter keeps the HTTP header of the ARC record in the block.

A block that is no HTTP response becomes a ``resource`` of its own content type. A record that breaks the
format costs nothing but itself: the reader goes on at the next line that can begin a record, and says what
it left out (``index_arc``, column ``error``).

Archives are rolled by bytes and written a gzip member per record, with the version block (ARC) or a
``warcinfo`` record (WARC) in front. Spark's text writer puts them into the checkpoint folder and the
binaryFile source reads them, so neither executors nor the driver touch a local path; readers decompress
as they go and hold one record.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import Scratch

ARCHIVE_BYTES = 64 << 20  # of records in a file, before compression; a larger record has a file of its own
CHUNK = 1 << 16
REVISIT_BYTES = 1000
EMIT_BYTES = 2 << 20

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """An archive breaks its format."""


class Stream:
    """Bytes of one file, plain or of any number of gzip members, decompressed as they are asked for."""

    def __init__(self, blob: bytes) -> None:
        self._blob, self._fed, self._unzip = memoryview(blob), 0, None
        self._zipped = bytes(blob[:2]) == b"\x1f\x8b"
        self._held, self._from = bytearray(), 0
        self.at = 0  # decompressed bytes read so far

    def _more(self) -> bool:
        """Append the next bytes of the file; False at its end."""
        if self._from > CHUNK:
            del self._held[:self._from]
            self._from = 0
        if self._fed >= len(self._blob):
            if self._unzip is not None and not self._unzip.eof:
                self._unzip = None
                raise ArchiveError("the last gzip member is cut off")
            return False
        part = self._blob[self._fed:self._fed + CHUNK]
        self._fed += len(part)
        if not self._zipped:
            self._held += part
            return True
        if self._unzip is None or self._unzip.eof:
            self._unzip = zlib.decompressobj(31)
        try:
            self._held += self._unzip.decompress(part)
        except zlib.error as broken:
            self._fed, self._unzip = len(self._blob), None
            raise ArchiveError(f"broken gzip member: {broken}") from None
        self._fed -= len(self._unzip.unused_data)
        return True

    def take(self, size: int) -> bytes:
        """The next ``size`` bytes, fewer at the end of the file."""
        while len(self._held) - self._from < size and self._more():
            pass
        out = bytes(self._held[self._from:self._from + size])
        self._from += len(out)
        self.at += len(out)
        return out

    def line(self, most: int = 1 << 20) -> bytes:
        """The next line with its end; only ``most`` bytes of a longer one."""
        seen = 0
        while True:
            end = self._held.find(b"\n", self._from + seen, self._from + most)
            if end >= 0:
                return self.take(end + 1 - self._from)
            seen = min(len(self._held) - self._from, most)
            if seen == most or not self._more():
                return self.take(seen)


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _archives(lead: Callable[[bytes], bytes], limit: int):
    """Rows of one record become rows of one archive without its last byte, which is zero.

    ``lead`` gives the record that opens an archive, from the first one in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def archive():
            # A member ends with its length; the highest byte of that is zero below 16 MB, else an empty member follows.
            whole = b"".join(held if held[-1].endswith(b"\0") else [*held, _member(b"")])
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], names=["value"])

        for batch in batches:
            for value in batch.column("value"):
                record = value.as_py()
                if held and size + len(record) > limit:
                    yield archive()
                    held, size = [], 0
                if not held:
                    held.append(_member(lead(record)))
                held.append(_member(record))
                size += len(record)
        if held:
            yield archive()

    return run


def _write(records: DataFrame, path: str, lead: Callable[[bytes], bytes], limit: int) -> None:
    """Write binary ``value`` rows, a record each, as archives of up to ``limit`` bytes; no row is shuffled."""
    files = records.mapInArrow(_archives(lead, limit), "value binary")
    files.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def pages_to_arc(pages: DataFrame, path: str, version: int, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write (page_id, url, html) as ARC records of one version, payload in UTF-8; null html is empty.

    White space in a URL is percent-encoded, a null URL becomes ``-``. The URL as it was and the page id travel
    in HTTP header fields of their own.
    """
    body = F.coalesce("html", F.lit(""))
    size = F.octet_length(body).cast("string")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("-")),
        F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"),
    )
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("-"))
    url = F.when(url == "", F.lit("-")).otherwise(url)
    date = F.date_format(F.timestamp_seconds(F.lit(1_262_304_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000))), "yyyyMMddHHmmss")
    length = (F.octet_length(http) + F.octet_length(body)).cast("string")
    fields = [url, F.lit("0.0.0.0"), date, F.lit("text/html")]
    if version == 2:
        fields += [F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("pages.arc")]
    record = F.concat(F.concat_ws(" ", *fields, length), F.lit("\n"), http, body, F.lit("\n"))
    head = f"{version} 0 pressroom\n{ARC_FIELDS[version]}\n"
    block = f"filedesc://pages.arc 0.0.0.0 20100101000000 text/plain {'200 - - 0 pages.arc ' if version == 2 else ''}{len(head)}\n{head}\n".encode()
    _write(pages.select(record.cast("binary").alias("value")), path, lambda first: block, archive_bytes)


RECORD_LINE = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*:\S.* \d{12}(\d\d)? \S.* \d+\r?\n")


def arc_records(data: bytes | Stream, bad: Callable[[int, int, str], None] | None = None) -> Iterator[tuple[int, str, str, str, str, bytes, int]]:
    """(version, url, ip, date, content type, block, offset) of each record of one ARC file.

    A line has as many fields as the version block names, counted from the right: a URL may hold blanks. A record that
    breaks the format raises ArchiveError, or is told to ``bad`` (offset, bytes left out, reason) where that is given.
    Where its line gives no length, reading goes on at the next line that has the form of a record's.
    """
    stream = data if isinstance(data, Stream) else Stream(data)
    version, names, held = 0, [], None

    def wrong(start: int, reason: str) -> None:
        if bad is None:
            raise ArchiveError(f"record at byte {start}: {reason}")
        bad(start, stream.at - start, reason)

    while True:
        start = stream.at
        try:
            raw = stream.line() if held is None else held
            if held is not None:
                start, held = start - len(raw), None
            if not raw:
                return
            if raw in (b"\n", b"\r\n"):
                continue
            fields = raw.rstrip(b"\r\n").decode("utf-8", "surrogateescape").split(" ")
            if not raw.endswith(b"\n") or not re.fullmatch(r"[0-9]{1,18}", fields[-1]):
                while (more := stream.line()) and not RECORD_LINE.fullmatch(more) and not more.startswith(b"filedesc://"):
                    pass
                # what was read last is the next record's
                stream.at -= len(more)
                wrong(start, f"no length in the line {raw[:80]!r}")
                stream.at += len(more)
                held = more or None
                continue
            size = int(fields[-1])
            block = stream.take(size)
            if len(block) < size:
                wrong(start, f"{size} bytes declared, {len(block)} are there")
                return
            if raw.startswith(b"filedesc://"):
                first, _, rest = block.decode("utf-8", "replace").partition("\n")
                told = first.split(" ")[0]
                version = int(told) if told in ("1", "2") else 0
                names = rest.split("\n")[0].rstrip("\r").split(" ")
                if not version or set(names) - set(ARC_FIELDS[2].split(" ")) or not set(ARC_FIELDS[1].split(" ")) <= set(names):
                    version = 0
                    wrong(start, f"version block {first[:80]!r}")
                continue
            if not version:
                wrong(start, "no version block before it")
                continue
            parts = raw.rstrip(b"\r\n").decode("utf-8", "surrogateescape").rsplit(" ", len(names) - 1)
            if len(parts) != len(names):
                wrong(start, f"version {version} lines have {len(names)} fields: {raw[:80]!r}")
                continue
            row = dict(zip(names, parts))
            if not DATE.fullmatch(row["Archive-date"]):
                wrong(start, f"date {row['Archive-date']!r}")
                continue
        except ArchiveError as broken:
            if bad is None:
                raise
            bad(start, stream.at - start, str(broken))
            return
        yield version, row["URL"], row["IP-address"], row["Archive-date"], row["Content-type"], block, start


DATE = re.compile(r"[0-9]{12}([0-9]{2})?")


def iso_date(date: str) -> str:
    """14 (or 12) digits of an ARC date as the timestamp WARC wants."""
    if not DATE.fullmatch(date):
        raise ArchiveError(f"date {date!r}")
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(url: str, date: str, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {place}')}>"


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about EMIT_BYTES; ``weight`` is the column that holds the bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"") + 200
        if size > EMIT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


ARC_ROW = pa.schema([("arc_version", pa.int32()), ("record_id", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()),
                     ("content_type", pa.string()), ("http", pa.binary()), ("payload", pa.binary())])


ARC_INDEX = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()),
                       ("file", pa.string()), ("offset", pa.int64()), ("error", pa.string())])
PAGE_ID = re.compile(rb"(?m)^X-Page-Id: (-?\d+)\r?$")


def _page_id(http: bytes) -> int | None:
    found = PAGE_ID.search(http)
    return int(found[1]) if found else None


def _http_end(block: bytes) -> int:
    """Where the payload of an HTTP response begins (old servers end lines by LF alone); 0 for any other block."""
    blank = re.search(rb"\r?\n\r?\n", block) if block[:5] == b"HTTP/" else None
    return blank.end() if blank else 0


def _clean(text: str) -> str:
    """A URL as a header field can hold it: blanks and control characters escaped, bytes that are no UTF-8 too."""
    whole = text.encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace")
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", whole)


def _index_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same walk without payloads: their lengths and digests, and a row for each record left out."""

    def rows():
        for batch in batches:
            for path, blob in zip(batch.column("path"), batch.column("content")):
                place, left_out = path.as_py().rsplit("/", 1)[-1], []
                for _, url, _, date, _, block, offset in arc_records(Stream(blob.as_py()), lambda *of: left_out.append(of)):
                    cut = _http_end(block)
                    payload = block[cut:]
                    yield (record_id(url, date, f"{place}:{offset}"), _page_id(block[:cut]), _clean(url), iso_date(date), len(payload), hashlib.sha1(payload).hexdigest(),
                           place, offset, None)
                for offset, size, reason in left_out:
                    yield None, None, None, None, size, None, place, offset, reason

    yield from _batches(rows(), ARC_INDEX, 2)


def _walk_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for path, blob in zip(batch.column("path"), batch.column("content")):
                place = path.as_py().rsplit("/", 1)[-1]
                for version, url, ip, date, kind, block, offset in arc_records(Stream(blob.as_py()), lambda *of: None):
                    cut = _http_end(block)
                    yield version, record_id(url, date, f"{place}:{offset}"), _clean(url), _clean(ip), iso_date(date), _clean(kind), block[:cut], block[cut:]

    yield from _batches(rows(), ARC_ROW, 7)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def index_arc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, url, date, payload_bytes, digest, file, offset, error) of all records below ``path``; no payload leaves its task.

    A row with an ``error`` is a stretch of ``payload_bytes`` bytes from ``offset`` that holds no readable record; its other columns are null.
    """
    return _files(spark, path).mapInArrow(_index_arc, "record_id string, page_id long, url string, date string, payload_bytes long, digest string, file string, offset long, error string")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Readable records of all ARC files below ``path``: version, synthesised id and timestamp, HTTP header (empty if there is none), payload."""
    files = _files(spark, path)
    return files.mapInArrow(_walk_arc, "arc_version int, record_id string, url string, ip string, date string, content_type string, http binary, payload binary")


def warcinfo(when: str) -> Callable[[bytes], bytes]:
    """The record that opens an archive; its id follows from the first record in it."""
    body = b"software: pressroom\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC\r\n"

    def lead(first: bytes) -> bytes:
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {hashlib.sha1(first).hexdigest()}")
        return (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {when}\r\n"
                f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    return lead


def arc_to_warc(source: str, path: str, scratch: Scratch, archive_bytes: int = ARCHIVE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write the ARC archives below ``source`` as WARC 1.1; return the rows of ``index_arc`` that say what could not be read (file, offset, bytes, error).

    An HTTP response becomes a response, any other block a resource; a payload of ``revisit_bytes`` or more that a later page has too
    becomes a revisit. Payloads meet by SHA-1 and length in a narrow aggregate (largest page id and its record id per
    digest, combined before the shuffle); the payloads themselves are not shuffled.
    """
    narrow = scratch.cut(index_arc(scratch.spark, source), "arc-index")
    rows = read_arc(scratch.spark, source).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    large = narrow.where(F.col("payload_bytes") >= revisit_bytes)
    best = large.groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "record_id", "url", "date")).alias("of"), F.count("*").alias("n"))
    revisits = scratch.cut(
        large.join(best.where("n > 1"), ["digest", "payload_bytes"]).where("record_id != of.record_id").select("record_id", "of"), "revisits")
    # Few records revisit another; a short list is broadcast, a long one shuffles the records by id.
    short = revisits.limit(100_001).count() <= 100_000
    rows = rows.join(F.broadcast(revisits) if short else revisits, "record_id", "left")
    twin = F.col("of").isNotNull()
    response = F.octet_length("http") > 0
    block = F.when(twin, F.col("http")).otherwise(F.concat("http", "payload"))
    name = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), name("WARC-Type", F.when(twin, "revisit").when(response, "response").otherwise("resource")), name("WARC-Record-ID", F.col("record_id")),
        name("WARC-Target-URI", F.col("url")), name("WARC-Date", F.col("date")), name("WARC-IP-Address", F.col("ip")),
        name("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), name("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(twin, F.concat(
            name("WARC-Profile", F.lit(REVISIT_PROFILE)), name("WARC-Refers-To", F.col("of.record_id")), name("WARC-Refers-To-Target-URI", F.col("of.url")),
            name("WARC-Refers-To-Date", F.col("of.date")), name("X-Refers-To-Page-Id", F.coalesce(F.col("of.page_id").cast("string"), F.lit("-"))),
        )).otherwise(F.lit("")),
        name("Content-Type", F.when(response, "application/http; msgtype=response").otherwise(F.col("content_type"))), name("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    when = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    _write(rows.select(F.concat(head.cast("binary"), block, F.lit(b"\r\n\r\n")).alias("value")), path, warcinfo(when), archive_bytes)
    return narrow.where("error is not null").select("file", "offset", F.col("payload_bytes").alias("bytes"), "error")


def warc_records(data: bytes | Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of one WARC file."""
    stream = data if isinstance(data, Stream) else Stream(data)
    while first := stream.line():
        at = stream.at - len(first)
        if not first.startswith(b"WARC/1."):
            raise ArchiveError(f"no WARC header at byte {at}")
        fields = {}
        while (line := stream.line()) != b"\r\n":
            if not line.endswith(b"\n"):
                raise ArchiveError(f"the header at byte {at} does not end")
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.take(size)
        if len(block) < size or stream.take(4) != b"\r\n\r\n":
            raise ArchiveError(f"record at byte {at} declares {size} bytes")
        yield fields, block


def _converted(blob: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields, HTTP header and payload of the records that stand for ARC records."""
    for fields, block in warc_records(Stream(blob)):
        if fields["warc-type"] != "warcinfo":
            cut = _http_end(block) if fields["content-type"].startswith("application/http") else 0
            yield fields, block[:cut], block[cut:]


WARC_ROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()),
                      ("payload_bytes", pa.int64()), ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("http", pa.binary()), ("payload", pa.binary())])


WARC_INDEX = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("page_id", pa.int64())])


def _index_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header fields of all records; a payload must have the length and digest that its header says."""

    def rows():
        for batch in batches:
            for blob in batch.column("content"):
                for f, http, payload in _converted(blob.as_py()):
                    digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-length"])
                    if f["warc-type"] != "revisit" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ArchiveError(f"payload differs from its digest: {f['warc-record-id']}")
                    page = f.get("x-refers-to-page-id", "-")
                    yield (f["warc-record-id"], f["warc-type"], f["warc-target-uri"], f["warc-date"], digest, size, f.get("warc-refers-to"),
                           None if page == "-" else int(page), _page_id(http))

    yield from _batches(rows(), WARC_INDEX, 2)


def index_warc(spark: SparkSession, path: str) -> DataFrame:
    """Header fields of all records below ``path``, payloads checked in the task that reads them."""
    return _files(spark, path).select("content").mapInArrow(
        _index_warc, "record_id string, record_type string, url string, date string, payload_digest string, payload_bytes long, "
                     "refers_to_record string, refers_to long, page_id long")


def _walk_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for blob in batch.column("content"):
                for f, http, payload in _converted(blob.as_py()):
                    page = f.get("x-refers-to-page-id", "-")
                    yield (f["warc-record-id"], f["warc-type"], f["warc-target-uri"], f["warc-date"], f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-length"]),
                           f.get("warc-refers-to"), None if page == "-" else int(page), http, None if f["warc-type"] == "revisit" else payload)

    yield from _batches(rows(), WARC_ROW, 9)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files below ``path``. The payload of a revisit is null: its response holds it."""
    return _files(spark, path).select("content").mapInArrow(_walk_warc, "record_id string, record_type string, url string, date string, payload_digest string, payload_bytes long, "
                                        "refers_to_record string, refers_to long, http binary, payload binary")


def convert_pages(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) as ARC, convert to WARC, and read that back.

    Even page ids are written as version 1, odd and null ones as version 2. One row per row of ``pages``, with
    what was read: payload length and SHA-1 are computed again for responses and must agree with the header.
    A null page id stays null and ranks last; rows that repeat a page id are records of their own, of which one
    is the response.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    pages = pages.select("page_id", "url", "html")
    new = scratch.path("warc")
    first = F.coalesce(F.pmod("page_id", F.lit(2)), F.lit(1)) == 0
    with Scratch(spark, "arc") as work:  # the ARC files are gone once the WARC files are written
        old = work.path("pages")
        pages_to_arc(pages.where(first), f"{old}/v1", 1)
        pages_to_arc(pages.where(~first), f"{old}/v2", 2)
        arc_to_warc(old, new, work)
    return index_warc(spark, new).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "refers_to_record")
