"""WARC response records and the metadata and plain-text conversion records derived from them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkledger.llm.common import BATCH_BYTES, BATCH_ROWS, bounded_batches
from linkledger.llm.markup import read_page
from linkledger.sources.ranges import open_store

CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:linkledger:warc")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
CHUNK_SIZE = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n")
#: A body of more bytes than this after decoding is not converted; its metadata record says so.
DECODED_BYTES = 1 << 28
#: What ``read_warc`` says of a record.
MATCH, MISMATCH, UNCHECKED, TRUNCATED, DAMAGED = "match", "mismatch", "unchecked", "truncated", "damaged"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(*parts: str) -> str:
    """The same id for the same parts, on every run."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def one_line(value: str) -> str:
    """A header value without line breaks."""
    return " ".join(value.split())


def plain_text(markup: str) -> str:
    """Readable text of a page; see :func:`read_page`."""
    return read_page(markup).text


def header_value(header: str, name: str) -> str | None:
    for line in header.splitlines():
        key, colon, value = line.partition(":")
        if colon and key.strip().lower() == name.lower():
            return value.strip()
    return None


def unchunked(body: bytes) -> tuple[bytes, str | None]:
    """A chunked body's content, and what is wrong with it; a body that begins with no chunk size is taken as it is."""
    parts, at = [], 0
    while size := CHUNK_SIZE.match(body, at):
        at, length = size.end(), int(size[1], 16)
        if not length:
            return b"".join(parts), None
        parts.append(body[at:at + length])
        if at + length > len(body):
            return b"".join(parts), "chunk without end"
        at += length + (2 if body[at + length:at + length + 2] == b"\r\n" else body[at + length:at + length + 1] == b"\n")
    return (b"".join(parts), "chunk size missing") if parts else (body, "not chunked")


def inflated(body: bytes, coding: str, limit: int) -> tuple[bytes, str | None]:
    """A ``gzip`` or ``deflate`` body's content, as far as it can be read, and what is wrong with it.

    A body that does not begin like its coding is taken as it is: crawlers often store bodies decoded and keep the header.
    """
    if coding == "gzip":
        if body[:2] != b"\x1f\x8b":
            return body, "not gzip"
        wbits = 31
    else:
        wrapped = len(body) > 1 and body[0] & 15 == 8 and (body[0] << 8 | body[1]) % 31 == 0
        wbits = 15 if wrapped else -15
    parts: list[bytes] = []
    held, problem = 0, None
    while body:
        inflater = zlib.decompressobj(wbits)
        try:
            while body and not inflater.eof:
                parts.append(inflater.decompress(body, 1 << 20))
                held += len(parts[-1])
                if held > limit:
                    return b"", f"over {limit} bytes decoded"
                body = inflater.unconsumed_tail
            parts.append(inflater.flush())
        except zlib.error:
            if coding == "deflate" and not held:
                return b"".join([*parts, body]), "not deflate"
            problem = f"damaged {coding} data"
            break
        if not inflater.eof:
            problem = f"{coding} data without end"
            break
        body = inflater.unused_data
        if wbits != 31 or body[:2] != b"\x1f\x8b":
            break
    return b"".join(parts), problem


def body_of(payload: bytes, header: str, limit: int = DECODED_BYTES) -> tuple[bytes, list[str]]:
    """The payload without transfer and content codings, last applied first, and what hindered that.

    Of a coding that is not known (only ``chunked``, ``gzip``, ``deflate`` and ``identity`` are) nothing can be read: the body is empty.
    """
    problems = []
    codings = [c.strip().lower() for name in ("Content-Encoding", "Transfer-Encoding") for c in (header_value(header, name) or "").split(",")]
    for coding in reversed([c for c in codings if c and c != "identity"] if payload else []):
        coding = coding.removeprefix("x-")
        if coding == "chunked":
            payload, problem = unchunked(payload)
        elif coding in ("gzip", "deflate"):
            payload, problem = inflated(payload, coding, limit)
        else:
            payload, problem = b"", f"unknown coding {coding}"
        if problem:
            problems.append(problem)
    return (payload, problems) if len(payload) <= limit else (b"", [*problems, f"over {limit} bytes decoded"])


def decoded(body: bytes, header: str) -> str:
    """A body by the charset of its content type; UTF-8 if there is none or it is unknown or no text encoding."""
    found = CHARSET.search(header_value(header, "Content-Type") or "")
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def warc_header(fields: list[tuple[str, str | None]]) -> str:
    return CRLF.join(["WARC/1.1", *[f"{name}: {one_line(value)}" for name, value in fields if value is not None]]) + RECORD_END


RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, source_header string, source_digest string, block_digest string, content_length long, header string, block binary"


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source_id, record_id, target_uri, date, http_header, payload): one response per page, with a stable record id.

    A null page has an empty payload, a null url is empty. Pages that repeat id, url and payload have one record id.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.length(payload).cast("string"))
    h = F.sha2(F.concat_ws("\u0000", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")), F.sha2(payload, 256)), 256)
    # The layout of a UUID whose bits are chosen freely (version 8).
    uid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return pages.select(F.col(id_col).alias("source_id"), F.concat(F.lit("<urn:uuid:"), uid, F.lit(">")).alias("record_id"),
                        F.coalesce(F.col(url_col), F.lit("")).alias("target_uri"), F.lit(date).alias("date"), head.alias("http_header"), payload.alias("payload"))


def derive(record_id: str, target_uri: str, date: str, http_header: str, payload: bytes) -> list[dict[str, object]]:
    """The metadata and the conversion record of one response.

    The conversion is the text of the decoded body; the digest is that of the payload as it was stored.
    """
    body, problems = body_of(payload, http_header)
    page = read_page(decoded(body, http_header))
    text = page.text.encode("utf-8", "replace")
    source_digest = digest(payload)
    metadata_id, conversion_id = record_uuid("metadata", record_id), record_uuid("conversion", record_id)
    status = http_header.split(CRLF, 1)[0].split(" ")[1:2]
    facts = [
        ("source-record-id", record_id), ("conversion-record-id", conversion_id), ("source-payload-digest", source_digest), ("source-payload-length", str(len(payload))),
        ("source-http-status", status[0] if status else None), *[("source-http-header", line) for line in http_header.split(CRLF)[1:] if line.strip()],
        *[("decoding-problem", p) for p in problems], ("title", page.title), ("outlink-count", str(len(page.links))), ("text-length", str(len(text))),
    ]
    about = CRLF.join(f"{name}: {one_line(value)}" for name, value in facts if value is not None).encode("utf-8", "replace") + CRLF.encode()
    out = []
    for kind, own, other, content_type, block in (("metadata", metadata_id, conversion_id, "application/warc-fields", about), ("conversion", conversion_id, metadata_id, "text/plain; charset=utf-8", text)):
        header = warc_header([
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", target_uri), ("WARC-Refers-To", record_id), ("WARC-Refers-To-Target-URI", target_uri),
            ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", other), ("WARC-Source-Payload-Digest", source_digest), ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))])
        out.append({"record_type": kind, "record_id": own, "refers_to": record_id, "target_uri": target_uri, "date": date, "source_header": http_header, "source_digest": source_digest,
                    "block_digest": digest(block), "content_length": len(block), "header": header, "block": block})
    return out


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per response: a ``metadata`` and a ``conversion`` record that refer to it and to each other.

    Every record keeps the response's id, address, date, HTTP header and payload digest; ``header`` and ``block`` are its
    WARC form. Each response is converted where it is read, whole. Null fields count as empty; a response without payload
    has an empty conversion. Repeated responses give repeated records.
    """
    bounded_batches(responses.sparkSession)
    kind = responses.schema["source_id"].dataType.simpleString()
    fields = [f.strip().split(" ")[0] for f in RECORD.split(",")]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for source_id, *response in zip(batch.column("source_id"), *(batch.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "http_header", "payload"))):
                records = derive(*[x or "" for x in response[:4]], response[4] or b"")
                rows += records
                ids += [source_id] * len(records)
            columns = [pa.array([r[f] for r in rows], pa.binary() if f == "block" else pa.int64() if f == "content_length" else pa.string()) for f in fields]
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], batch.schema.field("source_id").type), *columns], names=["source_id", *fields])

    given = responses.select("source_id", "record_id", "target_uri", F.col("date").cast("string").alias("date"), "http_header", F.col("payload").cast("binary").alias("payload"))
    return given.mapInArrow(convert, f"source_id {kind}, {RECORD}")


def write_warc(records: DataFrame, path: str) -> None:
    """Files of records, one per task. Derived records are UTF-8, so Spark's text writer makes them, with the record end as its line end."""
    text = F.concat(F.col("header"), F.decode("block", "UTF-8"))
    records.select(text.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


class RecordReader:
    """(header, block, state) of every record of a stream, read one after another: memory holds one record.

    The state compares the block with its ``WARC-Block-Digest`` (SHA-1 in base 32 or base 16, else ``unchecked``). A last
    record with missing bytes is ``truncated``. From where no record begins, or compressed data is broken, nothing more can
    be read; that place is one ``damaged`` record whose header holds the bytes found there.
    """

    HEAD_STEP, HEAD_LIMIT = 1 << 13, 1 << 20

    def __init__(self, stream: BinaryIO):
        self.stream, self.held = stream, b""

    def _head(self) -> tuple[bytes, bool] | None:
        """The bytes before the next empty line, without line ends before, and whether they can be a header; None at the end of the stream."""
        seen = 0
        while True:
            if not seen:
                self.held = self.held.lstrip(b"\r\n")
            end = self.held.find(b"\r\n\r\n", max(0, seen - 3))
            if end >= 0:
                head, self.held = self.held[:end], self.held[end + 4:]
                return head, head.startswith(b"WARC/")
            seen = len(self.held)
            more = b"" if seen > self.HEAD_LIMIT or seen >= 5 and not self.held.startswith(b"WARC/") else self.stream.read(self.HEAD_STEP)
            if not more:
                return (self.held, False) if self.held else None
            self.held += more

    def __iter__(self) -> Iterator[tuple[str, bytes, str]]:
        try:
            while (found := self._head()) is not None:
                header = found[0].decode("utf-8", "replace")
                length = (header_value(header, "Content-Length") or "").strip()
                if not found[1] or not re.fullmatch("[0-9]{1,18}", length):
                    yield header[:self.HEAD_STEP], b"", DAMAGED
                    return
                missing = int(length) - len(self.held)
                block = self.held + self.stream.read(missing) if missing > 0 else self.held[:int(length)]
                self.held = b"" if missing > 0 else self.held[int(length):]
                yield header + RECORD_END, block, TRUNCATED if len(block) < int(length) else digest_state(header, block)
        except (EOFError, zlib.error, gzip.BadGzipFile):
            yield "", b"", DAMAGED


def digest_state(header: str, block: bytes) -> str:
    name, _, value = (header_value(header, "WARC-Block-Digest") or "").partition(":")
    value = value.strip().upper()
    if name.strip().lower() not in ("sha1", "sha-1") or len(value) not in (32, 40):
        return UNCHECKED
    own = hashlib.sha1(block)
    return MATCH if value == (own.hexdigest().upper() if len(value) == 40 else base64.b32encode(own.digest()).decode()) else MISMATCH


def parse_warc(stream: BinaryIO) -> Iterator[tuple[str, bytes, str]]:
    """The records of a stream, plain or of gzip members."""
    buffered = io.BufferedReader(stream) if isinstance(stream, io.RawIOBase) else stream
    first = buffered.read(2)
    whole = Rejoined(first, buffered)
    return iter(RecordReader(gzip.GzipFile(fileobj=whole) if first == b"\x1f\x8b" else whole))


class Rejoined:
    """A stream whose first bytes were read already."""

    def __init__(self, first: bytes, rest: BinaryIO):
        self.first, self.rest = first, rest

    def read(self, size: int = -1) -> bytes:
        if not self.first:
            return self.rest.read(size)
        first, self.first = (self.first, b"") if size < 0 else (self.first[:size], self.first[size:])
        return first + (self.rest.read() if size < 0 else self.rest.read(size - len(first)) if size > len(first) else b"")


FILE_RECORD = "path string, record_type string, record_id string, refers_to string, target_uri string, date string, state string, header string, block binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files of a folder (all types), plain or gzip.

    Spark lists the files and deals them to tasks; a task opens its files one after another and reads them record by record,
    so a file may be of any size, and a record must fit into a task. The file system must be one that Arrow opens by URI.
    ``state`` says whether the block has its digest, and names what cannot be read (:class:`RecordReader`).
    """
    bounded_batches(spark)
    names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date")
    fields = [f.split(" ")[0] for f in FILE_RECORD.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if f == "block" else pa.string()) for f, c in zip(fields, zip(*rows))], names=fields)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows, held = [], 0
                store, inside, _ = open_store(name)
                with store.open_input_stream(inside, compression=None, buffer_size=1 << 20) as stream:
                    for header, block, state in parse_warc(stream):
                        rows.append((name, *[header_value(header, n) for n in names], state, header, block))
                        held += len(block)
                        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(parse, FILE_RECORD)


def responses_from_warc(records: DataFrame, keep: tuple[str, ...] = (MATCH, UNCHECKED)) -> DataFrame:
    """The input of :func:`build_derivatives` from rows of :func:`read_warc`: HTTP responses whose state is in ``keep``.

    Records of other types are passed by. A block without an empty line is all header. ``source_id`` is the record's id.
    """
    bytes_ = F.decode("block", "ISO-8859-1")
    end = F.locate(RECORD_END, bytes_)
    http = F.lower(F.regexp_extract("header", r"(?im)^Content-Type:[ \t]*([^;\r\n]*)", 1))
    chosen = records.where((F.col("record_type") == "response") & F.col("state").isin(*keep) & F.trim(http).isin("application/http", ""))
    return chosen.select(
        F.col("record_id").alias("source_id"), "record_id", "target_uri", "date",
        F.when(end > 0, F.substr(bytes_, F.lit(1), end - 1)).otherwise(bytes_).alias("http_header"),
        F.when(end > 0, F.substr("block", end + 4)).otherwise(F.lit(b"")).alias("payload"))
