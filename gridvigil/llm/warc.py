"""WARC files: a writer with revisit records, and a reader that salvages damaged files.

The writer finds equal payloads by digest, keeps the one of the smallest id as a response
and writes the others as revisits of it. Pages are written where they lie: only digests are
shuffled, and the table of repeated ones is broadcast up to ``REPEATED`` rows; a longer one
meets the pages by a shuffle. Every record is a gzip member of its own; a file closes with
an empty member.

The reader takes any file of members or of plain records one after the other. Each record is
checked: member checksum, version line, headers, content length, block digest. Where a check
fails the reader looks for the next place at which a whole valid member or record begins,
goes on from there, and logs the bytes between as a gap with the reason. It holds a file's
bytes and the records of one member at a time, and hands rows on in slices of some
``SLICE_BYTES``, however far the payloads were compressed.

Defined results: a null payload is an empty one; a row with a null id is a response, and the
rows that share the smallest id of a payload all are; a null URL has no target header;
its control characters, line separators and outer spaces are percent-encoded; other columns
play no part; an empty table gives no files; files are read whole, so each must
stay below 2 GB (the writer closes them at ``FILE_BYTES``).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridvigil.llm.common import ROWS, read_blobs, shared_folder, slices, sql_type, stored, write_blobs

#: compressed bytes from which a file is closed
FILE_BYTES = 16 << 20
#: bytes of payloads from which the rows read so far are handed on
SLICE_BYTES = 1 << 20
#: rows of a table of repeated digests that may be broadcast (28 bytes each)
REPEATED = 200_000
DATE = "1970-01-01T00:00:00Z"
VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
MEMBER = b"\x1f\x8b\x08"
PLAIN = b"WARC/"
#: what a URL cannot hold in a header line
UNSAFE = re.compile("[\x00-\x1f\x7f-\x9f\u2028\u2029]|^ +| +$")
NAME = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_url(url: str) -> str:
    return UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(number: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit (of ``refers_to``) holds the HTTP headers without the payload."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    )
    block = http + payload if refers_to is None else http
    named = f"{NAME}{number}" if number is not None else "urn:sha1:" + digest(payload)
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <{named}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + header_url(url))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http_length(self) -> int | None:
        head = self.block.partition(b"\r\n\r\n")[0]
        found = re.search(rb"(?im)^content-length:\s*([0-9]+)", head)
        return int(found[1]) if found else None

    @property
    def payload(self) -> bytes:
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


class Damaged(ValueError):
    pass


def parse(data: bytes, at: int) -> tuple[Record, int]:
    """The plain record at ``at`` and where the next one begins."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    headers: dict[str, str] = {}
    begin = version.end()
    while True:  # lines end at CRLF or LF alone; the first bad one ends the search
        end = data.find(b"\n", begin)
        if end < 0:
            raise Damaged("headers do not end")
        line = data[begin:end].removesuffix(b"\r").decode("utf-8", "replace")
        begin = end + 1
        if not line:
            break
        name, colon, value = line.partition(":")
        if line[0] in " \t" and headers:  # a folded line
            last = next(reversed(headers))
            headers[last] += " " + line.strip(" \t")
        elif not colon or not name.strip():
            raise Damaged("bad header line")
        else:
            headers[name.strip().lower()] = value.strip(" \t")
    if not {"warc-record-id", "warc-type", "warc-date"} <= headers.keys():
        raise Damaged("a header is missing")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Damaged("no content length")
    stop = begin + int(size[:18])
    if stop > len(data):
        raise Damaged("block is cut off")
    block = data[begin:stop]
    kind, _, value = headers.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha1" and value.upper() != digest(block):
        raise Damaged("block digest differs")
    tail = re.compile(rb"\r?\n\r?\n").match(data, stop)
    if not tail:
        raise Damaged("no end of record")
    return Record(headers, block), tail.end()


def member(data: memoryview, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at ``at`` and where the next one begins."""
    unpacker, parts, fed = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            if fed >= len(data):
                raise Damaged("member is cut off")
            step = data[fed : fed + 65536]
            parts.append(unpacker.decompress(step))
            fed += len(step)
    except zlib.error as error:
        raise Damaged(f"member: {str(error)[:60]}") from None
    return b"".join(parts), fed - len(unpacker.unused_data)


def unit(data: bytes, view: memoryview, at: int) -> tuple[list[Record], int]:
    """All records of the member, or the plain record, at ``at`` and where the next begins."""
    if data.startswith(MEMBER, at):
        content, stop = member(view, at)
        found, inner = [], 0
        while inner < len(content):
            one, inner = parse(content, inner)
            found.append(one)
        return found, stop
    one, stop = parse(data, at)
    return [one], stop


def walk(data: bytes) -> Iterator[tuple[int, int, str | list[Record]]]:
    """(start, end, records) of every valid member or record and (start, end, reason) of every
    gap, as they stand in the file."""
    view, at = memoryview(data), 0
    while at < len(data):
        try:
            found, stop = unit(data, view, at)
        except Damaged as damage:
            reason, found, stop = str(damage), [], at
            begin, at = at, at + 1
            nexts = {MEMBER: -2, PLAIN: -2}  # where each mark stands next: -1 nowhere, -2 unknown
            while True:
                for mark, place in nexts.items():
                    if place == -2 or 0 <= place < at:
                        nexts[mark] = data.find(mark, at)
                at = min((p for p in nexts.values() if p >= 0), default=len(data))
                if at == len(data):
                    break
                try:
                    found, stop = unit(data, view, at)
                    break
                except Damaged:
                    at += 1
            yield begin, at, reason
            if at == len(data):
                break
        yield at, stop, found
        at = stop


def salvage(data: bytes) -> tuple[list[tuple[int, int, Record]], list[tuple[int, int, str]]]:
    """(start, end, record) of all valid records, (start, end, reason) of all gaps."""
    records, gaps = [], []
    for start, end, found in walk(data):
        if isinstance(found, str):
            gaps.append((start, end, found))
        else:
            records += [(start, end, one) for one in found]
    return records, gaps


def with_originals(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """Pages with ``refers_to``: the smallest id of an equal payload of ``least`` bytes or more."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sum", F.unhex(F.sha1("payload")))
    groups = (
        rows.filter(F.octet_length("payload") >= least)
        .groupBy("sum")
        .agg(F.min("id").alias("original"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("sum", "original")
    )
    groups = stored(groups, "originals")
    if groups.count() <= REPEATED:
        groups = F.broadcast(groups)
    return rows.join(groups, "sum", "left").select(
        "id", "url", "payload", F.when(F.col("id") > F.col("original"), F.col("original")).alias("refers_to")
    )


def write(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0
) -> str:
    """Write every page as a record; the folder's path."""

    def run(batches):
        waiting: list[bytes] = []
        size = 0
        closing = gzip.compress(b"", mtime=0)

        def file() -> pa.RecordBatch:
            # the sink's separator is the closing member's last byte
            return pa.RecordBatch.from_arrays([pa.array([b"".join([*waiting, closing[:-1]])], pa.binary())], names=["content"])

        for batch in batches:
            for part in slices(batch, 2, ROWS, SLICE_BYTES):
                for row in part.to_pylist():
                    made = gzip.compress(record(row["id"], row["url"], row["payload"], row["refers_to"]), 6, mtime=0)
                    waiting.append(made)
                    size += len(made)
                    if size >= FILE_BYTES:
                        yield file()
                        waiting, size = [], 0
        if waiting:
            yield file()

    folder = shared_folder(pages.sparkSession, "warc")
    rows = with_originals(pages, id_col, url_col, payload_col, least)
    write_blobs(rows.mapInArrow(run, "content binary"), "content", folder, per_file=1, end="\0")
    return folder


SCHEMA = (
    "path string, start long, end long, reason string, type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, http_length long, payload binary"
)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, with its place in its file, and per gap, which has a ``reason``."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def row(path, start, end, one: Record) -> tuple:
        h = one.headers
        return (
            path, start, end, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"),
            h.get("warc-refers-to"), h.get("warc-payload-digest"), one.http_length, one.payload,
        )

    def run(batches):
        types = dict(zip(names, [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()], strict=True))

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), types[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names
            )

        for batch in batches:
            rows, size = [], 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for start, end, found in walk(content.as_py()):
                    if isinstance(found, str):
                        rows.append((path, start, end, found, *[None] * 7))
                    else:
                        for one in found:
                            rows.append(row(path, start, end, one))
                            size += len(one.block)
                            if len(rows) >= ROWS or size >= SLICE_BYTES:
                                yield made(rows)
                                rows, size = [], 0
            if rows:
                yield made(rows)

    return read_blobs(spark, folder).mapInArrow(run, SCHEMA)


def page_number(name, kind: str):
    """Id in a record's name, null for another name."""
    return F.nullif(F.regexp_extract(name, f"<{NAME}(-?[0-9]+)>", 1), F.lit("")).cast(kind)


def pages_of(stored: DataFrame, pages_like: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per stored page: its full payload's size and digest, type and original."""
    kind = sql_type(pages_like, id_col)
    response = F.col("type") == "response"
    return stored.filter("reason is null").select(
        page_number(F.col("record_id"), kind).alias(id_col),
        F.when(response, F.octet_length("payload")).otherwise(F.col("http_length")).cast("long").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page_number(F.col("refers_to"), kind).alias("refers_to"),
    )
