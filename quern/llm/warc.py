"""WARC archives: writing with segments and revisits, and reading with segment reassembly.

Records longer than SEGMENT_BYTES are cut into a first record and continuations.
Reading groups continuations by the id of the record that they go on from, orders
them by segment number, verifies that none is missing and that the total length is
right, decodes chunked transfer framing and checks the payload's digest. Only
segments are shuffled for that; other records are complete where they are read.

Archives are rows of a table (name, content), of ARCHIVE_BYTES each or little more, so
any store that Spark writes holds them; ``read_records`` takes archives from
``spark.read.format("binaryFile")`` as well, plain or gzip.

Of records with equal payloads of at least REVISIT_BYTES, that with the largest key is a
response and the others revisit it; smaller ones all are responses.

Defined cases: null html is an empty payload; a null url has no target; a record that
cannot be put together or read gives its row with an error and no payload; an archive
that is damaged, cut short, or a broken gzip stream gives such a row for each damaged
place and all records that can be read, and a null one none; rows that repeat the
response's key are responses too; rows without a key revisit one with a key, if there is
one; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_map

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 16 * 1024
ARCHIVE_BYTES = 4 * 1024 * 1024
REVISIT_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_END = b"\r\n\r\n"
#: Bytes of a record's header at most, and of blocks that a reader holds before it passes them on, about.
MOST_HEADER, HELD_BYTES = 1 << 20, 16 << 20
_VERSION, _NUMBER, _CHUNK_SIZE = re.compile(rb"WARC/\d"), re.compile(r"\d{1,18}"), re.compile(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*")


def record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page} {digest}')}>"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The body in chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(part), part) for part in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; chunk extensions and trailers are skipped.

    ValueError if it is cut short or a size is anything but 1 to 15 hexadecimal digits, so every step goes forward.
    """
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        size = _CHUNK_SIZE.fullmatch(framed[at:line].split(b";")[0])
        if size is None:
            raise ValueError("bad chunk size")
        many, at = int(size[1], 16), line + 2
        if not many:
            return b"".join(out)
        if framed[at + many : at + many + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(framed[at : at + many])
        at += many + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END


def page_records(page: int | None, url: str | None, html: str, digest: str, kind: str, refers_to: int | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: a response, in segments if it is long, or a revisit."""
    own, body = record_id(page, digest), html.encode()
    fields: list[tuple[str, object]] = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Page-ID", page),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", refers_to)]
        yield record(fields, f"{head}Content-Length: {len(body)}\r\n\r\n".encode())
        return
    block = f"{head}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(body)
    if len(block) <= segment:
        yield record(fields, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record([*fields, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        own_part = f"<urn:uuid:{uuid.uuid5(_NAMES, f'{own} {n}')}>"
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", own_part), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), *last], part)


Found = tuple[dict[str, str], bytes | None, str | None]


def _lines_to_record(stream: BinaryIO) -> bytes:
    """The next line that begins a record, after damage; empty at the end."""
    while line := stream.readline(MOST_HEADER):
        if _VERSION.match(line):
            return line
    return b""


def _header(stream: BinaryIO) -> dict[str, str]:
    """The named fields after a version line, names lower-cased, up to a blank line; ValueError if there is none within MOST_HEADER bytes."""
    fields, left = {}, MOST_HEADER
    while (line := stream.readline(left + 1)) not in (b"\r\n", b"\n"):
        left -= len(line)
        if left < 0 or not line.endswith(b"\n"):
            raise ValueError("WARC header is cut short or too long")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def scan_archive(content: bytes) -> Iterator[Found]:
    """Fields, block and error of each record of an archive, plain or gzip, read as a stream.

    Damage gives one row with its error and no block, for what could be read of the record's
    fields, and reading goes on at the next line that begins a record, if there is one.
    """
    zipped = content[:2] == b"\x1f\x8b"
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if zipped else io.BytesIO(content)
    fields: dict[str, str] = {}
    try:
        line = stream.readline(MOST_HEADER)
        while line:
            fields, error, block = {}, None, None
            try:
                if not _VERSION.match(line):
                    raise ValueError("not a WARC record")
                fields = _header(stream)
                size = fields.get("content-length", "")
                if not _NUMBER.fullmatch(size):
                    raise ValueError("WARC record without a length")
                block = stream.read(int(size))
                if len(block) != int(size) or stream.read(len(_END)) != _END:
                    raise ValueError("WARC record is cut short")
            except ValueError as e:
                block, error = None, str(e)
            yield fields, block, error
            line = _lines_to_record(stream) if error else stream.readline(MOST_HEADER)
    except (EOFError, OSError, zlib.error) as e:  # the compressed stream ends or breaks here: nothing after it can be read
        yield fields, None, f"bad gzip stream: {e}"


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names lower-cased) and block of each record; ValueError at damage."""
    for fields, block, error in scan_archive(content):
        if error or block is None:
            raise ValueError(error)
        yield fields, block


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names lower-cased) and body, with its transfer framing taken off."""
    head, _, body = block.partition(_END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])}
    return fields, dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def _classified(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Adds payload digest, record type and what it refers to; only digests, lengths and keys are aggregated."""
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1(F.col("html").cast("binary")).alias("digest"), (F.octet_length("html") >= REVISIT_BYTES).alias("long"))
    first = rows.filter("long").groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first")
    revisits = F.col("long") & F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    return rows.join(first, "digest", "left").select("page", "url", "html", "digest", F.when(revisits, "revisit").otherwise("response").alias("kind"), F.when(revisits, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT_BYTES, archive: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, content): the archives of all rows. A record's segments may stand in several archives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            name = f"part-{task:06d}-{n:06d}.warc"
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "")), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([info + b"".join(held)], pa.binary())], names=["name", "content"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "digest", "kind", "refers_to"))):
                for one in page_records(*row, segment=segment):
                    held.append(one)
                    size += len(one)
                    if size >= archive:
                        yield closed()
                        n, held, size = n + 1, [], 0
        if held:
            yield closed()

    return arrow_map(_classified(pages, key, url, html), run, "name string, content binary")


_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("error", pa.string())]
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"


def _number(fields: dict[str, str], name: str) -> int | None:
    """A field as a signed 64-bit number, null where it is absent; ValueError for anything else."""
    if name not in fields:
        return None
    if not _NUMBER.fullmatch(fields[name].removeprefix("-")):
        raise ValueError(f"{name} is no number")
    return int(fields[name])


def _digest(fields: dict[str, str]) -> str | None:
    """The payload's SHA-1 in hex, null where the record gives none or one of another kind."""
    kind, _, value = fields.get("warc-payload-digest", "").partition(":")
    return base64.b32decode(value).hex() if kind.lower() == "sha1" else None


def _told(fields: dict[str, str], block: bytes | None, error: str | None, payloads: bool) -> tuple:
    """A row of RECORDS of a whole record; whatever is wrong with it is its error."""
    page = refers = digest = payload = size = None
    kind = fields.get("warc-type")
    try:
        page, refers, digest = _number(fields, "page-id"), _number(fields, "refers-to-page-id"), _digest(fields)
        if not error and block is not None:
            http, payload = http_parts(block)
            size = _number(http, "content-length") if kind == "revisit" else len(payload)
            if kind != "revisit":
                found = hashlib.sha1(payload).hexdigest()
                error = None if digest in (None, found) else "the payload's digest is another"
                digest = found
    except ValueError as e:
        payload, error = None, error or f"bad record: {e}"
    return page, fields.get("warc-target-uri"), payload if payloads and kind != "revisit" and not error else None, size, digest, kind, refers, error


def _columns(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return _columns(rows, _FIELDS)


def _is_segment(fields: dict[str, str]) -> bool:
    return "warc-segment-number" in fields or fields.get("warc-type") == "continuation"


def _whole(archives: DataFrame, content: str, payloads: bool) -> DataFrame:
    """Records that are in one piece, and a row for each damaged place of an archive."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(content):
                rows, held = [], 0
                for fields, block, error in scan_archive(data.as_py() or b""):
                    if fields.get("warc-type") == "warcinfo" and not error or _is_segment(fields) and not error:
                        continue
                    rows.append(_told(fields, block, error, payloads))
                    held += len(rows[-1][2] or b"")
                    if held > HELD_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return arrow_map(archives.select(content), run, RECORDS)


_SEGMENT = [("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]


def _segments(archives: DataFrame, content: str) -> DataFrame:
    """A row for each segment; one without an origin or a number counts as number 0 of its record, which never is whole."""

    def part(fields: dict[str, str], block: bytes) -> tuple:
        numbers = []
        for name in ("warc-segment-number", "warc-segment-total-length"):
            try:
                numbers.append(_number(fields, name))
            except ValueError:
                numbers.append(-1)
        return fields.get("warc-segment-origin-id") or fields.get("warc-record-id") or "", numbers[0] or 0, numbers[1], list(fields.items()), block

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(content):
                rows, held = [], 0
                for fields, block, error in scan_archive(data.as_py() or b""):
                    if _is_segment(fields) and not error:
                        rows.append(part(fields, block))
                        held += len(block)
                    if rows and held > HELD_BYTES:
                        yield _columns(rows, _SEGMENT)
                        rows, held = [], 0
                if rows:
                    yield _columns(rows, _SEGMENT)

    return arrow_map(archives.select(content), run, "origin string, number long, total long, fields map<string, string>, block binary")


def assemble(parts: list[tuple[int, int | None, dict[str, str], bytes]]) -> Iterator[Found]:
    """Fields, block and error of each record of one origin id; parts are ordered by number.

    A page that was written k times has each of its segments k times; they are equal.
    """
    numbers = [n for n, *_ in parts]
    copies, last = numbers.count(numbers[0]), numbers[-1]
    fields = dict(parts[0][2]) if numbers[0] == 1 else {}
    if numbers[0] != 1 or last * copies != len(numbers) or numbers != [n for n in range(1, last + 1) for _ in range(copies)]:
        yield fields, None, "segments are missing or repeated"
        return
    blocks = [b for *_, b in parts[::copies]]
    total = parts[-1][1]
    size = sum(map(len, blocks))
    error = None if total == size else f"total length is {size}, not {total}"
    for _ in range(copies):
        yield fields, b"".join(blocks), error


def read_records(archives: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """RECORDS of all archives: responses and revisits, whole and put together. ``archives`` is read twice, so it should be a written table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, parts = None, []

        def done() -> pa.RecordBatch:
            return _batch([_told(*found, payloads) for found in assemble(parts)] if parts else [])

        for batch in batches:
            for o, n, total, fields, block in zip(*(batch.column(c).to_pylist() for c, _ in _SEGMENT)):
                if o != origin:
                    yield done()
                    origin, parts = o, []
                parts.append((n, total, dict(fields or []), block))
        yield done()

    together = arrow_map(_segments(archives, content).repartition("origin").sortWithinPartitions("origin", "number"), run, RECORDS)
    return _whole(archives, content, payloads).unionByName(together)
