"""WARC archives: a writer with revisit records, and a salvage reader for damaged files."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from framelark.functions.storage import scratch_path, write_through

CRLF = b"\r\n"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
DIGESTS = ("md5", "sha1", "sha256", "sha512")
WINDOW = 1 << 20
MOST_HEADER = 1 << 20


@dataclass
class Record:
    """``inner`` is the byte range inside its member, where that holds more than this record."""

    offset: int
    end: int
    headers: dict[str, str]
    block: bytes
    unchecked: str | None = None
    inner: tuple[int, int] | None = None


@dataclass
class Gap:
    """Bytes that belong to no valid record, with the check that failed first."""

    offset: int
    end: int
    reason: str
    inner: tuple[int, int] | None = None


class Damaged(Exception):
    """A failed check; ``resume`` is where the next record must start if the frame is whole."""

    def __init__(self, reason: str, resume: int | None = None):
        super().__init__(reason)
        self.reason, self.resume = reason, resume


@dataclass
class Source:
    """Random reads from an open file, through one window."""

    file: pa.NativeFile
    size: int = field(init=False)
    begin: int = 0
    window: bytes = b""

    def __post_init__(self):
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.begin or at + n > self.begin + len(self.window):
            want = max(n, min(WINDOW, self.size - at))
            self.file.seek(at)
            self.begin, self.window = at, self.file.read(want)
        return self.window[at - self.begin : at - self.begin + n]

    def find(self, pattern: re.Pattern, at: int) -> int:
        """Where ``pattern`` (at most 64 bytes) next starts at or after ``at``; the file's size if nowhere."""
        while at < self.size:
            part = self.read(at, WINDOW // 2)
            hit = pattern.search(part)
            if hit:
                return at + hit.start()
            if at + len(part) >= self.size:
                break
            at += max(1, len(part) - 64)
        return self.size


_START = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r\n")


def _headers(raw: bytes) -> tuple[dict[str, str], int]:
    """Named fields (lower-case names) and where the block starts."""
    version = VERSION.match(raw)
    if not version:
        raise Damaged("no version line")
    end = raw.find(CRLF + CRLF, version.end() - 2)
    if end < 0:
        raise Damaged("header without end")
    out: dict[str, str] = {}
    for line in raw[version.end() : end].split(CRLF):
        name, colon, value = line.partition(b":")
        if line and not colon:
            raise Damaged("header line without a colon")
        if line:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out, end + 4


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", value):
        raise Damaged("no usable content length")
    return int(value)


def _spelled(wanted: str, size: int) -> bytes | None:
    """The bytes of a digest in hex or base32, told apart by their length."""
    try:
        if len(wanted) == 2 * size:
            return bytes.fromhex(wanted)
        return base64.b32decode(wanted.upper() + "=" * (-len(wanted) % 8))
    except (ValueError, binascii.Error):
        return None


def _check_digests(headers: dict[str, str], block: bytes, resume: int | None) -> str | None:
    """Raise where a digest differs; the fields whose method is unknown come back as text."""
    unknown = []
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", payload_of(headers, block))):
        method, colon, wanted = headers.get(name, "").partition(":")
        method = method.strip().lower().replace("sha-", "sha")
        if name == "warc-payload-digest" and headers.get("warc-type") == "revisit":
            continue  # it describes the payload of the record referred to
        if method in DIGESTS and colon:
            found = hashlib.new(method, data, usedforsecurity=False).digest()
            if _spelled(wanted.strip(), len(found)) != found:
                raise Damaged(f"{name} differs", resume)
        elif name in headers:
            unknown.append(f"{name}: {method}")
    return ", ".join(unknown) or None


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block, without the HTTP header where it has one."""
    if headers.get("content-type", "").lower().startswith("application/http"):
        return block.partition(CRLF + CRLF)[2]
    return block


def _member(source: Source, at: int) -> list[Record | Gap]:
    """The record of a member, or, where it does not hold just one, all records inside and the gaps between."""
    unzip, parts, pos = zlib.decompressobj(31), [], at
    while not unzip.eof:
        chunk = source.read(pos, 1 << 13)
        if not chunk:
            raise Damaged("member is cut off")
        try:
            parts.append(unzip.decompress(chunk))
        except zlib.error as e:
            raise Damaged("member does not decompress") from e
        pos += len(chunk)
    end = pos - len(unzip.unused_data)
    raw = b"".join(parts)
    try:
        headers, begin = _headers(raw)
        size = _length(headers)
        if raw[begin + size :] != CRLF + CRLF:
            raise Damaged("content length differs from the member")
    except Damaged as e:
        found = list(_scan(Source(pa.BufferReader(raw)), VERSION, False))
        if not any(isinstance(x, Record) for x in found):
            raise Damaged(e.reason, end) from e
        for x in found:
            x.inner, x.offset, x.end = (x.offset, x.end), at, end
        return found
    block = raw[begin : begin + size]
    return [Record(at, end, headers, block, _check_digests(headers, block, end))]


def _plain(source: Source, at: int) -> Record:
    raw = source.read(at, 1 << 13)
    while CRLF + CRLF not in raw and len(raw) < min(MOST_HEADER, source.size - at):
        raw = source.read(at, len(raw) * 2)
    headers, begin = _headers(raw)
    size = _length(headers)
    end = at + begin + size + 4
    if end > source.size:
        raise Damaged("record is cut off")
    if source.read(end - 4, 4) != CRLF + CRLF:
        raise Damaged("record does not end where its length says")
    follows = source.read(end, 64)
    block = source.read(at + begin, size)
    whole = not follows or bool(VERSION.match(follows)) or follows.startswith(MEMBER)
    return Record(at, end, headers, block, _check_digests(headers, block, end if whole else None))


def salvage(file: pa.NativeFile) -> Iterator[Record | Gap]:
    """All valid records of a file in order, and the gaps between them.

    A record counts when every check holds: it decompresses (with its CRC), has a
    version line, well-formed fields and a content length that fits, and its digests
    agree (md5, sha1, sha256 and sha512, in hex or base32; other methods are named in
    ``unchecked``). After a failed check the reader goes on at the next member or version line
    that starts a valid record; the bytes skipped are one gap. If only a digest
    is wrong and the frame is whole, just that record is skipped. A member that decompresses
    but is not one record is searched for version lines in the same way: its records and
    gaps carry the file range of the member and their own range inside it.
    """
    yield from _scan(Source(file), _START, True)


def _scan(source: Source, start: re.Pattern, members: bool) -> Iterator[Record | Gap]:
    at, lost, why = 0, None, ""
    while at < source.size:
        mark = source.read(at, 16)
        try:
            if members and mark.startswith(MEMBER):
                found = _member(source, at)
            elif mark.startswith(b"WARC/"):
                found = [_plain(source, at)]
            else:
                raise Damaged("neither member nor version line" if members else "no version line")
        except Damaged as e:
            if lost is None:
                lost, why = at, e.reason
            at = e.resume if e.resume is not None else source.find(start, at + 1)
            continue
        if lost is not None:
            yield Gap(lost, at, why)
            lost = None
        yield from found
        at = found[-1].end
    if lost is not None:
        yield Gap(lost, source.size, why)


def _open(path: str):
    where, inner = fs.FileSystem.from_uri(path)
    return where, inner


def _uri(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def _id_of(uri: str | None) -> int | None:
    m = re.fullmatch(r"<?urn:page:(-?\d+)>?", uri or "")
    return int(m[1]) if m else None


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One response or revisit record; a revisit holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_uri(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: <{_uri(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head = "\r\n".join(["WARC/1.1", *lines]).encode()
    return head + CRLF + CRLF + block + CRLF + CRLF


def write_warc(
    pages: DataFrame,
    root: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_revisit: int = 100,
    file_bytes: int = 64 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row, a gzip member each; returns the written files ``(path, records, bytes)``.

    Of rows whose payloads (of ``least_revisit`` bytes or more) are equal, that with the
    smallest id is the response and the others revisit it. Null payloads are empty;
    null ids come after all others, and a group of null ids only is all responses; rows
    that repeat the smallest id are all responses. Every task writes files of its own
    under a new name, and only files of tasks that ended well are in the result, so
    a lost executor leaves at most files that nobody lists. An empty table writes no file. Only
    the three columns are read, so others may have any names. ``root`` is a folder that all
    executors reach; the session's checkpoint folder by default.
    """
    spark = pages.sparkSession
    root = root or scratch_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    base = pages.select(
        F.col(id_col).cast("bigint").alias("_id"),
        F.col(url_col).cast("string").alias("_url"),
        payload.alias("_payload"),
        F.unhex(F.sha2(payload, 256)).alias("_digest"),
    )
    first = (
        base.filter(F.octet_length("_payload") >= least_revisit)
        .groupBy(F.col("_digest").alias("_d"))
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 AND _first IS NOT NULL")
    )
    # A table of repeated digests only: small, so the payloads move no more than they must.
    first = write_through(first.select("_d", "_first"), "repeated")
    rows = base.join(first, F.col("_digest") == F.col("_d"), "left").select(
        "_id", "_url", "_payload", F.lower(F.hex("_digest")).alias("_hex"), "_first"
    )

    def run(batches):
        where, inner = _open(root)
        where.create_dir(inner, recursive=True)
        out, path, count, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, data, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = refers_to is not None and page_id != refers_to
                if out is None:
                    path, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{inner}/{path}", compression=None)
                gzip = zlib.compressobj(4, zlib.DEFLATED, 31)
                raw = record_bytes(page_id, url, data, digest, refers_to, revisit, date)
                member = gzip.compress(raw) + gzip.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield _file_row(f"{root}/{path}", count, size)
        if out is not None:
            out.close()
            yield _file_row(f"{root}/{path}", count, size)

    return write_through(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


def _file_row(path: str, records: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})


READ = (
    "path string, offset bigint, end bigint, gap_reason string, record_type string, page_id bigint, url string, "
    "payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, "
    "inner_offset bigint, inner_end bigint, unchecked string"
)


def read_warc(files: DataFrame, path_col: str = "path", with_payload: bool = True) -> DataFrame:
    """All records of the files, and a row with ``gap_reason`` for each quarantined byte range.

    A file is read by one task in windows, never whole; files are dealt out evenly. For a
    revisit, digest and length are those of the full payload, from its fields. Plain and
    compressed files, also mixed, are understood, and members of several records, whose
    range inside the member is in ``inner_offset`` and ``inner_end``. Digests of unknown methods are
    named in ``unchecked``. Null paths are skipped; an empty file or an empty table gives no
    rows; of ``files`` only the path is read, so other columns may have any names.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, inner = _open(path)
                with where.open_input_file(inner) as file:
                    rows, held = [], 0
                    for item in salvage(file):
                        rows.append(_row(path, item, with_payload))
                        held += len(item.block) if isinstance(item, Record) and with_payload else 200
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    paths = files.select(F.col(path_col).alias("path")).filter("path IS NOT NULL")
    tasks = max(1, min(paths.count(), 100_000))
    return paths.repartition(tasks).mapInArrow(run, READ)


_SCHEMA = pa.schema(
    [
        ("path", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("gap_reason", pa.string()),
        ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
        ("inner_offset", pa.int64()), ("inner_end", pa.int64()), ("unchecked", pa.string()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _row(path: str, item: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(item, Gap):
        return (path, item.offset, item.end, item.reason, *[None] * 7, *(item.inner or (None, None)), None)
    h = item.headers
    payload = payload_of(h, item.block)
    revisit = h.get("warc-type") == "revisit"
    if revisit:
        m = re.search(rb"(?im)^content-length:\s*(\d+)", item.block)
        size = int(m[1]) if m else None
        digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return (
        path, item.offset, item.end, None, h.get("warc-type"), _id_of(h.get("warc-record-id")), h.get("warc-target-uri"),
        payload if with_payload and not revisit else None, size, digest, _id_of(h.get("warc-refers-to")),
        *(item.inner or (None, None)), item.unchecked,
    )
