"""WARC archives as a PySpark data source, and their writer.

Our files are rows of gzip members, one record each. The extra field ``sl`` of a member's gzip header
holds its packed and unpacked length, so a reader jumps from record to record: it unpacks a record
only as far as its headers and leaves the rest packed unless the payload is wanted and the record
passes the pushed filters. Other archives are read as well: gzip members without lengths, one for many
records, and plain files; their records stream past, in pieces, and payloads are kept only where
they are wanted. One partition reads one file; writers start a new file every ``FILE_BYTES``.

Reading::

    spark.dataSource.register(WarcSource)
    spark.read.format("warc").option("payload", "false").load(folder).where("record_type = 'response'")

Paths may lie in any store that ``pyarrow.fs`` reaches; folders are shared by all executors.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull,
)

from ..session import folder_of, shared_folder
from .common import fresh, keep, query, table, utf8

FILE_BYTES = 128 << 20
SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
_NAMES = ("record_id", "record_type", "target_uri", "page_id", "refers_to", "payload_bytes", "payload_digest", "payload")
_HEAD = 2048
_PIECE = 1 << 20
_BREAK = b"\r\n"


def store_of(folder: str):
    """File system and path of a folder's address; ``file:/x`` is read like ``file:///x``."""
    from pyarrow import fs  # starts threads of its own, so only where files are opened

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


def digest_of(payload: bytes) -> str:
    """SHA-1 in base 32, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    """A gzip member whose header tells its packed and unpacked length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, ordinal: str) -> bytes:
    """One packed record: a response with its payload, or a revisit that names the response."""
    revisit = refers_to is not None
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{ordinal}>"),
        ("WARC-Date", datetime.fromtimestamp(0, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "replace") for k, v in fields)
    return _member(head + _BREAK + block + _BREAK + _BREAK)


def _unpacked(packed: bytes, need: int | None) -> bytes:
    """The member's data from its deflate stream, at least up to ``need`` bytes if given."""
    unpacker = zlib.decompressobj(-15)
    return unpacker.decompress(packed) if need is None else unpacker.decompress(packed, need)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space goes on with the one before."""
    fields, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def _row(field: dict[str, str]) -> list:
    """A row of ``SCHEMA`` from header fields; what a record does not say is null."""
    number = lambda name: int(field[name]) if field.get(name, "").lstrip("-").isdigit() else None
    named = field.get("warc-record-id", "").strip("<>")
    uri = field.get("warc-target-uri")
    return [
        named.removeprefix("urn:uuid:") or None, field.get("warc-type"), uri.strip("<>") if uri is not None else None, number("x-page-id"),
        number("x-refers-to-page"), number("x-payload-length"), field.get("warc-payload-digest", "").removeprefix("sha1:") or None, None,
    ]


def records(handle, wanted, payload: bool) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` of one file whose header fields pass ``wanted``."""
    while True:
        start = handle.tell()
        head = handle.read(24)
        if not head:
            return
        if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"sl" or len(head) < 24:
            # an archive of others, or one that others have added to
            handle.seek(start)
            stream = io.BufferedReader(gzip.GzipFile(fileobj=handle, mode="rb"), _PIECE) if head[:2] == b"\x1f\x8b" else handle
            yield from streamed(stream, wanted, payload)
            return
        size = struct.unpack("<I", head[16:20])[0]
        body, need = handle.read(min(size - 24, _HEAD)), _HEAD
        data = _unpacked(body, need)
        while b"\r\n\r\n" not in data:  # very long headers
            need *= 4
            body += handle.read(min(size - 24 - len(body), need))
            data = _unpacked(body, need)
            if need > (size << 11):
                raise ValueError(f"headers do not end in the record at byte {start}")
        row = _row(_fields(data[:data.index(b"\r\n\r\n")]))
        if wanted(dict(zip(_NAMES, row, strict=True))):
            if payload and row[1] == "response":
                handle.seek(start + 24)
                data = _unpacked(handle.read(size - 24 - 8), None)
                block = data.index(b"\r\n\r\n") + 4
                row[7] = data[data.index(b"\r\n\r\n", block) + 4:-4]
            yield tuple(row)
        handle.seek(start + size)


def _block(stream, length: int, http: bool, keep_: bool) -> tuple[int, str, bytes | None]:
    """Bytes, digest and, if kept, content of a record's payload, read in pieces.

    The payload of an HTTP message is what follows its headers; without their end there is none.
    """
    head, total, digest, parts = b"", 0, hashlib.sha1(), []
    left, inside = length, not http
    while left:
        piece = stream.read(min(left, _PIECE))
        if not piece:
            raise ValueError("the archive ends within a record")
        left -= len(piece)
        if not inside:
            head += piece
            end = head.find(b"\r\n\r\n")
            if end < 0:
                continue
            piece, head, inside = head[end + 4:], b"", True
        total += len(piece)
        digest.update(piece)
        if keep_:
            parts.append(piece)
    return total, base64.b32encode(digest.digest()).decode(), b"".join(parts) if keep_ else None


def streamed(stream, wanted, payload: bool) -> Iterator[tuple]:
    """Rows of records that follow each other in an unpacked stream.

    Length and digest of a payload are taken from it where the headers do not tell them, so filters
    on these see records after they have been read. A revisit has no payload of its own.
    """
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        lines = [line.rstrip(b"\r\n")]
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line.rstrip(b"\r\n"))
        field = _fields(b"\r\n".join(lines))
        row = _row(field)
        http, own = field.get("content-type", "").lower().startswith("application/http"), row[1] != "revisit"
        size, digest, content = _block(stream, int(field["content-length"]), http, payload and own)
        if own:
            row[5] = size if row[5] is None else row[5]
            row[6] = digest if row[6] is None else row[6]
            row[7] = content
        if wanted(dict(zip(_NAMES, row, strict=True))):
            yield tuple(row)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Wanted:
    """Equality, membership and not-null tests on header fields, all of which a record must pass."""

    def __init__(self):
        self.tests: list[tuple[str, tuple | None]] = []

    def __call__(self, row: dict) -> bool:
        return all(row[name] is not None if values is None else row[name] in values for name, values in self.tests)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.wanted = _Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes tests on header fields; all others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in _NAMES[:-1]:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.tests.append((name, (f.value,)))
            elif isinstance(f, In):
                self.wanted.tests.append((name, tuple(f.value)))
            elif isinstance(f, IsNotNull):
                self.wanted.tests.append((name, None))
            else:
                yield f

    def partitions(self):
        store, path = store_of(self.root)
        from pyarrow.fs import FileSelector

        found = store.get_file_info(FileSelector(path, allow_not_found=True))
        names = sorted(x.path for x in found if x.is_file and x.path.endswith((".warc.gz", ".warc")))
        return [_File(name) for name in names] or [_File("")]

    def read(self, partition: _File):
        if not partition.path:
            return
        store, _ = store_of(self.root)
        with store.open_input_file(partition.path) as raw:
            yield from records(io.BufferedReader(raw, 1 << 20), self.wanted, self.payload)


class WarcSource(DataSource):
    """``format("warc")``: options ``path`` and ``payload`` ("false" leaves payloads packed)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def write_warc(pages: DataFrame, folder: str) -> int:
    """Write ``page_id, url, html, refers_to`` as archives into a new ``folder``; returns the number of records.

    Each task writes under a name of its own and names the file in full only when it is whole, so
    that a repeated or lost attempt leaves nothing that a reader takes up twice: the driver keeps
    the files of the attempts that succeeded.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, link in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    n = size = 0
                page, target = (None if x is None else int(x) for x in (page_id, link))
                packed = record(page, url, utf8(html), target, str(uuid.uuid4()))
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"name": [name], "n": [n]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"name": [name], "n": [n]})

    total = 0
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    # ids as text: beside nulls, pandas would round large numbers
    given = pages.selectExpr("CAST(page_id AS STRING) AS page_id", "url", "html", "CAST(refers_to AS STRING) AS refers_to")
    for row in given.mapInPandas(write, "name string, n long").collect():  # one row per file
        store.move(f"{root}/{row['name']}", f"{root}/{row['name'].removesuffix('.part')}.warc.gz")
        total += row["n"]
    return total


def with_revisits(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: for equal payloads of ``at_least`` bytes, the largest page_id but for that record itself.

    Rows that share the largest page_id and payload are all responses; so is a payload whose rows
    have no page_id, and rows with a null page_id refer to the response of their payload.
    """
    sum_, first, n = fresh(pages, "sum", "first", "n")
    marked = pages.withColumn(sum_, F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    named = keep(marked.groupBy(sum_).agg(F.max("page_id").alias(first), F.count("*").alias(n)).where(F.col(n) > 1).drop(n))
    linked = marked.join(named, sum_, "left")
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= at_least
    other = F.col(first).isNotNull() & ~F.col(first).eqNullSafe(F.col("page_id")) & long
    return linked.withColumn("refers_to", F.when(other, F.col(first))).drop(sum_, first)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Records of the archives in ``folder``; filters on header fields reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives into the shared folder, read them back: one row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A null html is an empty
    payload; a null url an empty target. Repeated rows each get a record. An empty table gives an
    empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    files, place = folder_of(spark, folder)
    files.deleteOnExit(place)
    write_warc(with_revisits(pages.select("page_id", "url", "html")), folder)
    return read_warc(spark, folder, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# the digest's 160 bits, five at a time from three hex digits
CHECK = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest FROM pages),
named AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first FROM payloads),
told AS (SELECT *, first IS NOT NULL AND page_id IS DISTINCT FROM first AS revisit FROM named)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(digest || '00', 5 * i // 4 + 1, 3))::BIGINT >> (7 - 5 * i % 4)) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
    CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to
FROM told
"""


@query("op5_warc", CHECK)
def op5(spark, folder):
    return archived(table(spark, folder, "pages"))
