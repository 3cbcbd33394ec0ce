"""Web archives: writing records as gzip members, and a splittable reader.

*Writing* is a map: every task writes archives of its own under a fresh name and returns one row
for each, and only archives of successful tasks stand in that manifest, so a lost executor or a
second attempt leaves nothing that would be read.

*Reading* gives each task byte ranges of the archives.  A task looks for gzip magic in its range,
takes a place for a member only if it decodes to the head of a record, and owns the
records that start inside its range; it reads past the end to complete the last one.
No task needs to know what lies before its range, so one large archive is read by many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyroute.llm import words as W
from skyroute.llm.tables import shared_folder, staged

#: Bytes of archive from which a task goes on to the next one.
ARCHIVE_BYTES = 1 << 30
#: Bytes of archive in one range of the reader.
SPLIT_BYTES = 8 << 20
_READ, _PIECE = 1 << 18, 1 << 14
_MAGIC = b"\x1f\x8b\x08"
_HEAD = b"WARC/1."
_ID = "urn:x-page:"

RECORD = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page: int, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    """One record; a revisit has the HTTP head of the payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{page}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if original is not None:
        head += [f"WARC-Refers-To: <{_ID}{original}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str | None = None, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of the pages (page_id, url, html); returns their manifest (path, bytes, records).

    Of pages with equal payloads that with the largest page_id is a ``response`` and the others are
    ``revisit`` records that refer to it.  A null html is an empty payload; pages without an
    id are left out; repeated rows of the kept page are each a response.  A null url has no target header.
    An empty table gives an empty manifest.  Other columns are ignored, whatever their names.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/skyroute/warc-{uuid.uuid4().hex}"
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")
    ).where("page_id is not null")
    pages = pages.withColumn("digest", F.sha1("payload"))
    keeper = pages.groupBy("digest").agg(F.max("page_id").alias("keeper"))
    pages = pages.join(keeper, "digest").select("page_id", "url", "payload", "digest", "keeper")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, size, records = None, "", 0, 0
        # a few pages at a time become Python objects
        for part in (part for batch in batches for part in W.chunks(batch, "payload")):
            for page, url, payload, digest, kept in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None:
                    path, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                base32 = base64.b32encode(bytes.fromhex(digest)).decode()
                member = packer.compress(_record(page, url, payload, base32, None if page == kept else kept)) + packer.flush()
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [records]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [records]})

    manifest = staged(pages.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")
    return manifest.withColumn("path", F.concat(F.lit(f"{folder}/"), "path"))


class _Source:
    """A window over a file that is moved on as needed."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data = file, start, b""

    def at(self, offset: int, n: int) -> bytes:
        """Up to n bytes from offset on; fewer only at the end of the file."""
        if offset < self.base or offset > self.base + len(self.data):
            self.base, self.data = offset, b""
        if offset - self.base > 4 * _READ:
            self.data, self.base = self.data[offset - self.base :], offset
        while len(self.data) < offset - self.base + n:
            self.file.seek(self.base + len(self.data))
            more = self.file.read(max(_READ, n))
            if not more:
                break
            self.data += more
        return self.data[offset - self.base : offset - self.base + n]


def _member(source: _Source, offset: int) -> tuple[bytes, int] | None:
    """The whole record at ``offset`` and where its member ends; None if none starts there."""
    unpack, out, at = zlib.decompressobj(31), [], offset
    try:
        while not unpack.eof:
            piece = source.at(at, _PIECE)
            if not piece:
                return None
            out.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
            if len(out) == 1 and not (out[0].startswith(_HEAD) or len(out[0]) < len(_HEAD) and not unpack.eof):
                return None
    except zlib.error:
        return None
    record = b"".join(out)
    return (record, at) if record.startswith(_HEAD) else None


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each member that starts in [start, end)."""
    source, at = _Source(file, start), start
    while at < end:
        piece = source.at(at, _READ)
        k = piece.find(_MAGIC)
        if k < 0:
            if len(piece) < _READ:
                return
            at += len(piece) - 2
            continue
        at += k
        if at >= end:
            return
        found = _member(source, at)
        if found is None:
            at += 1
            continue
        yield at, found[0]
        at = found[1]


def parse(record: bytes, with_payload: bool = True) -> dict:
    """Fields of one record; a response's payload is counted and digested anew."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    kind = fields.get("warc-type")
    if kind == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        n, digest, payload = int(size[1]) if size else None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    else:
        n, digest = len(payload), payload_digest(payload)
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "payload_bytes": n, "payload_digest": digest, "payload": payload if with_payload else None,
    }


def read_warc(archives: DataFrame, *, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the archives (path, bytes), one row each; see ``RECORD`` for the columns.

    Bytes between members, and members that don't begin with the head of a record, are skipped; a member
    cut off at the end of an archive is not a record.
    """
    ranges = archives.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + split_bytes).alias("end"))
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, local = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_file(local) as file:
                    for offset, record in members(file, start, end):
                        rows.append({"path": path, "offset": offset} | parse(record, with_payload))
                        size += len(record) if with_payload else 512
                        if size > W_BATCH:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, types, strict=True))))
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, types, strict=True))))

    parallel = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parallel).mapInArrow(run, RECORD)


#: Bytes of records in one batch of the reader.
W_BATCH = 4 << 20


def page_id(column: str) -> Column:
    return F.regexp_extract(column, rf"^<{re.escape(_ID)}(-?\d+)>$", 1).try_cast("long")


def archived_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages to archives and reads those back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = read_warc(write_warc(pages, folder), with_payload=False)
    return records.select(
        page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to").alias("refers_to")
    )
