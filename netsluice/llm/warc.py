"""WARC archives: a writer that leaves one gzip member per record, and a reader that salvages.

The reader walks an archive by offset. A member that does not inflate, or a record whose version line,
length, block digest or payload digest does not hold, is not trusted: it searches for the next place
where a valid record begins, goes on from there, and reports the bytes between as a quarantined gap.
Archives lie in the folder that all executors share and are read and written by ranges, never whole.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsluice.llm.common import written
from netsluice.session import work_path

#: Bytes after which the writer begins another archive.
ARCHIVE_BYTES = 32_000_000
#: Bytes read at once.
CHUNK = 1 << 18
#: Longest header block of a record that is looked at.
HEADER_BYTES = 1 << 16
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")

RECORDS = pa.schema(
    [
        ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("problem", pa.string()),
        ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ]
)
RECORDS_DDL = (
    "archive string, offset long, length long, problem string, record_id string, record_type string, "
    "refers_to string, uri string, payload_bytes long, payload_digest string, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record. A revisit keeps the HTTP head, with the full length, and leaves the body out."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if uri is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)))
    if refers_to:
        fields += [
            ("WARC-Refers-To", f"<{refers_to}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(
    df: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, compress: bool = True
) -> DataFrame:
    """Write rows (record_id, uri, payload, refers_to) as archives under ``folder``; return their names and sizes.

    Every attempt of a task writes files of its own name; only those of the attempts that ended well are
    in the returned manifest, so a lost executor or a second attempt leaves nothing that is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        stem = f"{context.partitionId():06d}-{uuid.uuid4().hex}"
        names, sizes, out, size = [], [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                data = record(row["record_id"], row["uri"], row["payload"] or b"", row["refers_to"], date)
                data = gzip_member(data) if compress else data
                if out is not None and size + len(data) > archive_bytes:
                    out.close()
                    sizes.append(size)
                    out, size = None, 0
                if out is None:
                    names.append(f"{base}/{stem}-{len(names):05d}.warc" + ".gz" * compress)
                    out = store.open_output_stream(names[-1], compression=None)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            sizes.append(size)
        yield pa.RecordBatch.from_pydict(
            {"archive": names, "bytes": sizes}, schema=pa.schema([("archive", pa.string()), ("bytes", pa.int64())])
        )

    rows = df.select("record_id", "uri", "payload", "refers_to")
    return written(rows.mapInArrow(run, "archive string, bytes long"), "warc-manifest")


class _Archive:
    """Ranges of one file, the last one kept."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.start, self.held = file, file.size(), 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if not self.start <= offset or offset + n > self.start + len(self.held):
            self.file.seek(offset)
            self.start, self.held = offset, self.file.read(max(n, CHUNK))
        return self.held[offset - self.start : offset - self.start + n]

    def find(self, pattern: re.Pattern, offset: int) -> int:
        """The next place from ``offset`` on where the pattern stands; the size if none."""
        while offset < self.size:
            m = pattern.search(self.at(offset, CHUNK))
            if m:
                return offset + m.start()
            offset += max(1, CHUNK - 16)
        return self.size


def _inflate(archive: _Archive, offset: int) -> tuple[bytes, int]:
    z, parts, at = zlib.decompressobj(31), [], offset
    while not z.eof:
        chunk = archive.at(at, CHUNK)
        if not chunk:
            raise ValueError("member is cut off")
        try:
            parts.append(z.decompress(chunk))
        except zlib.error as e:
            raise ValueError("member does not inflate") from e
        at += len(chunk)
    return b"".join(parts), at - len(z.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _parsed(head: bytes, block: bytes) -> dict:
    """The checked content of a record; a ValueError names the first check that fails."""
    fields = _fields(head)
    for name, data in (("warc-block-digest", block),):
        if name in fields and fields[name] != f"sha1:{base32_sha1(data)}":
            raise ValueError("block digest differs")
    kind, payload, size = fields.get("warc-type"), block, len(block)
    if "application/http" in fields.get("content-type", ""):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise ValueError("HTTP head without an end")
        size = int(_fields(http).get("content-length", len(payload)))
    digest = fields.get("warc-payload-digest", "")
    if kind == "revisit":
        payload = None
    else:
        if size != len(payload):
            raise ValueError("payload length differs")
        if digest and digest != f"sha1:{base32_sha1(payload)}":
            raise ValueError("payload digest differs")
        digest = digest or f"sha1:{base32_sha1(payload)}"
    bare = lambda x: x.strip("<>") if x else None
    return {
        "record_id": bare(fields.get("warc-record-id")), "record_type": kind, "refers_to": bare(fields.get("warc-refers-to")),
        "uri": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest.removeprefix("sha1:"),
        "payload": payload,
    }


def _head_of(data: bytes) -> tuple[bytes, int, int]:
    if not VERSION.match(data):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("header without an end")
    length = _fields(data[:end]).get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    return data[:end], end + 4, int(length)


def _one(archive: _Archive, offset: int, zipped: bool) -> tuple[dict, int]:
    """The record at an offset and the offset behind it."""
    if zipped:
        data, after = _inflate(archive, offset)
        head, start, length = _head_of(data)
        if len(data) != start + length + 4 or not data.endswith(b"\r\n\r\n"):
            raise ValueError("record length differs")
        return _parsed(head, data[start : start + length]), after
    head, start, length = _head_of(archive.at(offset, HEADER_BYTES))
    if offset + start + length + 4 > archive.size:
        raise ValueError("record is cut off")
    data = archive.at(offset + start, length + 4)
    if not data.endswith(b"\r\n\r\n"):
        raise ValueError("record length differs")
    return _parsed(head, data[:length]), offset + start + length + 4


def salvage(file: pa.NativeFile) -> Iterator[dict]:
    """All records that hold, in order, and a row with ``problem`` for each gap between them."""
    archive = _Archive(file)
    zipped = archive.at(0, 3) == MAGIC or not VERSION.match(archive.at(0, 16)) and archive.find(re.compile(re.escape(MAGIC)), 0) < archive.size
    begin = re.compile(re.escape(MAGIC)) if zipped else VERSION
    offset, bad, problem = 0, None, ""
    while offset < archive.size:
        try:
            found, after = _one(archive, offset, zipped)
        except ValueError as e:
            if bad is None:
                bad, problem = offset, str(e)
            offset = archive.find(begin, offset + 1)
            continue
        if bad is not None:
            yield {"offset": bad, "length": offset - bad, "problem": problem}
            bad = None
        yield {"offset": offset, "length": after - offset, **found}
        offset = after
    if bad is not None:
        yield {"offset": bad, "length": archive.size - bad, "problem": problem}


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives named in column ``archive``; gaps have a ``problem`` and no type.

    An archive that is empty gives no row. One that cannot be opened fails the job.
    """
    names = list(RECORDS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                store, path = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
                with store.open_input_file(path) as file:
                    held, size = [], 0
                    for row in salvage(file):
                        size += len(row.get("payload") or b"")
                        if not with_payload:
                            row.pop("payload", None)
                        held.append({"archive": name, **row})
                        if size > 8_000_000 or len(held) >= 2000:
                            yield _batch(held, names)
                            held, size = [], 0
                    yield _batch(held, names)

    n = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("archive").repartition(n).mapInArrow(run, RECORDS_DDL)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema=RECORDS)


def archive_pages(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page, repeats of a payload of ``min_bytes`` or more as revisits; return the manifest.

    The response of a payload is its row of smallest id (rows that repeat that id are responses too). A
    row without an id revisits, and is itself a response only where no row of its payload has an id.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("uri"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    firsts = (
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy(F.col("digest").alias("first_digest"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1 and first_id is not null")
    )
    rows = rows.join(firsts, rows["digest"] == firsts["first_digest"], "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    rows = rows.select(
        F.coalesce(urn(F.col("page_id")), F.lit("urn:page:none")).alias("record_id"), "uri", "payload",
        F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), urn(F.col("first_id"))).alias("refers_to"),
    )
    return write_archives(rows, work_path(pages.sparkSession, "warc"))


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages by way of their archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = read_archives(archive_pages(pages, min_bytes), with_payload=False)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return records.filter("problem is null").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )
