"""Archives written, damaged and read again."""

import base64
import hashlib
import io
import os

import pyarrow as pa
import pytest

from netsluice.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, h in rows:
        f = first.get(h or "")
        n = len((h or "").encode())
        revisit = f is not None and i != f and n >= least
        out.append((i, n, digest(h), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (5, "<p>é</p>"), (3, "<p>é</p>"), (9, "<p>é</p>"), (4, None), (6, ""), (7, "x" * 300_000), (8, "x" * 300_000), (10, "WARC/1.1\r\n\r\n"),
    (11, "lone"), (3, "<p>é</p>"), (None, "lone"), (None, "nobody"), (12, "\x1f\x8b\x08 not a member"),
]


@pytest.mark.parametrize("least", [0, 4, 100])
def test_pages(spark, least):
    df = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y" if i else None, h, "r", 1) for i, h in ROWS],
                               "page_id long, url string, html string, record_id string, digest int")
    got = sorted((tuple(r) for r in warc.archived_pages(df, least).collect()), key=str)
    assert got == brute(ROWS, least)


def test_empty(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def archive(zipped, n=6):
    parts = [warc.record(f"urn:page:{k}", None, f"payload {k} ".encode() * (5 + k), None, "2024-01-01T00:00:00Z") for k in range(n)]
    return [warc.gzip_member(p) if zipped else p for p in parts]


def read(data):
    return list(warc.salvage(pa.PythonFile(io.BytesIO(data), "r")))


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    parts = archive(zipped)
    whole = read(b"".join(parts))
    assert [r["record_id"] for r in whole] == [f"urn:page:{k}" for k in range(6)] and not any("problem" in r for r in whole)
    places = [sum(map(len, parts[:k])) for k in range(7)]

    def ids(rows):
        return [int(r["record_id"][9:]) for r in rows if "problem" not in r]

    def gaps(rows):
        return [(r["offset"], r["length"]) for r in rows if "problem" in r]

    # a damaged byte within record 2
    data = bytearray(b"".join(parts))
    data[places[2] + len(parts[2]) // 2] ^= 0xFF
    rows = read(bytes(data))
    assert ids(rows) == [0, 1, 3, 4, 5] and gaps(rows) == [(places[2], len(parts[2]))]
    # record 4 cut short, junk before the first and behind the last
    junk = os.urandom(40).replace(b"\x1f", b"a").replace(b"W", b"a")
    data = junk + b"".join(parts[:4]) + parts[4][:-30] + parts[5] + junk
    rows = read(data)
    assert ids(rows) == [0, 1, 2, 3, 5] and len(gaps(rows)) == 3 and gaps(rows)[0] == (0, 40)
    assert sum(n for _, n in gaps(rows)) == 80 + len(parts[4]) - 30
    # nothing but junk, nothing at all, an archive cut within its last record
    assert ids(read(junk)) == [] and gaps(read(junk)) == [(0, 40)] and read(b"") == []
    rows = read(b"".join(parts)[:-5])
    assert ids(rows) == [0, 1, 2, 3, 4] and gaps(rows) == [(places[5], len(parts[5]) - 5)]


def test_archives_roll(spark):
    df = spark.createDataFrame([(f"urn:page:{k}", None, os.urandom(3000), None) for k in range(40)],
                               "record_id string, uri string, payload binary, refers_to string").coalesce(1)
    from netsluice.session import work_path

    manifest = warc.write_archives(df, work_path(spark, "warc"), archive_bytes=20_000)
    assert manifest.count() > 5
    assert warc.read_archives(manifest).filter("problem is null").count() == 40
