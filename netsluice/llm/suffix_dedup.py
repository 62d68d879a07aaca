"""Removal of repeated byte strings by a hash-compared suffix sort.

Every window of ``length`` bytes is dealt by the least hash of the ``gram``-byte strings in it, so equal
windows meet whatever stands around them, and neighbouring windows mostly go together, as one segment.
Segments of equal content are one class: all but its first place are repeats throughout. What remains,
the first places of classes that meet others, is sorted by suffix: two suffixes are compared by a binary
search for their common extension over prefix polynomial hashes, in a merge sort that runs for all groups
side by side; strings found equal are verified byte by byte, and all but the first of them are repeats.
A key of more than ``DEALT`` windows is never held whole: its windows are dealt one by one by a 128-bit
digest of all their bytes, a task sends on one place of each, and all but the first of those are repeats.

Texts are scanned once per step and never shuffled: a text is known by its file and its row there, and
what a step has to know about the rows of a scan lies in files of the shared folder, one for each range
of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsluice.llm.common import documents, written
from netsluice.llm.shared_arrays import located, mapped, save
from netsluice.session import work_path

#: Bytes of a repeated string, and of the strings whose least hash deals it.
LENGTH, GRAM = 100, 32
#: Bytes hashed at once, windows sorted at once, and rows of a file of positions.
BLOCK, SORTED, ROWS = 1_000_000, 400_000, 1 << 14
#: Windows of a key that are sorted together; those of a larger key are dealt one by one.
DEALT = 200_000

SPANS = ["file", "row", "begin", "end"]

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, BLOCK + 1), np.uint64(base))
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE^i before each place."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data))[: len(data)], out=out[1:])
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every string of ``gram`` bytes, the same wherever it stands."""
    sums = prefix_hashes(data)
    n = len(data) - gram + 1
    return mixed((sums[gram:] - sums[:n]) * powers(INVERSE, len(data))[:n])


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima to both sides within blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64(2**64 - 1))
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def segments(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one least hash: text, start, windows, key, and whether a window may repeat within."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(bool)
    hashes = gram_hashes(data, gram)
    width = length - gram + 1
    least = window_minima(hashes, width)
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) - begin[text] + length <= sizes[text]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new & inside)
    # a run ends at the next start of any kind, or where its text has no further window
    starts = np.flatnonzero(new)
    stop = np.append(starts[1:], len(least))[np.searchsorted(starts, at)]
    stop = np.minimum(stop, begin[text[at]] + sizes[text[at]] - length + 1)
    twice = np.zeros(len(at), bool)
    step = max(1, BLOCK // width)
    offsets = np.arange(width)
    for i in range(0, len(at), step):  # one least string in the run: its first window and its last see it at one place
        a, z = at[i : i + step], stop[i : i + step] - 1
        first = (hashes[a[:, None] + offsets] == least[a][:, None]).argmax(axis=1) + a
        last = z + width - 1 - (hashes[z[:, None] + offsets[::-1]] == least[z][:, None]).argmax(axis=1)
        twice[i : i + step] = first != last
    return text[at], at - begin[text[at]], stop - at, least[at].view(np.int64), twice


# ---------------------------------------------------------------- suffix sort


class Suffixes:
    """Suffixes of a buffer, compared over ``length`` bytes by their hashes."""

    def __init__(self, data: bytes, length: int):
        self.data = np.frombuffer(data + b"\0" * length, np.uint8)
        self.length = length
        self.sums = prefix_hashes(self.data)
        self.powers = powers(BASE, len(self.data))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that two suffixes share at their start, ``length`` at most."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        first, second = np.minimum(a, b), np.maximum(a, b)
        shift = self.powers[second - first]
        at_first, at_second = self.sums[first], self.sums[second]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) >> 1
            same = (self.sums[first + mid] - at_first) * shift == self.sums[second + mid] - at_second
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)

    def below(self, a: np.ndarray, b: np.ndarray, equal: bool) -> np.ndarray:
        """Whether suffix a comes before b; what equal ones give is the caller's choice."""
        n = self.common(a, b)
        inner = np.minimum(n, self.length - 1)
        return np.where(n >= self.length, equal, self.data[a + inner] < self.data[b + inner])

    def sort(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the places by (group, suffix), stable. The first eight bytes make the first runs."""
        head = np.zeros(len(places), np.uint64)
        for k in range(min(8, self.length)):
            head = (head << np.uint64(8)) | self.data[places + k].astype(np.uint64)
        order = np.lexsort((head, group))
        g, h = group[order], head[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        begin = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, int)
        size = np.diff(np.append(np.flatnonzero(new), len(order)))[np.cumsum(new) - 1] if len(order) else begin
        run = 1
        while len(order) and run < size.max():
            at = np.flatnonzero(size > run)  # places in blocks that are not one run yet
            inside = at - begin[at]
            mine, other = inside // run, (inside // run) ^ 1
            low = np.minimum(other * run, size[at])
            high = np.minimum(low + run, size[at])
            base, start = begin[at], low.copy()
            suffix, left = places[order[at]], mine % 2 == 0
            todo = np.flatnonzero(low < high)
            while len(todo):
                mid = (low[todo] + high[todo]) >> 1
                there = places[order[base[todo] + mid]]
                # how many of the other run come before: ties go to the left run
                before = np.where(
                    left[todo], self.below(there, suffix[todo], False), self.below(there, suffix[todo], True)
                )
                low[todo] = np.where(before, mid + 1, low[todo])
                high[todo] = np.where(before, high[todo], mid)
                todo = todo[low[todo] < high[todo]]
            target = base + (np.minimum(mine, other) * run) + (inside - mine * run) + (low - start)
            fresh = order.copy()
            fresh[target] = order[at]
            order, run = fresh, 2 * run
        return order

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Byte by byte, over the whole length."""
        out = np.ones(len(a), bool)
        offsets = np.arange(self.length)
        step = max(1, 4 * BLOCK // self.length)
        for i in range(0, len(a), step):
            out[i : i + step] = (self.data[a[i : i + step, None] + offsets] == self.data[b[i : i + step, None] + offsets]).all(axis=1)
        return out


def later_copies(spans: list[bytes], counts: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For the windows of all spans in turn: whether an equal one of the group has a lower (rank, window).

    ``rank`` orders the spans' places in the corpus; spans of one text that overlap are in order there.
    """
    sizes = np.array([len(s) for s in spans], dtype=np.int64)
    start = np.cumsum(sizes) - sizes
    span = np.repeat(np.arange(len(spans)), counts)
    window = np.arange(len(span)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = start[span] + window
    suffixes = Suffixes(b"".join(spans), length)
    by_place = np.lexsort((window, rank[span]))
    order = by_place[suffixes.sort(places[by_place], group[span][by_place])]
    g, p = group[span][order], places[order]
    tie = np.flatnonzero((g[1:] == g[:-1]) & (suffixes.common(p[1:], p[:-1]) >= length))
    later = np.zeros(len(order), bool)
    later[order[tie + 1]] = suffixes.equal(p[tie + 1], p[tie])  # a stable sort keeps the first place first
    return later


# ---------------------------------------------------------------- Spark steps


def _position_files(rows: DataFrame, folder: str) -> None:
    """Write rows (file, row, then longs) as sorted arrays, a file for each ROWS rows of a file of texts."""
    columns = rows.columns

    def store(part):
        table = {c: part[c].to_numpy() for c in columns}
        order = np.lexsort((table[columns[2]], table["row"]))
        path = save(folder, "rows", {c: table[c][order] for c in columns[1:]})
        to = located(folder, table["file"][0], table["row"][0] >> ROWS.bit_length() - 1)
        system, inner = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        system.move(inner, fs.FileSystem.from_uri(to)[1] if ":/" in to else to)  # attempts write the same rows
        return pa.table({"rows": [len(order)]})

    bucket = F.shiftright("row", ROWS.bit_length() - 1).alias("bucket")
    rows.groupBy("file", bucket).applyInArrow(store, "rows long").agg(F.sum("rows")).collect()


def _positions(folder: str, file: int, row: int) -> dict[str, np.ndarray] | None:
    """The arrays of one text, if any were written."""
    arrays = _bucket(folder, file, row >> ROWS.bit_length() - 1)
    if arrays is None:
        return None
    a, z = np.searchsorted(arrays["row"], [row, row + 1])
    return {k: v[a:z] for k, v in arrays.items()} if z > a else None


_open: dict[tuple, dict | None] = {}


def _bucket(folder: str, file: int, bucket: int):
    key = (folder, file, bucket)
    if key not in _open:
        if len(_open) > 64:
            _open.clear()
        path = located(folder, file, bucket)
        system, inner = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        _open[key] = mapped.__wrapped__(path) if system.get_file_info(inner).type == fs.FileType.File else None
    return _open[key]


def _text_blocks(batches, size: int = BLOCK):
    """Lists of (file, row, doc_id) and of the texts' bytes, about ``size`` bytes at once."""
    for batch in batches:
        ids = list(zip(*(batch.column(c).to_pylist() for c in ("file", "row", "doc_id"))))
        held, texts, n = [], [], 0
        for i, raw in zip(ids, batch.column("raw")):
            held.append(i)
            texts.append(raw.as_py())
            n += len(texts[-1])
            if n >= size:
                yield held, texts
                held, texts, n = [], [], 0
        if held:
            yield held, texts


def _scan(df: DataFrame, in_place: bool, id_col: str, text_col: str) -> DataFrame:
    if not in_place:
        df = written(documents(df, id_col, text_col), "texts")
        id_col, text_col = "doc_id", "text"
    return df.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"),
    )


def removed_spans(scan: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(file, row, begin, end) of bytes to remove, overlapping and in no order, for texts of ``_scan``."""
    spark = scan.sparkSession

    def keys_only(batches):
        for ids, texts in _text_blocks(batches):
            _, _, _, key, twice = segments(texts, length, gram)
            # a run that may repeat within itself counts twice
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, key[twice]]))], names=["key"])

    counted = scan.mapInArrow(keys_only, "key long").groupBy("key").agg(F.count("*").alias("n"))
    repeated = written(counted.filter("n > 1").select("key"), "repeated-keys")

    def runs(batches):
        for ids, texts in _text_blocks(batches):
            text, start, n, key, twice = segments(texts, length, gram)
            file, row = np.array([i[0] for i in ids])[text], np.array([i[1] for i in ids])[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (key, file, row, start, n * 2 + twice)], names=["key", "file", "row", "start", "n"]
            )

    ddl = "key long, file long, row long, start long, n long"
    kept = scan.mapInArrow(runs, ddl).join(repeated, "key", "left_semi")
    folder = work_path(spark, "segments")
    _position_files(kept.select("file", "row", "start", "n", "key"), folder)

    def digests(batches):
        """What each run holds: members of one key and digest are copies of one another."""
        for ids, texts in _text_blocks(batches):
            out = []
            for (file, row, doc), raw in zip(ids, texts):
                found = _positions(folder, file, row)
                if found is not None:
                    for key, start, n in zip(found["key"].tolist(), found["start"].tolist(), found["n"].tolist()):
                        size = (n >> 1) + length - 1
                        digest = hashlib.blake2b(raw[start : start + size], digest_size=8).digest()
                        out.append((key, int.from_bytes(digest, "little", signed=True), file, row, doc, start, n))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out)], names=["key", "digest", "file", "row", "doc_id", "start", "n"]
                )

    members = written(
        scan.mapInArrow(digests, "key long, digest long, file long, row long, doc_id long, start long, n long"), "segment-members"
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "file", "row", "start")
    classes = written(
        members.groupBy("key", "digest").agg(F.min(place).alias("first"), F.max("n").alias("n"), F.count("*").alias("members")),
        "segment-classes",
    )
    many = classes.filter("members > 1").select("key", "digest", "first")
    copies = members.join(many, ["key", "digest"]).filter(
        (F.col("file") != F.col("first.file")) | (F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start"))
    )
    copies = copies.select("file", "row", F.col("start").alias("begin"), (F.col("start") + F.shiftright("n", 1) + (length - 1)).alias("end"))

    # classes that meet others of their key, or may repeat within: the suffix sort compares their first places
    met = classes.groupBy("key").agg(
        F.count("*").alias("classes"), F.max(F.col("n") % 2).alias("twice"), F.sum(F.shiftright("n", 1)).alias("windows")
    )
    met = written(met.filter("classes > 1 or twice = 1").select("key", (F.col("windows") > DEALT).cast("long").alias("large")), "met-keys")
    firsts = classes.join(met, "key").select(
        "first.file", "first.row", "first.start", (F.shiftright("n", 1) * 2 + F.col("large")).alias("n"), "key"
    )
    second = work_path(spark, "firsts")
    _position_files(firsts, second)

    def spans(batches):
        for ids, texts in _text_blocks(batches):
            out = []
            for (file, row, doc), raw in zip(ids, texts):
                found = _positions(second, file, row)
                if found is not None:
                    for key, start, n in zip(found["key"].tolist(), found["start"].tolist(), found["n"].tolist()):
                        if not n & 1:
                            out.append((key, doc, file, row, start, n >> 1, raw[start : start + (n >> 1) + length - 1]))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())],
                    names=["key", "doc_id", "file", "row", "start", "n", "span"],
                )

    def sort(batches):
        held: list[tuple] = []
        windows = 0
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if windows > SORTED and r[0] != held[-1][0]:
                    yield _later(held, length)
                    held, windows = [], 0
                held.append(r)
                windows += r[5]
        if held:
            yield _later(held, length)

    ddl = "key long, doc_id long, file long, row long, start long, n long, span binary"
    sorted_ = scan.mapInArrow(spans, ddl).repartition("key").sortWithinPartitions("key")
    found = copies.union(sorted_.mapInArrow(sort, "file long, row long, begin long, end long"))
    return found.union(_dealt_windows(scan, second, length)) if met.filter("large = 1").limit(1).count() else found


def _dealt_windows(scan: DataFrame, folder: str, length: int) -> DataFrame:
    """(file, row, begin, end) of the repeats among the windows of large keys, whose runs have an odd ``n`` in ``folder``."""

    def single(batches):
        for ids, texts in _text_blocks(batches):
            held: list[tuple] = []
            windows = 0
            for (file, row, doc), raw in zip(ids, texts):
                found = _positions(folder, file, row)
                if found is not None:
                    large = found["n"] & 1 == 1
                    for start, n in zip(found["start"][large].tolist(), (found["n"][large] >> 1).tolist()):
                        for at in range(start, start + n, SORTED):
                            part = min(SORTED, start + n - at)
                            held.append((doc, file, row, at, part, raw))
                            windows += part
                            if windows >= SORTED:
                                yield _single(held, length)
                                held, windows = [], 0
            if held:
                yield _single(held, length)

    def repeats(batches):
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            high, low = np.asarray(batch["high"]), np.asarray(batch["low"])
            again = np.asarray(batch["gone"].to_numpy(zero_copy_only=False)).copy()
            again[1:] |= (high[1:] == high[:-1]) & (low[1:] == low[:-1])
            again[0] |= before == (high[0], low[0])
            before = high[-1], low[-1]
            yield pa.RecordBatch.from_arrays([batch[c] for c in SPANS], names=SPANS).filter(pa.array(again))

    def joined(batches):
        """Spans of one text that touch, as one."""
        for batch in batches:
            if batch.num_rows:
                file, row, begin, end = (np.asarray(batch[c]) for c in SPANS)
                new = np.ones(len(row), bool)
                new[1:] = (file[1:] != file[:-1]) | (row[1:] != row[:-1]) | (begin[1:] > end[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (file[at], row[at], begin[at], np.maximum.reduceat(end, at))], names=SPANS)

    ddl = "high long, low long, gone boolean, last boolean, doc_id long, file long, row long, begin long, end long"
    places = scan.mapInArrow(single, ddl).repartition("high", "low")
    places = places.sortWithinPartitions("gone", "high", "low", "last", "doc_id", "file", "row", "begin")
    spans = places.mapInArrow(repeats, "file long, row long, begin long, end long")
    spans = spans.repartition("file", "row").sortWithinPartitions(*SPANS)
    return spans.mapInArrow(joined, "file long, row long, begin long, end long")


def _order(doc, file, row, start) -> np.ndarray:
    """Rank of each place in the corpus."""
    order = sorted(range(len(row)), key=lambda i: (doc[i] is None, doc[i] or 0, file[i], row[i], start[i]))
    rank = np.empty(len(row), np.int64)
    rank[order] = np.arange(len(row))
    return rank


def _edges(later: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of later copies within a span."""
    same = np.append(of[1:] == of[:-1], False)
    begin = np.flatnonzero(later & ~np.append(False, later[:-1] & (of[1:] == of[:-1])) if len(of) else later)
    return begin, np.flatnonzero(later & ~(np.append(later[1:], False) & same))


def _single(rows: list[tuple], length: int) -> pa.RecordBatch:
    """The first place of each different window of the rows, and as ``gone`` the runs of all others."""
    doc, file, row, start, n, raws = zip(*rows)
    digest = b"".join(
        b"".join(hashlib.blake2b(raw[i : i + length], digest_size=16).digest() for i in range(a, a + k)) for a, k, raw in zip(start, n, raws)
    )
    high, low = np.frombuffer(digest, "<i8").reshape(-1, 2).T
    counts = np.array(n)
    of = np.repeat(np.arange(len(rows)), counts)
    window = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.lexsort((window, _order(doc, file, row, start)[of], low, high))
    later = np.zeros(len(of), bool)
    later[order[1:]] = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
    first = np.flatnonzero(~later)
    begin, end = _edges(later, of)
    at = np.append(first, begin)
    span, place = of[at], np.array(start)[of[at]] + window[at]
    gone = np.arange(len(at)) >= len(first)
    rows_ = np.array(row)[span]
    stop = np.append(place[: len(first)], np.array(start)[of[end]] + window[end]) + length
    missing = np.array([d is None for d in doc])[span]
    return pa.RecordBatch.from_arrays(
        [
            # runs that are gone wait for no window: any spread will do
            pa.array(np.where(gone, rows_, high[at])), pa.array(np.where(gone, place, low[at])), pa.array(gone), pa.array(missing),
            pa.array(np.array([d or 0 for d in doc], np.int64)[span], mask=missing), pa.array(np.array(file)[span]), pa.array(rows_),
            pa.array(place), pa.array(stop),
        ],
        names=["high", "low", "gone", "last", "doc_id", *SPANS],
    )


def _later(rows: list[tuple], length: int) -> pa.RecordBatch:
    key, doc, file, row, start, n, spans = zip(*rows)
    counts = np.array(n)
    rank = _order(doc, file, row, start)
    later = later_copies(list(spans), counts, np.unique(np.array(key), return_inverse=True)[1], rank, length)
    of = np.repeat(np.arange(len(rows)), counts)
    window = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin, end = _edges(later, of)
    span = of[begin]
    at = np.array(start)[span]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(file)[span]), pa.array(np.array(row)[span]), pa.array(at + window[begin]), pa.array(at + window[end] + length)],
        names=SPANS,
    )


def _without(raw: bytes, found: dict[str, np.ndarray] | None) -> tuple[bytes, int, int]:
    """The bytes left, the number removed, and the number of removed runs."""
    if found is None:
        return raw, 0, 0
    edges = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edges, found["begin"], 1)
    np.add.at(edges, found["end"], -1)
    gone = np.cumsum(edges)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _applied(df: DataFrame, length: int, gram: int, in_place: bool, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    scan = _scan(df, in_place, id_col, text_col)
    folder = work_path(df.sparkSession, "removed")
    _position_files(removed_spans(scan, length, gram).select("file", "row", "begin", "end"), folder)
    return scan, folder


def digests_without_repeats(
    df: DataFrame, length: int = LENGTH, gram: int = GRAM, in_place: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, judged on the input.

    Order is that of doc_id, rows without an id last; rows that share an id are ordered by file and row of
    the table read, one of them being the first. A null text is empty. ``in_place`` says that
    ``df`` is a plain Parquet table, read as it is; anything else is written to the shared folder first.
    """
    scan, folder = _applied(df, length, gram, in_place, id_col, text_col)

    def run(batches):
        for ids, texts in _text_blocks(batches):
            out = []
            for (file, row, doc), raw in zip(ids, texts):
                left, gone, runs = _without(raw, _positions(folder, file, row))
                out.append((doc, len(raw), gone, runs, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in list(zip(*out))[:4]), pa.array([x[4] for x in out])],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return scan.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def texts_without_repeats(
    df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of a plain Parquet table, all its columns, with repeated bytes taken out of ``text_col``.

    A character that loses some of its bytes goes. A text that loses nothing stays as it is, null included.
    """
    scan, folder = _applied(df, length, gram, True, id_col, text_col)
    columns = [c for c in df.columns if c != text_col]
    whole = df.select(
        F.struct(*columns).alias("_rest"), F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"),
        F.col(text_col).cast("string").alias("_text"),
    )

    def run(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for i, (file, row) in enumerate(zip(batch.column("_file").to_pylist(), batch.column("_row").to_pylist())):
                found = _positions(folder, file, row)
                if found is not None:
                    texts[i] = _without(texts[i].encode(), found)[0].decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), pa.array(texts, pa.string())], names=["_rest", "_text"])

    rest = whole.schema["_rest"].dataType.simpleString()
    out = whole.mapInArrow(run, f"_rest {rest}, _text string")
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in df.columns])
