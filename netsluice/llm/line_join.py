"""Line dedup by a segment-partition edit join.

Lines within ``edits`` edits of each other agree in at least one of ``edits`` + 1 segments that the
shorter line is cut into. Each line therefore files its own segments under (length, segment, content) and
looks up, for every length it may be matched with, the few substrings whose place the edits before and
behind them allow. Lines that meet under a key are first compared by signatures of 64 bits, of which an edit can
change a few, and then verified by a banded bit-parallel edit distance, many pairs side by side. Equal lines are one
line throughout; texts are fetched for lines with a like signature alone. They are compared where they meet, in
blocks that split large keys, and what leaves are numbers of links and a forest of edges, never pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsluice.llm.common import per_block, written
from netsluice.llm.components import components

#: Edits between linked lines, and the least length of a line that links with lines not equal to it.
EDITS, MIN_CHARS = 2, 20
#: Characters of pairs that are verified side by side, and lines of a key that one task compares with as many.
BLOCK, MET = 4_000_000, 1024
#: Pairs of lines, of one key or of many, whose distances are worked out together.
TOGETHER = 8192
#: Different lines of a key that are compared by signatures in one task.
COMPARED = 16_384
#: Letters whose substrings are hashed together; a longer line stands alone.
LETTERS = 1 << 18
#: Buckets of line hashes that are broadcast at most: 8 bytes each.
HASHED = 1 << 22
#: Bits of a signature that one edit can change.
FLIPS = 4


BLANKS = " \t\n\v\f\r"
PLACES = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("line_no", pa.int32()), ("n_chars", pa.int32()),
        ("h", pa.int64()), ("h2", pa.int64()),
    ]
)
KEYS = pa.schema([("key", pa.int64()), ("tag", pa.int8()), ("h", pa.int64()), ("sign", pa.int64())])
MEETING = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("tag", pa.int8()), ("sign", pa.int64())])


def line_hash(line: bytes, seed: int = 0) -> int:
    x = xxhash.xxh64_intdigest(line, seed)
    return x - (1 << 64) if x >> 63 else x


def split_lines(text: str) -> list[tuple[int, str]]:
    """Number (from 0, blank lines counted) and content without outer blanks of each line with a word."""
    return [(k, x) for k, x in enumerate(x.strip(BLANKS) for x in text.split("\n")) if x]


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.coalesce(text, F.lit("")).alias("text")
    )


def line_places(texts: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, n_chars and two hashes of every line with a word."""

    def run(batch, texts):
        rows = []
        for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), texts):
            for k, line in split_lines(text):
                raw = line.encode()
                rows.append((doc, key, k, len(line), line_hash(raw), line_hash(raw, 1)))
        return dict(zip(PLACES.names, zip(*rows))) if rows else {n: [] for n in PLACES.names}

    return texts.mapInArrow(per_block(run, PLACES), "doc_id long, text_key long, line_no int, n_chars int, h long, h2 long")


def line_texts(texts: DataFrame, min_chars: int) -> DataFrame:
    """h and line of every line of ``min_chars`` or more; a line that a block repeats comes once from it."""

    def run(batch, texts):
        found = {line_hash(line.encode()): line for text in texts for _, line in split_lines(text) if len(line) >= min_chars}
        return {"h": list(found), "line": list(found.values())}

    return texts.mapInArrow(per_block(run, pa.schema([("h", pa.int64()), ("line", pa.string())])), "h long, line string")


def line_keys(texts: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """key, tag, h, sign of every line of ``min_chars`` or more: what it files and what it looks up.

    ``tag`` is twice the segment, and one more for a segment of the line's own; ``sign`` is :func:`signatures`'.
    """

    def run(batch, texts):
        found = {line_hash(line.encode()): line for text in texts for _, line in split_lines(text) if len(line) >= min_chars}
        h, lines, out = np.fromiter(found, np.int64, len(found)), list(found.values()), [[], [], [], []]
        size = np.cumsum([len(x) for x in lines]) if lines else np.empty(0, np.int64)
        edges = np.flatnonzero(np.diff(size // LETTERS, prepend=-1, append=-1)).tolist() if lines else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            key, tag, place, sign = keys(lines[a:b], edits)
            for column, part in zip(out, (key, tag, h[a:b][place], sign[place])):
                column.append(part)
        return {n: np.concatenate(c) if c else [] for n, c in zip(KEYS.names, out)}

    return texts.mapInArrow(per_block(run, KEYS), "key long, tag tinyint, h long, sign long")


@lru_cache(maxsize=8)
def probes(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter, segment, shift) of the substrings that a line looks up: multi-match-aware windows."""
    out = []
    for shorter in range(edits + 1):
        for segment in range(edits + 1):
            low = max(-segment, shorter - (edits - segment))
            high = min(segment, shorter + (edits - segment))
            out += [(shorter, segment, shift) for shift in range(low, high + 1)]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines, one after the other, and the n + 1 places where lines begin."""
    flat = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; those of usual blocks are kept."""
    return _usual_powers() if size <= 2 * LETTERS else _all_powers(size)


def _all_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(x))])) for x in (base, pow(base, -1, 1 << 64)))


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _all_powers(2 * LETTERS)


def keys(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, tag and line (its place) of all that the lines file and look up, and the lines' signatures.

    A key is a hash of (length, segment, substring). Substrings are hashed from running sums of letters times powers of
    an odd number, for all lines at once; equal ones have equal hashes, and others that meet are told apart
    by the comparison.
    """
    flat, at = _letters(lines)
    power, back = _powers(len(flat))
    upto = np.concatenate([[np.uint64(0)], np.cumsum((flat + np.uint64(1)) * power[: len(flat)])])
    n, parts, place = np.diff(at), edits + 1, np.arange(len(lines))
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int8)], [np.empty(0, np.int64)]]
    for shorter, segment, shift in probes(edits):
        length = n - shorter
        width, plain = length // parts, parts - length % parts  # the last segments are longer by one
        size = width + (segment >= plain)
        start = width * segment + np.maximum(0, segment - plain) + shift
        fits = np.flatnonzero((start >= 0) & (start + size <= n) & (length > 0))
        first = at[fits] + start[fits]
        content = (upto[first + size[fits]] - upto[first]) * back[first]
        key = _mixed(content ^ _mixed((length[fits] * parts + segment + 2).astype(np.uint64)))
        out[0].append(key.astype(np.int64))
        out[1].append(np.full(len(fits), 2 * segment + (shorter == 0 and shift == 0), np.int8))
        out[2].append(place[fits])
    return (*(np.concatenate(c) for c in out), signatures(flat, at))


def signatures(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits per line: for each of 64 kinds of letter pairs whether the line holds an odd number of them.

    An edit takes away and adds three or four pairs at most, so it changes at most FLIPS bits.
    """
    bits = np.zeros(len(flat) + 1, np.uint64)
    if len(flat) > 1:
        kind = (flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(58)
        bits[: len(flat) - 1] = np.uint64(1) << kind
    bits[at[1:][at[1:] > at[:-1]] - 1] = 0  # a pair over the end of a line is none
    out = np.bitwise_xor.reduceat(bits, at[:-1]) if len(at) > 1 else np.empty(0, np.uint64)
    out[at[1:] == at[:-1]] = 0
    return out.astype(np.int64)


def alike(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """For each pair of two lists of signatures whether the lines may lie within ``edits`` edits."""
    return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= FLIPS * edits


def within_edits(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Whether each pair of texts lies within ``edits`` (below 31) edits, by a band of bits along the diagonal.

    Bit 63 of a word stands for the row that is ``edits`` below the current column, lower bits for the
    rows above it. The distance follows the band's lower edge until it meets the last row, and then that
    row to the last column.
    """
    out = np.zeros(len(a), bool)
    sizes = np.array([max(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        step = max(1, min(len(order) - at, BLOCK // max(1, int(sizes[order[min(len(order) - 1, at + 4000)]]))))
        rows = order[at : at + step]
        out[rows] = _banded([a[i] for i in rows], [b[i] for i in rows], edits)
        at += step
    return out


def _codes(texts: list[str], width: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out = np.full((len(texts), width), fill, np.uint32)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out, sizes


def _banded(a: list[str], b: list[str], edits: int) -> np.ndarray:
    swap = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b)]
    width = max(len(x) for x, _ in swap) + 1
    rows, n = _codes([x for x, _ in swap], width + 2 * edits, 0xFFFFFFFF)  # rows: the longer text
    columns, m = _codes([y for _, y in swap], width, 0xFFFFFFFE)
    result = np.zeros(len(swap), bool)
    short = n <= edits  # no longer than the edits themselves: the longer text alone bounds them
    result[short] = True
    live = np.flatnonzero(~short & (n - m <= edits))
    u, one = np.uint64, np.uint64(1)
    vp = np.full(len(live), ~u(0) << u(63 - edits), np.uint64)
    vn = np.zeros(len(live), np.uint64)
    distance = np.full(len(live), edits)
    edge = np.full(len(live), 62)  # the bit of the last row, once the band has passed it
    column = 0
    while len(live):
        done = m[live] <= column
        if done.any():
            result[live[done]] = distance[done] <= edits
            on = ~done
            live, vp, vn, distance, edge = live[on], vp[on], vn[on], distance[on], edge[on]
            if not len(live):
                break
        match = np.zeros(len(live), np.uint64)
        letter = columns[live, column]
        for offset in range(-edits, edits + 1):
            row = column + offset
            if row >= 0:
                match |= (rows[live, row] == letter).astype(np.uint64) << u(63 - edits + offset)
        diagonal = (((match & vp) + vp) ^ vp) | match | vn
        rise = vn | ~(diagonal | vp)
        fall = diagonal & vp
        down = column + edits < n[live]  # the lower edge is still a row of the text
        distance += np.where(down, (diagonal >> u(63) == 0).astype(np.int64), 0)
        shift = edge.astype(np.uint64)
        across = ((rise >> shift) & one).astype(np.int64) - ((fall >> shift) & one).astype(np.int64)
        distance += np.where(down, 0, across)
        edge -= ~down
        vp = fall | ~((diagonal >> one) | rise)
        vn = (diagonal >> one) & rise
        column += 1
        # on the last row the distance falls by at most one a column, and there are at most 2 * edits of these
        hopeless = distance > edits + np.minimum(2 * edits, m[live] - column)
        if hopeless.any():
            on = ~hopeless
            live, vp, vn, distance, edge = live[on], vp[on], vn[on], distance[on], edge[on]
    return result


def first_segment(short: str, long: str, edits: int) -> int:
    """The first segment of the shorter line that the longer one looks up with success; more than all if none."""
    n, shorter, parts = len(short), len(long) - len(short), edits + 1
    base, plain = n // parts, parts - n % parts
    for segment in range(parts):
        size = base + (segment >= plain)
        start = base * segment + max(0, segment - plain)
        content = short[start : start + size]
        low = max(-segment, shorter - (edits - segment))
        high = min(segment, shorter + (edits - segment))
        if any(start + k >= 0 and long[start + k : start + k + size] == content for k in range(low, high + 1)):
            return segment
    return parts


def linked_here(own: list[tuple[int, int, str]], looking: list[tuple[int, int, str]], segment: int, edits: int):
    """Pairs (place in own, place in looking) of the lines (h, sign, text) of a key that are links and are first met here.

    Of lines of one length the smaller hash is the filed one; a pair that an earlier segment brings together
    is left to that segment's key, so every link is found once. Signatures leave few pairs to look at.
    """
    if not own or not looking:
        return
    signs = [np.array([x[1] for x in side], np.int64) for side in (own, looking)]
    for i, j in zip(*np.nonzero(alike(*signs, edits))):
        (u, _, x), (v, _, y) = own[i], looking[j]
        if (len(x) < len(y) or u < v) and u != v and first_segment(x, y, edits) == segment:
            yield int(i), int(j)


def meetings(rows: DataFrame, edits: int) -> DataFrame:
    """The rows of :func:`line_keys` whose line may be near another one of its key, each (key, h) once.

    Rows move once, to the task of their key, with a signature instead of a text. Lines of a key are compared there by
    signatures; those of a key of more than COMPARED different lines are all passed on, to be compared in blocks.
    """

    sorted_ = rows.repartition("key").sortWithinPartitions("key", "h")
    return sorted_.mapInArrow(lambda batches: _meet(batches, edits), "key long, h long, tag tinyint, sign long")


def _meet(batches, edits: int):
    """The batches of a task, sorted by key and h, key by key."""
    held = None
    for batch in batches:
        part = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in MEETING.names])
        held = part if held is None else np.concatenate([held, part], axis=1)
        last = np.searchsorted(held[0], held[0, -1])  # the rows of the last key may go on
        if last:
            yield from _met(held[:, :last], edits)
            held = held[:, last:]
        elif held.shape[1] > 4 * COMPARED:
            held = _once(held)
            if held.shape[1] > 2 * COMPARED:  # a large key: its lines go on as they come, some of them twice
                yield _rows(held)
                held = held[:, -COMPARED - 1 :]
    if held is not None:
        yield from _met(held, edits)


def _once(rows: np.ndarray) -> np.ndarray:
    """Each (key, h) once, with the tag of its own segment if it has it; rows are sorted by both."""
    new = np.flatnonzero((np.diff(rows[0], prepend=rows[0, 0] - 1) != 0) | (np.diff(rows[1], prepend=rows[1, 0] - 1) != 0))
    out = rows[:, new].copy()
    out[2] = np.maximum.reduceat(rows[2], new)
    return out


def _met(rows: np.ndarray, edits: int):
    """What :func:`meetings` passes on of whole keys."""
    rows = _once(rows)
    starts = np.flatnonzero(np.diff(rows[0], prepend=rows[0, 0] - 1) != 0)
    sizes = np.diff(np.append(starts, rows.shape[1]))
    filed = np.add.reduceat(rows[2] & 1, starts)
    keep = np.zeros(rows.shape[1], bool)
    for k in np.flatnonzero((sizes > 1) & (filed > 0)):
        at = slice(starts[k], starts[k] + sizes[k])
        if sizes[k] > COMPARED:
            keep[at] = True
            continue
        sign = rows[3, at]
        own = np.flatnonzero(rows[2, at] & 1)
        for first in range(0, len(own), MET):
            some = own[first : first + MET]
            near = alike(sign[some], sign, edits)
            near[np.arange(len(some)), some] = False
            keep[at.start + some] |= near.any(axis=1)
            keep[at] |= near.any(axis=0)
    if keep.any():
        yield _rows(rows[:, keep])


def _rows(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(rows, MEETING)], schema=MEETING)


def near_lines(texts: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Links between different lines within ``edits`` edits; ``texts`` has a column text.

    Returns edges (u, v) between hashes that join exactly the lines that links join, a few per line, and
    (node, n_links) with the number of all links of each line.
    """
    meeting = meetings(line_keys(texts, edits, min_chars), edits)
    # a line of a large key may come twice
    meeting = meeting.groupBy("key", "h").agg(F.max("tag").alias("tag"), F.first("sign").alias("sign"))
    segment, own = F.shiftright("tag", 1).cast("int").alias("segment"), (F.col("tag") % 2 == 1).alias("own")
    meeting = written(meeting.select("key", segment, "h", own, "sign"), "line-meetings")
    # at most HASHED buckets are broadcast; a text in none of them is in no meeting and does not move
    bucket = F.pmod("h", F.lit(HASHED)).alias("bucket")
    wanted = F.broadcast(meeting.select(bucket).distinct())
    contents = line_texts(texts, min_chars).withColumn("bucket", bucket).join(wanted, "bucket", "left_semi").drop("bucket")
    contents = contents.join(meeting.select("h").distinct(), "h", "left_semi")
    contents = written(contents.dropDuplicates(["h"]), "line-texts")
    # a key of many lines is cut into blocks, and every block of its own lines meets every block of all
    blocks = meeting.groupBy("key").agg(F.ceil(F.count("*") / MET).cast("int").alias("blocks"))
    placed = meeting.join(blocks, "key").join(contents, "h").withColumn("block", F.pmod(F.xxhash64("h", F.lit("block")), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.filter("own").select("key", "segment", "h", "sign", "line", F.lit(True).alias("filed"), F.col("block").alias("a"), others.alias("b"))
    dealt = dealt.union(placed.select("key", "segment", "h", "sign", "line", F.lit(False).alias("filed"), others.alias("a"), F.col("block").alias("b")))

    parts = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    linked = written(parts.mapInArrow(lambda batches: _compared(batches, edits), "node long, n long, root long"), "line-links")
    return linked.select(F.col("node").alias("u"), F.col("root").alias("v")), linked.groupBy("node").agg(F.sum("n").alias("n_links"))


def _compared(batches, edits: int):
    """The links of a task's keys: (node, number of links, root of a forest). Pairs of many keys are verified side by side."""
    place, segment, own, looking, pairs = None, 0, [], [], []

    def met():
        for i, j in linked_here(own, looking, segment, edits):
            pairs.append((own[i], looking[j]))
            if len(pairs) >= TOGETHER:
                yield _linked(pairs, edits)
                pairs.clear()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "a", "b", "segment", "h", "sign", "line", "filed")]
        for key, a, b, part, h, sign, line, is_filed in zip(*columns):
            if (key, a, b) != place:
                yield from met()
                place, segment, own, looking = (key, a, b), part, [], []
            (own if is_filed else looking).append((h, sign, line))
    yield from met()
    yield _linked(pairs, edits)


def _linked(pairs: list[tuple], edits: int) -> pa.RecordBatch:
    near = within_edits([x[2] for x, _ in pairs], [y[2] for _, y in pairs], edits)
    degree: dict[int, int] = {}
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for ((u, _, _), (v, _, _)), ok in zip(pairs, near):
        if ok:
            degree[u] = degree.get(u, 0) + 1
            degree[v] = degree.get(v, 0) + 1
            root[find(u)] = find(v)
    columns = [list(degree), list(degree.values()), [find(x) for x in degree]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "n", "root"])


def deduplicated_lines(
    df: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per line with a word: doc_id, line_no, n_chars, first_doc_id, first_line_no, n_links, kept, text_key.

    The first place is that of the smallest (doc_id, line_no) among the lines that links or equality
    reach; rows without an id come last. n_links counts the different lines linked directly. kept marks the
    first place. Null and blank texts have no lines. Rows that repeat an id and a text are one document.
    """
    texts = _texts(df, id_col, text_col)
    found = written(line_places(texts), "line-places")
    links, degree = near_lines(texts, edits, min_chars)
    place = lambda: F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no"))
    distinct = written(found.groupBy("h", "h2").agg(place().alias("first")), "distinct-lines")
    linked = components(links, "line-components").join(degree, "node")  # every linked line has a degree
    linked = written(linked, "linked-lines")
    firsts = (
        distinct.join(linked, distinct["h"] == linked["node"]).groupBy("component")
        .agg(F.min("first").alias("class_first"))
    )
    classes = linked.join(firsts, "component").select(F.col("node").alias("h"), "class_first", "n_links")
    of = distinct.join(classes, "h", "left").select(
        "h", "h2", F.coalesce("class_first", "first").alias("first"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )
    rows = found.join(of, ["h", "h2"])
    return rows.select(
        "doc_id", "line_no", "n_chars", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"),
        "n_links", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"),
        "text_key",
    )


def without_repeats(df: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with repeated lines taken out of their texts; a row whose every line goes is left out.

    Blank lines stay where they are. A row that had no line with a word is kept as it is.
    """
    marked = deduplicated_lines(df, edits, min_chars, id_col, text_col)
    removed = (
        marked.dropDuplicates(["doc_id", "text_key", "line_no"])
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(
            F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("line_no")))).alias("_gone"),  # the lines of one document
            F.max("kept").alias("_some"),
        )
    )
    own_key = F.xxhash64(F.col(text_col).cast("string"))
    joined = df.withColumn("_own", own_key).join(
        removed, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left"
    )
    numbered = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    gone = F.map_from_arrays("_gone", "_gone")
    left = F.transform(F.filter(numbered, lambda s: ~F.map_contains_key(gone, s["i"])), lambda s: s["x"])
    text = F.when(F.size("_gone") > 0, F.array_join(left, "\n")).otherwise(F.col(text_col))
    out = joined.filter(F.coalesce("_some", F.lit(True)))
    return out.withColumn("_text", text).select(*[F.col("_text").alias(c) if c == text_col else F.col(c) for c in df.columns])
