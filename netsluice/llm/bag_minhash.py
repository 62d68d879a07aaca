"""Near-duplicate documents by BagMinHash signatures of their word-shingle multisets.

An element of weight w owns the levels 1 to w. Levels are grouped in a hierarchy of strips, (0, 1],
(1, 2], (2, 4], (4, 8] and so on; a strip has a Poisson process of points seeded by the element and the
strip, as dense as the strip is wide; a point carries a level and a register, and counts if its level is
at most w. A register keeps its earliest point. Two multisets keep the same point with a probability
equal to their weighted Jaccard similarity, without bias. Points come in order of time, and only those
before a document's horizon, by which all its registers are all but surely filled, are ever made.

Registers are banded. Documents of one multiset are one node. Nodes that share a band are compared with
the band's first node; where parts of the band then lie in different components, all nodes of different
ones are compared in the task where they meet. The overlap of the multisets decides each link, exactly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsluice.llm.common import documents, per_block, written
from netsluice.llm.components import components

#: Words of a shingle, and the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 misses all bands with probability (1 - 0.8^3)^20, under one in a million.
BANDS, BAND_REGISTERS = 20, 3
#: Words whose hashes a worker remembers before it forgets all of them.
REMEMBERED = 250_000
#: Shingles of a block of a band, about.
SET_BLOCK = 1_000_000

GOLDEN, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))]
)
SHINGLES = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])

_known: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """From (0, 1], by the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > REMEMBERED:
        _known.clear()
    h = xxhash.xxh64_intdigest
    for w in set(words):
        if w not in _known:
            _known[w] = h(w)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def shingle_bag(text: str, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, as sorted 64-bit hashes, and their counts.

    Words stand between ASCII blanks, A to Z count as a to z. A text of fewer words than a shingle, but
    one at least, is a single shingle; a text of none has none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word_hashes(words)
    n = max(1, len(h) - size + 1)
    x = np.full(n, np.uint64(min(len(h), size)))
    for k in range(min(size, len(h))):
        x = mixed(x * GOLDEN + h[k : k + n])
    x.sort()
    new = np.ones(n, bool)
    new[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return x[at], np.diff(np.append(at, n))


def bag_digest(shingles: np.ndarray, counts: np.ndarray) -> int:
    raw = hashlib.blake2b(shingles.tobytes() + counts.astype("<i8").tobytes(), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """The earliest point of each register for each non-empty bag, one row per bag."""
    out = np.full(len(bags) * registers, np.inf)
    todo, slack = np.arange(len(bags)), 6.0
    while len(todo):
        _fill(out, todo, bags, registers, math.log(registers) + slack)
        empty = np.isinf(out.reshape(-1, registers)).any(axis=1)
        todo, slack = np.flatnonzero(empty), 2 * slack + 10
        out.reshape(-1, registers)[todo] = np.inf
    return out.reshape(-1, registers)


def _fill(out: np.ndarray, rows: np.ndarray, bags: list, registers: int, points: float) -> None:
    sizes = np.array([len(bags[i][0]) for i in rows])
    shingle = np.concatenate([bags[i][0] for i in rows])
    weight = np.concatenate([bags[i][1] for i in rows])
    total = np.array([bags[i][1].sum() for i in rows], float)
    row = np.repeat(rows, sizes)
    horizon = np.repeat(registers * points / total, sizes)
    strip = 0
    while len(shingle):
        below = 0 if strip == 0 else 1 << (strip - 1)  # the strip holds the levels below + 1 to below + width
        width = max(1, below)
        own = weight > below
        shingle, weight, row, horizon = shingle[own], weight[own], row[own], horizon[own]
        if not len(shingle):
            break
        state = mixed(shingle + np.uint64(int(GOLDEN) * (strip + 1) % 2**64))
        time = np.zeros(len(shingle))
        w, r, end = weight, row, horizon
        while len(state):
            state = mixed(state + GOLDEN)
            time = time - np.log(uniform(state)) / width
            on = time <= end
            state, time, w, r, end = state[on], time[on], w[on], r[on], end[on]
            place = mixed(state ^ MIX2)
            register = (place >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
            level = below + 1 + ((place & np.uint64(0xFFFFFFFF)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
            counts = level <= w
            np.minimum.at(out, r[counts] * registers + register[counts].astype(np.int64), time[counts])
        strip += 1


def band_keys(signature: np.ndarray, bands: int, size: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), bands, size)
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]) * GOLDEN
    for k in range(size):
        x = mixed(x ^ bits[:, :, k]) + GOLDEN
    return x.view(np.int64)


def sketches(rows: DataFrame, bands: int = BANDS, size: int = BAND_REGISTERS, words: int = WORDS) -> DataFrame:
    """doc_id, hash of the text, node (digest of the multiset, null for none), n shingles and band keys of (doc_id, text) rows."""

    def run(batch, texts):
        bags = [shingle_bag(t, words) for t in texts]
        full = [i for i, b in enumerate(bags) if len(b[0])]
        keys: list = [[]] * len(bags)
        if full:
            for i, k in zip(full, band_keys(signatures([bags[i] for i in full], bands * size), bands, size).tolist()):
                keys[i] = k
        return {
            "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "node": [bag_digest(*b) if len(b[0]) else None for b in bags],
            "n": [int(b[1].sum()) for b in bags], "bands": keys,
        }

    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(per_block(run, SKETCH), "doc_id long, text_key long, node long, n long, bands array<long>")


def shingles_of(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """node, n and the multiset of (doc_id, text, node) rows as a set: the k-th copy of a shingle has a hash of its own."""

    def run(batch, texts):
        nodes, sizes, sets = [], [], []
        for node, text in zip(batch.column("node").to_pylist(), texts):
            x, counts = shingle_bag(text, words)
            if bag_digest(x, counts) == node:  # else another row of the same id
                copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                nodes.append(node)
                sizes.append(len(copy))
                sets.append(mixed(np.repeat(x, counts) + copy.astype(np.uint64) * GOLDEN).view(np.int64))
        return {"node": nodes, "n": sizes, "shingles": sets}

    return rows.mapInArrow(per_block(run, SHINGLES), "node long, n long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose multisets overlap enough: shared / (all of u + all of v - shared)."""
    first = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    second = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(first, "u").join(second, "v")
        .withColumn("shared", shared)
        .filter(F.col("shared") >= F.lit(similarity) * (F.size("a") + F.size("b") - F.col("shared")))
        .select("u", "v")
    )


def compared_bands(members: DataFrame, of: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between nodes of one band and of different components: enough of them to join what all links join.

    Nodes are compared where their band brings them together, in blocks of about SET_BLOCK shingles that split
    large bands; a pair is compared in the first band that it shares. What leaves a task is a forest of edges.
    """
    state = members.join(of, "node", "left").select(
        "band", "place", "node", F.coalesce("component", "node").alias("component"), "n"
    )
    open_bands = (
        state.groupBy("band")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.sum("n") / SET_BLOCK).cast("int").alias("blocks"))
        .filter("low < high").select("band", "blocks")
    )
    placed = (
        state.join(open_bands, "band").join(sets.select("node", "shingles"), "node").join(nodes.select("node", "bands"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    columns = ["band", "place", "node", "component", "shingles", "bands"]
    first = placed.select(*columns, F.lit(True).alias("one"), F.col("block").alias("a"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("b"))
    second = placed.filter("block > 0").select(
        *columns, F.lit(False).alias("one"), F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("a"), F.col("block").alias("b")
    )

    def compare(batches):
        group: tuple | None = None
        rows: list[tuple] = []
        out: list[tuple[int, int]] = []
        for batch in batches:
            table = {c: batch.column(c) for c in ("band", "a", "b", "place", "node", "component", "one")}
            table = {c: x.to_pylist() for c, x in table.items()}
            for i in range(batch.num_rows):
                key = (table["band"][i], table["a"][i], table["b"][i])
                if key != group:
                    out += _group_links(group, rows, similarity)
                    group, rows = key, []
                rows.append(
                    (table["place"][i], table["node"][i], table["component"][i], table["one"][i],
                     batch.column("shingles")[i].values.to_numpy(), batch.column("bands")[i].values.to_numpy())
                )
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out + _group_links(group, rows, similarity))

    parts = first.union(second).repartition("band", "a", "b").sortWithinPartitions("band", "a", "b")
    return written(parts.mapInArrow(compare, "u long, v long"), "links")


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _group_links(group: tuple | None, rows: list[tuple], similarity: float) -> list[tuple[int, int]]:
    """Links of a block of a band with itself (a = b), or of its first rows with the others."""
    if not rows:
        return []
    root = {r[2]: r[2] for r in rows}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes, given = np.array([len(r[4]) for r in rows]), np.array([r[2] for r in rows])
    keys, one = np.stack([r[5] for r in rows]), np.array([r[3] for r in rows])
    sets: list[frozenset | None] = [None] * len(rows)
    out = []
    for i, (place, node, component, is_one, _, _) in enumerate(rows):
        if group[1] != group[2] and not is_one:
            continue
        others = np.arange(i + 1, len(rows)) if group[1] == group[2] else np.flatnonzero(~one)
        others = others[given[others] != component]
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[low >= similarity * high]
        others = others[(keys[others] == keys[i]).argmax(axis=1) == place]  # their first band in common
        for j in others.tolist():
            a, b = find(component), find(rows[j][2])
            if a != b:
                sets[i] = sets[i] or frozenset(rows[i][4].tolist())
                sets[j] = sets[j] or frozenset(rows[j][4].tolist())
                shared = len(sets[i] & sets[j])
                if shared >= similarity * (sizes[i] + sizes[j] - shared):
                    root[max(a, b)] = min(a, b)
                    out.append((node, rows[j][1]))
    return out


def near_duplicates(
    df: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, size: int = BAND_REGISTERS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, class_id (smallest id reachable by links, itself included), kept (doc_id = class_id), n_shingles, text_key.

    One row per row. A text without words, null included, links with nothing, and so does a row
    without an id: its class is its own id, and it is kept. Repeated rows share a class; those that repeat
    the id of the class are all marked kept.
    """
    rows = documents(df, id_col, text_col)
    all_sketches = written(sketches(rows, bands, size, words), "sketches")
    usable = all_sketches.filter("doc_id is not null and node is not null")
    nodes = written(
        usable.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes"
    )
    members = nodes.select("node", "n", F.posexplode("bands").alias("place", "band"))
    shared = members.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    members = written(members.join(shared.select("band", "pivot"), "band"), "band-members")
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    sets = written(shingles_of(rows.join(wanted, "doc_id"), words).dropDuplicates(["node"]), "shingles")

    # the first comparison: each member with the first node of its band; sizes rule out most others
    ratio = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)
    star = members.filter("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    sizes = sets.select("node", "n")
    star = star.join(sizes.select(F.col("node").alias("u"), F.col("n").alias("nu")), "u").join(
        sizes.select(F.col("node").alias("v"), F.col("n").alias("nv")), "v"
    )
    links = written(verified(star.filter(ratio(F.col("nu"), F.col("nv"))).select("u", "v"), sets, similarity), "links")
    of = written(components(links, "node-components"), "node-components")

    # then, where a band still holds several components, all its nodes of different ones
    found = compared_bands(members, of, nodes, sets, similarity)
    of = written(components(links.union(found), "node-components"), "node-components")

    classes = nodes.select("node", "doc_id").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    by_node = classes.join(least, "component").select(F.col("node").alias("of"), "class_id")
    marked = all_sketches.withColumn("of", F.when(F.col("doc_id").isNotNull(), F.col("node"))).join(by_node, "of", "left")
    class_id = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return marked.select(
        "doc_id", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"),
        F.col("n").alias("n_shingles"), "text_key",
    )


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``df`` that are kept, with all columns; of rows that repeat an id and a text with words, one.

    Rows without an id or without words stay.
    """
    marked = near_duplicates(df, id_col=id_col, text_col=text_col, **parameters)
    kept = marked.filter("kept and doc_id is not null and n_shingles > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_of")
    ).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = df.withColumns({"_key": F.col(id_col).cast("long"), "_text": F.xxhash64(text), "_words": text.rlike(r"[^\x20\x09-\x0D]")})
    free = F.col("_key").isNull() | ~F.col("_words")
    linked = own.filter(~free).join(kept, (F.col("_key") == F.col("_id")) & (F.col("_text") == F.col("_of")), "left_semi")
    return linked.dropDuplicates(["_key", "_text"]).select(*df.columns).union(own.filter(free).select(*df.columns))
