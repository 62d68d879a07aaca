"""Byte-level BPE over length-bucketed padded matrices, and the way back to bytes.

Every piece of a text is a row of byte ranks. Rows of like length share a matrix; in each round every
row merges its leftmost pair of least rank and moves the rest one place left, and rows without a pair
leave. Pair ranks come from a hash table of (left, right) kept in two numpy arrays. A worker keeps the
ids of pieces it has met in a bounded memory, so a piece is merged about once per task.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from netsluice.llm.common import documents, per_block

#: No pair.
NONE = np.int32(2**31 - 1)
#: Cells of one matrix.
CELLS = 1_000_000
#: Pieces that a worker remembers before it forgets all of them.
REMEMBERED = 250_000

ENCODED = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
)
DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


class PairTable:
    """(left rank, right rank) to merged rank: open addressing with linear probing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.uint64)
        values = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        bits = max(4, int(4 * max(1, len(pairs))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE)
        slots = self._slots(keys)
        while len(keys):
            free = self.values[slots] == NONE
            place = np.flatnonzero(free)
            _, first = np.unique(slots[place], return_index=True)
            put = place[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + np.uint64(1)) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        found = np.full(len(keys), NONE)
        open_rows, slots = np.arange(len(keys)), self._slots(keys)
        while len(open_rows):
            at, values = self.keys[slots], self.values[slots]
            hit = at == keys[open_rows]
            found[open_rows[hit]] = values[hit]
            on = ~hit & (values != NONE)
            open_rows, slots = open_rows[on], (slots[on] + np.uint64(1)) & self.mask
        return found


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ranks = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pairs = PairTable(
            {
                (ranks[token[:i]], ranks[token[i:]]): rank
                for token, rank in ranks.items()
                for i in range(1, len(token))
                if token[:i] in ranks and token[i:] in ranks
            }
        )
        self.known: dict[str, bytes] = {}

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes, packed as little-endian unsigned 32-bit integers."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        cells = self.byte_ranks[raw]
        at = np.arange(width)
        pad = at[None, :] >= sizes[:, None]
        cells[pad] = -1
        best = np.full((n, width), NONE)
        if width > 1:
            real = ~pad[:, 1:]
            best[:, :-1][real] = self.pairs.ranks(cells[:, :-1][real], cells[:, 1:][real])
        rows, out = np.arange(n), [b""] * n
        while len(rows):
            where = best.argmin(axis=1)
            index = np.arange(len(rows))
            rank = best[index, where]
            done = rank == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = cells[i, : sizes[i]].astype("<u4").tobytes()
                on = ~done
                rows, cells, best, sizes, where, rank = rows[on], cells[on], best[on], sizes[on], where[on], rank[on]
                if not len(rows):
                    break
                index = np.arange(len(rows))
                width = int(sizes.max())
                cells, best, at = cells[:, :width], best[:, :width], at[:width]
            moved = at[None, :-1] > where[:, None]
            cells[:, :-1] = np.where(moved, cells[:, 1:], cells[:, :-1])
            best[:, :-1] = np.where(moved, best[:, 1:], best[:, :-1])
            cells[:, -1], best[:, -1] = -1, NONE
            cells[index, where] = rank
            sizes = sizes - 1
            best[index, where] = NONE
            right = np.flatnonzero(where + 1 < sizes)
            best[right, where[right]] = self.pairs.ranks(cells[right, where[right]], cells[right, where[right] + 1])
            left = np.flatnonzero(where > 0)
            best[left, where[left] - 1] = self.pairs.ranks(cells[left, where[left] - 1], cells[left, where[left]])
        return out

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of new pieces into the memory, one matrix per range of lengths."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            else:
                buckets.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                for (piece, _), ids in zip(part, self._merge([raw for _, raw in part], width)):
                    self.known[piece] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = set().union(*split) - self.known.keys()
        if fresh:
            self.learn(sorted(fresh))
        look = self.known.__getitem__
        return [b"".join(map(look, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(ranks_path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file; a Python worker builds it once."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return ByteBpe(ranks, pattern)


def encoded(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the packed ids of every row's whole text.

    Rows stay as they are: repeated rows and null ids give a row each, a null or empty text has no ids.
    """

    def encode(batch, texts):
        ids = load(ranks_path, pattern).encode(texts)
        return {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    return documents(df, id_col, text_col).mapInArrow(per_block(encode, ENCODED), "doc_id long, n_tokens long, ids binary")


def decoded(ids: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that the packed ids of ``encoded`` stand for."""

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "raw": [bpe.decode(x or b"") for x in part.column("ids").to_pylist()]},
                    schema=pa.schema([("doc_id", pa.int64()), ("raw", pa.binary())]),
                )

    return ids.mapInArrow(run, "doc_id long, raw binary")


def round_trip_digests(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode, decode again, and return both digests per row without moving ids between processes."""

    def run(batch, texts):
        bpe = load(ranks_path, pattern)
        ids = bpe.encode(texts)
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
        }

    return documents(df, id_col, text_col).mapInArrow(
        per_block(run, DIGESTS), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
