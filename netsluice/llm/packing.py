"""Bulk-synchronous best-fit packing of tokenised documents.

Pieces of one length are interchangeable, so the sweeps match size classes with counts, at most one
class per possible length whatever the corpus. A round sorts the classes of unplaced pieces and of gaps
by size; each class of pieces takes its successor, the smallest gap that holds it; where several classes
want one class of gaps, the longer pieces go first by rank; the gaps shrink and the next round begins.
When no gap holds any piece, new sequences open for the longest. The rounds give runs: ranks within a
length, the sequences they go to and the place there. Every piece finds its run by its own rank, which
comes from counts per task and length, so no task sees all pieces of a length.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsluice.llm.common import blocks, documents, written

#: Words whose ids a worker remembers before it forgets all of them.
REMEMBERED = 600_000
#: Words of letters that are encoded as one text.
RUNNING = 1000

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("task", pa.int32()), ("local_rank", pa.int64()),
    ]
)
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"


class WordEncoder:
    """Ids of a tokenizer that never joins across ASCII white space, remembered per word.

    White space only separates for such a tokenizer, so the ids of a text are those of its words in
    order; lower-casing A to Z first changes nothing, as the tokenizer lower-cases all letters. A
    comma or full stop behind a letter or digit is a word of its own for it. With ``added_tokens`` the
    vocabulary's added tokens are cut out first, as they are written, each as its one id; else they are text.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # of single words, which are lower-cased: an added token never is one
        self.batch = self.tokenizer.encode_batch_fast
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        added = self.tokenizer.get_added_tokens_decoder() if added_tokens else {}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that do not stand for their characters alone")
        # under a name with a blank, which no word has
        self.added = {b" " + t.content.encode(): struct.pack("<I", i) for i, t in added.items()}
        self.marks = sorted((name[1:] for name in self.added), key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, self.marks)) + b")")
        self.known: dict[bytes, bytes] = dict(self.added)

    def _words(self, text: str) -> list[bytes]:
        raw = text.encode()
        if not any(mark in raw for mark in self.marks):
            return raw.lower().split()
        parts = self.cut.split(raw)  # text and added tokens in turn
        return [w for k, part in enumerate(parts) for w in ([b" " + part] if k % 2 else part.lower().split())]

    def _direct(self, words: list[bytes]) -> None:
        """Words of letters alone go as running texts: each ends where a token with the word end does."""
        plain, other = [], []
        for word in words:
            (plain if word.decode().isalpha() else other).append(word)
        for i in range(0, len(plain), RUNNING * 16):
            texts = [plain[j : j + RUNNING] for j in range(i, min(i + RUNNING * 16, len(plain)), RUNNING)]
            encodings = self.batch([b" ".join(t).decode() for t in texts], add_special_tokens=False)
            for part, e in zip(texts, encodings):
                ids = np.array(e.ids, dtype="<u4")
                ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(ends) != len(part):  # a letter that normalisation turns into something else
                    other += part
                    continue
                raw = ids.tobytes()
                self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends))))
        for i in range(0, len(other), 20_000):
            part = other[i : i + 20_000]
            for word, e in zip(part, self.batch([w.decode() for w in part], add_special_tokens=False)):
                self.known[word] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        split = [self._words(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.known.update(self.added)
        known = self.known
        fresh = set().union(*split) - known.keys()
        if fresh:
            ends = {w: w[:-1] for w in fresh if w[-1:] in (b",", b".") and w[-2:-1].isalnum()}
            need = (fresh - ends.keys()) | (set(ends.values()) - known.keys()) | ({b",", b"."} - known.keys())
            self._direct(list(need))
            for word, stem in ends.items():
                known[word] = known[stem] + known[word[-1:]]
        look = known.__getitem__
        return [b"".join(map(look, words)) for words in split]


@lru_cache(maxsize=2)
def load(path: str, added_tokens: bool) -> WordEncoder:
    return WordEncoder(path, added_tokens)


def token_pieces(
    df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    added_tokens: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids, with a checksum and a rank among the task's pieces of that length."""

    def run(batches):
        encoder, task, seen = load(tokenizer_path, added_tokens), TaskContext.get().partitionId(), {}
        end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch, texts in blocks(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                ids += end
                for k, i in enumerate(range(0, len(ids), width)):
                    part = ids[i : i + width]
                    n = len(part) // 4
                    rank = seen[n] = seen.get(n, -1) + 1
                    rows.append((doc_id, k, i // 4, n, zlib.crc32(part), task, rank))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    return documents(df, id_col, text_col).mapInArrow(run, PIECES_DDL)


def match_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset): ranks go to sequences one by one.

    ``counts`` has a number of pieces for each length from 1 to ``capacity``.
    """
    left = {size: n for size, n in counts.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of sequences (first, how many)
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def place(size: int, first: int, n: int, free: int) -> None:
        runs.append((size, taken[size], n, first, capacity - free))
        taken[size] += n
        left[size] -= n
        if free > size:
            after.setdefault(free - size, []).append((first, n))

    while any(left.values()):
        sizes = sorted((s for s, n in left.items() if n), reverse=True)
        after: dict[int, list[tuple[int, int]]] = {}
        free_sizes = sorted(gaps)
        moved = False
        for size in sizes:  # the longer pieces have the better rank
            at = bisect_left(free_sizes, size)
            if at == len(free_sizes):
                continue
            free = free_sizes[at]  # the successor; what it can't hold waits for the next round
            queue = gaps[free]
            while queue and left[size]:
                first, n = queue.pop()
                use = min(n, left[size])
                if use < n:
                    queue.append((first + use, n - use))
                place(size, first, use, free)
                moved = True
            if not queue:
                del gaps[free]
                free_sizes.pop(at)
        if not moved:
            size = sizes[0]
            n = left[size]
            if 2 * size <= capacity:  # no gap holds a piece: as many sequences as the longest fill
                n = -(-n // (capacity // size))
            place(size, opened, n, capacity)
            opened += n
        for free, more in after.items():
            gaps.setdefault(free, []).extend(more)
    return runs


def pack(
    df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    added_tokens: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A null or empty text is a piece of the end id alone. Repeated rows are packed as often as they come;
    rows without an id too. Pieces of equal length keep the order of the input's partitions. With ``added_tokens``
    the ids are those of the tokenizer's plain call; without, an added token's characters are text.
    """
    spark = df.sparkSession
    pieces = written(token_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col, added_tokens), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(
        per_task.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "ranks"
    )
    totals = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # by length: bounded
    runs = sorted(match_rounds(totals, capacity))
    shift = 1 << 48
    table = spark.sparkContext.broadcast(
        (
            np.array([r[0] * shift + r[1] for r in runs], dtype=np.int64), np.array([r[3] - r[1] for r in runs], dtype=np.int64),
            np.array([r[4] for r in runs], dtype=np.int64),
        )
    )

    def find(batches):
        keys, shifts, places = table.value
        for batch in batches:
            cols = {f.name: batch.column(f.name) for f in batch.schema}
            rank = np.asarray(cols["local_rank"]) + np.asarray(cols["before"])
            at = np.searchsorted(keys, np.asarray(cols["length"]) * shift + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(cols[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(rank + shifts[at]), pa.array(places[at]),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(offsets.drop("n"), ["task", "length"])
    return ranked.mapInArrow(
        find, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
