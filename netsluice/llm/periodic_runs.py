"""Periodic runs of words, found by common extensions over a recompression grammar, and texts without the repeats.

A run is a longest stretch of words of one smallest period whose length is at least LEAST_LENGTH words and
LEAST_PERIODS periods. In it, words one period apart are equal at (LEAST_PERIODS - 1) * period places in a row, so for
every period a grid of that spacing over the words meets each run. At grid places where two words one period
apart are equal, the common extensions forth and back of these two places give the run's exact ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsluice.llm.byte_arrays import byte_blocks, is_space, text_bytes, texts_of
from netsluice.llm.common import documents
from netsluice.llm.grammar import Grammar

LEAST_LENGTH, LEAST_PERIODS = 6, 4

#: Extensions asked for at once.
QUERIES = 1 << 18

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
DDL = "doc_id long, n long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, first byte and size of every word, and the number of words before each text (n + 1 numbers).

    Equal words have equal numbers: they are told apart by their bytes.
    """
    if not len(raw):
        none = np.empty(0, np.int64)
        return none, none, none, np.zeros(len(at), np.int64)
    space = is_space(raw)
    inner = ~space
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begins = np.flatnonzero(inner & (np.concatenate([[True], space[:-1]]) | edge[:-1]))
    stops = np.flatnonzero(inner & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1
    places = np.concatenate([[0], np.cumsum(stops - begins)])
    letters = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(raw[inner])])
    numbers = letters.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers, begins, stops - begins, np.searchsorted(begins, at, "left")


def _candidates(words: np.ndarray, longest: int, least_periods: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places and periods at which words one period apart are equal, in portions."""
    held, places, periods = 0, [], []
    for q in range(1, longest // least_periods + 1):
        grid = (least_periods - 1) * q
        hits = np.flatnonzero(words[: len(words) - q : grid] == words[q::grid]) * grid
        if len(hits):
            places.append(hits)
            periods.append(np.full(len(hits), q))
            held += len(hits)
        if held >= QUERIES:
            yield np.concatenate(places), np.concatenate(periods)
            held, places, periods = 0, [], []
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def find_runs(
    numbers: np.ndarray, before: np.ndarray, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, by text, start and period.

    ``numbers`` are the words of all texts, ``before`` the number of words before each text (n + 1 numbers).
    """
    texts = len(before) - 1
    ends = np.arange(1, texts + 1)
    letters = np.insert(numbers, before[1:], -ends)  # each text ends with a letter of its own
    begin = before[:-1] + np.arange(texts)
    longest = int(np.diff(before).max(initial=0))
    found = [np.empty((0, 3), np.int64)]
    if longest >= max(least_length, least_periods):
        grammar = Grammar(letters)
        for i, q in _candidates(letters, longest, least_periods):
            start = i - grammar.backward(i - 1, i + q - 1)
            stop = i + q + grammar.forward(i, i + q)
            long = stop - start >= np.maximum(least_length, least_periods * q)
            found.append(np.unique(np.stack([start, stop, q], axis=1)[long], axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # one stretch is found under all multiples of its period: the least comes first
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    start, stop, q = runs[new].T
    order = np.lexsort([q, start])
    start, stop, q = start[order], stop[order], q[order]
    text = np.searchsorted(begin, start, "right") - 1
    return text, start - begin[text], stop - start, q


def _collapsed(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, before: np.ndarray, dropped: np.ndarray) -> pa.Array:
    """The words that are kept, one space between them."""
    kept = np.flatnonzero(~dropped)
    bounds = np.searchsorted(kept, before)
    gap = np.ones(len(kept), np.int64)
    gap[bounds[1:][np.diff(bounds) > 0] - 1] = 0
    size = sizes[kept] + gap
    places = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(places[-1]) + np.repeat(begins[kept] - places[:-1], size)
    out = raw[np.minimum(source, max(len(raw) - 1, 0))]
    out[places[1:][gap == 1] - 1] = 0x20
    return texts_of(out, places[bounds])


def _runs(batches: Iterator[pa.RecordBatch], least_length: int, least_periods: int) -> Iterator[pa.RecordBatch]:
    for batch in byte_blocks(batches, "text"):
        raw, at = text_bytes(batch.column("text"))
        numbers, begins, sizes, before = words_of(raw, at)
        text, start, length, period = find_runs(numbers, before, least_length, least_periods)
        cover = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(cover, before[text] + start + period, 1)
        np.add.at(cover, before[text] + start + length, -1)
        dropped = np.cumsum(cover[:-1]) > 0
        runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(RUN))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(at))), pa.int32()), runs)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(before)), lists, _collapsed(raw, begins, sizes, before, dropped)], schema=SCHEMA
        )


def periodic_runs(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n, runs, collapsed) per row: number of words, its runs by start and period, the text without repeats.

    A word goes where some run contains it after that run's first period; the others are joined by one space.
    A null, empty or blank text has no words, no runs and an empty text. Rows of equal ids are looked at one
    by one and all returned, an empty table gives no row, and no other column of ``docs`` is read. A text
    is worked on whole, however long, in memory of about 100 times its bytes where it is longer than a block.
    """
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    rows = documents(docs, id_col, text_col)
    return rows.mapInArrow(lambda batches: _runs(batches, least_length, least_periods), DDL)


def with_cycles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): in a tenth of the rows, by a checksum of the id, words from some place on go round in a cycle.

    With h the checksum and g = h // 10, a text of n words with h % 10 = 0 repeats, from word a = g % n on, the
    1 + (n - a) // (3 + g % 8) words from there, and its words are joined by one space. Other texts stay as
    they are; a null text is empty, and a null id has no checksum.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = documents(docs, id_col, text_col).select("doc_id", "text", F.floor(h / 10).alias("g"), chosen.alias("words"))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))

    def cycled(word: Column, i: Column) -> Column:
        back = F.col("a") + (i - F.col("a")) % F.col("p")
        return F.when(i < F.col("a"), word).otherwise(F.get("words", back.cast("int")))

    made = F.array_join(F.transform("words", cycled), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""

    def order(a: Column, b: Column) -> Column:
        exponent = b["length"] * a["period"] - a["length"] * b["period"]
        return F.signum(F.when(exponent != 0, exponent).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
