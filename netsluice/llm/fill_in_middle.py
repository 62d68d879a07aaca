"""Fill-in-middle: texts cut in three and put together anew by displaced bytes, and put back.

A block of texts is one array of bytes. A scan finds the ends of its tokens; the cuts of every text make a
difference array, whose running sum tells each byte how far it moves; one scatter writes all outputs of the
block. Restoring finds the three marks in the outputs, makes the same kind of difference array and gathers the
bytes back.

A token is ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+`` or, at the end of a text, white space alone. White space
is ASCII, so bytes give the same tokens as code points do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsluice.llm.byte_arrays import byte_blocks, is_space, text_bytes, texts_of
from netsluice.llm.common import documents

#: Marks of prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]
#: Output order of the parts 0 prefix, 1 middle, 2 suffix, each behind its mark.
ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
MARK_OF = (MARKS[0], MARKS[2], MARKS[1])

TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def token_ends(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens end, over all texts, and the number of tokens before each text (n + 1 numbers)."""
    space = is_space(raw)
    last = np.zeros(len(raw), bool)
    if len(raw):
        last[:-1] = space[1:]
        last &= ~space
        last[at[1:][at[1:] > at[:-1]] - 1] = True  # a text's last byte ends a token of either kind
    ends = np.flatnonzero(last) + 1
    return ends, np.searchsorted(ends, at, "right") if len(raw) else np.zeros(len(at), np.int64)


def mark_places(raw: np.ndarray) -> list[np.ndarray]:
    """Where each mark stands, over all bytes."""
    if len(raw) < 3:
        return [np.empty(0, np.int64)] * 3
    open_ = (raw[:-2] == ord("<")) & (raw[2:] == ord(">"))
    return [np.flatnonzero(open_ & (raw[1:-1] == mark[1])) for mark in MARKS]


def holds_mark(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text holds a mark; what reaches over the end of a text does not count."""
    found = np.concatenate(mark_places(raw))
    text = np.searchsorted(at, found, "right") - 1
    held = np.zeros(len(at) - 1, bool)
    held[text[found + 3 <= at[text + 1]]] = True
    return held


def displaced(starts: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """How far each of ``size`` bytes moves: parts begin at ``starts`` (ascending) and move by ``shifts``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, np.diff(shifts, prepend=0))
    return np.cumsum(steps[:-1])


def scatter(raw: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of texts cut at the byte places ``first`` <= ``second``, in their forms."""
    sizes = np.stack([first - at[:-1], second - first, at[1:] - second])  # prefix, middle, suffix
    out_at = np.concatenate([[0], np.cumsum(np.diff(at) + np.where(form == PLAIN, 0, 9))])
    new = np.stack([out_at[:-1], out_at[:-1] + sizes[0], out_at[:-1] + sizes[0] + sizes[1]])  # plain: nothing moves apart
    out = np.empty(out_at[-1], np.uint8)
    for kind, order in ORDER.items():
        rows = np.flatnonzero(form == kind)
        place = out_at[rows]
        for part in order:
            for k, byte in enumerate(MARK_OF[part]):
                out[place + k] = byte
            new[part, rows] = place + 3
            place = place + 3 + sizes[part, rows]
    starts = np.stack([at[:-1], first, second])
    shift = displaced(starts.T.ravel(), (new - starts).T.ravel(), len(raw))
    out[np.arange(len(raw)) + shift] = raw
    return out, out_at


def gather(out: np.ndarray, out_at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, from outputs and forms alone."""
    size = np.diff(out_at)
    begin = np.stack([out_at[:-1], out_at[1:], out_at[1:]])  # where prefix, middle, suffix begin in the output
    length = np.stack([size, np.zeros_like(size), np.zeros_like(size)])
    marked = np.flatnonzero(form != PLAIN)
    prefix, suffix, middle = (f[np.searchsorted(f, out_at[marked])] + 3 if len(marked) else marked for f in _own_marks(out, out_at, form))
    begin[:, marked] = np.stack([prefix, middle, suffix])
    for kind, order in ORDER.items():
        rows = np.flatnonzero(form == kind)
        for part, after in zip(order, order[1:] + (None,)):
            stop = out_at[rows + 1] if after is None else begin[after, rows] - 3
            length[part, rows] = stop - begin[part, rows]
    at = np.concatenate([[0], np.cumsum(length.sum(axis=0))])
    starts = np.stack([at[:-1], at[:-1] + length[0], at[:-1] + length[0] + length[1]])
    shift = displaced(starts.T.ravel(), (begin - starts).T.ravel(), int(at[-1]))
    return out[np.arange(at[-1]) + shift], at


def _own_marks(out: np.ndarray, out_at: np.ndarray, form: np.ndarray) -> list[np.ndarray]:
    """Places of the marks of outputs that are not plain: each of them holds each mark once."""
    kept = []
    for found in mark_places(out):
        text = np.searchsorted(out_at, found, "right") - 1
        kept.append(found[(form[text] != PLAIN) & (found + 3 <= out_at[text + 1])])
    return kept


def _transform(batches: Iterator[pa.RecordBatch], plain_below: int, spm_below: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in byte_blocks(batches, "text"):
        raw, at = text_bytes(batch.column("text"))
        ends, before = token_ends(raw, at)
        n = np.diff(before)
        draw = [batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)]
        form = np.where(draw[3] % 100 < spm_below, SPM, PSM)
        form[(n == 0) | (draw[2] % 100 >= plain_below) | holds_mark(raw, at)] = PLAIN
        a, b = draw[0] % (n + 1), draw[1] % (n + 1)
        edge = np.concatenate([[0], ends])  # the end of no token, then of each
        cuts = []
        for units in (np.minimum(a, b), np.maximum(a, b)):
            cut = edge[before[:-1] + units]
            cuts.append(np.where((units == 0) | (form == PLAIN), at[:-1], cut))
        out, out_at = scatter(raw, at, cuts[0], cuts[1], form)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        plain = form == PLAIN
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n.astype(np.int64)),
                pa.DictionaryArray.from_arrays(pa.array(form.astype(np.int32)), FORMS).cast(pa.string()),
                pa.array(chars[cuts[0]] - chars[at[:-1]], pa.int64(), mask=plain),
                pa.array(chars[cuts[1]] - chars[cuts[0]], pa.int64(), mask=plain),
                texts_of(out, out_at),
            ],
            schema=schema,
        )


def _restore(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in byte_blocks(batches, "output"):
        out, out_at = text_bytes(batch.column("output"))
        form = pc.index_in(batch.column("form"), pa.array(FORMS)).to_numpy(zero_copy_only=False)
        restored = texts_of(*gather(out, out_at, form))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), restored], schema=schema)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and id; a null id stands as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def transformed(
    docs: DataFrame, seed: int = 42, plain_below: int = 50, spm_below: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: number of tokens, form, sizes of prefix and middle, and the output text.

    A text is transformed where its third draw modulo 100 is below ``plain_below``, it is not empty and holds
    none of the marks; it takes the form ``spm`` where the fourth modulo 100 is below ``spm_below``, else ``psm``.
    The smaller of the first two draws modulo n + 1 is the number of tokens of the prefix, the larger that of
    prefix and middle.

    A null text is empty, and an empty text plain with n = 0. Rows of equal ids get equal draws and are all
    returned; a null id draws from an empty id. An empty table gives no row. Only id and text are read, so
    further columns may have any names. A text is cut whole, however long: a block holds one text at least.
    """
    rows = documents(docs, id_col, text_col)
    schema = _arrow_schema(TRANSFORMED)
    rows = rows.select("doc_id", "text", *draws(F.col("doc_id"), seed))
    return rows.mapInArrow(lambda batches: _transform(batches, plain_below, spm_below, schema), TRANSFORMED)


def restored(outputs: DataFrame) -> DataFrame:
    """The columns of ``transformed`` and ``restored``, the text rebuilt from ``form`` and ``output`` alone."""
    rows = outputs.select(*[c.split()[0] for c in TRANSFORMED.split(", ")])
    ddl = TRANSFORMED + ", restored string"
    schema = _arrow_schema(ddl)
    return rows.mapInArrow(lambda batches: _restore(batches, schema), ddl)


def digests(docs: DataFrame, **options) -> DataFrame:
    """Sizes and form of every text with the digests of its output and of the text restored from it."""
    return restored(transformed(docs, **options)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )
