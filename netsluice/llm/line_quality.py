"""Quality rules from line labels: a linear-chain conditional random field reads a document line by line.

Each line with a word gets a few binary features; Viterbi decoding marks it content or boilerplate from
its own features and its neighbours' marks; the share of words in content lines decides whether the
document is kept. The field is fitted on a bounded sample of labelled documents: their labels hold for
all their lines at first, then, once, the lines of a poor document that the first fit takes for content
are left out of its boilerplate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsluice.llm.common import documents, per_block

#: Labelled documents that the field is fitted on, those of least hash.
SAMPLE_DOCS = 2000
#: Least share of words in content lines.
CONTENT_SHARE = 0.5
# The characters counted as symbols, and the ends of a sentence.
SYMBOLS = b"#*$%&|<>"
ENDS = (b".", b"!", b"?", b":", b";", b'"', b")")

UPPER, LOWER, DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
FEATURES = (
    "always", "few symbols", "some symbols", "many symbols", "some capitals", "mostly capitals", "digits", "shouting",
    "ends a sentence", "under 4 words", "under 10 words", "repeats words", "one word again and again", "seen before",
    "long words", "short words",
)
CONTENT, BOILERPLATE = 0, 1

MEASURED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
        ("n_lines", pa.int64()), ("n_boilerplate_lines", pa.int64()), ("content_share", pa.float64()),
    ]
)
MEASURED_DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_boilerplate_lines long, content_share double"
)


@dataclass(frozen=True)
class Field:
    """Weights of the two marks for each feature, of each pair of neighbours, and of the first line."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray


def line_features(line: bytes, words: list[bytes], seen: bool) -> int:
    """The features of a line as bits, in the order of FEATURES."""
    n, size = len(words), len(line)
    symbols = size - len(line.translate(None, SYMBOLS))
    upper = size - len(line.translate(None, UPPER))
    lower = size - len(line.translate(None, LOWER))
    digits = size - len(line.translate(None, DIGITS))
    distinct = len(set(words))
    chars = sum(map(len, words))
    bits = 1
    if symbols:
        bits |= 2 if 10 * symbols <= n else 4 if 2 * symbols <= n else 8
    if n > 1 and 10 * upper > 3 * (upper + lower):
        bits |= 16 if 10 * upper <= 6 * (upper + lower) else 32
    bits |= (10 * digits > chars) << 6
    bits |= (2 * line.count(b"!") > n) << 7
    bits |= words[-1].endswith(ENDS) << 8
    bits |= (n < 4) << 9 | (4 <= n < 10) << 10
    if n >= 6:
        bits |= (10 * distinct < 3 * n) << 12 or (10 * distinct < 6 * n and n < 60) << 11
    bits |= seen << 13 | (chars > 18 * n) << 14 | (chars < 2 * n) << 15
    return bits


def repeated_words(ids: list[int], distinct: int) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(ids) < 4:
        return 0
    a = np.array(ids, dtype=np.int64)
    if distinct < 2_000_000:  # the product stays below 2^63
        windows = (a[:-2] * distinct + a[1:-1]) * distinct + a[2:]
    else:
        pairs = np.unique(a[:-1] * distinct + a[1:], return_inverse=True)[1]
        windows = pairs[:-1] * distinct + a[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(a), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[tuple[int, int, int, int, int], list[int], list[int]]:
    """Base measures of a whole text, and for each line with a word its features and number of words."""
    raw = text.encode()
    ids: dict[bytes, int] = {}
    sequence: list[int] = []
    features, sizes, seen, repeats = [], [], set(), 0
    for line in raw.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            repeats += again
            seen.add(line)
            features.append(line_features(line, words, again))
            sizes.append(len(words))
            sequence += [ids.setdefault(w, len(ids)) for w in words]
    blanks = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return (len(sequence), len(text) - blanks, symbols, repeats, repeated_words(sequence, len(ids))), features, sizes


def scores(features: np.ndarray, field: Field) -> np.ndarray:
    """Weight of either mark for each line, from the bits of its features."""
    bits = (features[:, None] >> np.arange(len(FEATURES))) & 1
    return bits @ field.emit


def viterbi(features: list[list[int]], field: Field) -> list[np.ndarray]:
    """The best marks of each document; documents go side by side, longest first, line after line."""
    order = sorted(range(len(features)), key=lambda i: -len(features[i]))
    lengths = np.array([len(features[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(features)
    if not len(lengths) or not lengths[0]:
        return out
    starts = np.concatenate([[0], np.cumsum(lengths)])
    weights = scores(np.concatenate([np.array(features[i], dtype=np.int64) for i in order]), field)
    back = np.zeros((len(weights), 2), np.int8)
    alive = int((lengths > 0).sum())
    best = field.first + weights[starts[:alive]]
    final = best.copy()
    for t in range(1, lengths[0]):
        alive = int(np.searchsorted(-lengths, -t, side="left"))
        at = starts[:alive] + t
        through = best[:alive, :, None] + field.step[None]
        back[at] = through.argmax(axis=1)
        best = through.max(axis=1) + weights[at]
        final[:alive] = best
    marks = np.zeros(len(weights), np.int8)
    alive = len(final)
    mark = final.argmax(axis=1).astype(np.int8)
    ends = starts[:alive] + lengths[:alive] - 1
    marks[ends] = mark
    for t in range(lengths[0] - 1, 0, -1):  # a document joins when its last line is reached
        alive = int(np.searchsorted(-lengths, -t, side="left"))
        at = starts[:alive] + t
        marks[at - 1] = back[at, marks[at]]
    for k, i in enumerate(order):
        out[i] = marks[starts[k] : starts[k + 1]]
    return out


def fit(documents_lines: list[list[int]], marks: list[list[int]], rounds: int = 80, rate: float = 0.2, penalty: float = 0.01) -> Field:
    """Maximum likelihood by gradient steps (Adam) with forward and backward sums; empty documents are left out."""
    pairs = [(f, m) for f, m in zip(documents_lines, marks) if f]
    k = len(FEATURES)
    if not pairs:
        return Field(np.zeros((k, 2)), np.zeros((2, 2)), np.zeros(2))
    pairs.sort(key=lambda p: -len(p[0]))
    lengths = np.array([len(f) for f, _ in pairs])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    bits = ((np.concatenate([np.array(f, dtype=np.int64) for f, _ in pairs])[:, None] >> np.arange(k)) & 1).astype(float)
    gold = np.concatenate([np.array(m) for _, m in pairs])
    hot = np.eye(2)[gold]
    inner = np.ones(len(gold), bool)
    inner[starts[:-1]] = False
    seen_emit, seen_first = bits.T @ hot, hot[starts[:-1]].sum(axis=0)
    seen_step = hot[np.flatnonzero(inner) - 1].T @ hot[inner]
    theta, m1, m2 = np.zeros(2 * k + 6), np.zeros(2 * k + 6), np.zeros(2 * k + 6)
    alive = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(lengths[0])]
    for r in range(1, rounds + 1):
        emit, step, first = theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 :]
        w = bits @ emit
        fwd, bwd = np.zeros_like(w), np.zeros_like(w)
        fwd[starts[:-1]] = first + w[starts[:-1]]
        for t in range(1, lengths[0]):
            at = starts[: alive[t]] + t
            fwd[at] = np.logaddexp(fwd[at - 1, 0, None] + step[0], fwd[at - 1, 1, None] + step[1]) + w[at]
        for t in range(lengths[0] - 1, 0, -1):
            at = starts[: alive[t]] + t
            ahead = bwd[at] + w[at]
            bwd[at - 1] = np.stack([np.logaddexp(step[a, 0] + ahead[:, 0], step[a, 1] + ahead[:, 1]) for a in (0, 1)], axis=1)
        total = np.repeat(np.logaddexp(*(fwd[starts[1:] - 1].T)), lengths)
        p = np.exp(fwd + bwd - total[:, None])
        at = np.flatnonzero(inner)
        pair = np.exp(fwd[at - 1][:, :, None] + step[None] + (w[at] + bwd[at])[:, None, :] - total[at, None, None])
        grad = np.concatenate(
            [(seen_emit - bits.T @ p).ravel(), (seen_step - pair.sum(axis=0)).ravel(), seen_first - p[starts[:-1]].sum(axis=0)]
        ) / len(pairs) - penalty * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-8)
    return Field(theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 :])


def train(df: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on at most ``sample_docs`` labelled documents (columns doc_id and quality of ``labels``).

    Rows of ``labels`` without an id or a quality are left out, an id with several counts as good if one
    says so. Without documents of both kinds the weights are zero, and every line is content.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    )
    rows = documents(df, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most sample_docs ids
    schema = pa.schema([("quality", pa.int32()), ("features", pa.list_(pa.int32()))])

    def features(batch, texts):
        return {"quality": batch.column("quality"), "features": [measure(t)[1] for t in texts]}

    found = rows.mapInArrow(per_block(features, schema), "quality int, features array<int>").collect()
    found = sorted((r["quality"], list(r["features"])) for r in found)
    lines = [f for _, f in found]
    if len({q > 0 for q, f in found if f}) < 2:
        return fit([], [])
    marks = [[CONTENT if q > 0 else BOILERPLATE] * len(f) for q, f in found]
    field = fit(lines, marks)
    for i, decoded in enumerate(viterbi(lines, field)):
        if found[i][0] <= 0 and BOILERPLATE in decoded:
            marks[i] = decoded.tolist()
    return fit(lines, marks)


def _assessed(texts: list[str], field: Field, content_share: float) -> list[tuple]:
    """The columns of MEASURED after the id, for each text."""
    measured = [measure(t) for t in texts]
    rows = []
    for (base, _, sizes), marks in zip(measured, viterbi([m[1] for m in measured], field)):
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        content = int(np.dot(marks == CONTENT, sizes)) if sizes else 0
        share = content / base[0] if base[0] else 0.0
        rows.append((*base, failed, not failed and share >= content_share, len(sizes), int(marks.sum()), share))
    return rows


def assess(df: DataFrame, field: Field, content_share: float = CONTENT_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every row, in no order; repeated rows give a row each.

    A null text is empty; an empty text, or one of blanks, fails the base rules, so it is not kept.
    """

    def run(batch, texts):
        columns = list(zip(*_assessed(texts, field, content_share)))
        return dict(zip(MEASURED.names, [batch.column("doc_id"), *columns]))

    return documents(df, id_col, text_col).mapInArrow(per_block(run, MEASURED), MEASURED_DDL)


def kept_rows(df: DataFrame, field: Field, content_share: float = CONTENT_SHARE, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with all their columns whose text ``assess`` keeps."""
    columns = [c for c in df.columns if c != text_col]
    whole = df.select(F.struct(*columns).alias("_rest"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield part.filter(pa.array(_verdicts([t or "" for t in part.column("_text").to_pylist()], field, content_share)))

    out = whole.mapInArrow(run, f"_rest {whole.schema['_rest'].dataType.simpleString()}, _text string")
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in df.columns])


def _verdicts(texts: list[str], field: Field, content_share: float) -> list[bool]:
    return [row[6] for row in _assessed(texts, field, content_share)]
