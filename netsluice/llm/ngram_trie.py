"""Language-model scoring by an n-gram trie in Elias-Fano coded, memory-mapped levels.

Level 1 holds the hashes of all training words, cut into shards by their first bits; a word's number is
its place. Level k holds the k-word strings of the training texts: the number that the first k - 1 words
have in the level below, as context, and the last word. It is dealt into shards by context (a very common
context by context and word); a string's number is its place behind the shards before. Within a shard the
contexts, the pointers to their successors and the successors are three monotone sequences: a successor is
stored as its word number plus the last value of the contexts before it, so a lookup goes to its context's
pointer, adds that base and asks for the successor there. Counts are stored beside the successors.
Probabilities (absolute discounting, each level interpolated with the one below, the first with the
smoothed unigrams) and back-off weights are rounded to codes of one byte. Spark counts words, deals
each task's sorted strings to the shards and hands texts on as word numbers; each shard is built by one task.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsluice.llm.common import documents, per_block, written
from netsluice.llm.elias_fano import EliasFano
from netsluice.llm.shared_arrays import mapped, save
from netsluice.session import work_path

#: Words of a level-1 shard, and half the tokens that are dealt to a shard of a further level, about.
SHARD_ROWS = 1_000_000
#: Words of the longest strings of the trie.
ORDER = 2
#: Strings of two or more words met less often are left to the back-off.
MIN_COUNT = 2
#: Taken off every count of two or more words.
DISCOUNT = 0.75
#: Tokens whose strings a task sorts and deals at once, and whose strings it looks up and scores: that takes more memory a token.
BLOCK_TOKENS, SCORED_TOKENS = 1_000_000, 500_000
#: Words whose numbers a worker remembers before it forgets all of them.
REMEMBERED = 250_000
#: Codes of a quantised value, and the least log10 that they reach.
CODES, FLOOR = 255, -16.0

SCORED = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ]
)
SCORED_DDL = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def coded(log10: np.ndarray) -> np.ndarray:
    """Quantise values from FLOOR to 0 to one byte."""
    return np.rint(np.clip(log10, FLOOR, 0.0) * (CODES / FLOOR)).astype(np.uint8)


def value(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (FLOOR / CODES)


def tokens(text: str) -> list[bytes]:
    """Words between ASCII blanks, A to Z in lower case; the end token is the empty word."""
    words = text.encode().lower().split()
    words.append(b"")
    return words


# ---------------------------------------------------------------- level 1: words


@dataclass(frozen=True)
class Words:
    """Level 1 as its shards: files, the number of the first word of each, and the totals."""

    bits: int
    seed: int
    files: tuple[str, ...]
    firsts: tuple[int, ...]
    tokens: int
    distinct: int

    def hashes(self, words: list[bytes]) -> np.ndarray:
        h = xxhash.xxh64_intdigest
        return np.fromiter((h(w, self.seed) for w in words), np.uint64, len(words))

    def shards(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where training has none of it."""
        hashes = self.hashes(words)
        shard, out = self.shards(hashes), np.full(len(words), -1)
        rest = hashes & np.uint64((1 << (64 - self.bits)) - 1)
        for s in np.unique(shard):
            if self.files[s]:
                rows = np.flatnonzero(shard == s)
                at = EliasFano.open(mapped(self.files[s]), "word_").find(rest[rows])
                out[rows] = np.where(at >= 0, at + self.firsts[s], -1)
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training count of each word number; -1 has none."""
        out, firsts = np.zeros(len(numbers), np.int64), np.array(self.firsts)
        shard = np.searchsorted(firsts, numbers, side="right") - 1
        for s in np.unique(shard[numbers >= 0]):
            rows = np.flatnonzero((shard == s) & (numbers >= 0))
            out[rows] = mapped(self.files[s])["count"][numbers[rows] - firsts[s]]
        return out


class _Places(dict):
    """Words and their places in the order in which they came; a new word gets the next."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


class Numbering:
    """Word numbers with a bounded memory, for one worker."""

    def __init__(self, level: Words):
        self.level, self.known, self.number = level, _Places(), np.zeros(0, np.int64)

    def sequences(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of each text's tokens."""
        if len(self.known) > REMEMBERED:
            self.known, self.number = _Places(), np.zeros(0, np.int64)
        look = self.known.__getitem__
        places = []
        for text in texts:
            words = tokens(text)
            places.append(np.fromiter(map(look, words), np.int64, len(words)))
        fresh = list(islice(self.known, len(self.number), None))
        if fresh:
            self.number = np.append(self.number, self.level.numbers(fresh))
        return [self.number[x] for x in places]


@lru_cache(maxsize=1)
def numbering(level: Words) -> Numbering:
    return Numbering(level)


def count_words(train: DataFrame) -> DataFrame:
    """word and n over the texts of ``train``; a task counts its own words before the shuffle."""

    def run(batches):
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(tokens(text))
                if len(counts) > 500_000:
                    yield _rows(counts)
                    counts = Counter()
        yield _rows(counts)

    def _rows(counts):
        return pa.RecordBatch.from_pydict(
            {"word": list(counts), "n": list(counts.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())])
        )

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_words(train: DataFrame, folder: str, shard_rows: int = SHARD_ROWS) -> tuple[Words, np.ndarray]:
    """Level 1, and the numbers of the words too common for one shard of the next."""
    counts = written(count_words(train), "word-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, distinct = total["n"] or 0, total["v"]
    bits = max(0, (distinct // shard_rows).bit_length())
    for seed in range(64):  # two words of one hash would be one word: take the first seed without such a pair
        level = Words(bits, seed, (), (), n, distinct)

        def hashed(batches):
            for batch in batches:
                hashes = level.hashes(batch.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(level.shards(hashes)), pa.array(hashes.view(np.int64)), batch.column("n")], names=["shard", "hash", "n"]
                )

        def build(rows):
            hashes = rows["hash"].to_numpy().view(np.uint64) & np.uint64((1 << (64 - bits)) - 1)
            order = np.argsort(hashes)
            hashes = hashes[order]
            twice = int((hashes[1:] == hashes[:-1]).sum())
            arrays = {f"word_{k}": a for k, a in EliasFano.of(hashes).arrays().items()}
            path = save(folder, "words", arrays | {"count": rows["n"].to_numpy()[order]})
            return pa.table({"shard": [rows["shard"][0].as_py()], "rows": [len(hashes)], "twice": [twice], "path": [path]})

        shards = counts.mapInArrow(hashed, "shard long, hash long, n long").groupBy("shard").applyInArrow(
            build, "shard long, rows long, twice long, path string"
        )
        found = {r["shard"]: r for r in shards.collect()}  # a row for each million words
        if not sum(r["twice"] for r in found.values()):
            break
    files = tuple(found[s]["path"] if s in found else "" for s in range(1 << bits))
    sizes = [found[s]["rows"] if s in found else 0 for s in range(1 << bits)]
    firsts = tuple(int(x) for x in np.concatenate([[0], np.cumsum(sizes)])[:-1])
    level = Words(bits, seed, files, firsts, n, distinct)
    common = [bytes(r["word"]) for r in counts.filter(F.col("n") > shard_rows // 2).select("word").collect()]
    return level, np.sort(level.numbers(common)) if common else np.zeros(0, np.int64)


# ---------------------------------------------------------------- texts as word numbers


def number_texts(df: DataFrame, level: Words) -> DataFrame:
    """Rows (doc_id, text, held_out) with the numbers of the text's words, as 32-bit integers, in place of the text."""

    def run(batch, texts):
        sequences = numbering(level).sequences(texts)
        return {
            "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
            "words": [x.astype("<i4").tobytes() for x in sequences],
        }

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("words", pa.binary())])
    rows = df.select("doc_id", "held_out", "text")
    return written(rows.mapInArrow(per_block(run, schema), "doc_id long, held_out boolean, words binary"), "word-numbers")


def _token_blocks(batches, most: int):
    """Pieces of Arrow batches of about ``most`` tokens: the piece, its word numbers, and where its texts start."""
    for batch in batches:
        sizes = np.array([len(x) // 4 for x in batch.column("words").to_pylist()], np.int64)
        block = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1)) if len(sizes) else []
        for i, j in zip(cuts[:-1], cuts[1:]):
            piece = batch.slice(i, j - i)
            words = np.frombuffer(b"".join(piece.column("words").to_pylist()), "<i4").astype(np.int64)
            yield piece, words, np.cumsum(sizes[i:j]) - sizes[i:j]


# ---------------------------------------------------------------- further levels: strings of words


def _is_in(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among sorted ones, and where."""
    if not len(among):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values, at


def dealt(context: np.ndarray, word: np.ndarray, shards: int, common: np.ndarray) -> np.ndarray:
    """The shard of each (context, word): by the context alone, where it is not common."""
    if len(common):
        context = context + np.where(_is_in(context, common)[0], word + 1, 0)
    return (context % shards).astype(np.min_scalar_type(shards))  # small integers are sorted by their digits


@dataclass(frozen=True)
class Strings:
    """A level as its shards: files and the number of the first string of each.

    Of contexts that lie in several shards: their numbers, how often their strings occur, and how many they have.
    """

    files: tuple[str, ...]
    firsts: tuple[int, ...]
    common: tuple[int, ...]
    occurrences: tuple[int, ...]
    successors: tuple[int, ...]

    def look_up(self, context: np.ndarray, word: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
        """For strings in order of (context, word), contexts occurring ``whole`` times.

        The string's number, -1 where not stored, and its count; and of the context the occurrences and the number of
        its strings, 0 where it has none.
        """
        number, count = np.full(len(context), -1), np.zeros(len(context), np.int64)
        total, size = whole.copy(), np.zeros(len(context), np.int64)
        shard = dealt(context, word, len(self.files), np.array(self.common, np.int64))
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for i, j in zip(cuts[:-1], cuts[1:]):
            rows = order[i:j]
            s = shard[rows[0]]
            if not self.files[s]:
                continue
            a = mapped(self.files[s])
            c = context[rows]
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            group = np.cumsum(new) - 1
            at = EliasFano.open(a, "context_").find(c[new])
            known, place = at >= 0, np.maximum(at, 0)
            pointers, words = EliasFano.open(a, "pointer_"), EliasFano.open(a, "word_")
            begin, end = pointers.access(place).astype(np.int64), pointers.access(place + 1).astype(np.int64)
            base = np.where(begin > 0, words.access(np.maximum(begin - 1, 0)), np.uint64(0))
            size[rows] = np.where(known, end - begin, 0)[group]
            if "sum" in a:
                total[rows] = np.where(known, a["sum"][place], 0)[group]
            ask = np.flatnonzero(known[group] & (word[rows] >= 0))
            own = group[ask]
            spot = words.find(base[own] + word[rows[ask]].astype(np.uint64) + np.uint64(1))
            ok = (spot >= 0) & (spot < end[own])
            spot, hit = spot[ok], rows[ask[ok]]
            number[hit] = spot + self.firsts[s]
            n = a["n"][spot].astype(np.int64)
            many = np.flatnonzero(n == 255)
            n[many] = a["many"][np.searchsorted(a["many_at"], spot[many])]
            count[hit] = n
        spread, at = _is_in(context, np.array(self.common, np.int64))
        if spread.any():
            total[spread] = np.array(self.occurrences)[at[spread]]
            size[spread] = np.array(self.successors)[at[spread]]
        return number, count, total, size


def _walk(words: np.ndarray, starts: np.ndarray, level: Words, levels: tuple[Strings, ...]):
    """For each level and one more: the tokens that have a context, their strings, and of which string each token is.

    A string is its context, its word and the context's occurrences; the end token stands before the first word, and no
    context reaches beyond it. What the levels hold of the strings comes with them.
    """
    bits = np.uint64((level.distinct + 1).bit_length())
    end = level.numbers([b""])
    ids, counts = words, level.counts(words)
    for k in range(len(levels) + 1):
        context, whole = np.empty_like(ids), np.empty_like(counts)
        context[1:], whole[1:] = ids[:-1], counts[:-1]
        context[starts], whole[starts] = (end, level.counts(end)) if k == 0 else (-1, 0)
        seen = np.flatnonzero(context >= 0)
        if len(seen) and int(context.max()).bit_length() + int(bits) > 64:
            raise ValueError("more strings than a key of 64 bits tells apart")
        key = (context[seen].astype(np.uint64) << bits) | (words[seen] + 1).astype(np.uint64)
        if k == len(levels):
            yield seen, key, None, None
            return
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.ones(len(key), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        of = np.empty(len(key), np.int64)
        of[order] = np.cumsum(new) - 1
        mask = (np.uint64(1) << bits) - np.uint64(1)
        strings = (sorted_[new] >> bits).astype(np.int64), (sorted_[new] & mask).astype(np.int64) - 1, whole[seen[order[new]]]
        del context, whole, key, order, sorted_, new  # several bytes a token each, while the level is asked
        found = levels[k].look_up(*strings)
        yield seen, strings, of, found
        ids, counts = np.full(len(words), -1), np.zeros(len(words), np.int64)
        ids[seen], counts[seen] = found[0][of], found[1][of]


def _small(values: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _steps(key: np.ndarray) -> bytes:
    """Sorted keys as differences, all first bytes before all second ones: the high bytes, mostly zero, compress away."""
    return np.diff(key, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(steps: bytes) -> np.ndarray:
    planes = np.frombuffer(steps, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def build_strings(
    train: DataFrame, level: Words, levels: tuple[Strings, ...], common: np.ndarray, folder: str, min_count: int, shard_rows: int
) -> tuple[Strings, np.ndarray]:
    """The level on top of ``levels`` from the numbered texts, and the numbers of its strings too common for one shard of the next."""
    bits = (level.distinct + 1).bit_length()
    mask = np.uint64((1 << bits) - 1)
    shards = level.tokens // (2 * shard_rows) + 1

    def deal(batches):
        for _, words, starts in _token_blocks(batches, BLOCK_TOKENS):
            *_, (_, key, _, _) = _walk(words, starts, level, levels)
            key = np.sort(key)
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            n = np.diff(np.append(at, len(key)))
            key = key[at]
            shard = dealt((key >> np.uint64(bits)).astype(np.int64), (key & mask).astype(np.int64) - 1, shards, common)
            order = np.argsort(shard, kind="stable")
            shard, key, n = shard[order], key[order], n[order].astype("<u4")
            cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": shard[cuts[:-1]],
                    "steps": [_steps(key[i:j]) for i, j in zip(cuts[:-1], cuts[1:])],
                    "n": [n[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])],
                },
                schema=pa.schema([("shard", pa.int64()), ("steps", pa.binary()), ("n", pa.binary())]),
            )

    def build(rows):
        key = np.concatenate([_keys(x) for x in rows["steps"].to_pylist()])
        n = np.frombuffer(b"".join(rows["n"].to_pylist()), "<u4").astype(np.int64)
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.add.reduceat(n[order], at)
        often = n >= min_count
        key, n = key[at][often], n[often]
        out = {"shard": [rows["shard"][0].as_py()], "rows": [len(key)], "path": [""], "common": [[]], "sum": [[]], "size": [[]], "next": [[]]}
        if len(key):
            context, word = (key >> np.uint64(bits)).astype(np.int64), (key & mask).astype(np.int64) - 1
            begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            sizes, sums = np.diff(np.append(begin, len(key))), np.add.reduceat(n, begin)
            ends = np.append(begin[1:], len(word)) - 1
            base = np.concatenate([[0], np.cumsum(word[ends] + 1)[:-1]])  # the last value of the contexts before
            arrays = {}
            values = np.repeat(base, sizes) + word + 1
            for name, x in (("context_", context[begin]), ("pointer_", np.append(begin, len(word))), ("word_", values)):
                arrays |= {name + k: v for k, v in EliasFano.of(x).arrays().items()}
            many = np.flatnonzero(n >= 255)
            arrays |= {"n": np.minimum(n, 255).astype(np.uint8), "many_at": many, "many": n[many]}
            if min_count > 1:
                arrays["sum"] = _small(sums)
            spread = np.flatnonzero(_is_in(context[begin], common)[0])
            out |= {
                "path": [save(folder, "strings", arrays)], "common": [context[begin][spread]], "sum": [sums[spread]],
                "size": [sizes[spread]], "next": [np.flatnonzero(n > shard_rows // 2)],
            }
        return pa.table(out, schema=pa.schema([("shard", pa.int64()), ("rows", pa.int64()), ("path", pa.string())] + [
            (c, pa.list_(pa.int64())) for c in ("common", "sum", "size", "next")
        ]))

    ddl = "shard long, rows long, path string, common array<long>, sum array<long>, size array<long>, next array<long>"
    # tasks grow in number with the shards, whatever number of partitions shuffles have by default
    rows = train.mapInArrow(deal, "shard long, steps binary, n binary").repartition(shards, "shard").groupBy("shard").applyInArrow(build, ddl)
    found = {r["shard"]: r for r in rows.collect()}  # a row for each shard, and few contexts common enough to be in it
    sizes = [found[s]["rows"] if s in found else 0 for s in range(shards)]
    firsts = [int(x) for x in np.concatenate([[0], np.cumsum(sizes)])[:-1]]
    sums, counts = np.zeros(len(common), np.int64), np.zeros(len(common), np.int64)
    for r in found.values():
        at = np.searchsorted(common, r["common"])
        sums[at] += np.array(r["sum"], np.int64)
        counts[at] += np.array(r["size"], np.int64)
    files = tuple(found[s]["path"] if s in found else "" for s in range(shards))
    above = np.sort(np.array([firsts[s] + x for s, r in found.items() for x in r["next"]], np.int64))
    return Strings(files, tuple(firsts), tuple(common.tolist()), tuple(sums.tolist()), tuple(counts.tolist())), above


def unigram(counts: np.ndarray, level: Words) -> np.ndarray:
    """Add-half estimate, one place for all unknown words together."""
    return (counts + 0.5) / (level.tokens + 0.5 * (level.distinct + 1))


# ---------------------------------------------------------------- scoring


def _rounded(p: np.ndarray) -> np.ndarray:
    """log10 of probabilities as their codes give it."""
    return value(coded(np.log10(np.maximum(p, 1e-16))))


def score(numbered: DataFrame, level: Words, levels: tuple[Strings, ...], discount: float = DISCOUNT) -> DataFrame:
    """Score numbered texts: one row each, in no order."""

    def run(batches):
        for piece, words, starts in _token_blocks(batches, SCORED_TOKENS):
            counts = level.counts(words)
            p = unigram(counts, level)
            base = np.log10(p)
            model = base.copy()
            for k, (seen, strings, of, found) in enumerate(islice(_walk(words, starts, level, levels), len(levels))):
                number, count, total, size = found
                whole = strings[2].astype(float)
                back = np.where(size > 0, 1.0 - (total - discount * size) / whole, 1.0)
                share = (count - discount) / whole
                off = np.where(size > 0, _rounded(back), 0.0)
                known = (number >= 0)[of]
                below = model[seen]
                p = p[seen] if k == 0 else 10.0**below
                model[seen] = np.where(known, _rounded(share[of] + back[of] * p), off[of] + below)
            total = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has its end token
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"),
                    "n_tokens": np.diff(np.append(starts, len(words))), "n_known": total((counts > 0).astype(np.int64)),
                    "train_tokens": np.full(len(starts), level.tokens), "base_score": total(base), "score": total(model),
                },
                schema=SCORED,
            )

    return numbered.mapInArrow(run, SCORED_DDL)


def held_out(doc_id):
    """Whether the CRC-32 of the id's text leaves 1 when divided by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, min_count: int = MIN_COUNT,
    discount: float = DISCOUNT, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Learn strings of up to ``order`` words from the rows that are not held out, score all.

    ``min_count=1`` leaves no string out of the model. A null text is empty: its one token is the end. Repeated rows count and
    score as often as they come. With no training rows every token is unknown and both scores are those of a vocabulary of none.
    """
    rows = documents(df, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    folder = work_path(df.sparkSession, "trie")
    level, common = build_words(rows.filter(~F.col("held_out")), folder, shard_rows)
    numbered, levels = number_texts(rows, level), ()
    train = numbered.filter(~F.col("held_out")).select("words")
    for _ in range(order - 1 if level.tokens else 0):
        strings, common = build_strings(train, level, levels, common, folder, min_count, shard_rows)
        levels += (strings,)
    return score(numbered, level, levels, discount)
