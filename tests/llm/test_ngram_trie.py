"""The trie against dictionaries that hold the same counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from netsluice.llm import elias_fano
from netsluice.llm import ngram_trie as T
from netsluice.llm.elias_fano import EliasFano


def brute(rows, min_count=2, discount=0.75):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    uni, pair = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            w = words(t)
            uni.update(w)
            pair.update(zip([""] + w, w))
    pair = {k: n for k, n in pair.items() if n >= min_count}
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    kept = Counter()
    for (c, _), k in pair.items():
        kept[c] += k - discount
    q = lambda x: float(T.value(T.coded(np.array([x])))[0])
    out = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10(p1(x)) for x in w)
        score = 0.0
        for c, x in zip([""] + w, w):
            back = 1 - kept[c] / uni[c] if c in kept else 1.0
            if (c, x) in pair:
                score += q(math.log10((pair[c, x] - discount) / uni[c] + back * p1(x)))
            else:
                score += (q(math.log10(max(back, 1e-16))) if c in kept else 0.0) + math.log10(p1(x))
        out.append((i, held[i], len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return sorted(out, key=str)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


ROWS = [
    (i, " ".join(f"{'wW'[k % 2]}{(i * 7 + k * k) % 23}" for k in range(i % 40)) + ("\n\tThe the THE end" if i % 3 else ""))
    for i in range(120)
] + [(200, None), (201, ""), (202, "  \t "), (203, "Ünïcode ÜNÏCODE x"), (3, "the same id"), (None, "no id the the"), (204, "lang " * 3000)]


@pytest.mark.parametrize("shard_rows", [7, 1_000_000])
def test_scores(spark, shard_rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, score int, held_out string")
    got = sorted((tuple(r) for r in T.score_documents(df, shard_rows=shard_rows).collect()), key=str)
    same(got, brute(ROWS))


@pytest.mark.parametrize("shard_rows", [1, 4])
def test_back_off_of_contexts_that_begin_a_shard(spark, shard_rows):
    """Unknown words, and words of every number, behind each context."""
    is_held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    rows = [(i, " ".join(f"w{(i * 3 + k * k) % 6}" for k in range(9))) for i in range(40)]
    rows += [(i, " ".join(f"w{k % 6} unseen w{k % 6} w{k // 6}" for k in range(36))) for i in range(100, 140) if is_held(i)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in T.score_documents(df, shard_rows=shard_rows).collect()), key=str)
    same(got, brute(rows))


def test_empty_table_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.score_documents(empty).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = T.score_documents(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score == row.base_score


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, u in ((1, 5), (1000, 1 << 62), (5000, 6000), (300, 300), (64, 1)):
        v = np.sort(r.integers(0, u, n).astype(np.uint64))
        e = EliasFano.of(v)
        assert (e.access(np.arange(n)) == v).all()
        q = np.concatenate([v, r.integers(0, u + 5, 2000).astype(np.uint64), v + np.uint64(1)])
        assert (e.successor(q) == np.searchsorted(v, q)).all()
    assert EliasFano.of(np.zeros(0, np.uint64)).find(np.array([1], np.uint64)).tolist() == [-1]


def brute_of_order(rows, order, min_count, discount=0.75):
    """The model of strings of up to ``order`` words from dictionaries; none reaches beyond the end before the first word."""

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]

    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    uni, grams, whole = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            w = words(t)
            uni.update(w)
            stream = [""] + w
            for k in range(2, order + 1):
                for j in range(len(stream) - k + 1):
                    grams[tuple(stream[j : j + k])] += 1
                    whole[tuple(stream[j : j + k - 1])] += 1
    grams = {g: n for g, n in grams.items() if n >= min_count}
    kept = Counter()
    for g, n in grams.items():
        kept[g[:-1]] += n - discount
    n, v = sum(uni.values()), len(uni)
    q = lambda x: float(T.value(T.coded(np.array([math.log10(max(x, 1e-16))])))[0])

    def log10(context, word):
        if not context:
            return math.log10((uni[word] + 0.5) / (n + 0.5 * (v + 1)))
        lower = log10(context[1:], word)
        if context not in kept:
            return lower
        back = 1 - kept[context] / whole[context]
        g = (*context, word)
        return q((grams[g] - discount) / whole[context] + back * 10**lower) if g in grams else q(back) + lower

    out = []
    for i, t in rows:
        stream = [""] + words(t)
        out.append((i, sum(log10(tuple(stream[max(0, j - order + 1) : j]), stream[j]) for j in range(1, len(stream)))))
    return sorted(out)


@pytest.mark.parametrize("order, min_count, shard_rows", [(3, 1, 1_000_000), (3, 1, 20), (3, 2, 20), (4, 1, 300), (2, 1, 20)])
def test_longer_strings_and_single_sightings(spark, order, min_count, shard_rows):
    """Every string of training counts, met once or often, of common contexts as of rare ones."""
    rows = [(i, " ".join(f"w{(i * 3 + k * k * (1 + i % 3)) % 9}" for k in range(i % 25))) for i in range(90)]
    rows += [(i, f"the one sighting of{i} the the new{i % 7} words the one") for i in range(100, 130)] + [(131, None), (132, "x" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.score) for r in T.score_documents(df, order=order, min_count=min_count, shard_rows=shard_rows).collect())
    want = brute_of_order(rows, order, min_count)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-9, abs=1e-9)


def test_search_of_long_and_short_runs_and_what_it_reads(monkeypatch):
    """Values of equal high bits in runs of one and of many; a value alone with its high bits costs one read of low bits."""
    r = np.random.default_rng(2)
    words = np.concatenate([np.array([1, 1 << 63, (1 << 64) - 1], np.uint64), r.integers(1, 1 << 63, 500, np.uint64)])
    for rank in (0, 1, 7, 31):
        some = words[np.bitwise_count(words) > rank]
        got = elias_fano._select_in_words(some, np.full(len(some), rank))
        assert got.tolist() == [[i for i in range(64) if int(w) >> i & 1][rank] for w in some]
    v = np.unique(np.concatenate([r.integers(0, 1 << 40, 3000), (1 << 39) + r.integers(0, 9000, 3000)])).astype(np.uint64)
    e = EliasFano.of(v)
    asked = np.concatenate([v, v + np.uint64(1), r.integers(0, 1 << 41, 3000).astype(np.uint64)])
    at = np.searchsorted(v, asked)
    assert (e.find(asked) == np.where(np.isin(asked, v), at, -1)).all()
    reads, low = [], EliasFano._low
    monkeypatch.setattr(EliasFano, "_low", lambda self, at: reads.append(len(at)) or low(self, at))
    apart = np.arange(1000, dtype=np.uint64) * np.uint64(1000)
    assert EliasFano.of(apart).find(apart).tolist() == list(range(1000)) and sum(reads) == 1000
