"""Runs, collapsed texts and the grammar against quadratic versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netsluice.llm import periodic_runs as pr
from netsluice.llm.grammar import Grammar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least_length=6, least_periods=4):
    """Every period over the whole text; a stretch counts under its smallest period."""
    found = {}
    n = len(words)
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_length, least_periods * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapse(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def cycled(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    words = cycled(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] * 10**12 // r[2], r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapse(words, runs)))


def texts():
    rng = random.Random(3)
    out = ["", " \n", None, "one", "a a a a a", "a a a a a a", "a\x0ba\ta a\ra\na ", "x a b a b a b a b y", "ab" * 50, "ä " * 40, "a\x85b " * 9]
    for _ in range(400):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        k = rng.randint(1, 6)
        unit = [rng.choice(["x", "yy", "ß"]) for _ in range(k)]
        words += unit * rng.randint(0, 7) + unit[: rng.randint(0, k)]
        words += [rng.choice("abc") for _ in range(rng.randint(0, 10))]
        out.append(rng.choice([" ", "\n", "  \t"]).join(words))
    return out + ["same same same same same same"] * 2


def test_against_every_period(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b c " * 9), (3, "again 3")]
    df = spark.createDataFrame([(i, t, 0, "w", 2) for i, t in rows], "doc_id long, text string, n int, words string, start int")
    got = sorted((tuple(r) for r in pr.digests(pr.periodic_runs(pr.with_cycles(df))).collect()), key=str)
    want = sorted((brute(i, t) for i, t in rows), key=str)
    assert got == want and sum(w[1] > 0 for w in want) > 150
    plain = {(r.doc_id, r.n, r.collapsed): [tuple(x) for x in r.runs] for r in pr.periodic_runs(df.filter("doc_id < 300")).collect()}
    for i, t in rows:
        if i is not None and i < 300:
            words = WORD.findall(t or "")
            runs = brute_runs(words)
            assert plain[(i, len(words), collapse(words, runs))] == runs


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pr.digests(pr.periodic_runs(pr.with_cycles(empty))).collect() == []


def test_very_long_text(spark):
    rng = random.Random(5)
    noise = [f"w{rng.randint(0, 10**9)}" for _ in range(300_000)]
    unit = [f"u{k}" for k in range(1000)]
    words = noise + unit * 30 + ["z"] * 50_000
    [row] = pr.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(300_000, 30_000, 1000), (330_000, 50_000, 1)]
    assert row.collapsed == " ".join(noise + unit + ["z"])


lists = st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(lists, st.integers(1, 8), st.integers(2, 5), st.integers(0, 60))
def test_other_bounds(cases, least_length, least_periods, repeat):
    cases = [c + c[:2] * (repeat % 7) for c in cases]
    before = np.concatenate([[0], np.cumsum([len(c) for c in cases])])
    text, start, length, period = pr.find_runs(np.array(sum(cases, []), np.int64), before, least_length, least_periods)
    got = [[] for _ in cases]
    for t, *run in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[t].append(tuple(run))
    if least_length >= least_periods:
        assert got == [brute_runs(c, least_length, least_periods) for c in cases]


@settings(max_examples=300, deadline=None)
@given(lists, st.sampled_from([0, 1, 2, 200]))
def test_grammar(cases, rounds):
    text = np.array([x for k, c in enumerate(cases) for x in [*c, -k - 1]], np.int64)
    grammar = Grammar(text, rounds)
    assert grammar.expanded().tolist() == text.tolist()
    x, y = np.triu_indices(len(text), 1)

    def extension(a, b, step):
        k = 0
        while 0 <= a + k * step and b + k * step < len(text) and text[a + k * step] == text[b + k * step]:
            k += 1
        return k

    assert grammar.forward(x, y).tolist() == [extension(a, b, 1) for a, b in zip(x, y)]
    assert grammar.backward(x, y).tolist() == [extension(a, b, -1) for a, b in zip(x, y)]


def test_least_periods():
    with pytest.raises(ValueError):
        pr.periodic_runs(None, least_periods=1)
