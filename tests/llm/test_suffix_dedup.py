"""Removed bytes against a dictionary of all windows; the sort against plain sorting."""

import hashlib
import random

import numpy as np
import pytest

from netsluice.llm import suffix_dedup as S


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) in the order of ids; rows that repeat an id keep the input's order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen:
                gone[k : k + length] = True
            seen.add(window)
        left = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((rows[i][0], len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    shared = [text(r.randint(30, 260)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [r.choice(shared) if r.random() < 0.5 else text(r.randint(1, 90)) for _ in range(r.randint(0, 6))]
        rows.append((i * 2, "".join(parts)))
    rows += [(1, rows[40][1]), (3, rows[40][1] + "tail"), (501, "a" * 700), (502, "a" * 350), (503, "ab" * 200), (504, ("xyz" * 30 + "q") * 9)]
    rows += [(600, None), (601, ""), (602, "short"), (None, shared[0] + shared[1]), (None, shared[0] + shared[1]), (700, "é" * 300 + text(40) + "é" * 300)]
    period = text(37)
    return rows + [(800, period * 8), (801, text(50) + period * 4 + text(50)), (4, rows[50][1])]


@pytest.mark.parametrize("length, gram", [(100, 32), (20, 7)])
def test_removed_bytes(spark, length, gram):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, file string").repartition(3)
    got = sorted((tuple(r) for r in S.digests_without_repeats(df, length, gram).collect()), key=str)
    assert got == brute(rows, length)


@pytest.mark.parametrize("most, block", [(0, 400_000), (90, 50), (400, 400_000)])
def test_large_keys_are_dealt_by_window(spark, monkeypatch, most, block):
    """Results as before, and no key of more than ``most`` windows reaches a sort."""
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    line, passage = text(40), text(130)  # one line, and one passage longer than a window, with ever other neighbours
    rows = corpus() + [(1000 + i, text(r.randint(0, 90)) + r.choice([line, passage]) + text(r.randint(0, 90))) for i in range(80)]
    held = S._later

    def bounded(members, length):
        windows = {}
        for m in members:
            windows[m[0]] = windows.get(m[0], 0) + m[5]
        assert max(windows.values()) <= most
        return held(members, length)

    monkeypatch.setattr(S, "DEALT", most, raising=False)
    monkeypatch.setattr(S, "SORTED", block)
    monkeypatch.setattr(S, "_later", bounded)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((tuple(x) for x in S.digests_without_repeats(df).collect()), key=str)
    assert got == brute(rows, 100)


def test_texts(spark, tmp_path):
    r = random.Random(2)
    a = "".join(r.choice("abcdefgh ") for _ in range(150))
    rows = [(1, a + "!", "m"), (2, "é" + a + "é", None), (3, None, "n"), (4, "clean", "o")]
    spark.createDataFrame(rows, "doc_id long, text string, _rest string").write.parquet(str(tmp_path / "t"))
    got = sorted(tuple(r) for r in S.texts_without_repeats(spark.read.parquet(str(tmp_path / "t"))).collect())
    assert got == [(1, a + "!", "m"), (2, "éé", None), (3, None, "n"), (4, "clean", "o")]


def test_empty(spark):
    assert S.digests_without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sort():
    r = random.Random(5)
    data = "".join(r.choice("ab") for _ in range(900)).encode() + b"ab" * 80
    places = np.array([r.randrange(len(data)) for _ in range(700)])
    group = np.array([r.randrange(3) for _ in range(700)])
    for length in (5, 40):
        order = S.Suffixes(data, length).sort(places, group)
        padded = data + b"\0" * length
        want = sorted(range(700), key=lambda i: (group[i], padded[places[i] : places[i] + length]))
        assert order.tolist() == want
