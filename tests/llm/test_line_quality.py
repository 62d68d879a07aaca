"""Base measures against plain counting, decoding against all labellings, verdicts on held-out labels."""

import itertools
import random
import re
from collections import Counter

import numpy as np

from netsluice.llm import line_quality as L

WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if counts[w] > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def texts(seed=1):
    r = random.Random(seed)
    out = ["", " \n\t ", "a", "a a a a a a", "x y z x y z", "é | ü\né | ü\n\n é | ü", "one\x0btwo\x0cthree\xa0four five", "w " * 20_000, "\n" * 3000 + "end"]
    for _ in range(60):
        out.append("".join(r.choice(["a", "b", "Cd", "e#", "|", " ", " ", "\n", "\t"]) for _ in range(r.randint(0, 400))))
    return out


def labelled(n=300, seed=2):
    r = random.Random(seed)
    good = lambda: " ".join(r.choice(["the", "river", "was", "cold", "and", "deep", "stone", "light"]) + str(r.randint(0, 400)) for _ in range(14)) + "."
    junk = [lambda: " | ".join(str(r.randint(0, 999)) for _ in range(14)) + " |", lambda: " ".join(f"W{r.randint(0, 99)}!!" for _ in range(12)).upper()]
    docs, labels = [], []
    for i in range(n):
        poor = i % 3 == 0
        lines = [r.choice(junk)() if poor else good() for _ in range(r.randint(8, 15))]
        if i % 5 == 0:
            lines.insert(r.randint(0, len(lines)), good() if poor else r.choice(junk)())
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(not poor)))
    return docs, labels


def test_base_measures(spark):
    rows = list(enumerate(texts())) + [(1000, None), (None, "no id here"), (3, texts()[3])]
    df = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, n_words int, kept boolean")
    found = L.assess(df, L.fit([], [])).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found), key=str)
    assert got == sorted(((i, *base(t or "")) for i, t in rows), key=str)
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # a field without weights takes every line for content


def test_decoding_is_the_best_of_all():
    g = np.random.default_rng(3)
    field = L.Field(g.normal(size=(len(L.FEATURES), 2)), g.normal(size=(2, 2)), g.normal(size=2))
    docs = [[int(x) for x in g.integers(1, 1 << len(L.FEATURES), n)] for n in (0, 1, 2, 7, 7, 3, 10)]
    for lines, marks in zip(docs, L.viterbi(docs, field)):
        weights = L.scores(np.array(lines, dtype=np.int64), field)
        total = lambda m: sum(weights[k][x] for k, x in enumerate(m)) + (field.first[m[0]] if m else 0) + sum(field.step[a][b] for a, b in zip(m, m[1:]))
        best = max(itertools.product((0, 1), repeat=len(lines)), key=total)
        assert tuple(marks) == best


def test_held_out_verdicts(spark):
    docs, labels = labelled()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1), (3, None)], "doc_id long, quality int")
    verdict = {r.doc_id: r.kept for r in L.assess(df, L.train(df, known)).collect()}
    asked = [(i, q) for i, q in labels if i % 2 == 0]
    assert sum(verdict[i] == bool(q) for i, q in asked) >= 0.98 * len(asked)


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "word " * 3 + " ".join(str(k) for k in range(60)))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in L.assess(df, L.train(df, none)).collect()] == [True]
    assert L.assess(df.limit(0), L.train(df, none)).collect() == []


def test_kept_rows_keep_their_columns(spark):
    good = "\n".join(" ".join(f"w{k}{j}" for j in range(20)) + "." for k in range(5))
    df = spark.createDataFrame([(1, good, "a", None), (1, "few", "b", 2), (None, good, None, 3), (2, None, "c", 4)], "doc_id long, text string, _rest string, kept int")
    got = L.kept_rows(df, L.fit([], []))
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, good, "a", None), (None, good, None, 3)], key=str)
