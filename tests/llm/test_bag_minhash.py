"""Signatures against the similarity they estimate, classes against all pairs."""

import random
from collections import Counter

import numpy as np

from netsluice.llm import bag_minhash as B


def bag(text, size=5):
    w = text.encode().lower().split()
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute(rows, least=0.8):
    bags = [bag(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and None not in (rows[i][0], rows[j][0]) and similarity(bags[i], bags[j]) >= least:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, low[find(i)], d == low[find(i)]) if d is not None else (None, None, True) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    rows, i = [], 0
    for _ in range(30):
        base = [word() for _ in range(r.randint(8, 200))]
        if r.random() < 0.4:
            base += base[:60] * 3  # weights above one
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, 1 + len(w) // 60)):
                w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += r.randint(1, 3)
    hot = [word() for _ in range(120)]
    for _ in range(40):
        w = list(hot)
        w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
        i += 1
    return rows + [
        (5000, None), (5001, ""), (5002, " \n\t"), (5003, "one two"), (5004, "One TWO"), (5005, "one two three"), (None, rows[0][1]),
        rows[4], (7, "x " * 30_000), (5008, "x " * 30_000),
    ]


def test_classes(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in B.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_chain_in_one_band(spark):
    """Neighbours of a chain link though its ends don't."""
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join([f"v{k}" for k in range(2 * i)] + base[2 * i :])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in B.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert B.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_estimate_the_weighted_similarity():
    r = np.random.default_rng(2)
    keys = np.sort(r.integers(0, 2**63, 300).astype(np.uint64))
    for top in (1, 3, 20):
        a, b = r.integers(0, top + 1, 300), r.integers(0, top + 1, 300)
        bags = [(keys[x > 0], x[x > 0]) for x in (a, b)]
        s = B.signatures(bags, 8192)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - want) < 0.03
