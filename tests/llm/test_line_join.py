"""The join against all pairs of lines, the banded distance against the plain one."""

import random

import numpy as np
import pytest

from netsluice.llm import line_join as L

BLANKS = " \t\n\v\f\r"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows, edits=2, least=20):
    found = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(BLANKS):
                found.setdefault(line.strip(BLANKS), []).append(((d is None, d or 0), k, d))
    distinct = list(found)
    parent, links = {x: x for x in distinct}, dict.fromkeys(distinct, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    first = {}
    for x, places in found.items():
        first[find(x)] = min([*places, first.get(find(x), places[0])], key=lambda p: p[:2])
    out = []
    for x, places in found.items():
        _, k0, d0 = first[find(x)]
        out += [(d, k, len(x), d0, k0, links[x], (d, k) == (d0, k0)) for _, k, d in places]
    return sorted(out, key=str)


def corpus(seed=4):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé ü") for _ in range(r.randint(15, 70))).strip() + "x" for _ in range(40)]

    def changed(line):
        line = list(line)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(line))
            line[k : k + r.randint(0, 1)] = r.choice(["", "q", "é", "zz"])
        return "".join(line)

    rows = [(i, "\n".join(r.choice(["", "  ", "\t"]) + changed(r.choice(base)) for _ in range(r.randint(0, 6)))) for i in range(120)]
    return rows + [
        (500, None), (501, ""), (502, "\n \n\t"), (503, "short"), (504, "shart"), (505, "short"), (None, base[3]), (3, "same id, other text here"),
        (506, "long " * 300), (507, "long " * 299 + "lung"), (508, base[0] + "\n" + base[0]), rows[5],
    ]


def columns(r):
    return (r.doc_id, r.line_no, r.n_chars, r.first_doc_id, r.first_line_no, r.n_links, r.kept)


def test_all_links(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, h string, line int").repartition(3)
    got = sorted((columns(r) for r in L.deduplicated_lines(df).collect()), key=str)
    assert got == brute(rows)


def near_variants(r, line):
    line = list(line)
    for _ in range(r.randint(0, 2)):
        k = r.randrange(len(line) + 1)
        line[k : k + r.randint(0, 1)] = r.choice([[], ["q"], ["é"]])
    return "".join(line)


def test_signatures_never_part_near_lines():
    r = random.Random(8)
    base = ["".join(r.choice("abcdefgh é𝄞") for _ in range(r.randint(20, 90))) for _ in range(300)] + ["", "x", "aa"]
    pairs = [(x, near_variants(r, x)) for x in base for _ in range(6)]
    a, b = (L.signatures(*L._letters([p[k] for p in pairs])) for k in (0, 1))
    assert all(L.alike(a[i : i + 1], b[i : i + 1], 2)[0, 0] for i in range(len(pairs)))
    others = L.signatures(*L._letters(base))
    assert L.alike(others, others, 2).mean() < 0.05


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_near_lines_share_a_key(edits):
    r = random.Random(edits)
    lines = ["".join(r.choice("ab𝄞") for _ in range(r.randint(20, 40))) for _ in range(60)]
    for line in lines:
        other = list(line)
        for _ in range(edits):
            k = r.randrange(len(other) + 1)
            other[k : k + r.randint(0, 1)] = r.choice([[], ["c"]])
        pair = sorted([line, "".join(other)], key=len)
        key, tag, place, _ = L.keys(pair, edits)
        filed = {(k, t // 2) for k, t, p in zip(key, tag, place) if p == 0 and t % 2}
        asked = {(k, t // 2) for k, t, p in zip(key, tag, place) if p == 1}
        assert filed & asked
    key, tag, place, sign = L.keys([], edits)
    assert len(key) == len(tag) == len(place) == len(sign) == 0


@pytest.mark.parametrize("compared, step", [(16_384, 7), (16_384, 10_000), (20, 13), (3, 50), (1, 1000)])
def test_meetings_lose_no_pair(monkeypatch, compared, step):
    monkeypatch.setattr(L, "COMPARED", compared)
    monkeypatch.setattr(L, "MET", 5)
    r = random.Random(1)
    base = ["".join(r.choice("abcdefgh") for _ in range(30)) for _ in range(12)]
    lines = list({near_variants(r, r.choice(base)) for _ in range(300)})
    key, tag, place, sign = L.keys(lines, 2)
    rows = sorted({(int(k), int(p), int(t), int(s)) for k, t, p, s in zip(key, tag, place, sign[place])}) * 2
    rows += [(5, p, 1, int(sign[p])) for p in range(len(lines))]  # a key that all lines file
    rows.sort()
    batches = [L._rows(np.array(rows[i : i + step], np.int64).T) for i in range(0, len(rows), step)]
    got = {(k, h) for b in L._meet(iter(batches), 2) for k, h in zip(b.column("key").to_pylist(), b.column("h").to_pylist())}
    by_key = {}
    for k, p, t, _ in rows:
        by_key.setdefault(k, {}).setdefault(p, []).append(t & 1)
    for k, held in by_key.items():
        for p, own in held.items():
            if any(own):
                for q in held:
                    if p != q and abs(len(lines[p]) - len(lines[q])) <= 2 and edit_distance(lines[p], lines[q]) <= 2:
                        assert (k, p) in got and (k, q) in got
    assert list(L._meet(iter([]), 2)) == []


def test_texts_without_repeats(spark):
    a, b = "the first line of some length", "another line that is as long"
    rows = [(1, f"{a}\n\n{b}", 7), (2, f"{a}!\nnew here", 8), (3, f"{b}\n{a}", 9), (4, None, 1), (5, "", 2), (6, " \n", 3)]
    got = sorted(tuple(r) for r in L.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, _x int")).collect())
    assert got == [(1, f"{a}\n\n{b}", 7), (2, "new here", 8), (4, None, 1), (5, "", 2), (6, " \n", 3)]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.deduplicated_lines(empty).collect() == [] and L.without_repeats(empty).collect() == []


@pytest.mark.parametrize("edits", [0, 1, 2, 5])
def test_banded_distance(edits):
    r = random.Random(edits)
    a, b = [], []
    for _ in range(1500):
        x = [r.choice("abc𝄞") for _ in range(r.randint(0, 24))]
        y = list(x)
        for _ in range(r.randint(0, edits + 2)):
            k = r.randint(0, len(y))
            y[k : k + r.randint(0, 1)] = r.choice([[], ["a"], ["b"]])
        a.append("".join(x))
        b.append("".join(y))
    a += ["x" * 300, "x" * 300 + "y", "p" * 9]
    b += ["x" * 299 + "z", "w" + "x" * 300, "q" * 9]
    assert L.within_edits(a, b, edits).tolist() == [edit_distance(x, y) <= edits for x, y in zip(a, b)]
