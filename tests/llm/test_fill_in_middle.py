"""Outputs and restored texts against a version on single strings."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netsluice.llm import byte_arrays
from netsluice.llm import fill_in_middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    "", " ", "\n\t ", "one", " one", "one ", "one two  three\n\nfour ", "Größe über alles — naïve 日本語 😀 x", "a <P> b", "<S>", "x<M", "<M",
    "P> and <S", "a\x1cb\x85c", "<", "<P", ">", "word " * 5000, " wide space", "same text", "same text", "<<S> no", "a\x00b \x0b c",
]


def brute(doc_id, text, seed=42):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows():
    # every text under many ids, so that it meets every form
    out = [(100 * i + k, t) for i, t in enumerate(TEXTS) for k in range(25)]
    return out + [(None, "no id here"), (7, None), (7, None), (-5, "negative id words")]


def test_against_single_strings(spark):
    df = spark.createDataFrame([(i, t, "n", 1, "x") for i, t in rows()], "doc_id long, text string, form string, h1 int, output string")
    want = [brute(i, t) for i, t in rows()]
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    made = fim.transformed(df)
    assert sorted((tuple(r) for r in made.collect()), key=str) == sorted(want, key=str)
    back = sorted((r.restored for r in fim.restored(made).collect()))
    assert back == sorted(t or "" for _, t in rows())
    got = sorted((tuple(r) for r in fim.digests(df).collect()), key=str)
    assert got == sorted(((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows())), key=str)


def test_empty_table(spark):
    assert fim.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_text_alone(spark):
    text = "wörter und mehr \n" * 400_000
    assert len(text.encode()) > byte_arrays.BLOCK_BYTES
    data = [(i, t) for i in range(3) for t in (text, "short one")]
    got = sorted((tuple(r) for r in fim.digests(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=str)
    want = [(*(w := brute(i, t))[:5], sha(w[5]), sha(t)) for i, t in data]
    assert got == sorted(want, key=str)


piece = st.text(alphabet="<PSM> a\né😀", max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(piece, st.integers(0, 20), st.integers(0, 20), st.sampled_from([0, 1, 2])), max_size=8))
def test_scatter_and_gather(cases):
    texts = [t.encode() for t, *_ in cases]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    held = fim.holds_mark(raw, at)
    assert held.tolist() == [any(m in t for m in fim.MARKS) for t in texts]
    form = np.array([0 if h else f for (*_, f), h in zip(cases, held)], np.int64)
    cuts = [sorted((min(a, len(t)), min(b, len(t)))) for t, (_, a, b, _) in zip(texts, cases)]
    first, second = (at[:-1] + np.array([c[k] for c in cuts], np.int64) for k in (0, 1))
    out, out_at = fim.scatter(raw, at, first, second, form)
    for i, (t, (a, b)) in enumerate(zip(texts, cuts)):
        p, m, s = t[:a], t[a:b], t[b:]
        want = {0: t, 1: b"<P>" + p + b"<S>" + s + b"<M>" + m, 2: b"<S>" + s + b"<P>" + p + b"<M>" + m}[int(form[i])]
        assert out[out_at[i] : out_at[i + 1]].tobytes() == want
    again, again_at = fim.gather(out, out_at, form)
    assert again.tobytes() == raw.tobytes() and again_at.tolist() == at.tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_tokens(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    ends, before = fim.token_ends(raw, np.array([0, len(raw)]))
    want = np.cumsum([len(t.encode()) for t in TOKEN.findall(text)]).tolist()
    assert ends.tolist() == want and before.tolist() == [0, len(want)]
